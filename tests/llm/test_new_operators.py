"""The filter audit, the set join and the divergence audit against brute force, and the cases that each docstring defines."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import divergence, filter_audit, setjoin

DOC = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, fails int, words string"
LABEL = "doc_id long, quality int, toxic int, part string"


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""), "x", "y", 1, "z")


def prose(rng, n, vocabulary=None):
    return " ".join(rng.choice(vocabulary) if vocabulary else f"w{rng.randrange(10**6)}" for _ in range(n))


# --- 11 -----------------------------------------------------------------------------------------------------------


def audit_by_hand(rows, labels):
    first, good, toxic = {}, defaultdict(bool), defaultdict(bool)
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    for i, q, t, *_ in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    docs = []
    for i, text, _, source, *_ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > first.get(t, i),
        }
        docs.append((source or "", {k for k, v in fails.items() if v}, i is not None and good[i], i is not None and toxic[i]))
    out, earned = [], Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                earned[part, f] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in d[1] for d in mine) - len(gone), sum(d[1] == {f} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*r, earned[r[0], r[1][r[2] - 1]]) for r in out)


def test_filter_audit_by_hand(spark):
    rng = random.Random(2)
    long = [prose(rng, 60) for _ in range(4)]
    texts = [None, "", "a b", "A B C", *long, long[0], long[0].upper(), long[1] + " #", "same " * 70, "same " * 70 + "$", prose(rng, 60) + " É ß 語", "x " * 40_000, long[0]]
    rows = [row(i, t, source=("a", "b", None, "")[i % 4]) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], row(None, long[0]), row(None, "short"), row(2, "other text of one id")]
    labels = [(0, 1, 0, "q"), (4, 1, 1, "q"), (4, 0, 0, "q"), (8, None, 1, "q"), (9, 1, None, "q"), (None, 1, 1, "q"), (99, 1, 1, "q")]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    got = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, LABEL)))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    assert sorted(tuple(r) for r in got.collect()) == audit_by_hand(rows, labels)
    none = spark.createDataFrame([], DOC)
    assert filter_audit.audit(filter_audit.failures(none, spark.createDataFrame([], LABEL))).count() == 0
    lone = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame([], LABEL)))
    assert lone.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_filter_audit_hands_on_parts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 2)
    rows = [("p%d" % (i % 7), i % 32, i % 2 == 0, i % 3 == 0) for i in range(500)]
    failed = spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean").repartition(5)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(failed).collect()}
    assert len(got) == 7 * 600
    for part in ("p0", "p3"):
        mine = [r for r in rows if r[0] == part]
        assert got[part, "ABCDE", 5].kept == sum(r[1] == 0 for r in mine)
        assert got[part, "ABCDE", 1].removed == sum(r[1] & 1 for r in mine)
        assert got[part, "EABCD", 2].good_lost == sum(r[1] & 1 and not r[1] & 16 and r[2] for r in mine)


# --- 12 -----------------------------------------------------------------------------------------------------------


def shingle_set(text):
    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def join_by_hand(rows):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 90 * (len(a) + len(sets[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(top(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randrange(most + 1)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], [f"v{rng.randrange(10**5)}"], [w[at], "more"]))
        out.append(" ".join(w))
    return out


def edge_pairs():
    """Texts at the threshold: sets of 19 with 18 in common (linked), and of 18 with 17 (not)."""
    a = [f"e{i}" for i in range(21)]
    b = [f"f{i}" for i in range(20)]
    return [" ".join(a), " ".join([*a[:-1], "other"]), " ".join(b), " ".join([*b[:-1], "other"])]


@pytest.mark.parametrize(("seed", "heavy", "often"), [(1, 1_000_000, 32), (2, 1_000_000, 2), (3, 50, 2), (4, 0, 2)])
def test_set_join_by_hand(spark, monkeypatch, seed, heavy, often):
    monkeypatch.setattr(setjoin, "HEAVY", heavy)
    monkeypatch.setattr(setjoin, "FREQUENT", often)
    monkeypatch.setattr(setjoin, "WINDOW", 1 << 14)
    rng = random.Random(seed)
    base, passage = prose(rng, 150), prose(rng, 60)
    texts = [None, "", " \n", "one", "ONE", "two words", "two  WORDS", "a b c", *edge_pairs(), base, base.upper(), base.upper() + ".", "x " * 4000, prose(rng, 3000)]
    texts += family(rng, base, 60, 6) + family(rng, prose(rng, 90), 60, 4) + [f"{prose(rng, 15)} {passage} {prose(rng, 15)}" for _ in range(20)]
    texts += [prose(rng, rng.randrange(3, 60), ["p", "q", "r"]) for _ in range(40)]
    chain = base.split()
    for k in range(0, 60, 3):  # each links to the next, the ends don't
        chain[k] = f"c{k}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], row(None, base), row(None, "alone without id"), row(3, "second text of an id")]
    got = setjoin.groups(spark.createDataFrame(rows, DOC).repartition(4))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == join_by_hand(rows)


def test_set_join_of_nothing(spark):
    assert setjoin.groups(spark.createDataFrame([], DOC)).count() == 0
    assert [tuple(r) for r in setjoin.groups(spark.createDataFrame([row(5, None)], DOC)).collect()] == [(5, 0, 5)]


def test_answers_derived_from_leaders(spark):
    """Members of two groups whose leaders don't link, by their differences alone."""
    rng = random.Random(9)
    base = prose(rng, 200).split()
    near = lambda at: " ".join(w if i not in at else f"n{i}" for i, w in enumerate(base))
    texts = [near(()), near((10,)), near((10, 30)), near((10, 30, 50)), near((10, 30, 50, 70)), near((10, 30, 50, 70, 90)), near((10, 30, 50, 70, 90, 110)), near((10, 30, 50, 70, 90, 110, 130))]
    texts += family(rng, texts[-1], 20, 3) + family(rng, texts[0], 20, 3)
    rows = [row(i, t) for i, t in enumerate(texts)]
    got = setjoin.groups(spark.createDataFrame(rows, DOC))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == join_by_hand(rows)


# --- 13 -----------------------------------------------------------------------------------------------------------


def divergence_by_hand(rows, least=10, top=10):
    docs = [((r[2] or ""), (r[3] or ""), [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[1] or "")]) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t, n in df.items() if n >= least]
        whole = Counter(t for d in mine for t in d[2])
        count = defaultdict(Counter)
        for _, s, terms in mine:
            count[s].update(terms)

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t])[:top]
            for part, ranked in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("block", "vectors"), [(128, 20_000), (2, 7), (1, 3)])
def test_divergence_by_hand(spark, block, vectors):
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "Äpfel", "äpfel", "語", "a1b", "x-y", "don't", "naïve", "É", "rare", *[f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]]
    rows = [row(i, prose(rng, rng.randrange(0, 80), vocabulary[: rng.randrange(5, 70)]), rng.choice(("en", "de", None, "")), rng.choice(("a", "b", "c", None, "é", "z"))) for i in range(120)]
    rows += [row(500, None), row(501, "123 !!", "fr", "lone"), row(502, "too few", "xx", "a"), row(503, "too few", "xx", "b"), row(504, "the " * 30_000, "en", "a"), rows[3], rows[3]]
    got = divergence.audit(spark.createDataFrame(rows, DOC).repartition(3), block=block, vectors=vectors)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence_by_hand(rows)
    assert divergence.audit(spark.createDataFrame([], DOC)).count() == 0


def test_shares_are_exact():
    import numpy as np

    for count, words, terms in ((0, 0, 1), (5, 17, 3), (10**12 + 7, 3 * 10**13 + 1, 10**9), (9 * 10**13 - 3, 9 * 10**13, 10**6)):
        want = 1 + 10**9 * (count + 2) // (words + 2 * terms)
        got = divergence.share(np.array([count]), np.array([words]), np.array([terms]), np.floor_divide)[0]
        assert (int(got), divergence.share(count, words, terms, lambda a, b: a // b)) == (want, want)
