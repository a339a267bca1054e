"""Scanning, findings and inventory on small tables of our own."""

import base64
import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from sievework.functions import classify, schedule, text, versions
from sievework.operators import findings, inventory, matching, rows, runs, taint, vulnerability
from sievework.plans import scan, snapshots
from sievework.sources import files, pack
from sievework.streaming import watch
from tests import sequential

PACK = pack.Pack(
    version=3,
    signatures=[(0, "h", "Hash", "known", "infected"), (1, "l", "Literal", "shell", "infected"), (2, "r", "Regex", "odd", "suspicious"), (3, "f", "First", "head", "info")],
    literals=[(0, 0, 1, "file_php", "evil_call(")],
    regexes=[(0, 2, "/odd[0-9]+/", False, [], ["file_any"]), (1, 3, "/first\\s+line/i", True, [], ["file_any"])],
    hashes=[("md5", "5d41402abc4b2a76b9719d911017c592", 0)],
)


def one(df):
    (row,) = df.collect()
    return row


def test_versions(spark):
    pairs = [("1.0", "1.0.0"), ("1.0.beta", "1.0"), ("1.9", "1.10"), ("5.9.3.beta", "5.9.3rc2"), ("1.0rc1", "1.0"), ("1.0", "1.0p1"), ("1.0-dev", "1.0-alpha"), ("1.0alpha", "1.0b1")]
    df = spark.createDataFrame(pairs, "a string, b string")
    k = lambda c: versions.version_key(versions.normal_version(F.col(c)))
    assert all(r.ok for r in df.select((k("a") < k("b")).alias("ok")).collect())


@pytest.mark.parametrize("version,low,high,low_in,high_in,want", [
    ("1.2", "1.0", "1.2", True, True, True), ("1.2", "1.0", "1.2", True, False, False), ("1.0", "1.0", "2", False, True, False), ("0.1", "*", "1", True, True, True), ("9", "1", "*", None, None, True), ("1.2-3", "1.2.2", "1.2.4", True, True, True),
])
def test_ranges(spark, version, low, high, low_in, high_in, want):
    df = spark.createDataFrame([(version, low, high, low_in, high_in)], "v string, lo string, hi string, li boolean, hi_in boolean")
    assert one(df.select(versions.in_range(*[F.col(c) for c in df.columns]).alias("x"))).x is want


def test_vulnerability_findings(spark):
    records = [{"id": "A", "title": "First", "software": [{"type": "plugin", "slug": "x", "name": "X", "patched": True, "patched_versions": ["2.0"], "affected_versions": {"*": {"from_version": "*", "to_version": "1.9", "to_inclusive": True}}}]},
               {"id": "B", "title": "Note", "informational": True, "software": [{"type": "plugin", "slug": "x", "affected_versions": {"*": {"from_version": "*", "to_version": "*"}}}]}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "j string").select(F.from_json("j", vulnerability.RECORD).alias("r")).select("r.*")
    software = spark.createDataFrame([("plugin", "x", "1.5"), ("plugin", "x2", "1.5"), ("plugin", "x", "2.0")], "kind string, slug string, version string")
    f = one(vulnerability.findings(vulnerability.matches(software, df)))
    assert (f.locator, f.tier, f.severity, f.fixed_in, f.reason) == ("plugin:x", "infected", "alert", "2.0", "First")


def test_kinds(spark):
    cases = [(b"PK\x03\x04zip", "zip", "archive"), (b"PK\x03\x04zip", "php", "php"), (b"x <?PHP echo", "txt", "php"), (b"\x7fELF..", "", "binary"), (b"<!DOCTYPE html>", "", "html"), (b"var a;", "js", "js"), (b"", "php", "php"),
             (b"\x00\x01\x02abc", "dat", "binary"), (b"plain", "txt", "other"), (base64.b64encode(b"<?php eval($_POST['x']); // padding padding padding padding"), "txt", "php"), (b"a" * 257 + b"ustar", "", "archive"), (b"\xff\xfe\xe9", "", "other")]
    df = spark.createDataFrame([(i, bytearray(c), e) for i, (c, e, _) in enumerate(cases)], "i int, c binary, e string")
    got = {r.i: r.k for r in df.select("i", classify.content_kind(classify.head_of(F.col("c")), F.col("e")).alias("k")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, _, w in cases]


def test_text_functions(spark):
    df = spark.createDataFrame([("ab\ncd\x01évil", "a/b.PhP", "aaaa", "TpAEMU")], "t string, p string, e string, r string")
    r = one(df.select(text.line_of(F.col("t"), F.lit(4)).alias("line"), text.excerpt(F.col("t"), F.lit(1)).alias("x"), text.extension(F.col("p")).alias("ext"), text.entropy(F.col("e")).alias("h"), text.case_transitions(F.col("r")).alias("c")))
    assert (r.line, r.x, r.ext, r.h, r.c) == (2, "ab\ncd??vil", "php", 0.0, 2)


@pytest.mark.parametrize("glob,path,hit", [("cache/*", "cache/a/b.txt", True), ("*.LOG", "x/y.log", True), ("build", "build/x", True), ("build", "builds/x", False), ("a?c", "abc", True), ("[!a]x", "bx", True)])
def test_globs(spark, glob, path, hit):
    df = spark.createDataFrame([(path,)], "path string")
    assert one(df.select(files.included(F.col("path"), [glob]).alias("k"))).k is not hit


@pytest.mark.parametrize("n", [0, 9, 10, 11, 16, 17, 40])
def test_chunks_cover(spark, n):
    body = bytes(range(65, 65 + n))
    df = spark.createDataFrame([("p", bytearray(body))], "path string, content binary")
    got = files.chunks(df, 10, 3).orderBy("chunk").collect()
    assert b"".join(r.text.encode("latin-1")[: 7 if not r.last else None] for r in got) == body
    assert got[0].first and got[-1].last and sum(r.last for r in got) == 1


MATCH = ("path", "layer", "position", "sig", "pos", "line", "excerpt")


def matched_as_in_sequence(spark, root, bodies, mine):
    """The engine's matches below ``root``, which must be those of a sequential scan; hash matches come first in both."""
    for name, body in bodies.items():
        (root / name).write_bytes(body)
    data = scan.classified(files.contents(spark, f"file://{root}"), [], None)
    targets = {r.path: set(r.t) for r in data.filter("kind NOT IN ('binary', 'archive')").select("path", matching.targets_of(F.col("path"), F.col("kind")).alias("t")).collect()}
    got = scan.match(data, mine)
    hashed = {r.path: r.n for r in got.filter("layer = 0 AND tier = 'infected'").groupBy("path").agg(F.count("*").alias("n")).collect()}
    rows_ = sorted(tuple(r) for r in got.filter("layer > 0").select(*MATCH).collect())
    assert rows_ == sequential.scan_all({k: bodies[k] for k in targets}, targets, mine, hashed)
    return rows_


def test_joins_agree_with_a_sequential_scan(spark, tmp_path):
    bodies = {"a.php": b"<?php\nevil_call(1); odd12 First  line", "b.txt": b"odd7\nfirst line", "c.php": b"<?php odd", "d.html": b"<html>\n\nodd5", "e.bin": b"\x00\x01\x02\x03"}
    got = matched_as_in_sequence(spark, tmp_path, bodies, PACK)
    assert {r[0] for r in got} == {"a.php", "b.txt", "d.html"}
    assert not any(r[0] == "a.php" and r[3] == 2 for r in got)  # suspicious after infected


@pytest.mark.parametrize("needed", [[], [1]])
def test_matcher_is_chosen_by_pattern(spark, tmp_path, needed):
    mine = pack.Pack(
        version=3, signatures=[*PACK.signatures, (4, "x", "Unportable", "odd", "infected"), (5, "y", "Unportable too", "odd", "suspicious")], literals=[*PACK.literals, (1, 1, 3, "file_any", "tail word")],
        regexes=[PACK.regexes[0], (1, 4, "/(ba|d)*blob/", False, needed, ["file_any"]), (2, 2, "/odd[a-z]+/", False, [], ["file_any"]), (3, 5, "/(x|y)*worse/", False, needed, ["file_any"])], hashes=PACK.hashes,
    )
    parts = ["odd12 ", "badblob\n", "oddly ", "xyworse ", "tail word\n", "evil_call( "]
    bodies = {f"{n}.php": ("<?php " + "".join(p for i, p in enumerate(parts) if n >> i & 1)).encode() for n in range(1 << len(parts))}
    got = matched_as_in_sequence(spark, tmp_path, {**bodies, "hash.txt": b"hello", "apart.php": b"<?php tail of word badblob"}, mine)
    assert {r[3] for r in got} == {1, 2, 3, 4, 5}
    assert not needed or not any(r[0] == "apart.php" and r[3] == 4 for r in got)  # both words, but not the literal


def test_files_of_many_chunks(spark, tmp_path):
    """Matches in overlaps, the quota over chunks, rules for first chunks, and literals that only regular expressions need."""
    sigs = [(0, "l", "L", "c", "infected"), (1, "r", "R", "c", "suspicious"), (2, "f", "F", "c", "info"), (3, "i", "I", "c", "infected"), (4, "k", "K", "c", "info")]
    mine = pack.Pack(
        version=1, signatures=sigs, literals=[(0, 0, 0, "file_any", "evil_call(")], texts=[(0, "evil_call("), (1, "needle")],
        regexes=[(0, 1, "/odd[0-9]+/", False, [], ["file_any"]), (1, 2, "/head[a-z]/", True, [], ["file_any"]), (2, 3, "/bad[0-9]{2}/", False, [], ["file_any"]), (3, 4, "/x\\Kneedle\\h/", False, [1], ["file_any"])],
    )
    step = files.CHUNK - files.OVERLAP
    fill = lambda n: (b"\xe9" + b"." * 98 + b"\n") * (n // 100) + b"." * (n % 100)

    def body(at):
        out = bytearray(fill(3 * step + 5000))
        for place, word in at:
            out[place : place + len(word)] = word
        return bytes(out)

    bodies = {
        "overlap.txt": body([(step + 10, b"odd11 "), (step + 50, b"headz"), (2 * step + 70_000, b"odd12 "), (3 * step + 100, b"xneedle ")]),
        "late.txt": body([(2 * step + 5, b"evil_call("), (step + 5, b"odd1 "), (3 * step + 4000, b"odd2 ")]),
        "quota.txt": body([(k * step + 70_000, b"bad%02d evil_call(" % k) for k in range(3)] + [(10, b"heada")]),
        "small.php": b"<?php xneedle\t evil_call( odd1",
    }
    for quota in (10, 3, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(matching.suppress, "__defaults__", (quota, "path"))
            m.setattr(sequential.Sequential.__init__, "__defaults__", (files.CHUNK, files.OVERLAP, quota))
            got = matched_as_in_sequence(spark, tmp_path, bodies, mine)
    assert {r[3] for r in got} >= {0, 1, 2, 4}


def test_literals_are_found_inside_longer_words(spark, tmp_path):
    """Literals at the edge of a word, inside one, without words; and presence by a pack's own words."""
    texts = ["eval(base", "b64_dec", ";$x", "then the end", "_call(", "(abc", "zz9"]
    sigs = [(i, f"s{i}", "S", "c", "info") for i in range(8)]
    mine = pack.Pack(
        version=1, signatures=sigs, literals=[(i, i, i, "file_any", t) for i, t in enumerate(texts)], regexes=[(i, 7, "/[a-z]/", False, [i], ["file_any"]) for i in range(7)],
        words=[("eval", 0), ("base", 0), ("b64_dec", 1), ("then", 3), ("end", 3), ("zz9", 6)], pure=[1, 6], always=[2],
    )
    parts = ["xeval(base64", "my_B64_decode", "b64_dec eval", ";$xy", "Then the end", "athen the end base", "evil_call(", "(abcd then", "qzz9 end", "zz9"]
    bodies = {f"{n}.txt": " ".join(p for i, p in enumerate(parts) if n >> i & 1).encode() for n in range(0, 1 << len(parts), 7)}
    got = matched_as_in_sequence(spark, tmp_path, bodies, mine)
    assert {r[3] for r in got} == set(range(8))


def test_unreadable_patterns_are_left_out_and_counted(spark, tmp_path):
    regexes = [(0, 2, "/(?R)x/", False, [], ["file_any"]), (1, 2, "/a++b/", False, [], ["file_any"]), (2, 3, "/[[:alpha:]]+7/", False, [], ["file_any"]), (3, 3, "/(/", False, [], ["file_any"]), (4, 3, "/é./u", False, [], ["file_any"])]
    mine = pack.Pack(version=1, signatures=PACK.signatures, regexes=regexes)
    assert mine.unread() == ["/(?R)x/", "/(/"]
    (tmp_path / "site").mkdir()
    (tmp_path / "site/a.php").write_bytes(b"<?php aab zz7")
    (tmp_path / "site/b.php").write_bytes(b"<?php \xff")
    out = scan.scan(spark, f"file://{tmp_path}/site", mine, f"file://{tmp_path}/state")
    assert {(r.locator, tuple(r.signature_ids)) for r in out.findings.collect()} == {("a.php", ("r", "f"))}
    assert {r.path: r.pattern_errors for r in out.files.collect()} == {"a.php": 0, "b.php": 1}
    last = out.runs.collect()[0]
    assert (last.unread_patterns, last.counts["pattern_errors"], last.counts["matched"], last.counts["new"]) == (2, 1, 2, 1)


@pytest.mark.parametrize(("pattern", "data", "at"), [
    (r"/a\hb/", b"xa\tb", 2), (r"/[^[:alpha:]]+/", b"ab1", 3), (r"/[[:^digit:]]/", b"12a", 3), (r"/\Qa.b\E+/", b"a.bbb", 1), (r"/foo\Kbar/", b"xfoobar", 5), (r"/(?|a(x)|b(y))/", b"by", 1),
    (r"/a(?i)b|c/", b"zC", 2), (r"/(x(?i)y)z/", b"xYZ", 0), (r"/a$/D", b"a\n", 0), (r"/b\z/", b"b\n", 0), (r"/b\Z/", b"b\n", 1), (r"/b/A", b"ab", 0), (r"/(?<n>a)\k<n>/", b"baa", 2), (r"/\Rx/", b"\r\nx", 1), (r"/./u", b"\xff", -1),
])
def test_patterns_mean_what_they_say(pattern, data, at):
    assert pack.first_match(pack.byte_pattern(pattern), data) == at


def test_large_packs_reach_few_rules_a_chunk(spark):
    """Thousands of generated patterns through the inverted index, against each pattern tried on each text."""
    import random
    import re

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    words = [word() for _ in range(3000)]
    regexes = [(i, i % 3, f"/{words[i]}[a-h ]{{0,3}}{words[-i]}/", False, [i, (i + 7) % 3000], ["file_any"]) for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(30)]
    chunk = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumns({"chunk": F.lit(0), "first": F.lit(True), "line_base": F.lit(0), "targets": F.array(F.lit("file_any"))})
    literals = spark.createDataFrame(list(enumerate(words)), "lit int, text string")
    key = ("id", "chunk")
    found = matching.located(chunk, literals, matching.candidates(chunk, literals, key), key)
    assert {(r.id, r.lit, r.pos) for r in found.collect()} == {(i, k, t.find(w) + 1) for i, t in enumerate(texts) for k, w in enumerate(words) if w in t.split()}
    got = {(r.id, r.position, r.pos) for r in matching.regex_matches(chunk, regexes, found.select(*key, "lit"), key).collect()}
    want = {(i, r[0], m.start() + 1) for i, t in enumerate(texts) for r in regexes if all(words[x] in t.split() for x in r[4]) and (m := re.search(r[2][1:-1], t))}
    assert got == want and want


def test_rows_of_chunks_are_never_marked_for_broadcast(spark):
    """what grows with the chunks (their literals, their rules) is not marked for broadcast, however few rows it has."""
    chunk = spark.createDataFrame([(i, f"alpha{i} beta gamma") for i in range(20)], "id int, text string").withColumns({"chunk": F.lit(0), "first": F.lit(True), "line_base": F.lit(0), "targets": F.array(F.lit("file_any"))})
    literals = spark.createDataFrame([(0, "alpha"), (1, "beta g")], "lit int, text string")
    key, regexes = ("id", "chunk"), [(0, 0, "/beta +g/", False, [0, 1], ["file_any"])]
    found = matching.located(chunk, literals, matching.possible(chunk, literals, key), key)
    hits = matching.regex_matches(chunk, regexes, found.select(*key, "lit"), key)
    for df in (found, hits):
        assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 40 and hits.count() == 20


def test_rules_led_by_their_beginning_match_as_by_presence(spark):
    """Plain patterns tried where their beginning stands, against the same patterns as Python finds them; others keep their way."""
    import random
    import re

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 15)))
    tails = [" +[a-c]+", "", "[ab]{2,3}c?", ",? x", r"\. [a-d]*b", "a+b"]
    bodies = sorted({word() + rng.choice(tails) for _ in range(300)}) + ["(abc|bcd) ", "ab|cd", "abcd*", "ab", r"\babcd"]
    regexes = [(i, i % 3, f"/{b}/", i % 7 == 0, [i], [("file_any", "file_js")[i % 5 == 0]]) for i, b in enumerate(bodies)]
    texts = [rng.choice([" ", ". ", ", ", "\n", "😀"]).join(word() for _ in range(400)) for _ in range(40)]
    rows = [(i, i % 2, i % 2 == 0, t, ["file_any"] if i % 3 else ["file_js", "file_any"]) for i, t in enumerate(texts)]
    chunk = spark.createDataFrame(rows, "id int, chunk int, first boolean, text string, targets array<string>").withColumn("line_base", F.lit(0))
    got = {(r.id, r.position, r.pos, r.line) for r in matching.regex_matches(chunk, regexes, None, ("id", "chunk")).collect()}
    want = {(i, r[0], m.start() + 1, t.count("\n", 0, m.start()) + 1) for i, _, first, t, targets in rows for r in regexes if r[5][0] in targets and (first or not r[3]) and (m := re.search(bodies[r[0]], t))}
    assert got == want and len({x[1] for x in want}) > 50
    assert matching.leading("/abcd*x/") == ("abc", "d*x") and not any(map(matching.leading, ("/ab|cd/", "/(abc)/", "/abc/i", "/ab*/", "/abc.x/", "/abc\\d/", "/abc[^a]/", "/abcd$/")))


def test_chunked_scan_equals_whole():
    body = b"".join(b"x" * 37 + (b"odd%d" % i if i % 3 == 0 else b"evil_call(") + b"\n" for i in range(60))
    whole = sequential.Sequential(PACK, 1 << 20, 1 << 10, quota=10**6).scan(body, {"file_any"})
    small = sequential.Sequential(PACK, 300, 60, quota=10**6).scan(body, {"file_any"})
    assert whole[0][3:] == small[0][3:] and len({m[4] for m in small}) == len(small)
    for m in small:
        assert m[5] == body.count(b"\n", 0, m[4]) + 1


def test_scan_is_incremental_and_idempotent(spark, tmp_path):
    root, state = tmp_path / "site", f"file://{tmp_path}/state"
    root.mkdir()
    (root / "a.php").write_bytes(b"<?php evil_call(1);")
    (root / "b.txt").write_bytes(b"hello")
    first = scan.scan(spark, f"file://{root}", PACK, state)
    got = {r.locator: r for r in first.findings.collect()}
    assert set(got) == {"a.php", "b.txt"} and got["a.php"].severity == "alert" and got["b.txt"].signature_ids == ["h"]
    second = scan.scan(spark, f"file://{root}", PACK, state)
    again = {r.locator: r for r in second.findings.collect()}
    assert {k: (v.tier, v.state, v.first_seen) for k, v in again.items()} == {k: (v.tier, v.state, v.first_seen) for k, v in got.items()}
    (root / "a.php").write_bytes(b"<?php fine();")
    (root / "b.txt").unlink()
    third = scan.scan(spark, f"file://{root}", PACK, state, scope="changed")
    assert third.findings.count() == 0 and third.files.count() == 1 and snapshots.current(spark, state)["version"] == 3


def test_watch_mode(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "a.php").write_bytes(b"<?php evil_call(1);")
    q = watch.watch(spark, f"file://{root}", PACK, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination(120)
    assert spark.read.parquet(f"file://{tmp_path}/out").select("path").collect()[0].path == "a.php"


def test_findings_merge_cases(spark):
    schema = "locator_hash string, type string, locator string, signature_ids array<string>, tier string, severity string, category string, line int, excerpt string, reason string, first_seen long, last_seen long, state string, state_changed_at long"
    row = lambda k, ids, tier, sev, state: (k, "file", k, ids, tier, sev, "c", 1, "", "r", 1, 1, state, 0)
    old = spark.createDataFrame([row("up", ["a"], "suspicious", "review", "new"), row("down", ["a"], "infected", "alert", "new"), row("ign", ["a"], "info", "review", "ignored"), row("ack", ["a"], "info", "review", "acknowledged"), row("same", ["a"], "info", "review", "ignored")], schema)
    new = spark.createDataFrame([row("up", ["a"], "infected", "alert", "new"), row("down", ["b"], "suspicious", "review", "new"), row("ign", ["a", "b"], "info", "review", "new"), row("ack", ["z"], "info", "review", "new"), row("same", ["a"], "info", "review", "new")], schema)
    got = {r.locator_hash: r for r in findings.merge(old, new, F.lit(9).cast("long")).collect()}
    assert (got["up"].tier, got["up"].severity, got["up"].change) == ("infected", "alert", "changed")
    assert (got["down"].tier, got["down"].severity, got["down"].signature_ids) == ("infected", "alert", ["a", "b"])
    assert (got["ign"].state, got["ign"].state_changed_at, got["ack"].state, got["same"].state, got["same"].change) == ("new", 9, "acknowledged", "ignored", "seen")
    assert all(r.first_seen == 1 and r.last_seen == 9 for r in got.values())


def test_deletions(spark):
    f = spark.createDataFrame([("1", "file"), ("2", "vulnerability"), ("3", "vulnerability")], "locator_hash string, type string")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "locator_hash string")
    left = lambda df: sorted(r.locator_hash for r in df.collect())
    assert left(findings.only_listed(f, keys("3"), "vulnerability")) == ["1", "3"] and left(findings.only_listed(f, keys(), "vulnerability")) == ["1"]
    assert left(findings.without(f, keys("1", "2"), kind="file")) == ["2", "3"]


def test_like_prefilter(spark):
    df = spark.createDataFrame([("100%",), ("100x",), (None,)], "c string")
    n = lambda rules: df.filter(rows.like_prefilter(rules, ["c"])).count()
    like = f"%{rows.like_literal('0%')}%"
    assert n([("t", 0, "/x/", like)]) == 1 and n([("t", 0, "/x/", None)]) == 3 and n([]) == 0


def test_java_patterns():
    assert pack.java_pattern("/ab+c/i") == "(?di)ab+c"
    assert all(pack.java_pattern(p) is None for p in ("/(a|b)*c/", "/[[:alpha:]]/", "/a\\Kb/", "/(?R)/", "/x/u"))
    assert pack.byte_pattern("/a$/").search(b"a\n") and not pack.byte_pattern("/a$/D").search(b"a\n") and pack.byte_pattern("~\\xe9~").search(b"\xe9")


def encoded_pack(tmp_path):
    u32 = lambda *v: base64.b64encode(struct.pack(f"<{len(v)}I", *v)).decode()
    data = {
        "format": 1, "version": 7, "count": 2, "sig_tier": base64.b64encode(bytes([1, 2])).decode(), "regex_patterns": "/a+//b/i", "regex_offsets": u32(0, 4, 8), "regex_sigs": u32(0, 1), "regex_flags": base64.b64encode(bytes([0, 1])).decode(),
        "regex_lits": u32(0), "regex_lit_offsets": u32(0, 1, 1), "literal_strings": "foo bar", "literal_offsets": u32(0, 7), "wordless_literals": u32(), "targets": {"file_any": u32(0, 1)}, "plain_literals": [[0, 1, "file_any"]],
        "hash": {"md5": {"aa": 0}, "sha256": {}}, "db": {"db_post": [[1, "/x/", None]]}, "allowlist": {"bb": 1}, "words": {}, "literal_word_counts": "", "literal_pure": "",
    }
    at = tmp_path / "pack.json"
    at.write_text(json.dumps(data))
    return at


def test_load_pack(spark, tmp_path):
    p = pack.load_pack(str(encoded_pack(tmp_path)), version=7)
    assert p.regexes == [(0, 0, "/a+/", False, [0], ["file_any"]), (1, 1, "/b/i", True, [], ["file_any"])] and p.literals[0][4] == "foo bar" and p.row_rules == [("db_post", 1, "/x/", None)]
    assert p.frames(spark)["signature"].count() == 2
    with pytest.raises(pack.PackError):
        pack.load_pack(str(encoded_pack(tmp_path)), sha256="0" * 64)
    with pytest.raises(pack.PackError):
        pack.load_pack(str(encoded_pack(tmp_path)), version=8)


def test_schedule_and_verdicts(spark):
    df = spark.createDataFrame([(1,)], "x int").select(F.timestamp_seconds(F.lit(1704159000)).alias("now"))  # 2024-01-02 01:30
    due = one(df.select(*[F.date_format(schedule.next_due(F.col("now"), F.lit(s), F.lit(3)), "dd HH:mm").alias(s) for s in ("hourly", "daily", "weekly", "off")]))
    assert (due.hourly, due.daily, due.weekly, due.off) == ("02 02:00", "02 03:00", "02 03:00", None)
    log = spark.createDataFrame([(i, s) for i, s in enumerate(["done", "failed", "done", "failed", "failed"])], "id int, status string")
    assert one(runs.failure_streak(log)).streak == 2
    assert one(runs.worst(spark.createDataFrame([("a", "ok"), ("b", "critical")], "name string, status string"))).verdict == "critical"


def test_inventory_queue_prefix_has_no_slash(spark):
    df = spark.createDataFrame([("a/b/x", False, 1, "m", "php"), ("a/bc", False, 1, "m", "php"), ("z", False, 1, "m", "php")], "path string, known_good boolean, scanned_bundle int, md5 string, kind string")
    assert sorted(r.path for r in inventory.queue(df, 2, "a/b").collect()) == ["a/b/x", "a/bc"]


def test_taint_chain(spark):
    code = "<?php $a = $_GET['q']; // $z = 1\n$b = $a . 'x;y'; $c = $b; /* exec($c); */ exec($c); call_user_func('f', $a); $o->exec($a); preg_replace('/x/e', $a, 1); preg_replace('/x/', $a, 1);"
    found = taint.findings(spark.createDataFrame([("p", code)], "path string, text string"))
    assert sorted(r.sink for r in found.collect()) == ["exec", "preg_replace"]


def test_command_line(spark, tmp_path, capsys):
    from sievework.__main__ import main

    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "x.php").write_bytes(b"<?php foo bar aaa")
    at, state = encoded_pack(tmp_path), f"file://{tmp_path}/state"
    assert main(["--state", state, "status"]) == 2
    assert main(["--state", state, "run", f"file://{tmp_path}/site", "--pack", str(at), "--scope", "full"]) == 1
    capsys.readouterr()
    assert main(["--state", state, "--format", "json", "findings", "--severity", "alert"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert (found["title"], found["detected_by"], found["state"]) == ("x.php", "signature", "new")
    assert main(["--state", state, "--format", "yaml", "findings"]) == 0
    assert '- locator_hash: "' in (said := capsys.readouterr().out) and '\n  title: "x.php"\n' in said
    assert main(["--state", state, "--format", "csv", "findings"]) == 0
    assert capsys.readouterr().out.splitlines()[0] == "locator_hash,severity,state,title,subtitle,detected_by,shown"
    assert main(["--state", state, "ignore", found["locator_hash"]]) == 0
    assert snapshots.load(spark, state, "findings").select("state").first().state == "ignored"


def test_command_line_takes_published_lists(spark, tmp_path, capsys):
    from sievework.__main__ import main

    site = tmp_path / "site" / "wp-content/plugins/p"
    site.mkdir(parents=True)
    (site / "a.php").write_text("<?php 1;")
    (site / "own.php").write_text("<?php 2;")
    (tmp_path / "sums").write_text("".join(json.dumps({"package": "plugin:p", "path": f, "md5": "0"}) + "\n" for f in ("a.php", "own.php")))
    (tmp_path / "own").write_text(json.dumps({"wp-content/plugins/p/own.php": hashlib.md5(b"<?php 2;").hexdigest()}))
    (tmp_path / "software").write_text(json.dumps({"kind": "plugin", "slug": "p", "version": "1.0"}))
    below = {"a": {"from_version": "*", "to_version": "1.5", "from_inclusive": True, "to_inclusive": True}}
    (tmp_path / "records").write_text(json.dumps({"id": "v1", "title": "Hole", "informational": False, "software": [{"type": "plugin", "slug": "p", "name": "p", "patched": True, "patched_versions": ["2"], "affected_versions": below}], "references": []}))
    at, state = encoded_pack(tmp_path), f"file://{tmp_path}/state"
    lists = [x for k in ("own", "software", "records") for x in (f"--{k}", f"file://{tmp_path}/{k}")]
    assert main(["--state", state, "run", f"file://{tmp_path}/site", "--pack", str(at), "--slug", "plugin:p", "--checksums", f"file://{tmp_path}/sums", *lists]) == 1
    found = {(r.type, r.locator) for r in snapshots.load(spark, state, "findings").collect()}
    assert found >= {("integrity", "wp-content/plugins/p/a.php"), ("vulnerability", "plugin:p")} and not any("own.php" in x for _, x in found)


def test_records(spark, tmp_path):
    from sievework.functions import present
    from sievework.sources import records

    (tmp_path / "sums.json").write_text('{"package": "core", "path": "a", "md5": "x"}\n{"package": "core", "path": "b", "md5": ["y", ""]}\n{"package": "core", "path": "c", "md5": []}\n')
    got = {r.path: r.md5s for r in records.checksums(spark, f"file://{tmp_path}/sums.json").collect()}
    assert got == {"a": ["x"], "b": ["y"]}
    rows_ = spark.createDataFrame([(100, "a"), (10, "b")], "fetched_at long, v string")
    assert [r.v for r in records.fresh(rows_, F.lit(150), 60).collect()] == ["a"]
    plugins = spark.createDataFrame([("x/y.php", "1", "X", True), ("solo.php", "2", "S", False)], "file string, version string, name string, active boolean")
    themes = spark.createDataFrame([("t", "3", "T", True)], "slug string, version string, name string, active boolean")
    assert sorted(r.slug for r in records.software("6.1", plugins, themes).collect()) == ["core", "solo", "t", "x"]
    log = spark.createDataFrame([(1, "done")], "id int, status string")
    assert runs.appended(log, {"id": 2, "status": "failed"}, 1).collect()[0].id == 2
    assert one(spark.createDataFrame([(["http://a", "https://b"],)], "u array<string>").select(present.record_link(F.col("u")).alias("x"))).x == "https://b"


def test_scan_reports_analysis_software_and_rows(spark, tmp_path):
    root, state = tmp_path / "site", f"file://{tmp_path}/state"
    (root / "wp-content/uploads").mkdir(parents=True)
    (root / "taint.php").write_bytes(b"<?php\n/* two\nlines */ $a = $_GET['q'];\nsystem($a);\n")
    (root / "wp-content/uploads/hid.php").write_bytes(b"<?php\n/* Plugin Name: x */\n")
    (root / "packed.php").write_bytes(b"<?php\n\necho base64_decode('" + base64.b64encode(b"evil_call(1)") + b"');")
    (root / "fine.php").write_bytes(b"<?php echo 1;")
    mine = pack.Pack(version=3, signatures=PACK.signatures, literals=PACK.literals, regexes=[*PACK.regexes, (2, 2, "/(ba|d)*blob/", False, [], ["file_any"])], row_rules=[("db_post", 1, "/bad[0-9]/", "%bad%"), ("db_post", 2, "/(x|y)*worse/", "%worse%")])
    (root / "packed2.php").write_bytes(b"<?php echo base64_decode('" + base64.b64encode(b"badblob") + b"');")
    software = spark.createDataFrame([("plugin", "p", "1.0"), ("plugin", "q", "9")], "kind string, slug string, version string")
    hit = lambda v: {"type": "plugin", "slug": v, "name": v, "patched": True, "patched_versions": ["2"], "affected_versions": {"a": {"from_version": "*", "to_version": "1.5", "from_inclusive": True, "to_inclusive": True}}}
    records = spark.createDataFrame([("v1", "Hole", False, [hit("p"), hit("q")], [])], vulnerability.RECORD)
    posts = spark.createDataFrame([(1, "bad1", "xworse"), (2, "fine", ""), (3, "bad", None)], "ID int, post_content string, post_excerpt string")
    table = scan.RowTable("db_post", "posts", posts, "ID", ("post_content", "post_excerpt"), F.concat(F.lit("post #"), F.col("ID").cast("string")))
    run = lambda s: {r.locator: r for r in scan.scan(spark, f"file://{root}", mine, state, software=s, records=records, tables=[table]).findings.collect()}
    got = run(software)
    assert set(got) == {"taint.php", "wp-content/uploads/hid.php", "packed.php", "packed2.php", "plugin:p", "posts:post_content:1", "posts:post_excerpt:1"}
    t = got["taint.php"]
    assert (t.signature_ids, t.tier, t.category, t.line, t.excerpt) == (["heur:source_sink"], "suspicious", "backdoor", 4, "system($a);") and "system" in t.reason
    assert got["wp-content/uploads/hid.php"].signature_ids == ["heur:disguise"] and got["packed.php"].signature_ids == ["l"] and got["packed2.php"].signature_ids == ["r"] and got["packed.php"].line == 3
    assert (got["plugin:p"].severity, got["plugin:p"].signature_ids) == ("alert", ["v1"]) and got["posts:post_content:1"].tier == "infected" and got["posts:post_excerpt:1"].signature_ids == ["r"]
    assert "plugin:p" not in run(spark.createDataFrame([("plugin", "p", "2.0")], software.schema))


def test_a_run_that_dies_leaves_the_version_before_it(spark, tmp_path, monkeypatch):
    from sievework.plans import snapshots

    root, one = str(tmp_path / "state"), lambda n: {"t": spark.range(n)}
    assert snapshots.current(spark, root) is None and snapshots.load(spark, root, "t") is None
    assert snapshots.commit(one(3), root, {}) == 1
    real = snapshots._path
    with monkeypatch.context() as m:  # the tables and the new pointer are written, the rename never comes

        def dies(spark, name):
            if name.endswith("CURRENT.2"):
                raise KeyboardInterrupt
            return real(spark, name)

        m.setattr(snapshots, "_path", dies)
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(one(9), root, {})
    assert snapshots.current(spark, root)["version"] == 1 and snapshots.load(spark, root, "t").count() == 3
    assert snapshots.commit(one(5), root, {}) == 2 and snapshots.load(spark, root, "t").count() == 5
    assert snapshots.load(spark, root, "other") is None


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    """A file whose size and time stay is neither read nor hashed; a new pack opens only what it has to match."""
    import os

    root, state = tmp_path / "site", f"file://{tmp_path}/state"
    root.mkdir()
    for name in ("a.php", "b.php", "odd [x]{y}*.php"):
        (root / name).write_bytes(b"<?php evil_call(1);")
    scan.scan(spark, f"file://{root}", PACK, state)
    asked = []
    real = files.contents_of

    def spy(spark_, root_, wanted, *rest):
        asked.append(sorted(r.path for r in wanted.select("path").collect()))
        return real(spark_, root_, wanted, *rest)

    monkeypatch.setattr(files, "contents_of", spy)
    monkeypatch.setattr(files, "contents", None)
    at = (root / "b.php").stat()
    (root / "b.php").write_bytes(b"<?php fine_call(1);")
    os.utime(root / "b.php", ns=(at.st_atime_ns, at.st_mtime_ns))
    out = scan.scan(spark, f"file://{root}", PACK, state, scope="changed")
    assert not any(asked) and {r.locator for r in out.findings.collect()} == {"a.php", "b.php", "odd [x]{y}*.php"}
    asked.clear()
    (root / "c.php").write_bytes(b"<?php odd1")
    out = scan.scan(spark, f"file://{root}", PACK, state, scope="changed")
    assert asked == [["c.php"], ["c.php"]] and out.findings.count() == 4
    asked.clear()
    out = scan.scan(spark, f"file://{root}", PACK, state, scope="path", prefix="odd")
    assert asked == [[], ["odd [x]{y}*.php"]] and out.files.count() == 4 and out.findings.count() == 4
    asked.clear()
    out = scan.scan(spark, f"file://{root}", PACK, state, rehash=True)
    assert asked[0] == ["a.php", "b.php", "c.php", "odd [x]{y}*.php"] and {r.locator for r in out.findings.collect()} == {"a.php", "c.php", "odd [x]{y}*.php"}
    log = {r.id: r for r in out.runs.collect()}
    assert [log[i].scope for i in sorted(log)] == ["full", "changed", "changed", "path", "full"] and (log[1].counts["added"], log[2].counts["matched"], log[3].counts["added"], log[5].counts["matched"]) == (3, 0, 1, 4)
    assert set(log[1].phases) == {"index", "hash", "match", "analysis", "commit"}


def test_unchanged_files_meet_only_new_rules(spark, tmp_path):
    """Every file's own rules: those younger than its last pack, and all of them where it has a finding or has changed."""
    root, state = tmp_path / "site", f"file://{tmp_path}/state"
    root.mkdir()
    rule = lambda i, p: (i, i, p, False, [], ["file_any"])
    mine = lambda version, *ps: pack.Pack(version=version, signatures=[(i, f"s{p}", p, "c", "info") for i, p in enumerate(ps)], regexes=[rule(i, f"/{p}/") for i, p in enumerate(ps)], literals=[(0, 0, 0, "file_any", "literal")])
    bodies = {"old.txt": "aa bb", "both.txt": "aa bb cc", "late.txt": "cc", "none.txt": "zz"}
    for name, body in bodies.items():
        (root / name).write_text(body)
    ids = lambda out: {r.locator: sorted(r.signature_ids) for r in out.findings.collect()}
    first = scan.scan(spark, f"file://{root}", mine(1, "bb"), state)
    assert ids(first) == {"old.txt": ["sbb"], "both.txt": ["sbb"]}
    tried = []
    with pytest.MonkeyPatch.context() as m:
        real = scan.matched
        m.setattr(scan, "matched", lambda rows, p, added: tried.append({r.path: r.known for r in rows.select("path", "known").collect()}) or real(rows, p, added))
        second = scan.scan(spark, f"file://{root}", mine(2, "bb", "cc"), state, scope="changed")
    assert tried == [{"old.txt": 0, "both.txt": 0, "late.txt": 1, "none.txt": 1}]
    whole = scan.scan(spark, f"file://{root}", mine(2, "bb", "cc"), f"file://{tmp_path}/fresh")
    assert ids(second) == ids(whole) == {"old.txt": ["sbb"], "both.txt": ["sbb", "scc"], "late.txt": ["scc"]}
    (root / "none.txt").write_text("aa changed")
    third = scan.scan(spark, f"file://{root}", mine(3, "bb", "cc", "aa"), state, scope="changed")
    assert ids(third)["none.txt"] == ["saa"] and {r.added for r in snapshots.load(spark, state, "rules").collect()} == {1, 2, 3}


def test_baseline_and_notices(spark):
    run = lambda i, status, at: (i, status, "full", 1, at, at + 1, 0, {}, {})
    log = lambda *rows_: spark.createDataFrame([run(*r) for r in rows_], runs.LOG)
    base = lambda df: tuple(one(runs.baseline(df)))
    assert base(log()) == (0, False) and base(log((1, "failed", 5))) == (0, False)
    assert base(log((1, "failed", 5), (7, "done", 9))) == (7, True) and base(log((7, "done", 9), (8, "failed", 10))) == (7, True)
    assert base(log((7, "done", 9), (8, "done", 10))) == (7, False)
    found = spark.createDataFrame([("a", "new", "alert", 9, 0), ("b", "new", "review", 2, 11), ("c", "new", "alert", 2, 0), ("d", "ignored", "alert", 11, 0)], "locator_hash string, state string, severity string, first_seen long, state_changed_at long")
    told = lambda df: tuple(one(runs.notices(df, found)))
    assert told(log((7, "done", 9))) == (0, 0, False)
    assert told(log((7, "done", 1), (8, "done", 9))) == (1, 1, False)
    failed = [(k, "failed", 9) for k in (8, 9, 10, 11)]
    assert told(log((7, "done", 1), *failed[:2])) == (0, 0, False) and told(log((7, "done", 1), *failed[:3])) == (0, 0, True) and told(log((7, "done", 1), *failed)) == (0, 0, False)


def landed_database(spark, folder, members):
    tables = {
        "options": ([(1, "active_plugins", "bad1", "no"), (2, "x", "bad2", "no"), (3, "y", "bad3", "yes"), (4, "sidebars_widgets", "bad4", "no"), (5, "_transient_z", "bad5", "yes"), (6, "sievework_own", "bad6", "yes"), (7, "home", None, "yes")], "option_id long, option_name string, option_value string, autoload string"),
        "posts": ([(1, "post", "A title", "bad1", "xworse", "publish"), (2, "revision", "t", "bad1", "", "publish"), (3, "page", None, "bad3", None, "trash"), (4, "page", "t", "fine", "", "draft")], "ID long, post_type string, post_title string, post_content string, post_excerpt string, post_status string"),
        "postmeta": ([(1, 4, "_elementor_data", "xworse"), (2, 4, "other", "bad1")], "meta_id long, post_id long, meta_key string, meta_value string"),
        "triggers": ([("t1", "INSERT bad9"), ("t2", "")], "name string, statement string"),
        "usermeta": ([(i, u, "wp_capabilities", 'a:1:{s:13:"administrator";b:1;}') for i, u in enumerate(members)] + [(90, 99, "wp_capabilities", 'a:1:{s:6:"editor";b:1;}')], "umeta_id long, user_id long, meta_key string, meta_value string"),
        "users": ([(u, f"user{u}", "2024-01-02") for u in (1, 2, 3, 99)], "ID long, user_login string, user_registered string"),
    }
    for name, (rows_, schema) in tables.items():
        spark.createDataFrame(rows_, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def test_database_from_the_command_line(spark, tmp_path, capsys):
    """Five tables in one scan, and administrators that the run before didn't know."""
    from sievework.__main__ import main
    from sievework.sources import database, pack as packs

    (tmp_path / "site").mkdir()
    state, folder = f"file://{tmp_path}/state", f"file://{tmp_path}/db"
    mine = packs.Pack(version=3, signatures=PACK.signatures, row_rules=[("db_post", 1, "/bad[0-9]/", "%bad%"), ("db_post", 2, "/(x|y)*worse/", "%worse%"), ("db_post", 2, "/(?R)/", None), ("db_option", 1, "/bad[0-9]/", "%bad%"), ("db_trigger", 1, "/bad[0-9]/", "%nothing%")])

    def run(*members):
        landed_database(spark, folder, members)
        with pytest.MonkeyPatch.context() as m:
            m.setattr("sievework.__main__.load_pack", lambda *_: mine)
            code = main(["--state", state, "run", f"file://{tmp_path}/site", "--pack", "-", "--database", folder])
        return code, {r.locator: r for r in snapshots.load(spark, state, "findings").collect()}

    code, got = run(1, 2)
    assert code == 1 and set(got) == {"options:option_value:1", "options:option_value:3", "options:option_value:4", "posts:post_content:1", "posts:post_excerpt:1", "postmeta:meta_value:1", "triggers:statement:t1"}
    assert got["posts:post_content:1"].reason.startswith("post #1 A title: ") and got["postmeta:meta_value:1"].reason.startswith("_elementor_data (post 4): ") and got["options:option_value:1"].reason.startswith("active_plugins: ")
    _, got = run(1, 2, 3)
    assert got["users:capabilities:3"].reason == "New administrator account: user3 (registered 2024-01-02)" and got["users:capabilities:3"].severity == "review" and len(got) == 8
    assert "users:capabilities:4" not in run(1, 2)[1] and database.landed(spark, f"file://{tmp_path}/none") == {}
    capsys.readouterr()
    assert main(["--state", state, "--format", "json", "runs"]) == 0 and len(capsys.readouterr().out.splitlines()) == 3


def test_answers_of_the_provider(spark, tmp_path):
    """Found, none, failed, stale and missing answers: what a pass may settle."""
    from sievework.sources import records as published

    (tmp_path / "site").mkdir()
    hit = lambda v, versions: {"type": "plugin", "slug": v, "name": v, "patched": bool(versions), "patched_versions": versions, "affected_versions": {"a": {"from_version": "*", "to_version": "1.5", "from_inclusive": True, "to_inclusive": True}}}
    records = lambda *slugs: spark.createDataFrame([(f"v-{s}", "Hole", False, [hit(s, ["2"] if s < "c" else [])], []) for s in slugs], vulnerability.RECORD)
    software = lambda *slugs: spark.createDataFrame([("plugin", s, "1.0") for s in slugs], "kind string, slug string, version string")
    now = one(spark.range(1).select(F.unix_timestamp(F.current_timestamp()).alias("t"))).t
    answers = lambda *rows_: spark.createDataFrame([("plugin", s, now - age, a) for s, age, a in rows_], "kind string, slug string, fetched_at long, answer string")

    def run(slugs, known, said):
        out = scan.scan(spark, f"file://{tmp_path}/site", PACK, f"file://{tmp_path}/state", software=software(*slugs), records=records(*known), answers=answers(*said))
        return {r.locator[7:]: r.reason for r in out.findings.collect()}

    slugs = ("a", "b", "c", "d")
    fine = [(s, 5, "found") for s in slugs]
    got = run(slugs, slugs, fine)
    assert got == {"a": "Hole — installed 1.0, patched in 2", "b": "Hole — installed 1.0, patched in 2", "c": "Hole — installed 1.0, no fix available", "d": "Hole — installed 1.0, no fix available"}
    late = published.VULNERABILITY_TTL + 60
    assert set(run(slugs, ("z",), [("a", 5, "none"), ("b", 5, "failed"), ("c", late, "none"), ("d", 5, "failed"), ("d", 90, "none")])) == {"b", "c"}
    assert set(run(("a", "b"), ("a",), [("a", 5, "found"), ("b", 5, "missing")])) == {"a", "b", "c"}
    assert set(run(("a", "b"), ("a",), [("a", 5, "found")])) == {"a", "b"}


def test_checksum_lists_grow_stale(spark, tmp_path):
    from sievework.sources import records as published

    old = published.CHECKSUM_TTL + 10
    (tmp_path / "sums").write_text("".join(json.dumps({"package": "p", "path": f, "md5": m, "fetched_at": t}) + "\n" for f, m, t in (("a", "1", 1000), ("b", "2", 1000 - old), ("c", "3", None), ("d", ["4", "5"], 1000))))
    assert sorted(r.path for r in published.checksums(spark, f"file://{tmp_path}/sums", F.lit(1005)).collect()) == ["a", "c", "d"]
    assert published.checksums(spark, f"file://{tmp_path}/sums").count() == 4


def test_mounted_trees_with_links_and_unreadable_entries(spark, tmp_path):
    root = tmp_path / "site"
    (root / "a/b/c").mkdir(parents=True)
    (root / "node_modules/x").mkdir(parents=True)
    (root / "cache/y").mkdir(parents=True)
    (tmp_path / "outside").mkdir()
    for at in ("top.php", "a/one.txt", "a/b/c/deep.php", "node_modules/x/no.php", "cache/y/no.php", "../outside/linked.php"):
        (root / at).write_bytes(b"<?php evil_call(1);")
    (root / "gone.php").symlink_to(tmp_path / "nowhere")
    (root / "lib").symlink_to(tmp_path / "outside")
    (root / "a/loop").symlink_to(root / "a")
    (root / "file.php").symlink_to(root / "top.php")
    found = lambda **how: {r.path: r.unreadable for r in files.walk_mounted(spark, f"file://{root}", ["cache"], **how).collect()}
    plain = {"top.php": False, "a/one.txt": False, "a/b/c/deep.php": False, "gone.php": True, "file.php": False}
    assert found() == plain and found(follow_links=True) == {**plain, "lib/linked.php": False}
    out = scan.scan(spark, f"file://{root}", PACK, f"file://{tmp_path}/state", excluded=["cache"], mounted=True)
    assert {r.path: r.kind for r in out.files.collect()} == {"top.php": "php", "a/one.txt": "php", "a/b/c/deep.php": "php", "gone.php": "unreadable", "file.php": "php"}
    assert {r.locator for r in out.findings.collect()} == {"top.php", "a/one.txt", "a/b/c/deep.php", "file.php"}


def test_overview_and_times(spark, tmp_path, capsys):
    from sievework.__main__ import main
    from sievework.functions import present

    rows_ = [(None, "never", ""), (1000, "just now", "1970-01-01 00:16"), (1000 - 61, "1 minute ago", "1970-01-01 00:15"), (1000 - 7200, "2 hours ago", ""), (1000 - 90000, "1 day ago", "")]
    df = spark.createDataFrame([(r[0],) for r in rows_], "t long")
    assert [tuple(r) for r in df.select("t", present.age(F.col("t"), F.lit(1000)), present.timestamp_text(F.col("t"))).collect()] == rows_
    (tmp_path / "site").mkdir()
    (tmp_path / "site/x.php").write_bytes(b"<?php foo bar aaa")
    state = f"file://{tmp_path}/state"
    before = len(snapshots._made)
    main(["--state", state, "run", f"file://{tmp_path}/site", "--pack", str(encoded_pack(tmp_path)), "--scope", "full"])
    assert len(snapshots._made) == before  # a scan leaves none of its intermediate tables
    capsys.readouterr()
    assert main(["--state", state, "--format", "json", "overview", "--interval", "3600"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert (told["files"], told["alerts"], told["runs"], told["last_status"], told["last_run"], told["verdict"], told["queued"]) == (1, 1, 1, "done", "just now", "crit", 0)
