"""Multi-pattern matching: hash, literal and regular-expression rules over chunks of content.

All of it is joins and expressions. Rules reach a chunk through inverted indexes: words lead to literals, and a division join of
the literals that are there leads to the regular expressions that need them, so a chunk is tried with few of a pack's
rules however many there are. Where it isn't known which literals are there, a plain pattern's own beginning leads to the places where it is tried. Patterns that Java would read otherwise run over the same candidates in Arrow batches. The
order-dependent rules (suppression after an infected match, quota, overlap) are windows over (chunk, layer, position).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import EXCERPT_BEFORE, EXCERPT_BYTES, ascii_lower, basename, beyond_java, code_points, excerpt, let, line_of, word_set
from sievework.sources.files import CHUNK, OVERLAP
from sievework.sources.pack import byte_pattern, first_match, readings, split_pattern

#: Infected matches after which a file's regular expressions stop.
QUOTA = 10
RANKS = {"integrity": 4, "infected": 3, "suspicious": 2, "info": 1}
#: Rules in a broadcast; larger packs join by shuffling on the word.
BROADCAST_RULES = 200_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has few rows; the rule tables are bounded by their pack, which is counted here."""
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def targets_of(path: Column, kind: Column) -> Column:
    """Rule targets that apply to a file."""
    lits = lambda *x: F.array(*map(F.lit, x))
    return (
        F.when(basename(path) == ".htaccess", lits("htaccess", "file_any")).when(kind == "php", lits("file_php", "file_code", "file_any", "file_js", "file_html"))
        .when(kind == "js", lits("file_js", "file_code", "file_any")).when(kind == "html", lits("file_html", "file_any")).otherwise(lits("file_any"))
    )


def tier_rank(tier: Column) -> Column:
    out = F.lit(0)
    for name, rank in RANKS.items():
        out = F.when(tier == name, rank).otherwise(out)
    return out


def hash_matches(files: DataFrame, hash_rules: DataFrame, key: str = "path") -> DataFrame:
    """(key, position, sig): md5 first, then sha256; both may match."""
    both = files.select(key, F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("kind"), F.col(k).alias("hex")) for i, k in enumerate(("md5", "sha256"))])).alias("h"))
    return both.select(key, "h.*").join(small(hash_rules, hash_rules.count()), ["kind", "hex"]).select(key, "position", "sig")


def allowed(files: DataFrame, allow: DataFrame) -> DataFrame:
    """``files`` with ``is_allowed``: the list has its md5, or its md5, an O and its size."""
    keys = F.array(F.col("md5"), F.concat("md5", F.lit("O"), F.col("size").cast("string")))
    hits = files.select("path", F.explode(keys).alias("key")).join(small(allow, allow.count()), "key", "left_semi").select("path").distinct()
    return files.join(hits.withColumn("is_allowed", F.lit(True)), "path", "left").withColumn("is_allowed", F.coalesce("is_allowed", F.lit(False)))


def candidates(chunks: DataFrame, literals: DataFrame, key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, lit): literals that may stand in a chunk, because it has all of their words; literals without words always may.
    Chunks' words are joined to the literals' words; only hits are counted, and counts combine before the shuffle."""
    words, n = word_set(F.col("text")), literals.count()
    rules = literals.select("lit", "text").distinct().withColumn("of", words)
    index = rules.select("lit", F.size("of").alias("need"), F.explode("of").alias("word"))
    seen = chunks.select(*key, F.explode(words).alias("word"))
    hits = seen.join(small(index, n), "word").groupBy(*key, "lit").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
    always = [r.lit for r in rules.filter(F.size("of") == 0).select("lit").collect()]  # a pack's rules are bounded
    hits = hits.select(*key, "lit")
    return hits.unionByName(chunks.select(*key, F.explode(F.array(*map(F.lit, always))).alias("lit"))) if always else hits


#: Numbers of characters of a word by which a literal is looked up where the text's word may be longer than the literal's.
GRAMS = (12, 11, 10, 9, 8, 6, 5, 4, 3, 2, 1)


def lookup_keys(text: str) -> list[tuple[str, str]]:
    """What a chunk that holds the lower-cased literal must hold among its words, as (form, word): whole words (``=``) where the
    literal has some between other characters; else a word's end (``>``) or start (``<``) where one stands at its edge, or a part
    of one (``*``) where the literal is a single word. Empty for a literal without words."""
    words = list(re.finditer(r"[a-z0-9_]+", text))
    inner = sorted({m[0] for m in words if m.start() > 0 and m.end() < len(text)})
    if inner:
        return [("=", w) for w in inner]
    if not words:
        return []
    longest = max(words, key=lambda m: len(m[0]))
    w = longest[0]
    n = next(n for n in GRAMS if n <= len(w))
    if longest.start() == 0 and longest.end() == len(text):
        return [("*", w[:n])]
    return [(">", w[-n:])] if longest.start() == 0 else [("<", w[:n])]


def possible(chunks: DataFrame, literals: DataFrame, key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, lit): literals that may stand in a chunk; those that can't be told from its words always may. A chunk's words, and the
    ends and parts of them that some literal is looked up by, are joined to the literals' keys; hits combine before the shuffle."""
    rows = sorted({(r.lit, r.text) for r in literals.select("lit", ascii_lower(F.col("text")).alias("text")).distinct().collect()})  # a pack's rules are bounded
    keys = [(lit, form, w, len(ks)) for lit, text in rows for ks in [lookup_keys(text)] for form, w in ks]
    names, parts = list(key), []
    if keys:
        index = small(chunks.sparkSession.createDataFrame(keys, "lit int, form string, word string, need int"), len(keys))
        lengths = {f: sorted({len(k[2]) for k in keys if k[1] == f}) for f in "=><*"}
        each = lambda form, many: F.array(*[f(n) for n in lengths[form] for f in (many,)])
        tagged = lambda form, words: F.transform(words, lambda w: F.struct(F.lit(form).alias("form"), w.alias("word")))
        words, forms = word_set(F.col("text")), []
        if lengths["="]:
            forms.append(lambda ws: tagged("=", ws))
        if lengths[">"]:
            forms.append(lambda ws: tagged(">", F.array_distinct(F.flatten(F.transform(ws, lambda w: each(">", lambda n: F.when(F.length(w) >= n, F.right(w, F.lit(n)))))))))
        if lengths["<"]:
            forms.append(lambda ws: tagged("<", F.array_distinct(F.flatten(F.transform(ws, lambda w: each("<", lambda n: F.when(F.length(w) >= n, F.left(w, F.lit(n)))))))))
        if lengths["*"]:  # by a pattern, as cutting a long word at each of its places would read it from its start each time
            parts_of = [F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"(?=([a-z0-9_]{{{n}}}))"), F.lit(1)) for n in lengths["*"]]
            forms.append(lambda ws: tagged("*", F.array_distinct(F.concat(*parts_of))))
        seen = chunks.select(*names, F.explode(let(words, lambda ws: F.concat(*[f(ws) for f in forms]))).alias("w")).select(*names, "w.*")
        hits = seen.join(index, ["form", "word"]).groupBy(*names, "lit").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need")
        parts.append(hits.select(*names, "lit"))
    if always := sorted({lit for lit, text in rows if not lookup_keys(text)}):
        parts.append(chunks.select(*names, F.explode(F.array(*map(F.lit, always))).alias("lit")))
    if not parts:
        return chunks.limit(0).select(*names, F.lit(0).alias("lit"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def presence(chunks: DataFrame, found: DataFrame, words: list[tuple[str, int]], pure: set[int], key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, lit): the literals that count as present for the regular expressions that need them. ``found`` are those that stand in the
    chunk. A literal for which the pack lists ``words`` (word, lit) also needs each of them as a whole word, and if it is ``pure`` the words alone decide."""
    names = list(key)
    if not words:
        return found.select(*names, "lit").distinct()
    spark = chunks.sparkSession
    index = spark.createDataFrame(words, "word string, lit int").distinct()
    needs = small(index.join(index.groupBy("lit").agg(F.count(F.lit(1)).alias("need")), "lit"), len(words))
    whole = chunks.select(*names, F.explode(word_set(F.col("text"))).alias("word")).join(needs, "word").groupBy(*names, "lit").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need").select(*names, "lit")
    listed = sorted({lit for _, lit in words})
    by_word = whole.filter(F.col("lit").isin(*sorted(pure))) if pure else whole.limit(0)
    both = whole.join(found.select(*names, "lit"), [*names, "lit"], "left_semi")
    rest = found.select(*names, "lit").join(small(spark.createDataFrame([(x,) for x in listed], "lit int"), len(listed)), "lit", "left_anti")
    return by_word.unionByName(both).unionByName(rest.select(*names, "lit")).distinct()


def located(chunks: DataFrame, literals: DataFrame, have: DataFrame | None = None, key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, targets, lit, pos, line, excerpt): the first place of each literal that really stands in a chunk, out of its candidates
    ``have`` or out of all. Each chunk's text is read and lower-cased once, whatever its candidates."""
    from sievework.plans.snapshots import cut

    names = list(key)
    texts = literals.select("lit", ascii_lower(F.col("text")).alias("literal")).distinct()
    if have is None:  # the literals of a pack are a bounded table
        every = [r.asDict() for r in texts.orderBy("lit").collect()]
        rows = chunks.withColumn("_wanted", F.from_json(F.lit(json.dumps(every)), "array<struct<lit:int,literal:string>>"))
    else:
        wanted = cut(have.join(small(texts, literals.count()), "lit").groupBy(*key).agg(F.collect_list(F.struct("lit", "literal")).alias("_wanted")))
        rows = chunks.join(wanted, names)  # one row a chunk, which grows with the texts: never marked for broadcast
    places = let(ascii_lower(F.col("text")), lambda low: F.filter(F.transform("_wanted", lambda w: F.struct(w["lit"].alias("lit"), F.call_function("instr", low, w["literal"]).alias("pos"))), lambda x: x["pos"] > 0))
    found = rows.withColumn("hit", F.explode(places)).select(*names, "targets", "text", "line_base", "hit.*")
    return found.select(*names, "targets", "lit", "pos", line_of(F.col("text"), F.col("pos"), F.col("line_base")).alias("line"), excerpt(F.col("text"), F.col("pos")).alias("excerpt"))


def literal_rules(found: DataFrame, literals: DataFrame, key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, layer 1, position, sig, pos, line, excerpt): the rules of the literals ``found`` whose target applies."""
    rules = small(literals.select("lit", "position", "sig", "target"), literals.count())
    rows = found.join(rules, "lit").filter(F.array_contains("targets", F.col("target")))
    return rows.select(*key, F.lit(1).alias("layer"), "position", "sig", "pos", "line", "excerpt")


def literal_matches(chunks: DataFrame, literals: DataFrame, present: DataFrame | None = None, key: tuple[str, ...] = ("path", "chunk")) -> DataFrame:
    """(key, layer 1, position, sig, pos, line, excerpt): the first place of each literal rule whose target applies; ``present`` lists
    the candidates (key, lit)."""
    return literal_rules(located(chunks, literals, present, key), literals, key)


RULE = "position:int,sig:int,pattern:string,first_only:boolean,targets:array<string>,added:int"


def rule_candidates(present: DataFrame, rules: list[tuple], key: tuple[str, ...] = ("path", "chunk"), added: dict[int, int] | None = None) -> DataFrame:
    """(key, _rules): the ``rules`` (position, sig, pattern, first_only, needed literals, targets) all of whose literals are in the chunk: a
    division join through the inverted index from literals to rules."""
    spark, n = present.sparkSession, sum(len(r[4]) for r in rules)
    index = spark.createDataFrame([(lit, r[0], len(set(r[4]))) for r in rules for lit in sorted(set(r[4]))], "lit int, position int, need int")
    of = spark.createDataFrame([(r[0], r[1], r[2], bool(r[3]), list(r[5]), (added or {}).get(r[0], 1)) for r in rules], f"struct<{RULE}>")
    hits = present.select(*key, "lit").distinct().join(small(index, n), "lit").groupBy(*key, "position").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n = need")
    return hits.join(small(of, len(rules)), "position").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(*of.columns))).alias("_rules"))


def tried(chunks: DataFrame, rules: list[tuple], present: DataFrame | None, key: tuple[str, ...], added: dict[int, int] | None = None) -> DataFrame:
    """``chunks`` with ``_rules``, the rules to try on each: those without needed literals (all of them if it isn't known which are
    there), and those that ``rule_candidates`` leads to, as far as target, chunk and what the file has been matched with allow."""
    from sievework.plans.snapshots import cut

    free = [r for r in rules if present is None or not r[4]]
    fields = [{"position": r[0], "sig": r[1], "pattern": r[2], "first_only": bool(r[3]), "targets": list(r[5]), "added": (added or {}).get(r[0], 1)} for r in free]
    always = F.from_json(F.lit(json.dumps(fields)), f"array<struct<{RULE}>>")
    rows, led = chunks, [r for r in rules if present is not None and r[4]]
    if led:
        found = cut(rule_candidates(present, led, key, added))
        rows = chunks.join(found, list(key), "left" if free else "inner")  # one row a chunk, never marked for broadcast
        always = F.concat(always, F.coalesce("_rules", F.from_json(F.lit("[]"), f"array<struct<{RULE}>>"))) if free else F.col("_rules")
    fits = lambda r: F.arrays_overlap(r["targets"], "targets") & (~r["first_only"] | F.col("first"))
    if added is not None:  # ``known`` is the pack that the file was matched with, 0 for none
        return rows.withColumn("_rules", F.filter(always, lambda r: fits(r) & (r["added"] > F.col("known")))).filter(F.size("_rules") > 0)
    return rows.withColumn("_rules", F.filter(always, fits)).filter(F.size("_rules") > 0)


#: Patterns of plain characters, classes and counts that begin with letters, digits or underscores of one word: every
#: engine finds the same first place of them.
LED = re.compile(r"([A-Za-z0-9_]{3,})(?![+*?{])((?:(?:[A-Za-z0-9_ <>=,;:!@#%&~\"'-]|\\[.()\[\]{}+*?|^$\\/]|\[(?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9_ ])+\])(?:[+*?]|\{\d+(?:,\d*)?\})?)*)")
#: Words whose leads a task remembers, and characters of the longest of them.
REMEMBERED, LONG_WORD = 100_000, 64


def leading(pattern: str) -> tuple[str, str] | None:
    """(lead, tail) of a pattern that begins with a literal, else None."""
    body, flags = split_pattern(pattern)
    found = None if flags else LED.fullmatch(body)
    return (found[1], found[2]) if found else None


def led_search(rules: list[tuple[int, int, str, str]]):
    """A function of texts: array<struct<position,sig,pos>> of the first match of each of the ``rules`` (position, sig, lead, tail). Words lead
    to the rules whose lead stands in them, and only there their tail is tried."""
    grams = sorted({max(n for n in GRAMS if n <= len(r[2])) for r in rules})
    index: dict[str, list[int]] = {}
    for i, (_, _, lead, _) in enumerate(rules):
        index.setdefault(lead[: max(n for n in GRAMS if n <= len(lead))], []).append(i)

    def leads_in(word: str) -> list[tuple[int, int]]:
        return [(at + len(rules[i][2]), i) for at in range(len(word)) for n in grams if at + n <= len(word) for i in index.get(word[at : at + n], ()) if word.startswith(rules[i][2], at)]

    known: dict[str, list[tuple[int, int]]] = {}

    def search(texts: pa.Array) -> pa.Array:
        tails = {tail: re.compile(tail).match for tail in {r[3] for r in rules}}
        tail_of = [tails[r[3]] for r in rules]
        ends, which, where = [0], [], []
        for text in texts:
            first: dict[int, int] = {}
            for m in re.finditer("[A-Za-z0-9_]+", text.as_py() or ""):
                word = m[0]
                places = known.get(word)
                if places is None:
                    places = leads_in(word)
                    if len(word) <= LONG_WORD:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[word] = places
                for after, i in places:
                    if i not in first and tail_of[i](m.string, m.start() + after):
                        first[i] = m.start() + after - len(rules[i][2]) + 1
            which += first.keys()
            where += first.values()
            ends.append(len(which))
        ints = lambda xs: pa.array(xs, pa.int32())
        return pa.ListArray.from_arrays(ints(ends), pa.StructArray.from_arrays([ints([rules[i][0] for i in which]), ints([rules[i][1] for i in which]), ints(where)], ["position", "sig", "pos"]))

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, "array<struct<position:int,sig:int,pos:int>>")


def led_matches(chunks: DataFrame, rules: list[tuple[tuple, tuple[str, str]]], names: list[str]) -> list[DataFrame]:
    """What ``regex_matches`` gives for the rules that ``leading`` splits, by the targets and chunks that they apply to."""
    parts, groups = [], {}
    for r, (lead, tail) in rules:
        groups.setdefault((tuple(sorted(r[5])), bool(r[3])), []).append((r[0], r[1], lead, tail))
    for (targets, first_only), group in groups.items():
        fits = F.arrays_overlap(F.array(*map(F.lit, targets)), "targets")
        rows = chunks.filter(fits & F.col("first") if first_only else fits).withColumn("hit", F.explode(led_search(group)(F.col("text"))))
        line = line_of(F.col("text"), F.col("hit.pos"), F.col("line_base"))
        parts.append(rows.select(*names, F.lit(2).alias("layer"), "hit.*", line.alias("line"), excerpt(F.col("text"), F.col("hit.pos")).alias("excerpt")))
    return parts


HIT = pa.schema([("k", pa.string()), ("position", pa.int32()), ("sig", pa.int32()), ("pos", pa.int32()), ("lines", pa.int32()), ("around", pa.string())])


def byte_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (k, content, rules): the first match of each candidate, with the line ends before it and the bytes around it."""
    compiled: dict[str, object] = {}
    for batch in batches:
        out = []
        for k, content, rules in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for r in rules:
                if r["pattern"] not in compiled:
                    compiled[r["pattern"]] = byte_pattern(r["pattern"])
                if pos := first_match(compiled[r["pattern"]], content or b""):
                    start = max(0, pos - 1 - EXCERPT_BEFORE)
                    out.append({"k": k, "position": r["position"], "sig": r["sig"], "pos": pos, "lines": content.count(b"\n", 0, max(0, pos - 1)), "around": content[start : start + EXCERPT_BYTES].decode("latin-1")})
        yield pa.RecordBatch.from_pylist(out, HIT)


def regex_matches(chunks: DataFrame, regexes: list[tuple], present: DataFrame | None = None, key: tuple[str, ...] = ("path", "chunk"), errors: bool = False, added: dict[int, int] | None = None) -> DataFrame:
    """(key, layer 2, position, sig, pos, line, excerpt) of the first match of each rule that applies and whose literals
    are all there. With ``errors`` a failed search is a row with pos -1. With ``added`` (pack of each rule, by position) a chunk
    is tried with the rules younger than its ``known`` only. Without ``present`` rules that begin with a literal are led by it."""
    java, other, _ = readings([r[2] for r in regexes])
    names, parts = list(key), []
    if present is None and added is None:
        led = [(r, x) for r in regexes if r[2] in java and (x := leading(r[2]))]
        parts += led_matches(chunks, led, names)
        ours = {r[0] for r, _ in led}
        regexes = [r for r in regexes if r[0] not in ours]
    if native := [(*r[:2], java[r[2]], *r[3:]) for r in regexes if r[2] in java]:
        hits = F.filter(F.transform("_rules", lambda r: F.struct(r["position"].alias("position"), r["sig"].alias("sig"), F.regexp_instr("text", r["pattern"]).alias("pos"))), lambda x: x["pos"] > 0)
        rows = tried(chunks, native, present, key, added).withColumn("_wide", beyond_java(F.col("text"))).withColumn("hit", F.explode(hits))
        rows = rows.withColumn("_at", F.when(F.col("_wide"), code_points(F.col("text"), F.col("hit.pos"))).otherwise(F.col("hit.pos")))
        line = line_of(F.col("text"), F.col("_at"), F.col("line_base"))
        parts.append(rows.select(*names, F.lit(2).alias("layer"), "hit.position", "hit.sig", F.col("_at").alias("pos"), line.alias("line"), excerpt(F.col("text"), F.col("_at")).alias("excerpt")))
    if rest := [r for r in regexes if r[2] in other]:
        rows = tried(chunks, rest, present, key, added)
        keyed = rows.select(F.to_json(F.struct(*names, "line_base")).alias("k"), F.encode("text", "ISO-8859-1").alias("content"), "_rules")
        hits = keyed.mapInArrow(byte_search, "k string, position int, sig int, pos int, lines int, around string")
        types = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in [*names, "line_base"])
        hits = hits.withColumn("k", F.from_json("k", types))
        hits = hits if errors else hits.filter("pos > 0")
        line = (F.col("k.line_base") + F.col("lines") + 1).cast("int")
        parts.append(hits.select(*[F.col(f"k.{c}").alias(c) for c in names], F.lit(2).alias("layer"), "position", "sig", "pos", line.alias("line"), excerpt(F.col("around"), F.lit(1)).alias("excerpt")))
    if not parts:
        nil = F.lit(0)
        return chunks.limit(0).select(*names, F.lit(2).alias("layer"), nil.alias("position"), nil.alias("sig"), nil.alias("pos"), nil.alias("line"), F.lit("").alias("excerpt"))
    return reduce(DataFrame.unionByName, parts)


def suppress(matches: DataFrame, quota: int = QUOTA, key: str = "path") -> DataFrame:
    """What a sequential scan keeps of (key, chunk, layer, position, tier), without ``chunk`` that of one chunk: all hash and literal
    matches; a regular expression's unless the quota of infected ones is full, or it is only suspicious and something
    infected stands before; and nothing of the chunks after the quota is full."""
    rows = matches if "chunk" in matches.columns else matches.withColumn("chunk", F.lit(0))
    infected = F.when(F.col("tier") == "infected", 1).otherwise(0)
    regex = F.col("layer") == 2
    nil = F.lit(0)
    before = Window.partitionBy(key).orderBy("chunk", "layer", "position").rowsBetween(Window.unboundedPreceding, -1)
    chunks_before = Window.partitionBy(key).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "chunk")
    counted = (
        rows.withColumn("_seen", F.coalesce(F.sum(infected).over(before), nil)).withColumn("_past", F.coalesce(F.sum(infected).over(chunks_before), nil))
        .withColumn("_first", F.sum(F.when(~regex, infected).otherwise(0)).over(inside))
        .withColumn("_rx", F.coalesce(F.sum(F.when(regex, infected).otherwise(0)).over(inside.orderBy("layer", "position").rowsBetween(Window.unboundedPreceding, -1)), nil))
    )
    open_ = (F.col("chunk") == 0) | (F.col("_past") < quota)
    room = F.col("_rx") < F.greatest(F.lit(1), F.lit(quota) - F.col("_past") - F.col("_first"))
    kept = open_ & (~regex | (room & ~((F.col("tier") == "suspicious") & (F.col("_seen") > 0))))
    return counted.filter(kept).select(*matches.columns)


def drop_overlaps(matches: DataFrame, stride: int = CHUNK - OVERLAP, overlap: int = OVERLAP, key: str = "path") -> DataFrame:
    """Matches (key, chunk, sig, pos) without those that the chunk before has reported: inside the overlap, and not past
    the greatest place of the same signature in that chunk. ``pos`` counts from 1 in its chunk."""
    at = F.col("chunk") * stride + F.col("pos") - 1
    per = matches.groupBy(key, "sig", "chunk").agg(F.max(at).alias("_last")).withColumn("chunk", F.col("chunk") + 1)
    joined = matches.join(per, [key, "sig", "chunk"], "left")
    again = (F.col("chunk") > 0) & (F.col("pos") <= overlap) & (F.coalesce(F.col("_last"), F.lit(-1)) >= F.col("chunk") * stride)
    return joined.filter(~again).drop("_last")


def named(matches: DataFrame, signatures: DataFrame) -> DataFrame:
    return matches.join(small(signatures, signatures.count()), "sig")
