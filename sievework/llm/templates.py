"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the canonical
words are joined by hash against the benchmark's, and slots must map consistently, so a question with other
numbers or names is still found. Built-in expressions and joins only.

Words: white-space tokens without punctuation, but for the marks inside a number and the sign before it; a number with a unit glued
to it is two words. ``<n>`` is a number or a number word, ``<u>`` a unit after a number, ``<p>`` a capitalised word that isn't a common one, wherever it stands; other
words count in lower case. A window has ``WINDOW`` words; an item with fewer is one window, with fewer than ``LEAST`` none.

A window whose words are the item's in lower case is a copy and counts. Windows that have the item's canonical words only count by
stretches, runs of windows that follow each other on one diagonal of document and item: a stretch must agree on a one-to-one mapping of
slot values within each type, and one of its windows must be a copy or have at least half its words outside of placeholders; windows
of more placeholders then count with it. So windows are hashed twice, by their canonical words and by their own.

Documents are read once for all window sizes. The hashes of the benchmark's windows are broadcast, in blocks of a stated size, one
pass over the documents each; a hit carries its own words, so no text is shuffled.

Cases: a null or blank text or item has no windows; repeated rows of either table change nothing; an empty table
gives no rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import SPACE, free_name, let, materialise, table

WINDOW, LEAST = 8, 3
#: Window hashes broadcast in one pass (about 50 bytes each); rows of a hit list that are broadcast (about 16 bytes each).
BROADCAST_ROWS, BROADCAST_KEYS = 500_000, 1_000_000
UNITS = (
    "km", "m", "cm", "mm", "mi", "miles", "mile", "feet", "ft", "inches", "kg", "g", "mg", "lb", "lbs", "pounds", "tons", "l", "ml", "litres", "liters", "hours",
    "hour", "minutes", "minute", "seconds", "second", "days", "day", "weeks", "months", "years", "year", "dollars", "euros", "cents", "percent", "degrees", "mph",
)
NUMBERS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen",
    "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
)
#: Words that begin sentences and are no names.
COMMON = (
    "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "because", "before", "both", "but", "by", "can", "choose", "compute", "consider", "could", "did", "do", "does",
    "each", "every", "find", "for", "from", "given", "had", "has", "have", "he", "her", "here", "his", "how", "i", "if", "in", "into", "is", "it", "its", "let", "many", "may", "more", "most", "my",
    "no", "not", "now", "of", "on", "one", "or", "our", "over", "please", "she", "should", "show", "since", "so", "some", "than", "that", "the", "their", "then", "there", "these", "they", "this",
    "those", "to", "under", "until", "was", "we", "were", "what", "when", "where", "which", "while", "who", "whose", "why", "will", "with", "would", "you", "your",
)
SLOTS = ("<n>", "<p>", "<u>")
#: The edges of a word among words one space apart.
START, STOP = r"(?<![^ ])", r"(?![^ ])"


def number_forms() -> list[str]:
    return [f for w in NUMBERS for f in (w, w.capitalize(), w.upper())]


def either(words) -> str:
    """An alternation of ``words`` by their first letters, so that most words of a text are passed over after one look."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in by.items())


#: A number; what parts of a text are no words: punctuation, but for marks between digits and a sign that starts a number.
NUMBER = r"-?[0-9]+(?:[.,][0-9]+)*"
NOT_WORDS = r"[^\p{L}\p{N}\x20\x09-\x0D.,-]+|[.,](?:(?![0-9])|(?<![0-9].))|-(?:(?![0-9])|(?<=[\p{L}\p{N}]-))"


def marked(text: Column) -> Column:
    """The text as its words, one space apart."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), NOT_WORDS, "")
    s = F.btrim(F.regexp_replace(s, SPACE + "+", " "))
    return F.regexp_replace(s, rf"{START}({NUMBER})({either(UNITS)}){STOP}", "$1 $2")


def canonical(words: Column) -> Column:
    """``marked`` text with placeholders, in lower case; word for word like its input."""
    s = F.regexp_replace(words, rf"{START}(?:{NUMBER}|{either(number_forms())}){STOP}", "<N>")
    s = F.regexp_replace(s, rf"(?<=<N> )(?:{either(UNITS)}){STOP}", "<U>")
    s = F.regexp_replace(s, rf"{START}(?!(?:{either(w.capitalize() for w in COMMON)}){STOP})\p{{Lu}}\p{{L}}*{STOP}", "<P>")
    return F.lower(s)


def split_words(marked_text: Column) -> Column:
    """The words; a text without any has one empty word, which no window reaches."""
    return F.split(marked_text, " ")


def window_hashes(canon: Column, size: int) -> Column:
    """A hash of every ``size`` words in a row, combined pairwise from shorter ones; empty for a shorter text."""

    def pair(x: Column, y: Column, by: int) -> Column:
        m = F.greatest(F.size(x) - by, F.lit(0))
        return F.zip_with(F.slice(x, F.lit(1), m), F.slice(y, F.lit(by + 1), m), lambda a, b: F.xxhash64(a, b))

    def grow(one: Column, have: Column, span: int) -> Column:
        if span == size:
            return have
        if span * 2 <= size:
            return let(pair(have, have, span), lambda x: grow(one, x, span * 2))
        rest = F.slice(one, F.lit(span + 1), F.greatest(F.size(one) - span, F.lit(0)))
        return let(F.zip_with(F.slice(have, F.lit(1), F.size(rest)), rest, lambda a, b: F.xxhash64(a, b)), lambda x: grow(one, x, span + 1))

    hashed = let(F.transform(canon, lambda w: F.xxhash64(w)), lambda one: grow(one, one, 1))
    return F.when(F.size(canon) >= size, hashed).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, ipos, words, canon, loose, hash) of the items' windows, words in lower case; ``loose`` windows have
    words enough to be met with other slots by themselves. A window has a row for the hash of its canonical words and one for that of its words, if they differ."""
    items = benchmark.select("item_id", marked(F.col("text")).alias("m")).filter("length(m) > 0").distinct()
    items = items.select("item_id", split_words(F.lower("m")).alias("raw"), split_words(canonical(F.col("m"))).alias("all"))
    items = items.filter(F.size("raw") >= LEAST).withColumn("size", F.least(F.size("raw"), F.lit(window)))
    out = items.select("item_id", "size", "raw", "all", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("size"))).alias("ipos"))
    out = out.select("item_id", "size", "ipos", F.slice("raw", F.col("ipos") + 1, F.col("size")).alias("words"), F.slice("all", F.col("ipos") + 1, F.col("size")).alias("canon"))
    out = out.withColumn("loose", 2 * F.size(F.filter("canon", lambda w: w.isin(*SLOTS))) <= F.col("size"))
    of = lambda c: reduce(lambda rest, n: F.when(F.col("size") == n, window_hashes(F.col(c), n)[0]).otherwise(rest), range(LEAST, window + 1), F.lit(None).cast("long"))
    return out.withColumn("hash", F.explode(F.array_distinct(F.array(of("canon"), of("words")))))


def hits(docs: DataFrame, hashes: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, key, pos, size, hash, got, form): the windows of ``docs`` whose hash is among ``hashes`` (hash, size), with their words
    and canonical words; ``key`` is the hash of the document's id and text. The windows of all sizes are one list, size after size and
    first the canonical ones, and the words of a window are cut out where its hash is found, in the same stage."""
    words = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), marked(F.col("text")).alias("m"))
    split = words.select("doc_id", "key", split_words(F.lower("m")).alias("w"), split_words(canonical(F.col("m"))).alias("c"))
    hashed = split.select("doc_id", "key", "w", "c", F.concat(*[window_hashes(F.col(x), size) for x in "cw" for size in sizes]).alias("h"))
    # the outer form, as the plain one makes the optimiser filter on the list's length, for which it would hash every text twice
    found = hashed.select("doc_id", "key", "w", "c", F.posexplode_outer("h").alias("at", "hash")).join(F.broadcast(hashes), "hash")
    count = lambda size: F.greatest(F.size("c") - size + 1, F.lit(0))
    before = {size: sum((count(x) for x in sizes[:i]), F.lit(0)) for i, size in enumerate(sizes)}
    first = reduce(lambda rest, size: F.when(F.col("size") == size, before[size]).otherwise(rest), sizes, F.lit(None).cast("int"))
    total = sum((count(x) for x in sizes), F.lit(0))
    found = found.withColumn("pos", F.col("at") - F.when(F.col("at") >= total, total).otherwise(0) - first)
    found = found.filter((F.col("pos") >= 0) & (F.col("pos") + F.col("size") <= F.size("c")))
    return found.select("doc_id", "key", "pos", "size", "hash", F.slice("w", F.col("pos") + 1, F.col("size")).alias("got"), F.slice("c", F.col("pos") + 1, F.col("size")).alias("form"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, key, item_id, windows, item_windows): how many windows of the item the document holds; ``key`` is the
    hash of the document's id and text."""
    bench, _ = materialise(benchmark_windows(benchmark, window), "benchmark")
    hashes = bench.select("hash", "size").distinct()
    total = hashes.count()
    sizes = sorted((r["size"] for r in hashes.select("size").distinct().collect()), reverse=True) or [window]  # at most ``window`` values
    blocks = max(1, -(-total // BROADCAST_ROWS))
    parts = [hits(docs, hashes.filter(F.pmod("hash", F.lit(blocks)) == i) if blocks > 1 else hashes, sizes) for i in range(blocks)]
    found, _ = materialise(reduce(DataFrame.unionByName, parts), "hits")
    small = F.broadcast if blocks == 1 else lambda df: df
    same = found.join(small(bench), ["hash", "size"]).withColumn("copy", F.col("got") == F.col("words")).filter("copy OR form = canon")
    slots = F.filter(
        F.zip_with(F.arrays_zip("canon", "words"), "got", lambda a, g: F.struct(a["canon"].alias("type"), a["words"].alias("of"), g.alias("to"))),
        lambda x: x["type"].isin(*SLOTS),
    )
    lined = same.select(
        "doc_id", "key", "item_id", (F.col("pos") - F.col("ipos")).alias("diagonal"), "ipos", "copy", (F.col("copy") | F.col("loose")).alias("firm"), F.when(~F.col("copy"), slots).alias("slots"),
    )
    along = Window.partitionBy("doc_id", "key", "item_id", "diagonal").orderBy("ipos")
    starts = F.coalesce((F.col("ipos") - F.lag("ipos").over(along) > 1).cast("int"), F.lit(0))
    lined = lined.withColumn("starts", starts).withColumn("stretch", F.sum("starts").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    one = lambda *keys: F.size(F.array_distinct(F.transform("pairs", lambda x: F.struct(*[x[k].alias(k) for k in keys]))))
    lined = lined.groupBy("doc_id", "key", "item_id", "diagonal", "stretch").agg(
        F.collect_set(F.when(F.col("copy"), F.col("ipos"))).alias("exact"), F.collect_set("ipos").alias("every"), F.max("firm").alias("firm"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("pairs")
    )
    agreed = F.col("firm") & (one("type", "of") == F.size("pairs")) & (one("type", "to") == F.size("pairs"))
    lined = lined.select("doc_id", "key", "item_id", F.explode(F.when(agreed, F.col("every")).otherwise(F.col("exact"))).alias("ipos"))
    whole = bench.groupBy("item_id").agg(F.countDistinct("ipos").alias("item_windows"))
    per = lined.groupBy("doc_id", "key", "item_id").agg(F.countDistinct("ipos").alias("windows"))
    return per.join(whole, "item_id").select("doc_id", "key", "item_id", "windows", "item_windows")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item."""
    k = free_name(docs, "leak_key")
    found, _ = materialise(leaks(docs.select("doc_id", "text"), benchmark).select(F.col("key").alias(k)).distinct(), "leaks")
    if found.count() <= BROADCAST_KEYS:
        found = F.broadcast(found)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(k, F.xxhash64("doc_id", "text")).join(found, k, "left_anti").select(*own)


def query(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "windows", "item_windows")


def oracle(window: int = WINDOW) -> str:
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    slot = quoted(SLOTS)
    return rf"""
    WITH both_ AS (
      SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
    ), p AS (
      SELECT side, id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: regexp_extract_all(w, '[0-9]+(?:[.,][0-9]+)*|[^0-9]+')) AS w FROM both_
    ), t AS (
      SELECT side, id, list_filter(list_transform(w, lambda ps: array_to_string(list_transform(ps, lambda x, i: CASE WHEN regexp_matches(x, '^[0-9]') THEN x ELSE regexp_replace(x, '[^\p{{L}}\p{{N}}]+', '', 'g')
          || CASE WHEN i < len(ps) AND regexp_matches(x, '(^|[^\p{{L}}\p{{N}}])-$') AND (length(x) > 1 OR i = 1) THEN '-' ELSE '' END END), '')), lambda w: w <> '') AS w FROM p
    ), u AS (
      SELECT side, id, flatten(list_transform(w, lambda x: CASE WHEN regexp_full_match(x, '{NUMBER}(?:{either(UNITS)})')
          THEN [regexp_extract(x, '^{NUMBER}'), regexp_extract(x, '[a-z]+$')] ELSE [x] END)) AS w FROM t
    ), c AS (
      SELECT side, id, list_transform(w, lambda x: lower(x)) AS w, list_transform(w, lambda x, i: CASE
          WHEN regexp_full_match(x, '{NUMBER}') OR x IN ({quoted(number_forms())}) THEN '<n>'
          WHEN i > 1 AND x IN ({quoted(UNITS)}) AND (regexp_full_match(w[i - 1], '{NUMBER}') OR w[i - 1] IN ({quoted(number_forms())})) THEN '<u>'
          WHEN regexp_full_match(x, '\p{{Lu}}\p{{L}}*') AND x NOT IN ({quoted(w.capitalize() for w in COMMON)}) THEN '<p>'
          ELSE lower(x) END) AS c
      FROM u WHERE len(w) > 0
    ), b AS (
      SELECT id, least(len(w), {window}) AS size, w, c, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS p FROM c WHERE side = 'b' AND len(w) >= {LEAST}
    ), bw AS (
      SELECT DISTINCT id AS item_id, size, p AS ipos, w[p:p + size - 1] AS words, c[p:p + size - 1] AS canon FROM b
    ), s AS (SELECT DISTINCT size FROM bw), dp AS (
      SELECT id AS doc_id, s.size, unnest(list_transform(range(1, len(w) - s.size + 2), lambda p: {{'pos': p, 'got': w[p:p + s.size - 1], 'canon': c[p:p + s.size - 1]}}), recursive := true)
      FROM c, s WHERE side = 'd' AND len(w) >= s.size
    ), m AS (
      SELECT DISTINCT doc_id, item_id, pos - ipos AS diagonal, ipos, got, words, canon FROM dp JOIN bw USING (size, canon) WHERE got <> words
      UNION ALL SELECT DISTINCT doc_id, item_id, pos - ipos, ipos, got, words, bw.canon FROM dp JOIN bw ON dp.size = bw.size AND got = words
    ), f AS (
      SELECT *, got = words OR 2 * len(list_filter(canon, lambda x: x IN ({slot}))) <= len(canon) AS firm,
             coalesce(ipos - lag(ipos) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY ipos) > 1, false)::INT AS starts FROM m
    ), g AS (
      SELECT *, sum(starts) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY ipos ROWS UNBOUNDED PRECEDING) AS stretch FROM f
    ), pairs AS (
      SELECT doc_id, item_id, diagonal, stretch, unnest(list_transform(range(1, len(canon) + 1), lambda k: {{'ty': canon[k], 'f': words[k], 'o': got[k]}}), recursive := true) FROM g WHERE got <> words
    ), bad AS (
      SELECT DISTINCT doc_id, item_id, diagonal, stretch FROM pairs WHERE ty IN ({slot}) GROUP BY doc_id, item_id, diagonal, stretch
      HAVING count(DISTINCT (ty, f)) < count(DISTINCT (ty, f, o)) OR count(DISTINCT (ty, o)) < count(DISTINCT (ty, f, o))
      UNION SELECT doc_id, item_id, diagonal, stretch FROM g GROUP BY doc_id, item_id, diagonal, stretch HAVING NOT bool_or(firm)
    )
    SELECT doc_id, item_id, count(DISTINCT ipos)::BIGINT AS windows, (SELECT count(DISTINCT ipos) FROM bw WHERE bw.item_id = g.item_id)::BIGINT AS item_windows
    FROM g LEFT JOIN bad USING (doc_id, item_id, diagonal, stretch) WHERE got = words OR bad.doc_id IS NULL GROUP BY doc_id, item_id
    """
