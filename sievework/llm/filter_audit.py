"""Filter interaction audit: for every part of the documents and every order of a set of filters, what each step removes, keeps,
would have removed anyway, and costs in labelled documents.

A document's failures are one number, a bit a filter. A table of first failures, with a row for each such number and a column
for each order, tells the step that removes it. Arrow tasks look the documents up in that table, accumulate removals by
part, order, step and label with ``np.bincount``, and hand on one row a part, order and step; Spark sums these rows.

Copies are found by the SHA-256 of the text: only digests and ids are shuffled, and they are joined on (digest, id), so that a
text that a third of all rows share is still dealt over all tasks.

Cases: a null text is empty, a null part is the empty string; a null doc_id is neither smaller nor larger than another, so it
neither makes nor is a later copy; rows that share a doc_id are documents of their own; a document of several label rows
has a label if one of them has; documents without labels have none; an empty table gives no rows; other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import let, materialise, table, words_of

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: Parts that a task accumulates before it hands them on (about 34 kB each).
HELD_PARTS = 1000
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in permutations(filters)]


def first_failures(filters: str = FILTERS) -> np.ndarray:
    """[failures, order]: the 0-based step that removes a document; the number of filters if none does."""
    n, bits = len(filters), np.arange(1 << len(filters))
    fails = [(bits >> filters.index(f)) & 1 for f in filters]
    return np.stack([np.argmax(np.stack([fails[filters.index(f)] for f in o] + [np.ones_like(bits)]), axis=0) for o in orders(filters)], axis=1).astype(np.int64).reshape(1 << n, -1)


def step_filters(filters: str = FILTERS) -> np.ndarray:
    """[order, step]: the number of the filter applied there."""
    return np.array([[filters.index(f) for f in o] for o in orders(filters)])


def tally(fails: np.ndarray, part: np.ndarray, parts: int, good: np.ndarray, toxic: np.ndarray, filters: str = FILTERS) -> np.ndarray:
    """[part, count, order, step]: the counts of ``COUNTS`` over documents with these failures; they add up over documents."""
    steps, of, n = first_failures(filters)[fails], step_filters(filters), len(filters)
    many = steps.shape[1]
    cell = (part[:, None] * many + np.arange(many)) * (n + 1) + steps

    def by_step(rows) -> np.ndarray:
        return np.bincount(cell[rows].ravel(), minlength=parts * many * (n + 1)).reshape(parts, many, n + 1)

    removed, total = by_step(slice(None))[:, :, :n], np.bincount(part, minlength=parts)
    bit = (fails[:, None] >> np.arange(n)) & 1
    failing = np.stack([np.bincount(part, bit[:, f], parts) for f in range(n)], axis=1).astype(np.int64)
    alone = bit.sum(axis=1) == 1
    unique = np.stack([np.bincount(part[alone], bit[alone, f], parts) for f in range(n)], axis=1).astype(np.int64)
    earned = np.stack([(removed * (of == f)).sum(axis=(1, 2)) for f in range(n)], axis=1)
    before = np.cumsum(removed, axis=2)
    return np.stack([total[:, None, None] - before, removed, failing[:, of] - removed, unique[:, of], by_step(good)[:, :, :n], by_step(toxic)[:, :, :n], earned[:, of]], axis=1)


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (part, fails, good, toxic): one row of counts a part and (order, step) ``cell``, summed within the task."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            flat = counts.reshape(len(COUNTS), -1)
            yield pa.RecordBatch.from_arrays([pa.array([part] * flat.shape[1], pa.string()), pa.array(np.arange(flat.shape[1], dtype=np.int32)), *map(pa.array, flat)], ["part", "cell", *COUNTS])
        held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        coded = batch.column("part").dictionary_encode()
        names = coded.dictionary.to_pylist()
        code, fails, good, toxic = (x.to_numpy(zero_copy_only=False) for x in (coded.indices, *(batch.column(c) for c in ("fails", "good", "toxic"))))
        for name, counts in zip(names, tally(fails.astype(np.int64), code.astype(np.int64), len(names), good.astype(bool), toxic.astype(bool)), strict=True):
            held[name] = held[name] + counts if name in held else counts
        if len(held) > HELD_PARTS:
            yield from out()
    yield from out()


def own_failures(text: Column) -> Column:
    """Failures that a text has by itself: A, B, C and D."""

    def bits(x: Column) -> Column:
        words, distinct = F.size(x["words"]), F.size(F.array_distinct(x["words"]))
        capitals = F.length(x["text"]) - F.length(F.translate(x["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
        failed = (
            words < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * words.cast("long"),
            100 * capitals.cast("long") > MOST_CAPITALS * F.length(x["text"]).cast("long"), x["text"].rlike(r"[#$%&*|]"),
        )
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))

    full = F.coalesce(text, F.lit(""))
    return let(F.struct(full.alias("text"), words_of(full).alias("words")), bits)


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, fails, good, toxic) of every document of ``docs`` (doc_id, source, text)."""
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own_failures(F.col("text")).alias("own"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))
    own, _ = materialise(own, "own-failures")
    first = own.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("is_first", F.lit(True))
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    joined = own.join(first, ["digest", "doc_id"], "left").join(marked, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return joined.select("doc_id", "part", (F.col("own") + F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).cast("int").alias("fails"), no("good"), no("toxic"))


def audit(failed: DataFrame) -> DataFrame:
    """The counts of every part, order and step over (part, fails, good, toxic)."""
    schema = "part string, cell int, " + ", ".join(f"{c} long" for c in COUNTS)
    sums = failed.select("part", "fails", "good", "toxic").mapInArrow(tallied, schema).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in COUNTS])
    n = len(FILTERS)
    names = F.array(*map(F.lit, orders()))
    return sums.select("part", F.get(names, F.floor(F.col("cell") / n).cast("int")).alias("filter_order"), (F.col("cell") % n + 1).cast("int").alias("step"), *COUNTS)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return audit(failures(docs.select("doc_id", "source", "text"), labels.select("doc_id", "quality", "toxic")))


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first_id FROM base GROUP BY t), lab AS (
  SELECT doc_id, max(coalesce(quality, 0) = 1) AS good, max(coalesce(toxic, 0) = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT b.part, len(b.w) < 50 AS a, 100 * len(list_distinct(b.w)) < 65 * len(b.w) AS b, 100 * length(regexp_replace(b.t, '[^A-Z]', '', 'g')) > 5 * length(b.t) AS c,
         regexp_matches(b.t, '[#$%&*|]') AS d, coalesce(b.doc_id > x.first_id, false) AS e, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic
  FROM base b JOIN firsts x ON b.t = x.t LEFT JOIN lab l ON b.doc_id = l.doc_id
), masks AS (
  SELECT part, good, toxic, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END) || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS fails,
         count(*) AS n FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM letters p, letters q, letters r, letters s, letters u
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5
), steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders), cells AS (
  SELECT m.part, s.filter_order, s.step, substr(s.filter_order, s.step, 1) AS letter, m.n, m.good, m.toxic, contains(m.fails, substr(s.filter_order, s.step, 1)) AS failed, length(m.fails) = 1 AS alone,
         regexp_matches(substr(s.filter_order, 1, s.step - 1), '[z' || m.fails || ']') AS gone
  FROM masks m, steps s
), sums AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone AND failed THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND failed AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND failed AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY ALL
)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
       toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM sums
"""
