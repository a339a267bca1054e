"""Source divergence audit: how far each source's words are from the other sources' of its language, and which words set it apart.

Terms with the same sparse vector of (source, count) weigh the same in every comparison, so they are one row with a
multiplicity: each pair of sources is evaluated once a distinct vector. Vectors are dealt over hash salts and sources over blocks,
so a task holds a bounded matrix however common a language is; block sums are added by Spark. Terms are ranked by themselves.

Shares are whole numbers, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), found by two divisions that fit 64 bits up to 9e13
words a language; the divergence of two shares is floor((p - q)^2 / (p + q)).

Cases: null text, lang and source are empty strings; a document without terms still makes its (lang, source) occur; a
language without kept terms has pairs of value 0 and no term rows; repeated rows are documents of their own; ties are ranked
by the item's bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import materialise, table
from sievework.llm.hashing import text_chunks

LEAST_DOCS, SMOOTH, TOP = 10, 2, 10
SCALE = (10**5, 10**4)
#: Sources in a block of comparisons; vectors that one task compares at a time.
BLOCK, VECTORS = 128, 20_000
#: Bytes of a term: ASCII letters, made small, and all that isn't ASCII; the others part terms.
TERM_BYTES = np.full(256, 32, np.uint8)
TERM_BYTES[65:91] = np.arange(97, 123)
TERM_BYTES[97:123] = np.arange(97, 123)
TERM_BYTES[128:] = np.arange(128, 256)


def term_lists(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(text of each term, terms) of a run of texts, in order."""
    plain = np.append(TERM_BYTES[data], np.uint8(32))
    letter = plain != 32
    before = np.append(False, letter[:-1])
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(letter & ~before)
    ends = np.flatnonzero(letter & np.append(~letter[1:] | np.isin(np.arange(1, len(plain)), cuts, assume_unique=True), True)) + 1 if len(starts) else starts
    bounds = np.empty(2 * len(starts) + 1, np.int64)
    bounds[0:-1:2], bounds[1::2], bounds[-1] = starts, ends, ends[-1] if len(ends) else 0
    every = pa.LargeStringArray.from_buffers(2 * len(starts), pa.py_buffer(bounds.tobytes()), pa.py_buffer(plain.tobytes()))
    return np.searchsorted(offsets, starts, "right") - 1, every.take(pa.array(np.arange(0, 2 * len(starts), 2)))


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, source, text): (lang, source, term, occ, docs) summed within each run of texts."""
    for batch in batches:
        for a, offsets, data in text_chunks(batch.column("text")):
            owner, terms = term_lists(offsets, data)
            if not len(owner):
                continue
            part = batch.slice(a, len(offsets) - 1)
            pair = pa.StructArray.from_arrays([part.column("lang").cast(pa.string()), part.column("source").cast(pa.string())], ["lang", "source"])
            names = pa.Table.from_arrays([pair.field(0), pair.field(1), pa.array(np.arange(len(pair)))], ["lang", "source", "row"])
            groups = names.group_by(["lang", "source"], use_threads=False).aggregate([("row", "list")])
            of = np.empty(len(pair), np.int64)
            for k, rows in enumerate(groups["row_list"].combine_chunks()):
                of[rows.values.to_numpy()] = k
            coded = terms.dictionary_encode()
            code, n = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            once, occ = np.unique(owner * n + code, return_counts=True)
            cell, at = np.unique(of[once // n] * n + once % n, return_inverse=True)
            total, docs = np.bincount(at, occ).astype(np.int64), np.bincount(at)
            group = pa.array(cell // n)
            yield pa.RecordBatch.from_arrays(
                [groups["lang"].combine_chunks().take(group), groups["source"].combine_chunks().take(group), coded.dictionary.take(pa.array(cell % n)).cast(pa.string()), pa.array(total), pa.array(docs.astype(np.int64))],
                ["lang", "source", "term", "occ", "docs"],
            )


def share(count, words, terms, div, lit=lambda x: x):
    """p of a count among ``words`` words of ``terms`` kept terms; ``div`` is the whole quotient."""
    a, whole = (count + lit(SMOOTH)) * lit(SCALE[0]), words + lit(SMOOTH) * terms
    return lit(1) + div(a, whole) * lit(SCALE[1]) + div((a % whole) * lit(SCALE[1]), whole)


def whole_quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def compared(_, left: pa.Table, right: pa.Table) -> pa.Table:
    """For a cogroup of vectors (sources, occs, many) with the sources of two blocks (source, words, terms, first, second): the sums
    (lang, source, other, value) of the divergence of each source of the one block from each of the other."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    names, lists = right["source"].combine_chunks(), left["sources"].combine_chunks()
    column = pc.fill_null(pc.index_in(lists.flatten(), value_set=names), -1).to_numpy()
    row, occ = np.repeat(np.arange(left.num_rows), pc.list_value_length(lists).to_numpy()), left["occs"].combine_chunks().flatten().to_numpy()
    counts, in_block = np.zeros((left.num_rows, len(names)), np.int64), column >= 0
    counts[row[in_block], column[in_block]] = occ[in_block]
    words, terms, many = right["words"].to_numpy(), right["terms"].to_numpy(), left["many"].to_numpy()
    with np.errstate(divide="ignore"):
        p = share(counts, words[None, :], terms[None, :], np.floor_divide)
    first, second = (np.flatnonzero(right[c].to_numpy()) for c in ("first", "second"))
    own, other, value = [], [], []
    for i in first:
        gap = p[:, second] - p[:, [i]]
        sums = many @ (gap * gap // (p[:, second] + p[:, [i]]))
        for j, v in zip(second, sums.tolist(), strict=True):
            if i != j:
                own, other, value = own + [i], other + [j], value + [v]
    if first.tolist() != second.tolist():  # two blocks: each pair stands once above
        own, other, value = own + other, other + own, value + value
    name = lambda at: names.take(pa.array(at, pa.int64())).cast(pa.string())
    lang = pa.array([left["lang"][0].as_py()] * len(own), pa.string())
    return pa.Table.from_arrays([lang, name(own), name(other), pa.array(value, pa.int64())], schema=schema)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, sources, occs) of each term that enough documents of its language hold; ``docs`` has (lang, source, text)."""
    counts = docs.mapInArrow(counted, "lang string, source string, term string, occ long, docs long")
    counts = counts.groupBy("lang", "source", "term").agg(F.sum("occ").alias("occ"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "occ"))).alias("of")).filter(F.col("docs") >= least)
    return terms.select("lang", "term", F.col("of.source").alias("sources"), F.col("of.occ").alias("occs"))


def pair_sums(kept: DataFrame, groups: DataFrame, block: int = BLOCK, vectors: int = VECTORS) -> DataFrame:
    """(lang, source, other, value) over the terms ``kept``; ``groups`` is (lang, source, words, terms). Pairs without a row have value 0."""
    vec, at = materialise(kept.groupBy("lang", "sources", "occs").agg(F.count(F.lit(1)).alias("many")), "vectors")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    placed = groups.withColumn("block", F.floor(number / block).cast("int"))
    size = vec.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / F.lit(vectors)).cast("int").alias("salts"))
    plan, _ = materialise(size.join(placed.groupBy("lang").agg((F.max("block") + 1).alias("blocks")), "lang"), "comparisons")
    met = plan.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("j", F.explode(F.sequence("i", F.col("blocks") - 1)))
    left = vec.join(met, "lang").select("lang", "i", "j", F.pmod(F.xxhash64("sources", "occs"), F.col("salts")).cast("int").alias("salt"), "sources", "occs", "many")
    ends = F.explode(F.array_distinct(F.array("i", "j")))
    right = met.withColumn("block", ends).join(placed, ["lang", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = ("lang", "i", "j", "salt")
    right = right.select(*[F.col(c).alias(f"of_{c}") for c in key], "source", "words", "terms", (F.col("block") == F.col("i")).alias("first"), (F.col("block") == F.col("j")).alias("second"))
    found = left.groupBy(*key).cogroup(right.groupBy(*[f"of_{c}" for c in key])).applyInArrow(compared, "lang string, source string, other string, value long")
    return found.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, block: int = BLOCK, vectors: int = VECTORS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks the other sources of a language, part ``term`` the terms that
    a source uses more than its language."""
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    plain = docs.select(empty("lang"), empty("source"), empty("text"))
    kept, _ = materialise(kept_terms(plain, least), "kept-terms")
    used = kept.select("lang", F.explode(F.arrays_zip("sources", "occs")).alias("u")).groupBy("lang", F.col("u.sources").alias("source")).agg(F.sum("u.occs").alias("words"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    nil = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    groups = plain.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(terms, "lang", "left")
    groups, _ = materialise(groups.select("lang", "source", nil("words"), nil("terms")), "groups")
    others = groups.select("lang", F.col("source").alias("other"))
    pairs = groups.select("lang", "source").join(others, "lang").filter("source <> other").join(pair_sums(kept, groups, block, vectors), ["lang", "source", "other"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), nil("value"))
    whole = groups.groupBy("lang").agg(F.sum("words").alias("all_words"))
    rows = kept.select("lang", "term", F.explode(F.arrays_zip("sources", "occs")).alias("u"), F.aggregate("occs", F.lit(0).cast("long"), lambda a, x: a + x).alias("all"))
    rows = rows.select("lang", "term", "all", F.col("u.sources").alias("source"), F.col("u.occs").alias("occ")).join(groups, ["lang", "source"]).join(whole, "lang")
    lit = lambda x: F.lit(x).cast("long")
    rows = rows.withColumn("p", share(F.col("occ"), F.col("words"), F.col("terms"), whole_quotient, lit)).withColumn("q", share(F.col("all"), F.col("all_words"), F.col("terms"), whole_quotient, lit))
    gap = F.col("p") - F.col("q")
    rows = rows.filter("occ > 0 AND p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), whole_quotient(gap * gap, F.col("p") + F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(rows).filter(F.col("rank") <= top))


def query(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), uses AS (SELECT r, lang, source, unnest(w) AS term FROM base), per AS (SELECT r, lang, source, term, count(*) AS n FROM uses GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM per GROUP BY lang, term HAVING count(*) >= 10),
used AS (SELECT p.lang, p.source, p.term, sum(p.n) AS n FROM per p JOIN kept k ON p.lang = k.lang AND p.term = k.term GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM base), v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
g AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(u.n) FROM used u WHERE u.lang = g.lang AND u.source = g.source), 0) AS n FROM groups g LEFT JOIN v ON g.lang = v.lang),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)::HUGEINT) // (g.n + 2 * g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n + 2)::HUGEINT) // (v.n + 2 * v.v)::HUGEINT AS q
  FROM g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows_ AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM dense WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows_)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
