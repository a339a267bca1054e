"""Low-discrepancy mixing: golden-ratio points mapped through the sources' cumulative targets give a slot schedule;
a source's k-th slot takes its k-th block of equally many words from its shuffled documents.

Targets: ``share`` of all words split by weight, none above ``most`` times its source's words, the excess shared
again by weight until none is above. Sources are a table like any other: their order, caps and shares are found by aggregates and running
sums, however many there are. A source's stream is its documents in hash order, ended by a short block
and then started anew; its last slot is trimmed so that the words taken meet the target to the word.

The schedule is the mix's order: each document is told its first slot and that slot's turn, and the mixed documents are written
in order of their turns.

Cases: a null text has no words and is never taken; sources with no words have target 0; a null source is a
source of its own, last in order; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import free_name, materialise, table, words_of

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Words in a block; rows in one running sum; slots ranked by one task; rows of a table of
#: sources or cells that is broadcast; larger ones are joined by shuffling.
BLOCK, RUN_ROWS, RUN_SLOTS, SOURCES = 1024, 2_000, 20_000, 100_000
#: Points of [0, 1) as whole numbers, bits of a half of one, the golden ratio among them (odd, so that points don't repeat).
HALF = 30
POINTS = 1 << 2 * HALF
GOLDEN = (math.isqrt(5 * POINTS * POINTS) - POINTS) // 2 | 1
#: Leading bits (cells) by which a point finds its source: an equality join, however many sources there are.
CELL_BITS = 12


def targets(sizes: list[float], weights: list[float], share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source."""
    left, open_, out = share * sum(sizes), [i for i, s in enumerate(sizes) if s > 0], [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def few(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``SOURCES`` rows."""
    return F.broadcast(df) if df.count() <= SOURCES else df


def in_order(per: DataFrame) -> DataFrame:
    """``per`` (source, ...) with ``sid``, its place from 0 in order of code points, null last: ranges are sorted apart and counted."""
    low = (1 << 33) - 1
    placed, _ = materialise(per.orderBy(F.col("source").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumns({"part": F.shiftright("m", 33), "at": F.col("m").bitwiseAND(F.lit(low))}).drop("m")
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(first), "part").withColumn("sid", F.col("first") + F.col("at")).drop("at", "first")


def level(ranked: DataFrame, share: float, most: float) -> float:
    """Words that a unit of weight gets: the common level above which sources are capped. Each round caps all sources above the level
    of the round before and shares their excess, until no more are; every round is one aggregate."""
    total = ranked.agg(F.sum("words").alias("n")).first().n or 0
    at, full = 0.0, -1
    while True:
        capped = (F.col("words") > 0) & (F.col("weight") * at > most * F.col("words")) if full >= 0 else F.lit(False)
        r = ranked.agg(F.count_if(capped).alias("full"), F.sum(F.when(capped, F.col("words")).otherwise(0)).alias("taken"), F.sum(F.when(~capped & (F.col("words") > 0), F.col("weight")).otherwise(0.0)).alias("open")).first()
        if not r.open:
            return math.inf if r.full else 0.0
        if r.full == full:
            return at
        at, full = (share * total - most * r.taken) / r.open, r.full


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """One row a source: number, words, target, blocks in a pass, slots, and its span [low, high) of the shares."""
    per = sized.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
    ranked, _ = materialise(in_order(per).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))), "ranked-sources")
    at = level(ranked, share, most)
    cap = F.col("words") * F.lit(float(most))
    goal = F.when(F.col("words") == 0, 0.0).when(F.lit(math.isinf(at)), cap).otherwise(F.least(cap, F.col("weight") * (0.0 if math.isinf(at) else at)))
    wanted = ranked.withColumn("target", goal).withColumn("take", F.least(F.bround("target").cast("long"), F.floor(cap)))
    inner = Window.partitionBy("part").orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    wanted, _ = materialise(wanted.withColumn("inner", F.coalesce(F.sum("target").over(inner), F.lit(0.0))), "targets")
    sums = wanted.groupBy("part").agg(F.sum("target").alias("n"))
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("first"))
    total = wanted.agg(F.sum("target").alias("n")).first().n or 1.0
    whole = F.ceil(F.col("words") / F.lit(block))
    slots = F.when(F.col("words") == 0, 0).otherwise(F.floor(F.col("take") / F.col("words")) * whole + F.ceil((F.col("take") % F.col("words")) / F.lit(block)))
    low = F.col("first") + F.col("inner")
    out = wanted.join(F.broadcast(sums), "part").select(
        "sid", "source", F.col("words").alias("source_size"), "target", "take", whole.cast("long").alias("pass_blocks"), slots.cast("long").alias("slots"), (low / total).alias("low"), ((low + F.col("target")) / total).alias("high"),
        F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(RUN_ROWS))).cast("long").alias("runs"),
    )
    return materialise(out, "plan")[0]


def golden_point(n: Column) -> Column:
    """``n`` times the golden ratio modulo one, in units of 2^-60: exact, in products of halves that fit 64 bits."""
    half = 1 << HALF
    a, b, high, low = F.shiftright(n, HALF), n.bitwiseAND(F.lit(half - 1)), GOLDEN >> HALF, GOLDEN & (half - 1)
    upper = ((a * F.lit(low)) % half + (b * F.lit(high)) % half) % half
    return (upper * half + b * F.lit(low)) % POINTS


def schedule(sources: DataFrame) -> DataFrame:
    """(sid, k, turn): the k-th slot of each source in the global order of golden-ratio points. As many points are drawn as
    slots are wanted; those that a source lacks then follow the last point, the sources taking turns, so that each
    slot of each source is there once."""
    spark = sources.sparkSession
    r = sources.agg(F.sum("slots").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    n = r.n or 0
    edge = lambda c: F.least((F.col(c) * F.lit(float(POINTS))).cast("long"), F.lit(POINTS))
    spans = sources.filter("slots > 0").select("sid", "slots", edge("low").alias("low"), edge("high").alias("high"))
    cell = lambda c: F.shiftright(c, 2 * HALF - CELL_BITS)
    cells = spans.filter("high > low").withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high") - 1))))
    marked = spark.range(n).select("id", golden_point(F.col("id") + 1).alias("point")).withColumn("cell", cell(F.col("point"))).join(few(cells), "cell")
    marked = marked.filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).drop("cell")
    marked = marked.withColumn("run", F.floor(F.col("id") / RUN_SLOTS))
    counts, _ = materialise(marked.groupBy("sid", "run").agg(F.count(F.lit(1)).alias("n")), "slot-runs")
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("sid", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = marked.withColumn("rank", F.row_number().over(Window.partitionBy("sid", "run").orderBy("id")))
    out = ranked.join(first, ["sid", "run"]).withColumn("k", F.col("first") + F.col("rank") - 1).filter(F.col("k") < F.col("slots"))
    got = spans.join(counts.groupBy("sid").agg(F.sum("n").alias("got")), "sid", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    late = got.filter("got < slots").withColumn("k", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)))
    late = late.select("sid", "k", (n + (F.col("k") - F.col("got")) * r.sources + F.col("sid")).alias("turn"))
    return out.select("sid", "k", F.col("id").alias("turn")).unionByName(late)


def streams(sized: DataFrame, sources: DataFrame, seed: str = "mix") -> DataFrame:
    """``sized`` (rid, source, size) with sid and ``start``, the words before the document in its source's shuffled stream."""
    keyed = sized.join(few(sources.select("sid", F.col("source").alias("of"), "runs")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("crc")))
    keyed = keyed.withColumn("run", F.pmod(F.col("h"), F.col("runs")))
    sums = keyed.groupBy("sid", "run").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    first, _ = materialise(sums.select("sid", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "stream-runs")
    within = Window.partitionBy("sid", "run").orderBy("h", "doc_id", "crc", "rid").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return ranked.join(first, ["sid", "run"]).withColumn("start", F.col("first") + F.col("inner")).drop("first", "inner", "runs", "run", "h")


def mix(docs: DataFrame, block: int = BLOCK, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For documents that carry a unique ``rid``: their streams (rid, doc_id, source, size, crc, sid, start), the
    sources' plan, and the pieces taken: (sid, k, rid, pass, at, words, turn), where ``at`` is the piece's first
    word within its document and ``turn`` its slot's place in the mix."""
    sized = docs.select(
        "rid", "doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("crc"),
    )
    sized, _ = materialise(sized, "sized")
    sources = plan(sized, block=block, **how)
    stream, _ = materialise(streams(sized, sources), "streams")
    spans = stream.filter(F.col("size") > 0).join(few(sources.select("sid", "source_size", "take", "pass_blocks")), "sid")
    passes = F.sequence(F.lit(0), F.lit(math.ceil(how.get("most", MOST)) - 1))
    pieces = spans.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    pieces = pieces.withColumn("pass", F.explode(passes)).withColumn("k", F.col("b") + F.col("pass") * F.col("pass_blocks"))
    first = F.greatest(F.col("start"), F.col("b") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("b") + 1) * block, F.col("take") - F.col("pass") * F.col("source_size"))
    pieces = pieces.select("rid", "sid", "k", "pass", (first - F.col("start")).alias("at"), (end - first).alias("words")).filter("words > 0")
    return stream, sources, pieces.join(schedule(sources), ["sid", "k"])


def query(spark, sf_dir: str) -> DataFrame:
    """A row a document: what the mix takes of it, and when first: the turn of its first slot and that slot's number in its source (null
    for a document that isn't taken)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("rid", F.monotonically_increasing_id())
    stream, sources, pieces = mix(docs)
    taken = pieces.groupBy("rid").agg(F.sum("words").alias("taken"), F.min("turn").alias("first_turn"), F.min("k").alias("first_slot"))
    return (
        stream.join(taken, "rid", "left").join(few(sources.select("sid", "source_size", "target")), "sid")
        .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_turn", "first_slot")
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Whole documents of the mix in its order: one row for each pass over its source that takes at least half of the document's
    words, so a document taken twice stands there twice, where the schedule has the first slot of each. The columns are those of ``docs``."""
    rid, turn = free_name(docs, "mix_rid"), free_name(docs, "mix_turn")
    keyed, _ = materialise(docs.withColumn(rid, F.monotonically_increasing_id()), "mix-docs")
    stream, _, pieces = mix(keyed.select(F.col(f"`{rid}`").alias("rid"), "doc_id", "source", "text"), **how)
    taken = pieces.groupBy("rid", "pass").agg(F.sum("words").alias("words"), F.min("turn").alias("turn")).join(stream.select("rid", "size"), "rid")
    taken = taken.filter(2 * F.col("words") >= F.col("size")).select(F.col("rid").alias(rid), F.col("turn").alias(turn))
    taken, _ = materialise(taken, "taken")
    return keyed.join(taken, rid).orderBy(turn, "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])
