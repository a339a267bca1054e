"""Exact n-gram Jaccard join with set relations: documents whose sets of three-word shingles overlap by 0.9, as connected groups.

Sets are ordered rarest shingle first, so that two sets that link share a shingle among the first tenth of both. These
prefixes give index lists (shingle; set, size, position).

Index level: entries of a list with one size and position are a block. Whether two sets can link depends on their sizes and
positions alone, so pairs of blocks are judged first and the entries of those that fail are skipped unread; so are blocks
whose sets are all in one group already.

Answer level: each set is compared with the smallest set of its lists, its leader if they link. A group's answers for
another set come from the leader's: an overlap with the leader bounds the overlap with each member from both sides by what
the member adds to the leader and lacks of it. Only pairs that the bounds leave open are worked out, and then from the
leader's overlap and the members' differences, not from whole sets. Pairs inside one group are never made.

The order needs no exact counts, since any fixed order gives exact results: tasks count the shingles that repeat within a window of
texts, the sums are halved to at most ``HEAVY`` frequent shingles, which are broadcast, and all others count as rare.

Each set also has a parity sketch, whose bits every shingle flips one of: where two sketches differ in more bits than two linked sets
may differ in shingles, the pair is dropped before any set is fetched. Such a pair can't link, whatever the hashes.

Sets are compared by 64-bit hashes of their shingles: two different shingles of a pair of sets of 10,000 share one with odds
below 1e-11. Equal sets are one class, known by size and 128 bits.

Cases: a null or blank text has an empty set and is a group of its own; fewer than three words are one shingle; repeated rows and
texts that differ only in the case of A to Z or in white space are of one class; documents without a doc_id are linked like
others, and a group of such alone has a null component_id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm import hashing
from sievework.llm.common import drop_path, materialise, table
from sievework.llm.graph import components

SHINGLE = 3
#: A pair links when OVER * (sum of sizes) <= TOTAL * overlap, which is Jaccard 0.9.
OVER, TOTAL = 9, 19
#: Shingles of a counting window; local repeats that make a shingle frequent; frequent shingles at most; ids broadcast to fetch texts.
WINDOW, FREQUENT, HEAVY, BROADCAST_KEYS = 1 << 21, 4, 1_000_000, 100_000
#: Entries up to which a list's sets are compared with each other at once, without a head first.
SHORT = 8
#: Least and most bits of a parity sketch, which has about two a shingle; 64-bit words of its folded form in the index lists.
LEAST_BITS, MOST_BITS, FOLDED = 256, 1 << 16, 4
U = np.uint64


def plain_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, its hash) in order: runs of bytes other than white space, A to Z made small."""
    n = len(data)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    if not ink.any():
        return np.zeros(0, np.int64), np.zeros(0, U)
    before = np.append(False, ink[:-1])
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(ink & ~before)
    folded = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * 32
    prefix = np.zeros(n + 1, U)
    np.cumsum(hashing.byte_values(3)[folded] * hashing.powers(n) * ink, out=prefix[1:])
    total = prefix[np.append(starts[1:], n)] - prefix[starts]
    return np.searchsorted(offsets, starts, "right") - 1, hashing.mix(total * hashing.powers(n, hashing.INVERSE)[starts])


def sets(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every distinct shingle of each text, sorted."""
    owner, shingle = hashing.shingles(*plain_words(offsets, data), SHINGLE)
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def digests(n: int, owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two 64-bit sums of each text's set."""
    one, two = np.zeros(n, U), np.zeros(n, U)
    np.add.at(one, owner, hashing.mix(shingle ^ U(0x6A09E667F3BCC909)))
    np.add.at(two, owner, hashing.mix(shingle + U(0xBB67AE8584CAA73B)))
    return np.bincount(owner, minlength=n), one, two


def parities(n: int, owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, words) of each text's sketch: every shingle flips one of its bits. A sketch of twice the bits, its halves joined bit by
    bit, is the sketch of half as many."""
    bits = np.clip(2 << np.ceil(np.log2(np.maximum(np.bincount(owner, minlength=n), 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    ends = np.append(0, np.cumsum(bits))
    at = ends[:-1][owner] + (hashing.mix(shingle ^ U(0x3C6EF372FE94F82B)) & (bits[owner] - 1).astype(U)).astype(np.int64)
    odd = (np.bincount(at, minlength=int(ends[-1])) & 1).astype(np.uint8)
    return (ends // 64).astype(np.int32), np.packbits(odd).view(np.int64)


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (text): (shingle, n) of the shingles of two or more different sets of a window."""
    held, seen, size = [], set(), 0

    def out() -> pa.RecordBatch:
        value, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1])], ["shingle", "n"])

    for batch in batches:
        for _, offsets, data in hashing.text_chunks(batch.column("text")):
            n = len(offsets) - 1
            owner, shingle = sets(offsets, data)
            key = list(zip(*(x.tolist() for x in digests(n, owner, shingle)), strict=True))
            fresh = np.zeros(n, bool)
            for i, k in enumerate(key):
                fresh[i] = k not in seen
                seen.add(k)
            held.append(shingle[fresh[owner]])
            size += len(held[-1])
            if size >= WINDOW:
                yield out()
                held, seen, size = [], set(), 0
    if size:
        yield out()


def prefix_size(n):
    """How many of a set's first shingles meet the first ones of every set that it links with."""
    return n - (9 * n + 9) // 10 + 1


def frequent(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their local repeats: at most ``HEAVY`` of them, the threshold doubled until so few are left."""
    counts, path = materialise(docs.select("text").mapInArrow(repeats, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT), "repeats")
    level = F.floor(F.log2("n")).cast("int")
    left, least = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}, FREQUENT
    while sum(left.values()) > HEAVY:
        left.pop(min(left))
        least = 1 << min(left) if left else 1 << 62
    found = counts.filter(F.col("n") >= least).toArrow()
    drop_path(docs.sparkSession, path)
    value, n = found["shingle"].to_numpy().view(U), found["n"].to_numpy()
    order = np.argsort(value)
    return value[order], n[order]


def prefixes(docs: DataFrame) -> DataFrame:
    """(doc_id, md5, n, one, two, prefix, odd) of each row of ``docs`` (doc_id, md5, text)."""
    held = docs.sparkSession.sparkContext.broadcast(frequent(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, often = held.value
        for batch in batches:
            for a, offsets, data in hashing.text_chunks(batch.column("text")):
                rows = len(offsets) - 1
                owner, shingle = sets(offsets, data)
                n, one, two = digests(rows, owner, shingle)
                rank = np.zeros(len(shingle), np.int64)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, shingle), len(heavy) - 1)
                    rank = np.where(heavy[at] == shingle, often[at], 0)
                order = np.lexsort((shingle, rank, owner))
                start = np.cumsum(n) - n
                keep = np.arange(len(owner)) - start[owner] < prefix_size(n)[owner]
                ends = np.append(0, np.cumsum(np.where(n > 0, prefix_size(n), 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle[order][keep].view(np.int64)))
                at, words = parities(rows, owner, shingle)
                odd = pa.ListArray.from_arrays(pa.array(at), pa.array(words))
                part = batch.slice(a, rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("md5"), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists, odd], ["doc_id", "md5", "n", "one", "two", "prefix", "odd"])

    return docs.mapInArrow(run, "doc_id long, md5 binary, n long, one long, two long, prefix array<long>, odd array<long>")


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, text): (node, shingles)."""
    for batch in batches:
        for a, offsets, data in hashing.text_chunks(batch.column("text")):
            rows = len(offsets) - 1
            owner, shingle = sets(offsets, data)
            ends = np.append(0, np.cumsum(np.bincount(owner, minlength=rows))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(shingle.view(np.int64)))], ["node", "shingles"])


def enough(overlap: Column, a: Column, b: Column) -> Column:
    return TOTAL * overlap >= OVER * (a + b)


def may_link(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """Whether sets of ``n`` and ``m`` shingles whose first common one stands at these positions can link."""
    return enough(F.least(n - pos, m - at), n, m)


def folded(odd: Column) -> Column:
    """A parity sketch of ``FOLDED`` words: words that stand as far apart are joined bit by bit."""
    return F.array(*[F.aggregate(F.filter(F.transform(odd, lambda x, i: F.when(i % FOLDED == k, x)), lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x)) for k in range(FOLDED)])


def differing(x: Column, y: Column) -> Column:
    """Bits in which two sketches differ; sets that can link have sketches of one size or of twice the size."""
    half = lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) / 2), F.slice(v, F.size(v) / 2 + 1, F.size(v) / 2), lambda a, b: a.bitwiseXOR(b))
    left, right = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    return F.aggregate(F.zip_with(left, right, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, n: t + n)


def close_enough(bits: Column, n: Column, m: Column) -> Column:
    return TOTAL * bits <= (TOTAL - 2 * OVER) * (n + m)


def bounded(rows: DataFrame) -> DataFrame:
    """``rows`` of a few ids, written and counted: broadcast if they are few, so that what they are joined with isn't shuffled."""
    rows, _ = materialise(rows, "keys")
    return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows


def may_overlap(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, ...) whose parity sketches differ in no more bits than linked sets may."""
    pairs = bounded(pairs)
    side = lambda k, x, n: classes.select(F.col("node").alias(k), F.col("odd").alias(x), F.col("n").alias(n))
    met = pairs.join(side("a", "_x", "_n"), "a").join(side("b", "_y", "_m"), "b")
    return met.filter(close_enough(differing(F.col("_x"), F.col("_y")), F.col("_n"), F.col("_m"))).select(*pairs.columns)


def sets_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(node, shingles) of the classes ``nodes``, from the text of each one's first document; those of ``known`` aren't fetched again."""
    nodes = nodes.distinct() if known is None else nodes.distinct().join(known.select("node"), "node", "left_anti")
    wanted, path = materialise(classes.join(nodes, "node", "left_semi").select("node", F.col("doc_id").alias("of"), F.col("md5").alias("of_md5")), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    found = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("md5") == F.col("of_md5"))).select("node", "text")
    out, at = materialise(found.mapInArrow(whole_sets, "node long, shingles array<long>"), "sets")
    drop_path(docs.sparkSession, path)
    return (out if known is None else known.unionByName(out)), [at]


def overlaps(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the size of both sets' intersection, each pair once. Only the sets of a pair are shuffled, to its ``b``."""
    pairs = bounded(pairs)
    left, right = of.select(F.col("node").alias("a"), F.col("shingles").alias("x")), of.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    met = left.join(pairs, "a").join(right.join(pairs.select("b").distinct(), "b", "left_semi"), "b")
    return met.select(*pairs.columns, F.size("x").cast("long").alias("n"), F.size("y").cast("long").alias("m"), F.size(F.array_intersect("x", "y")).cast("long").alias("overlap")).dropDuplicates(["a", "b"])


def index_lists(classes: DataFrame) -> DataFrame:
    """(shingle, many, node, n, pos, band, few) of the lists with two entries or more, one entry a class; ``many`` counts a list's entries,
    ``few`` is the set's folded sketch."""
    entries = classes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "shingle"))
    shared = entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    both = entries.join(shared, "shingle")
    both = both.join(classes.select("node", folded(F.col("odd")).alias("few")), "node")
    return both.select("shingle", "many", "node", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), F.floor(F.log("n") / float(np.log(10 / 9))).cast("int").alias("band"), "few")


def star_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): each set and the head of its size's band in each of its longer lists, where the two can link. The head is the set in which
    the shingle comes first, which has the fewest rare ones: the middle of a family of copies."""
    lists = lists.filter(F.col("many") > SHORT)
    heads = lists.groupBy("shingle", "band").agg(F.min(F.struct("pos", "n", "node", "few")).alias("head"))
    near = may_link(F.col("n"), F.col("pos"), F.col("head.n"), F.col("head.pos")) & close_enough(differing(F.col("few"), F.col("head.few")), F.col("n"), F.col("head.n"))
    return lists.join(heads, ["shingle", "band"]).filter((F.col("node") != F.col("head.node")) & near).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()


def block_pairs(lists: DataFrame) -> DataFrame:
    """(x, y): pairs of sets of different groups that share an entry and can link; ``lists`` has the group of each entry (label).
    Blocks of one list are judged against each other before their entries are."""
    long = lists.filter(F.col("many") > SHORT)
    split = long.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("shingle")
    mixed = lists.filter(F.col("many") <= SHORT).unionByName(long.join(split, "shingle", "left_semi")).select("shingle", "node", "n", "pos", "label", "few")
    mixed, _ = materialise(mixed, "mixed-lists")
    blocks = mixed.groupBy("shingle", "n", "pos").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    others = blocks.select("shingle", F.col("n").alias("m"), F.col("pos").alias("at"), F.col("low").alias("low_y"), F.col("high").alias("high_y"))
    met = blocks.join(others, "shingle").filter((F.struct("n", "pos") <= F.struct(F.col("m").alias("n"), F.col("at").alias("pos"))) & may_link(F.col("n"), F.col("pos"), F.col("m"), F.col("at")))
    met = met.filter(~((F.col("low") == F.col("high")) & (F.col("low_y") == F.col("high_y")) & (F.col("low") == F.col("low_y")))).select("shingle", "n", "pos", "m", "at")
    right = mixed.select("shingle", F.col("n").alias("m"), F.col("pos").alias("at"), F.col("node").alias("y"), F.col("label").alias("label_y"), F.col("few").alias("few_y"))
    near = (F.col("label") != F.col("label_y")) & close_enough(differing(F.col("few"), F.col("few_y")), F.col("n"), F.col("m"))
    pairs = right.join(mixed.join(met, ["shingle", "n", "pos"]), ["shingle", "m", "at"]).filter(near)
    return pairs.select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y")).distinct()


def derived(pairs: DataFrame, stars: DataFrame, docs: DataFrame, classes: DataFrame, of: DataFrame) -> DataFrame:
    """Links (a, b) among ``pairs`` (x, y), from the overlaps of their leaders. ``stars`` has (a, b, n, m, overlap) of the sets that were
    compared with the smallest of a list, ``of`` the sets fetched for that."""
    led = stars.filter(enough(F.col("overlap"), F.col("n"), F.col("m"))).groupBy("a").agg(F.min(F.struct("b", "n", "m", "overlap")).alias("s"))
    led = led.select(F.col("a").alias("node"), F.col("s.b").alias("leader"), (F.col("s.n") - F.col("s.overlap")).alias("gain"), (F.col("s.m") - F.col("s.overlap")).alias("loss"))
    size = classes.select("node", "n")
    side = lambda k: size.join(led, "node", "left").select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.coalesce("leader", "node").alias(f"l{k}"), F.coalesce("gain", F.lit(0)).alias(f"gain_{k}"), F.coalesce("loss", F.lit(0)).alias(f"loss_{k}"))
    named, _ = materialise(pairs.join(side("x"), "x").join(side("y"), "y"), "pairs")
    nodes = named.select(F.col("lx").alias("node")).unionByName(named.select(F.col("ly").alias("node")))
    of, paths = sets_of(docs, classes, nodes, of)
    leaders = named.select(F.least("lx", "ly").alias("a"), F.greatest("lx", "ly").alias("b")).distinct()
    known, _ = materialise(overlaps(leaders, of), "leaders")
    linked = enough(F.col("overlap"), F.col("n"), F.col("m"))
    links = known.filter(linked).select("a", "b")
    base = known.filter(~linked).select("a", "b", "overlap")
    open_ = named.filter("x <> lx OR y <> ly").withColumns({"a": F.least("lx", "ly"), "b": F.greatest("lx", "ly")}).join(base, ["a", "b"]).drop("a", "b")
    open_ = open_.filter(enough(F.col("overlap") + F.col("gain_x") + F.col("gain_y"), F.col("n_x"), F.col("n_y")))
    sure = enough(F.col("overlap") - F.col("loss_x") - F.col("loss_y"), F.col("n_x"), F.col("n_y"))
    open_, _ = materialise(open_.withColumn("sure", sure), "open")
    links = links.unionByName(open_.filter("sure").select(F.col("x").alias("a"), F.col("y").alias("b")))
    rest = open_.filter("NOT sure").drop("sure")
    if not rest.limit(1).count():
        return materialise(links, "links")[0]
    members = rest.select(F.col("x").alias("node")).unionByName(rest.select(F.col("y").alias("node"))).distinct()
    whole, more = sets_of(docs, classes, members, of)
    of_leader = bounded(members.join(led.select("node", "leader"), "node"))
    lead = whole.select(F.col("node").alias("leader"), F.col("shingles").alias("theirs")).join(of_leader.select("leader").distinct(), "leader", "left_semi")
    change = whole.join(of_leader, "node").join(lead, "leader")
    change, _ = materialise(change.select("node", F.array_except("shingles", "theirs").alias("added"), F.array_except("theirs", "shingles").alias("lacked")).dropDuplicates(["node"]), "differences")

    def moved(rows: DataFrame, member: str, other: str) -> DataFrame:
        """``rows`` with ``overlap`` of ``other`` and a leader made that of ``other`` and the leader's ``member``."""
        rows = bounded(rows)
        mine, theirs = change.withColumnRenamed("node", member), whole.select(F.col("node").alias(other), "shingles").dropDuplicates([other])
        met = theirs.join(rows, other).join(mine, member, "left")
        own = lambda c: F.coalesce(F.size(F.array_intersect(c, "shingles")), F.lit(0))
        plus = F.when(F.col("added").isNull(), 0).otherwise(own("added") - own("lacked"))
        return met.withColumn("overlap", F.col("overlap") + plus).drop("added", "lacked", "shingles")

    m = size.select(F.col("node").alias("ly"), F.col("n").alias("n_ly"))
    half = moved(rest.select("x", "lx", "ly", "n_x", "overlap").distinct(), "x", "ly").join(m, "ly")
    half, _ = materialise(half, "to-leaders")
    near = enough(F.col("overlap"), F.col("n_x"), F.col("n_ly"))
    links = links.unionByName(half.filter(near).select(F.col("x").alias("a"), F.col("ly").alias("b")))
    last = rest.drop("overlap").join(half.filter(~near).select("x", "ly", "overlap"), ["x", "ly"]).filter(enough(F.col("overlap") + F.col("gain_y"), F.col("n_x"), F.col("n_y")))
    last = moved(last.select("x", "y", "n_x", "n_y", "overlap"), "y", "x").filter(enough(F.col("overlap"), F.col("n_x"), F.col("n_y")))
    links = links.unionByName(last.select(F.col("x").alias("a"), F.col("y").alias("b")))
    out, _ = materialise(links, "links")
    for path in paths + more:
        drop_path(docs.sparkSession, path)
    return out


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    keyed = docs.select("doc_id", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("md5"), F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = materialise(prefixes(keyed), "prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "md5"))
    classes = rows.filter("n > 0").groupBy("n", "one", "two").agg(first.alias("f"), F.first("prefix").alias("prefix"), F.first("odd").alias("odd"))
    classes = classes.select(F.monotonically_increasing_id().alias("node"), "n", "one", "two", "f.doc_id", "f.md5", "prefix", "odd")
    classes, _ = materialise(classes, "classes")
    lists, lists_at = materialise(index_lists(classes), "lists")
    pairs, _ = materialise(may_overlap(star_pairs(lists), classes), "star-pairs")
    of, paths = sets_of(keyed, classes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    stars, _ = materialise(overlaps(pairs, of), "stars")
    links = stars.filter(enough(F.col("overlap"), F.col("n"), F.col("m"))).select("a", "b")
    label = components(links)
    marked = lists.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    more = may_overlap(block_pairs(marked).toDF("a", "b"), classes).toDF("x", "y")
    more, _ = materialise(more, "block-pairs")
    drop_path(spark, lists_at)
    label = components(links.unionByName(derived(more, stars, keyed, classes, of)))
    for path in paths:
        drop_path(spark, path)
    named = label.join(classes.select("node", "doc_id"), "node")
    least = named.groupBy("label").agg(F.min("doc_id").alias("least"))
    joined = named.join(least, "label").select("node", F.lit(True).alias("moved"), "least")
    found = classes.select("node", "n", "one", "two", "doc_id").join(joined, "node", "left")
    found = found.select("n", "one", "two", F.when(F.col("moved"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.lit(True).alias("known"))
    own = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(found, ["n", "one", "two"], "left").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
