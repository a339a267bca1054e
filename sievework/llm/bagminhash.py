"""Near-duplicate groups by BagMinHash: weighted-Jaccard signatures of five-word shingle multisets, banded, then
verified by exact multiset overlap.

Signature: a shingle's weight is its count. The weight axis is cut into dyadic levels [0,1), [1,2), [2,4), [4,8) and
so on; each (shingle, level) owns a Poisson process in time whose rate is the level's width, and every point draws
a signature place and a discretised weight cell inside its level. Points come in order of time and a process
stops once it is past the signature's largest value, so most shingles cost one or two points. A place keeps the
earliest point whose cell lies below the shingle's weight: two multisets agree there with a probability equal
to their weighted Jaccard similarity.

Groups: equal texts are collapsed to their smallest doc_id first. Band values give buckets, buckets give candidate
components, and each component's texts are compared exactly in blocks of bounded size; blocks emit spanning links
only, never all pairs, and links are joined into groups. In a component above ``BLOCK`` texts each text is first compared with
the smallest text that it shares a bucket with, which joins a family of copies in time linear in its size. What is
left is to compare texts of different clusters: large clusters and the pool of small ones are cut into hash blocks, and every
pair of blocks but those of one cluster is compared by some task, so no link between texts that share a bucket is lost.

Cases: a null or blank text has no shingles and is grouped only with its equals; a text under five words is one
shingle; case and ASCII punctuation don't count; repeated rows are copies; rows that share a doc_id stand for one
document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm import hashing
from sievework.llm.common import free_name, materialise, table
from sievework.llm.graph import components

SHINGLE, SIMILARITY = 5, (4, 5)
#: Bands of so many places: a pair of similarity 0.8 is missed with probability (1 - 0.8**5)**30 < 1e-5.
BANDS, ROWS = 30, 5
#: Texts in a block of comparisons; columns of one product; band rows combined in a task at a time.
BLOCK, COLUMNS, COMBINE = 256, 8192, 1 << 21
#: Candidate texts whose keys (about 50 bytes each) are broadcast to pick their texts; more are joined by shuffling.
BROADCAST_KEYS = 500_000
U = np.uint64


def weigh(owner: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) pairs and their counts."""
    if not len(owner):
        return owner, shingle, np.zeros(0, np.int64)
    order = np.argsort(hashing.mix(shingle + owner.astype(U) * U(0xA24BAED4963EE407)))
    o, s = owner[order], shingle[order]
    new = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
    return o[new], s[new], np.diff(np.append(new, len(o)))


def signatures(n: int, owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, places: int = BANDS * ROWS) -> np.ndarray:
    """An (n, places) array of times; infinite for a text without shingles."""
    out = np.full(n * places, np.inf)
    levels = np.ceil(np.log2(count)).astype(np.int64) + 1
    level = np.arange(int(levels.sum())) - np.repeat(np.cumsum(levels) - levels, levels)
    text, weight = np.repeat(owner, levels), np.repeat(count, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(low, 1)
    seed = hashing.mix(np.repeat(shingle, levels) + level.astype(U) * U(0xD6E8FEB86659FD93))
    time, drawn, step = np.zeros(len(seed)), 0, 1
    while len(seed):
        turn = (np.arange(drawn + 1, drawn + step + 1, dtype=U) * U(0x9FB21C651E98DF25))[None, :]
        a = hashing.mix(seed[:, None] + turn)
        gap = -np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[:, None]
        at = time[:, None] + np.cumsum(gap, axis=1)
        b = hashing.mix(a ^ U(0x2545F4914F6CDD1D))
        place = ((b & U(0xFFFFFFFF)) * U(places) >> U(32)).astype(np.int64)
        cell = low[:, None] + ((b >> U(32)) * width[:, None].astype(U) >> U(32)).astype(np.int64)
        held = cell < weight[:, None]
        np.minimum.at(out, (text[:, None] * places + place)[held], at[held])
        time, drawn = at[:, -1], drawn + step
        on = time <= out.reshape(n, places).max(axis=1)[text]
        seed, text, weight, low, width, time = (x[on] for x in (seed, text, weight, low, width, time))
        step = min(step * 2, 64)
    return out.reshape(n, places)


def bands(signature: np.ndarray, count: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit value for each band."""
    bits, out = signature.view(U).reshape(len(signature), count, rows), np.arange(1, count + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)
    out = np.repeat(out[None, :], len(signature), axis=0)
    for r in range(rows):
        out = hashing.mix(out ^ bits[:, :, r])
    return out


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, doc_id, text_md5, text): (node, doc_id, text_md5, bands), bands null for a text without words."""
    for batch in batches:
        for a, offsets, data in hashing.text_chunks(batch.column("text")):
            n = len(offsets) - 1
            owner, shingle, count = weigh(*hashing.shingles(*hashing.word_hashes(offsets, data), SHINGLE))
            rows = bands(signatures(n, owner, shingle, count)).view(np.int64)
            some = np.isin(np.arange(n), owner)
            at = np.append(0, np.cumsum(some) * BANDS).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(rows[some].ravel()))
            part = batch.slice(a, n)
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in ("node", "doc_id", "text_md5")), lists], ["node", "doc_id", "text_md5", "bands"])


def local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (node, bands): within the task, a bucket's members point at their smallest, and only
    that one goes on as (bucket, node). Rows are (bucket, a, b) with b null for what goes on."""

    def out(nodes: list[np.ndarray], values: list[np.ndarray]) -> pa.RecordBatch:
        node, bucket = np.concatenate(nodes), np.concatenate(values)
        order = np.lexsort((node, bucket))
        node, bucket = node[order], bucket[order]
        new = np.append(True, bucket[1:] != bucket[:-1])
        first = node[np.flatnonzero(new)][np.cumsum(new) - 1]
        keep = new | (node != first)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[keep]), pa.array(node[keep]), pa.array(first[keep], mask=new[keep])], ["bucket", "a", "b"]
        )

    nodes, values, held = [], [], 0
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("bands").flatten().to_numpy(zero_copy_only=False)
            nodes.append(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS))
            values.append(flat)
            held += len(flat)
        if held >= COMBINE:
            yield out(nodes, values)
            nodes, values, held = [], [], 0
    if held:
        yield out(nodes, values)


def tokens(column: pa.Array) -> list[np.ndarray]:
    """For each text the sorted multiset of its shingles, a repeat of one made a value of its own."""
    out = []
    for _, offsets, data in hashing.text_chunks(column):
        owner, shingle = hashing.shingles(*hashing.word_hashes(offsets, data), SHINGLE)
        order = np.lexsort((shingle, owner))
        owner, shingle = owner[order], shingle[order]
        if len(owner):
            new = np.append(True, (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1]))
            repeat = np.arange(len(owner)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            shingle = np.where(repeat > 0, hashing.mix(shingle + repeat.astype(U) * U(0x8CB92BA72F3D8DD7)), shingle)
        cut = np.searchsorted(owner, np.arange(1, len(offsets) - 1))
        out += [np.sort(x) for x in np.split(shingle, cut)]
    return out


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of membership matrices over the values that two sets share."""
    n, size = len(sets), np.array([len(x) for x in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.append(True, flat[1:] != flat[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [a, a + COLUMNS])
        member = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        member[owner[i:j], column[i:j] - a] = 1
        out += member @ member.T
    return out.astype(np.int64)


def links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning links (node, smallest node) of the texts whose multisets overlap enough."""
    up, over = list(range(len(nodes))), SIMILARITY[0]
    total = SIMILARITY[0] + SIMILARITY[1]

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    if len(nodes) <= 12:
        pairs = [
            (i, j) for i in range(len(nodes)) for j in range(i)
            if total * min(len(sets[i]), len(sets[j])) >= over * (len(sets[i]) + len(sets[j]))
            and total * len(np.intersect1d(sets[i], sets[j], assume_unique=True)) >= over * (len(sets[i]) + len(sets[j]))
        ]
    else:
        size = np.array([len(x) for x in sets])
        pairs = np.argwhere(np.tril(total * overlaps(sets) >= over * (size[:, None] + size[None, :]), -1)).tolist()
    for i, j in pairs:
        i, j = top(i), top(j)
        up[max(i, j, key=lambda k: nodes[k])] = min(i, j, key=lambda k: nodes[k])
    return [(int(nodes[i]), int(nodes[top(i)])) for i in range(len(nodes)) if nodes[top(i)] != nodes[i]]


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by ``unit`` (unit, node, text): the links within each unit, which is a small
    component or a pair of blocks of a large one. A unit's members are held together; its size is bounded."""

    def found(nodes, sets):
        out = links(np.array(nodes), sets) if len(nodes) > 1 else []
        return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    unit, nodes, sets = None, [], []
    for batch in batches:
        for u, node, s in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), tokens(batch.column("text")), strict=True):
            if u != unit:
                if len(nodes) > 1:
                    yield found(nodes, sets)
                unit, nodes, sets = u, [], []
            if len(s):
                nodes.append(node)
                sets.append(s)
    if len(nodes) > 1:
        yield found(nodes, sets)


def node_of(doc_id: Column, md5: Column) -> Column:
    """A document's node: its doc_id, or for a null one a number made from its text in the lowest eighth of the range."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(md5), 3))


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label): components of texts that share a bucket, over (node, bands); and the links that made them (a, b), each of a
    bucket's members to the smallest."""
    starred, _ = materialise(signed.mapInArrow(local_stars, "bucket long, a long, b long"), "stars")
    ends = starred.filter("b IS NULL").withColumn("b", F.min("a").over(Window.partitionBy("bucket"))).filter("a <> b")
    stars = starred.filter("b IS NOT NULL").select("a", "b").unionByName(ends.select("a", "b"))
    return components(stars), stars


def compare_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (a, text, b, other): the pairs (a, b) whose texts overlap enough. Rows of one ``b`` come together."""
    over, total = SIMILARITY[0], SIMILARITY[0] + SIMILARITY[1]
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in "ab")
        if not len(a):
            continue
        new = np.append(True, b[1:] != b[:-1])
        mine, theirs = tokens(batch.column("text")), tokens(batch.column("other").take(pa.array(np.flatnonzero(new))))
        run, size = np.cumsum(new) - 1, lambda i: len(mine[i]) + len(theirs[run[i]])
        keep = [
            i for i in range(len(a))
            if total * min(len(mine[i]), len(theirs[run[i]])) >= over * size(i) > 0 and total * len(np.intersect1d(mine[i], theirs[run[i]], assume_unique=True)) >= over * size(i)
        ]
        yield pa.RecordBatch.from_arrays([pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64())], ["a", "b"])


def star_links(texts: DataFrame, members: DataFrame, stars: DataFrame) -> DataFrame:
    """Links (a, b) of the texts of ``members`` (node, label) to the smallest text that each shares a bucket with."""
    mine = texts.join(members, "node", "left_semi")
    least = stars.join(members.select(F.col("node").alias("a")), "a", "left_semi").groupBy("a").agg(F.min("b").alias("b"))
    pairs = least.join(mine.select(F.col("node").alias("a"), "text"), "a").join(mine.select(F.col("node").alias("b"), F.col("text").alias("other")), "b")
    return materialise(pairs.select("a", "text", "b", "other").mapInArrow(compare_pairs, "a long, b long"), "star-links")[0]


def verified(texts: DataFrame, members: DataFrame, stars: DataFrame) -> DataFrame:
    """Links (a, b) within the candidate components ``members`` (node, label), over ``texts`` (node, text)."""
    sizes, _ = materialise(members.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "sizes")
    sized, _ = materialise(members.join(sizes, "label"), "sized")
    small, large = sized.filter(F.col("n") <= BLOCK), sized.filter(F.col("n") > BLOCK).select("node", "label")
    units, links = small.select("node", F.col("label").cast("string").alias("unit")), None
    if large.limit(1).count():
        links = star_links(texts, large, stars)
        joined = components(links).select("node", F.col("label").alias("cluster"))
        of, _ = materialise(large.join(joined, "node", "left").withColumn("cluster", F.coalesce("cluster", "node")), "clusters")
        whole = of.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BLOCK // 2).select("label", "cluster", F.col("cluster").alias("own"))
        placed, _ = materialise(of.join(whole, ["label", "cluster"], "left").select("node", "label", "own"), "placed")  # a null own is the pool of small clusters
        blocks = placed.groupBy("label", "own").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK // 2)).cast("int").alias("blocks"))
        blocks, _ = materialise(blocks, "blocks")
        others = blocks.select("label", F.col("own").alias("other"), F.col("blocks").alias("other_blocks"))
        placed = placed.join(blocks, placed["label"].eqNullSafe(blocks["label"]) & placed["own"].eqNullSafe(blocks["own"])).select(placed["node"], placed["label"], placed["own"], "blocks")
        met = placed.join(others, "label").filter(F.col("own").isNull() | ~F.col("own").eqNullSafe(F.col("other")))
        met = met.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
        mine = F.concat_ws("/", F.coalesce(F.col("own").cast("string"), F.lit("-")), F.pmod(F.xxhash64("node"), F.col("blocks")))
        theirs = F.concat_ws("/", F.coalesce(F.col("other").cast("string"), F.lit("-")), "at")
        units = units.unionByName(met.select("node", F.concat_ws(":", "label", F.least(mine, theirs), F.greatest(mine, theirs)).alias("unit")))
    units, _ = materialise(units, "units")
    rows = texts.join(units, "node").select("unit", "node", "text")
    found = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(compare, "a long, b long")
    return found if links is None else found.unionByName(links)


def groups(docs: DataFrame) -> DataFrame:
    """(node, doc_id, rows, class_id, group_id) for each distinct node of ``docs`` (doc_id, text): how many rows it has, the
    smallest node with an equal text, and the smallest node of its near-duplicate group."""
    keyed = docs.select("text", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_md5"), "doc_id")
    keyed = keyed.select(node_of(F.col("doc_id"), F.col("text_md5")).alias("node"), "doc_id", "text_md5", "text")
    signed, _ = materialise(keyed.mapInArrow(sign, "node long, doc_id long, text_md5 string, bands array<long>"), "signatures")
    first, _ = materialise(signed.groupBy("text_md5").agg(F.min("node").alias("class_id")), "classes")
    owned = signed.groupBy("node", "doc_id", "text_md5").agg(F.count(F.lit(1)).alias("rows")).join(first, "text_md5")
    owned, _ = materialise(owned, "owned")
    lone = owned.filter("node = class_id").select("node", "text_md5")
    banded = signed.filter("size(bands) > 0").join(lone, ["node", "text_md5"], "left_semi").select("node", "bands")
    members, stars = candidates(banded)
    wanted, _ = materialise(lone.join(members, "node", "left_semi"), "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    texts, _ = materialise(keyed.join(wanted, ["node", "text_md5"], "left_semi").select("node", "text"), "texts")
    label = components(verified(texts, members, stars))
    near = label.select(F.col("node").alias("class_id"), F.col("label").alias("group_id"))
    return owned.join(near, "class_id", "left").select("node", "doc_id", "text_md5", "rows", "class_id", F.coalesce("group_id", "class_id").alias("group_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """One row a document: its class of equal texts, its near-duplicate group, and whether it is the one that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = materialise(groups(docs), "groups")
    rows = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return rows.select("doc_id", "class_id", "group_id", ((F.col("node") == F.col("group_id")) & (F.col("copy") == 1)).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of the smallest doc_id."""
    m, n = free_name(docs, "node_md5"), free_name(docs, "node")
    found, _ = materialise(groups(docs).filter("node = group_id").select(F.col("node").alias(n), F.col("text_md5").alias(m), F.col("rows").alias("n_rows")), "kept")
    md5 = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    keyed = docs.withColumn(m, md5).withColumn(n, node_of(F.col("doc_id"), F.col(f"`{m}`")))
    own = [F.col(f"`{c}`") for c in docs.columns]
    once = keyed.join(found.filter("n_rows = 1"), [n, m], "left_semi")
    more = keyed.join(found.filter("n_rows > 1"), [n, m], "left_semi")
    more = more.withColumn(n, F.row_number().over(Window.partitionBy(n, m).orderBy(F.lit(0)))).filter(F.col(f"`{n}`") == 1)
    return once.select(*own).unionByName(more.select(*own))
