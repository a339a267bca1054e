"""Hierarchical weighted hash tree: a row descends region, rack and shard by weighted hash draws.

At each level the children of the node reached so far draw an exponential arrival -ln(u) / weight, with u hashed from the row's
key and the child, and the earliest wins, so a child gets its share of the weight below its parent. A node weighs what its
shards weigh. Draws depend on nothing else: a node whose weight rises wins rows from its siblings and loses none, a row whose
path keeps its winners stays, and inside a subtree where no weight changes no row moves. Rows move into the subtrees that gain
weight or out of those that lose it, at the level where the weights differ, and nowhere else.

Growth: a shard that opens a region of its own, as the 41st does, takes rows only into itself. One more shard in a standing
region makes that region heavier, so rows may also enter its other shards.

Cases: a null key draws as its own key; repeated rows share a shard and get slots of their own; equal texts
under different ids are placed independently (the law is ``key``); an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import free_name, let, materialise, table

#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """``shards`` leaves in order, ``per_rack`` to a rack and ``per_region`` racks to a region; ``weights`` by shard, 1 each by default."""

    shards: int
    per_rack: int = 5
    per_region: int = 2
    weights: tuple[float, ...] = ()

    def weight(self, shard: int) -> float:
        return self.weights[shard] if self.weights else 1.0

    def levels(self) -> tuple[list[float], list[list[tuple[int, float]]], list[list[tuple[int, float]]]]:
        """Weights of the regions, (number, weight) of the racks of each region and of the shards of each rack."""
        shards = [[(s, self.weight(s)) for s in range(a, min(a + self.per_rack, self.shards))] for a in range(0, self.shards, self.per_rack)]
        racks = [[(r, sum(w for _, w in shards[r])) for r in range(a, min(a + self.per_region, len(shards)))] for a in range(0, len(shards), self.per_region)]
        return [sum(w for _, w in r) for r in racks], racks, shards


#: Added to a node's number for its draw, by level.
REGION, RACK, SHARD = (level << 32 for level in range(3))


def place(df: DataFrame, key: Column, tree: Tree, into: str = "shard", salt: str = "tree") -> DataFrame:
    """``df`` with the shard of each row: one draw among the regions, one among the racks of the region that won, one
    among the shards of the rack that won."""
    regions, racks, shards = tree.levels()

    def nodes(level: int, children) -> Column:
        return F.array(*[F.struct(F.lit(level + n).alias("node"), F.lit(n).alias("id"), F.lit(float(w)).alias("weight")) for n, w in children])

    def winner(base: Column, children: Column) -> Column:
        u = lambda x: (F.shiftrightunsigned(F.xxhash64(base, x["node"].cast("long")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.array_min(F.transform(children, lambda x: F.struct((-F.log(u(x)) / x["weight"]).alias("t"), x["id"].alias("id"))))["id"]

    racks_of = F.array(*[nodes(RACK, r) for r in racks])
    shards_of = F.array(*[nodes(SHARD, s) for s in shards])
    shard = let(F.xxhash64(F.lit(salt), key), lambda base: let(winner(base, nodes(REGION, enumerate(regions))), lambda region: let(
        winner(base, F.get(racks_of, region)), lambda rack: winner(base, F.get(shards_of, rack)))))
    return df.withColumn(into, shard)


def number(df: DataFrame, group: str, order: list[str], into: str = "slot") -> DataFrame:
    """``df`` with gapless numbers from 0 in each ``group``: by ranges of the hash of the ``order`` columns, then by hash, columns and
    rows. The numbers depend on the rows alone, not on how they were dealt over tasks.

    Equal rows are counted, not ranked, so they weigh as one until each of their numbers becomes a row again, by blocks. Distinct rows are
    cut into ranges sized from their count: ranges are summed, the running sums give each range its first number, and rows follow each
    other within theirs. So no task numbers a whole group or all copies of a row."""
    h, b, n, at = (free_name(df, c) for c in ("h", "range", "copies", "block"))
    own = [F.col(f"`{c}`") for c in df.columns]
    kept, _ = materialise(df.groupBy(*own).agg(F.count(F.lit(1)).alias(n)).withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in order])), "numbered")
    ranges = max(1, -(-kept.count() // SLOT_ROWS))
    keyed = kept.withColumn(b, F.pmod(F.xxhash64(h), F.lit(ranges)).cast("int"))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    first = keyed.groupBy(group, b).agg(F.sum(n).alias("n")).select(group, b, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    first, _ = materialise(first, "slots")
    within = Window.partitionBy(group, b).orderBy(h, *own).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner", F.coalesce(F.sum(n).over(within), F.lit(0))).join(first, [group, b]).withColumn("first", F.col("first") + F.col("inner"))
    once = placed.filter(F.col(n) == 1).select(*own, F.col("first").cast("long").alias(into))
    more = placed.filter(F.col(n) > 1).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / SLOT_ROWS))))
    last = F.least(F.col(n), (F.col(at) + 1) * SLOT_ROWS) - 1
    more = more.repartition(F.col(h), F.col(at)).withColumn("copy", F.explode(F.sequence(F.col(at) * SLOT_ROWS, last)))
    more = more.select(*own, (F.col("first") + F.col("copy")).cast("long").alias(into))
    return once.unionByName(more)


SHARDS = 40


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Placement rows of ``documents``: id, size, checksum, shard, its slot, and the shard if there were one more. The law is ``key`` where one
    more shard opens a region, and so takes rows only into itself; else it is ``tree``, as rows also move into that shard's region."""
    law = "key" if shards % (Tree(shards).per_rack * Tree(shards).per_region) == 0 else "tree"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit(law).alias("law")
    )
    rows = place(place(rows, F.col("doc_id"), Tree(shards)), F.col("doc_id"), Tree(shards + 1), into="grown_shard")
    return number(rows, "shard", ["doc_id", "text_crc32", "size"])


def query(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
