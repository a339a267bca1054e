"""Connected components of an edge table by repeated contraction; every step is a join or a grouped minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import drop_path, materialise

JUMPS = 2


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b); the label is the smallest node of its component.

    A round points each node at its smallest neighbour, follows the pointers ``JUMPS`` times, replaces the edges'
    ends and drops what became loops or repeats. Stars vanish in one round and a chain shrinks to a fraction.
    Each round's tables are written to the shared folder, which cuts the lineage and lets Spark split the
    joins on a hub."""
    spark = edges.sparkSession
    left, path = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, at = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        for _ in range(JUMPS):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped, new = materialise(parent.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "parents")
            drop_path(spark, at)
            parent, at = jumped, new
        ends = left
        for side in ("a", "b"):
            ends = ends.join(parent.select(F.col("node").alias(side), F.col("up").alias(f"{side}_up")), side)
        ends = ends.select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).filter("a <> b").distinct()
        shrunk, new = materialise(ends, "edges")
        drop_path(spark, path)
        left, path = shrunk, new
        rounds.append(parent)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = rounds[0].select("node", F.col("up").alias("label"))
    for later in rounds[1:]:
        later = later.select(F.col("node").alias("label"), F.col("up").alias("top"))
        out = out.join(later, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return materialise(out, "labels")[0]
