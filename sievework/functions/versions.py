"""Version order as an array of comparable pairs, and membership in affected ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_version(version: Column) -> Column:
    return F.translate(F.lower(version), "-", ".")


def version_key(version: Column) -> Column:
    """array<struct<rank,number>> whose order is the version order: any word < dev < alpha < beta < rc < number < patch level.
    Parts split at dots, dashes, underscores, pluses and between digits and letters; the end ranks as a number below all."""
    dotted = F.regexp_replace(F.regexp_replace(F.translate(F.trim(version), "-_+", "..."), r"(?<=[0-9])(?=[^0-9.])|(?<=[^0-9.])(?=[0-9])", "."), r"\.+", ".")
    parts = F.filter(F.split(dotted, r"\."), lambda p: p != "")
    rank = lambda p: (
        F.when(p.rlike("^[0-9]+$"), 4).when(p.startswith("dev"), 0).when(p.startswith("alpha") | (p == "a"), 1).when(p.startswith("beta") | (p == "b"), 2)
        .when(p.rlike("^(RC|rc)"), 3).when((p == "p") | p.startswith("pl"), 5).otherwise(-1)
    )
    pair = lambda p: F.struct(rank(p).alias("rank"), F.coalesce(p.try_cast("long"), F.lit(-1).cast("long")).alias("number"))
    end = F.array(F.struct(F.lit(4).alias("rank"), F.lit(-1).cast("long").alias("number")))
    return F.concat(F.transform(parts, pair), end)


def in_range(version: Column, low: Column, high: Column, low_in: Column, high_in: Column) -> Column:
    """Whether a version lies in a range; ``*`` and null are no bound, bounds count in unless said otherwise."""
    v, lo, hi = (version_key(normal_version(x)) for x in (version, low, high))
    above = F.coalesce(low, F.lit("*")).isin("*", "") | F.when(F.coalesce(low_in, F.lit(True)), v >= lo).otherwise(v > lo)
    below = F.coalesce(high, F.lit("*")).isin("*", "") | F.when(F.coalesce(high_in, F.lit(True)), v <= hi).otherwise(v < hi)
    return above & below
