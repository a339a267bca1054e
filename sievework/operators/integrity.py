"""Integrity: files against published checksum lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def never_checked(path: Column) -> Column:
    """Paths that every installation changes."""
    return path.isin("wp-config.php", ".htaccess") | path.rlike("^wp-content/[^/]+$")


def checksum_rows(lists: DataFrame) -> DataFrame:
    """(package, path, md5s) from rows whose md5s may be one text or a list; empty ones are dropped."""
    return lists.withColumn("md5s", F.filter("md5s", lambda x: x.isNotNull() & (x != ""))).filter(F.size("md5s") > 0)


def status(files: DataFrame, checksums: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``files`` (path, package, package_path, md5) with ``integrity`` (match, mismatch or unknown) and ``expected_md5``.
    A match in the own list wins, a mismatch there falls through; then paths never checked, then the package's list."""
    rows = files.join(checksums.select("package", F.col("path").alias("package_path"), "md5s"), ["package", "package_path"], "left")
    if own is not None:
        rows = rows.join(own.select("path", F.col("md5").alias("_own")), "path", "left")
    else:
        rows = rows.withColumn("_own", F.lit(None).cast("string"))
    listed = F.when(F.col("md5s").isNull(), "unknown").when(F.array_contains("md5s", F.col("md5")), "match").otherwise("mismatch")
    verdict = F.when(F.col("_own") == F.col("md5"), "match").when(never_checked(F.col("path")), "unknown").otherwise(listed)
    expected = F.when(verdict == "mismatch", F.get("md5s", F.lit(0)))
    return rows.withColumn("integrity", verdict).withColumn("expected_md5", expected).drop("_own", "md5s")


def known_good_percent(good: Column, total: Column) -> Column:
    return F.round(100.0 * good / F.greatest(total, F.lit(1)), 1)
