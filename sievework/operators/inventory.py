"""The file inventory as snapshots: what a walk changes, what is to be scanned, what is gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_hash(path: Column) -> Column:
    return F.sha2(path, 256)


def upsert(snapshot: DataFrame, walk: DataFrame, run: Column | int) -> DataFrame:
    """The next snapshot from (path_hash, path, size, mtime, origin, path_signal) of a walk: a known file's stat columns and
    run are renewed, and if size or mtime changed its hashes, kind and verdicts are cleared; its path_signal stays until it
    is hashed again. Files that the walk missed are kept with their old run."""
    run = F.lit(run) if isinstance(run, int) else run
    old, new = (lambda c: F.col(f"s.{c}")), (lambda c: F.col(f"w.{c}"))
    seen, fresh = new("path_hash").isNotNull(), old("path_hash").isNull()
    more = [old(c).alias(c) for c in snapshot.columns if c == "pattern_errors"]
    changed = seen & ~fresh & ((old("size") != new("size")) | (old("mtime") != new("mtime")))
    stat = lambda c: F.when(seen, new(c)).otherwise(old(c)).alias(c)
    cleared = lambda c, empty: F.when(changed | fresh, F.lit(empty)).otherwise(old(c)).alias(c)
    return snapshot.alias("s").join(walk.alias("w"), F.col("s.path_hash") == F.col("w.path_hash"), "full_outer").select(
        F.coalesce(old("path_hash"), new("path_hash")).alias("path_hash"), stat("path"), stat("size"), stat("mtime"), stat("origin"), cleared("md5", ""), cleared("sha256", ""), cleared("kind", ""),
        cleared("known_good", False), cleared("scanned_bundle", 0), F.coalesce(old("path_signal"), new("path_signal")).alias("path_signal"), F.when(seen, run).otherwise(old("seen_run")).alias("seen_run"), *more,
        F.when(fresh, "added").when(changed, "changed").when(seen, "same").otherwise("missing").alias("change"),
    )


def queue(files: DataFrame, bundle: int, prefix: str | None = None) -> DataFrame:
    """Files to scan: readable, hashed, not known good, and last scanned with another rule pack. The prefix has no slash of its own."""
    out = files.filter((~F.col("known_good")) & (F.col("scanned_bundle") != bundle) & (F.col("md5") != "") & (F.col("kind") != "unreadable"))
    return out.filter(F.col("path").startswith(prefix)) if prefix else out


def unhashed(files: DataFrame) -> DataFrame:
    return files.filter("md5 = ''")


def vanished(files: DataFrame, run: int) -> DataFrame:
    return files.filter(F.col("seen_run") < run)


def present(files: DataFrame, run: int) -> DataFrame:
    return files.filter(F.col("seen_run") >= run)


def mark_scanned(files: DataFrame, done: DataFrame, bundle: int, flag: str | None = None) -> DataFrame:
    """``files`` with the pack that matched those of ``done``; ``flag`` names a column that tells them."""
    hit = done.select("path_hash", F.lit(True).alias("_done")).distinct()
    marked = files.join(hit, "path_hash", "left").withColumn("scanned_bundle", F.when(F.col("_done"), F.lit(bundle)).otherwise(F.col("scanned_bundle")))
    return marked.withColumn(flag, F.col("_done").isNotNull()).drop("_done") if flag else marked.drop("_done")


def reset_scanned(files: DataFrame, prefix: str = "") -> DataFrame:
    return files.withColumn("scanned_bundle", F.when(F.col("path").startswith(prefix), F.lit(0)).otherwise(F.col("scanned_bundle")))


def reset_hashes(files: DataFrame) -> DataFrame:
    return files.withColumns({"md5": F.lit(""), "sha256": F.lit(""), "known_good": F.lit(False), "scanned_bundle": F.lit(0)})


def only_new_rules(files: DataFrame, findings: DataFrame, since: int, has_new: bool, scope: str) -> DataFrame:
    """``files`` with ``only_new``: unchanged since a scan that knew all but the new rules, and without a finding."""
    with_finding = findings.select("path_hash", F.lit(True).alias("_found")).distinct()
    ok = F.lit(has_new and scope != "full") & (F.col("scanned_bundle") > 0) & (F.col("scanned_bundle") >= since) & F.col("_found").isNull()
    return files.join(with_finding, "path_hash", "left").withColumn("only_new", ok).drop("_found")


def statistics(files: DataFrame, bundle: int) -> DataFrame:
    """One row: files, known good, queued, unhashed, with a signal, and the share known good."""
    queued = (~F.col("known_good")) & (F.col("scanned_bundle") != bundle) & (F.col("md5") != "") & (F.col("kind") != "unreadable")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count_if("known_good").alias("known_good"), F.count_if(queued).alias("queued"), F.count_if(F.col("md5") == "").alias("unhashed"),
        F.count_if(F.col("path_signal") >= 40).alias("signalled"),
    ).withColumn("known_good_percent", F.round(100.0 * F.col("known_good") / F.greatest("files", F.lit(1)), 1))


def kinds(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
