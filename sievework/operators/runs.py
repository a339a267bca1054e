"""The run log: newest runs, pruning, failure streaks and the status verdict."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Runs kept, runs that a failure streak looks back, failures in a row that are told, intervals after which a scan is late.
KEPT_RUNS, STREAK_RUNS, STREAK, LATE = 50, 10, 3, 2


def latest(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("id")).limit(n)


def last_success(runs: DataFrame) -> DataFrame:
    return runs.filter("status = 'done'").orderBy(F.desc("id")).limit(1)


def pruned(runs: DataFrame, n: int = KEPT_RUNS) -> DataFrame:
    """The newest ``n`` runs."""
    return latest(runs, n)


def failure_streak(runs: DataFrame, look_back: int = STREAK_RUNS) -> DataFrame:
    """One row: failed runs in a row from the newest back, among the newest ``look_back``."""
    newest = latest(runs, look_back)
    fine = F.sum(F.when(F.col("status") != "failed", 1).otherwise(0)).over(Window.orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, 0))
    return newest.withColumn("_fine", fine).agg(F.count_if(F.col("_fine") == 0).alias("streak"))


def told_of_failure(streak: Column) -> Column:
    """The message goes out once, at the third failure in a row."""
    return streak == STREAK


def verdict(new_alerts: Column, runs: Column, last_status: Column, last_success: Column, now: Column, interval: Column) -> Column:
    """crit with new alerts, unknown without a run, warn after a failure, without a success or when a scan is late, else ok."""
    late = (interval > 0) & (now - last_success > LATE * interval)
    return (
        F.when(new_alerts > 0, "crit").when(runs == 0, "unknown").when(last_status == "failed", "warn")
        .when(last_success.isNull() | late, "warn").otherwise("ok")
    )


def worst(checks: DataFrame) -> DataFrame:
    """One row: the worst of (name, status): critical, warning or ok."""
    rank = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    return checks.agg(F.max_by("status", rank).alias("verdict"), F.count_if(rank > 0).alias("problems"))


def status_json(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def finding_numbers(findings: DataFrame, since: Column) -> DataFrame:
    """One row: findings that are new since a time, by severity."""
    fresh = (F.col("state") == "new") & ((F.col("first_seen") >= since) | (F.col("state_changed_at") >= since))
    return findings.agg(F.count_if(fresh).alias("new"), F.count_if(fresh & (F.col("severity") == "alert")).alias("alerts"), F.count_if(fresh & (F.col("severity") == "review")).alias("review"))


LOG = "id long, status string, scope string, bundle int, started_at long, finished_at long, unread_patterns int, phases map<string,long>, counts map<string,long>"


class Clock:
    """Milliseconds of a run's phases, one after another."""

    def __init__(self) -> None:
        self.started, self.phases, self._last = self.now(), {}, time.monotonic()

    def now(self) -> int:
        return int(time.time())

    def end(self, phase: str) -> None:
        at = time.monotonic()
        self.phases[phase] = self.phases.get(phase, 0) + int(1000 * (at - self._last))
        self._last = at


def log_of(spark: SparkSession, state: str) -> DataFrame:
    """The run log of a snapshot folder; empty before the first run."""
    from sievework.plans import snapshots

    had = snapshots.load(spark, state, "runs")
    return spark.createDataFrame([], LOG) if had is None else had


def baseline(runs: DataFrame) -> DataFrame:
    """One row: the first run that ended well is the baseline (``baseline_run``, 0 without one), whose findings are told to nobody;
    ``pending_review`` while no later run has ended well."""
    done = runs.filter("status = 'done'")
    return done.agg(F.coalesce(F.min("id"), F.lit(0)).alias("baseline_run"), (F.count(F.lit(1)) == 1).alias("pending_review"))


def notices(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """One row of what the newest run is to tell: how many new alerts and findings to review it left (0 for the baseline run and for
    failed ones), and whether to tell of failures, once, at the third in a row."""
    newest = runs.agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"), F.max_by("started_at", "id").alias("since")).first()
    since, silent = (newest.since or 0), newest.status != "done" or baseline(runs).first().baseline_run == newest.id
    n = finding_numbers(findings, F.lit(since))
    told = lambda c: (F.lit(0).cast("long") if silent else F.col(c)).alias(c)
    streak = failure_streak(runs).select(told_of_failure(F.col("streak")).alias("tell_failure"))
    return n.select(told("alerts"), told("review")).join(F.broadcast(streak))


def appended(runs: DataFrame, row: dict, keep: int = KEPT_RUNS) -> DataFrame:
    """The log with one run more, cut to the newest."""
    new = runs.sparkSession.createDataFrame([tuple(row.get(c) for c in runs.columns)], runs.schema)
    return pruned(runs.filter(F.col("id") != row["id"]).unionByName(new), keep)


def overview(files: DataFrame, findings: DataFrame, log: DataFrame, bundle: int, now: Column, interval: int = 0, seconds_per_file: float = 0.03) -> DataFrame:
    """One row: the tiles of a summary, the expected time of what is queued, how the last run went and when, in words, and the verdict."""
    from sievework.functions.present import age
    from sievework.operators import findings as f
    from sievework.operators import inventory

    last = log.agg(F.count(F.lit(1)).alias("runs"), F.max_by("status", "id").alias("last_status"), F.max_by("finished_at", "id").alias("last_finished"), F.max(F.when(F.col("status") == "done", F.col("finished_at"))).alias("last_success"))
    one = inventory.statistics(files, bundle).join(F.broadcast(f.chips(findings))).join(F.broadcast(last))
    told = verdict(F.col("alerts"), F.col("runs"), F.col("last_status"), F.col("last_success"), now, F.lit(interval))
    return one.withColumns({"expected_seconds": F.ceil(F.col("queued") * F.lit(seconds_per_file)), "last_run": age(F.col("last_finished"), now), "verdict": told})
