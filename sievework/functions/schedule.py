"""Due times, durations and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTERVALS = {"hourly": 3600, "daily": 86400, "weekly": 604800}


def interval_seconds(schedule: Column) -> Column:
    out = F.lit(0)
    for name, seconds in INTERVALS.items():
        out = F.when(schedule == name, seconds).otherwise(out)
    return out


def next_due(now: Column, schedule: Column, hour: Column) -> Column:
    """The next run after ``now``: the next full hour, or the next day or week at ``hour``; null when off."""
    at = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), hour)
    later = lambda days: F.when(at > now, at).otherwise(at + F.expr(f"INTERVAL {days} DAY"))
    return F.when(schedule == "hourly", F.date_trunc("hour", now) + F.expr("INTERVAL 1 HOUR")).when(schedule == "daily", later(1)).when(schedule == "weekly", later(7))


def percent(done: Column, total: Column) -> Column:
    return F.least(F.lit(100.0), F.round(100.0 * done / F.greatest(total, F.lit(1)), 1))


def remaining_seconds(elapsed: Column, done: Column, total: Column) -> Column:
    return F.when(done > 0, F.round(elapsed / done * (total - done)).cast("long"))
