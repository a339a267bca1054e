"""What a list of findings shows of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import basename, https_only, preview, truncated

ADVICE = {
    "integrity": "Compare the file with the published one and restore it.", "infected": "Treat the content as hostile until it is reviewed.",
    "suspicious": "Review the excerpt; acknowledge it if it belongs there.", "info": "No action is needed unless it is unexpected.",
}
RUN_ERRORS = {
    "lock": "Another run is active.", "pack": "No usable rule pack.", "bundle_changed": "The rule pack changed during the run.", "path": "The path is outside the scanned tree.",
    "memory": "Too little memory.", "storage": "The state folder can't be written.",
}


def choose(value: Column, options: dict[str, str], other: str = "") -> Column:
    out = F.lit(other)
    for k, v in options.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def run_error(code: Column) -> Column:
    return F.coalesce(F.nullif(choose(code, RUN_ERRORS), F.lit("")), code)


def presented(findings: DataFrame) -> DataFrame:
    """``findings`` with title, subtitle, advice, detected_by and the excerpt worth showing."""
    kind = F.col("type")
    title = F.when(kind.isin("file", "integrity"), basename(F.col("locator"))).when(kind == "vulnerability", F.substring_index("locator", ":", -1)).otherwise(F.substring_index("locator", ":", 1))
    by = F.when(kind == "integrity", "checksum").when(kind == "vulnerability", "version").when(F.exists("signature_ids", lambda x: x.startswith("heur")), "analysis").otherwise("signature")
    return findings.withColumns({
        "title": truncated(title, 60), "subtitle": F.concat_ws(" · ", F.nullif("locator", title), F.nullif("category", F.lit("")), preview(F.col("signature_ids"))), "advice": choose(F.col("tier"), ADVICE),
        "detected_by": by, "shown": F.when(F.coalesce("excerpt", F.lit("")) != "", truncated(F.col("excerpt"), 240)).otherwise(truncated(F.coalesce("reason", F.lit("")), 240)),
    })


def record_link(references: Column) -> Column:
    """The first https reference."""
    return F.coalesce(F.get(F.filter(references, lambda u: https_only(u) != ""), F.lit(0)), F.lit(""))


def age(at: Column, now: Column) -> Column:
    """How long ago a time (unix seconds) was, in the largest whole unit; never without one."""
    gap = F.greatest(now - at, F.lit(0))
    unit = lambda n, name: F.concat(F.floor(gap / n).cast("string"), F.lit(f" {name}"), F.when(F.floor(gap / n) == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(at.isNull(), "never").when(gap < 60, "just now").when(gap < 3600, unit(60, "minute")).when(gap < 86400, unit(3600, "hour")).otherwise(unit(86400, "day"))


def timestamp_text(at: Column) -> Column:
    """A time (unix seconds) as date and minute in the session's time zone; empty for none."""
    return F.when(at.isNull() | (at <= 0), "").otherwise(F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd HH:mm"))
