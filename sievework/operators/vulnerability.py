"""Installed software against vulnerability records: an equality join on kind and slug, then version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.versions import in_range

RECORD = (
    "id string, title string, informational boolean, software array<struct<type: string, slug: string, name: string, patched: boolean, patched_versions: array<string>, "
    "affected_versions: map<string, struct<from_version: string, to_version: string, from_inclusive: boolean, to_inclusive: boolean>>>>, references array<string>"
)


def slug_of(plugin_file: str = "file"):
    """Folder of a plugin file, or its name without .php where it stands alone."""
    c = F.col(plugin_file)
    return F.when(c.contains("/"), F.substring_index(c, "/", 1)).otherwise(F.regexp_replace(c, r"\.php$", ""))


def matches(software: DataFrame, records: DataFrame) -> DataFrame:
    """(kind, slug, version, id, title, patched, patched_version): records that name the software's version as affected.
    A record counts by its first entry for that kind and slug; informational ones are left out."""
    entries = records.filter(~F.coalesce("informational", F.lit(False))).select("id", "title", F.posexplode("software").alias("n", "s"))
    entries = entries.groupBy("id", F.col("s.type").alias("kind"), F.col("s.slug").alias("slug")).agg(F.min_by(F.struct("title", "s"), "n").alias("e"))
    joined = software.join(entries, ["kind", "slug"])
    hit = F.exists(F.map_values("e.s.affected_versions"), lambda r: in_range(F.col("version"), r["from_version"], r["to_version"], r["from_inclusive"], r["to_inclusive"]))
    return joined.filter(hit).select("kind", "slug", "version", "id", "e.title", F.coalesce("e.s.patched", F.lit(False)).alias("patched"), F.get("e.s.patched_versions", F.lit(0)).alias("patched_version"))


def findings(hits: DataFrame) -> DataFrame:
    """One finding a software: an alert if any record has a patch, up to three titles as the reason."""
    one = F.sort_array(F.collect_list(F.struct((~F.col("patched")).alias("open"), "id", "title", "patched_version")))
    grouped = hits.groupBy("kind", "slug", "version").agg(one.alias("records"))
    patched = ~F.col("records")[0]["open"]
    return grouped.select(
        F.concat_ws(":", "kind", "slug").alias("locator"), "version", F.when(patched, "infected").otherwise("suspicious").alias("tier"), F.when(patched, "alert").otherwise("review").alias("severity"),
        F.transform("records", lambda r: r["id"]).alias("signature_ids"), F.concat_ws("; ", F.transform(F.slice("records", 1, 3), lambda r: r["title"])).alias("reason"),
        F.when(patched, F.col("records")[0]["patched_version"]).alias("fixed_in"),
    )


def settle(findings_: DataFrame, checked: DataFrame, matched: DataFrame, complete: Column | bool, installed: DataFrame | None = None) -> DataFrame:
    """Vulnerability findings after a pass: ``checked`` software without a match loses its finding, software whose provider
    gave no answer keeps it, and only a ``complete`` pass drops findings of software that isn't ``installed`` (``checked`` by default)."""
    kept = findings_.join(checked.join(matched.select("locator"), "locator", "left_anti").select("locator"), "locator", "left_anti")
    here = (checked if installed is None else installed).select("locator", F.lit(True).alias("_here")).distinct()
    complete = F.lit(complete) if isinstance(complete, bool) else complete
    return kept.join(here, "locator", "left").filter(F.col("_here").isNotNull() | ~complete).drop("_here").select(*findings_.columns)
