"""Published lists that were landed as files: checksums, vulnerability records, installed software, each with its age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import integrity, vulnerability

#: Seconds that a landed answer counts: a checksum list, the answer that there is none, a vulnerability answer.
CHECKSUM_TTL, NO_CHECKSUM_TTL, VULNERABILITY_TTL = 7 * 86400, 86400, 3600


def fresh(rows: DataFrame, now: Column, ttl: Column | int) -> DataFrame:
    """Rows whose ``fetched_at`` (unix seconds) is not older than ``ttl``."""
    return rows.filter(F.col("fetched_at") + (F.lit(ttl) if isinstance(ttl, int) else ttl) >= now)


def answered(software: DataFrame, answers: DataFrame, now: Column) -> tuple[DataFrame, Column]:
    """The ``software`` (kind, slug, ...) whose newest answer says ``found`` or ``none`` and is fresh, and whether the pass is complete, which it
    isn't where the provider has gone (``missing``). ``answers`` is (kind, slug, fetched_at, answer); ``failed`` counts as no answer, and
    the answer before it still holds while it is fresh."""
    ttl = F.when(F.col("answer").isin("found", "none"), VULNERABILITY_TTL).otherwise(0)
    newest = answers.filter("answer <> 'failed'").groupBy("kind", "slug").agg(F.max_by(F.struct("answer", "fetched_at"), "fetched_at").alias("a")).select("kind", "slug", "a.*")
    good = fresh(newest.filter(F.col("answer").isin("found", "none")), now, ttl).select("kind", "slug")
    gone = newest.join(software.select("kind", "slug"), ["kind", "slug"], "left_semi").filter("answer = 'missing'").limit(1).count() > 0
    return software.join(good, ["kind", "slug"], "left_semi"), F.lit(not gone)


def checksums(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    """(package, path, md5s) of JSON lines {package, path, md5: text or list, fetched_at}; a text is a list of one. With ``now`` lines
    count while they are fresh; those without a time always do, and a line without a checksum is an answer that there is none."""
    raw = spark.read.schema("package string, path string, md5 string, fetched_at long").json(path)
    listed = F.when(F.col("md5").startswith("["), F.from_json("md5", "array<string>")).otherwise(F.array("md5"))
    if now is not None:
        ttl = F.when(F.coalesce(F.size(F.filter(listed, lambda x: F.coalesce(x, F.lit("")) != "")), F.lit(0)) > 0, CHECKSUM_TTL).otherwise(NO_CHECKSUM_TTL)
        raw = raw.withColumn("fetched_at", F.coalesce("fetched_at", now))
        raw = fresh(raw, now, ttl)
    return integrity.checksum_rows(raw.select("package", "path", listed.alias("md5s")))


def vulnerabilities(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(vulnerability.RECORD).json(path)


def software(core_version: str, plugins: DataFrame, themes: DataFrame) -> DataFrame:
    """(kind, slug, version, name, active) of the core, plugins (file, version, name, active) and themes (slug, ...)."""
    spark = plugins.sparkSession
    core = spark.createDataFrame([("core", "core", core_version, "Core", True)], "kind string, slug string, version string, name string, active boolean")
    p = plugins.select(F.lit("plugin").alias("kind"), vulnerability.slug_of("file").alias("slug"), "version", "name", "active")
    return core.unionByName(p).unionByName(themes.select(F.lit("theme").alias("kind"), "slug", "version", "name", "active"))


def own_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, md5) of a JSON object of paths."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("path", "md5"))
