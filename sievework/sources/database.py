"""A site's database as tables of rows to match: options, posts, their metadata, triggers and administrators.

Tables come as DataFrames, whatever holds them; ``landed`` reads them from a folder, ``over_jdbc`` from a database by ranges of the key,
so that tasks share a table and none reads it whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import rows

TABLES = ("options", "posts", "postmeta", "triggers", "usermeta", "users")
KEYS = {"options": "option_id", "posts": "ID", "postmeta": "meta_id", "usermeta": "umeta_id", "users": "ID"}
# Options that are read whatever their autoload, and prefixes of names that are not.
NAMED_OPTIONS = ("active_plugins", "admin_email", "default_role", "home", "siteurl", "stylesheet", "template", "users_can_register")
SKIPPED_OPTIONS = ("_transient", "_site_transient")


@dataclass
class RowTable:
    """Table rows to match: the pack's rules for ``target``, over ``columns`` of ``rows`` by their ``key``. ``prefiltered`` rows are only
    matched if some rule's LIKE admits them."""

    target: str
    name: str
    rows: DataFrame
    key: str
    columns: tuple[str, ...]
    label: Column
    prefiltered: bool = True


def row_tables(tables: dict[str, DataFrame], own_prefix: str = "sievework_") -> list[RowTable]:
    """What of a database's ``tables`` is matched; those that it lacks are left out. ``own_prefix`` names the scanner's own options."""
    out = []
    if "options" in tables:
        wanted = rows.options_rows(tables["options"], NAMED_OPTIONS, (own_prefix, *SKIPPED_OPTIONS))
        out.append(RowTable("db_option", "options", wanted, "option_id", ("option_value",), F.col("option_name")))
    if "posts" in tables:
        label = rows.row_label(F.col("post_type"), F.col("ID"), F.coalesce("post_title", F.lit("")))
        out.append(RowTable("db_post", "posts", rows.posts_rows(tables["posts"]), "ID", ("post_content", "post_excerpt"), label))
    if "postmeta" in tables:
        label = F.concat("meta_key", F.lit(" (post "), F.col("post_id").cast("string"), F.lit(")"))
        out.append(RowTable("db_post", "postmeta", rows.meta_rows(tables["postmeta"]), "meta_id", ("meta_value",), label, False))
    if "triggers" in tables:
        out.append(RowTable("db_trigger", "triggers", tables["triggers"], "name", ("statement",), F.col("name"), False))
    return out


def administrators(tables: dict[str, DataFrame], prefix: str = "wp_") -> DataFrame | None:
    """(user_id, login, registered) of the accounts whose capabilities name the administrator role; None without a usermeta table."""
    if "usermeta" not in tables:
        return None
    found = rows.administrators(tables["usermeta"], prefix)
    if "users" not in tables:
        return found.withColumns({"login": F.lit(""), "registered": F.lit("")})
    users = tables["users"].select(F.col("ID").alias("user_id"), F.col("user_login").alias("login"), F.col("user_registered").cast("string").alias("registered"))
    return found.join(users, "user_id", "left").select("user_id", F.coalesce("login", F.lit("")).alias("login"), F.coalesce("registered", F.lit("")).alias("registered"))


def landed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that stand in ``folder`` as Parquet, one a name."""
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
        except AnalysisException:  # not landed
            continue
    return out


def over_jdbc(spark: SparkSession, url: str, prefix: str = "wp_", partitions: int = 64, **options: str) -> dict[str, DataFrame]:
    """The tables of a database, each read by ``partitions`` ranges of its key; the smallest and largest key are asked for first."""
    out = {}
    for name, key in KEYS.items():
        at = spark.read.format("jdbc").options(url=url, **options)
        ends = at.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {prefix}{name}").load().first()
        whole = spark.read.format("jdbc").options(url=url, dbtable=f"{prefix}{name}", **options)
        if ends.low is not None:
            whole = whole.options(partitionColumn=key, lowerBound=ends.low, upperBound=int(ends.high) + 1, numPartitions=partitions)
        out[name] = whole.load()
    return out
