"""Rules over table rows: a cheap LIKE prefilter, then every rule's regular expression on the admitted rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import excerpt, latin1
from sievework.operators.matching import named, tier_rank
from sievework.sources.pack import byte_pattern, first_match, java_pattern, readings

#: Characters of a cell that are matched.
CELL = 1 << 20
AUTOLOADED = ("yes", "on", "auto", "auto-on")
#: Keys of the meta rows that are scanned.
META_KEYS = ("_wp_page_template", "_elementor_data", "_menu_item_url")


def like_literal(text: str) -> str:
    """A text as part of a LIKE pattern that matches only itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def like_prefilter(rules: Iterable[tuple], columns: Iterable[str]) -> Column:
    """Rows that any rule (target, sig, pattern, like) could match: one case-insensitive LIKE of any column. A rule without
    a LIKE admits every row; without rules or columns nothing is admitted."""
    rules, columns = list(rules), list(columns)
    if not rules or not columns:
        return F.lit(False)
    if any(r[3] is None for r in rules):
        return F.lit(True)
    out = F.lit(False)
    for like in dict.fromkeys(r[3] for r in rules):
        for c in columns:
            out = out | F.coalesce(F.col(c).ilike(like), F.lit(False))
    return out


def match_rows(rows: DataFrame, rules: Iterable[tuple], columns: Iterable[str]) -> DataFrame:
    """``rows`` that match, with ``matches``: array of (sig, column, pos) in order of rules, the first matching column each.
    The prefilter is a union over the rules; an admitted row is matched against all of them."""
    rules, columns = list(rules), list(columns)
    admitted = rows.filter(like_prefilter(rules, columns))

    def hit(r) -> Column:
        pattern = java_pattern(r[2])
        if pattern is None:
            raise ValueError(f"rule {r[1]} needs the byte matcher")
        tries = [F.when(F.regexp_instr(F.substring(c, 1, CELL), F.lit(pattern)) > 0, F.struct(F.lit(r[1]).alias("sig"), F.lit(c).alias("column"), F.regexp_instr(F.substring(c, 1, CELL), F.lit(pattern)).alias("pos"))) for c in columns]
        return F.coalesce(*tries)

    hits = F.filter(F.array(*[hit(r) for r in rules]), lambda x: x.isNotNull()) if rules else F.array()
    return admitted.withColumn("matches", hits).filter(F.size("matches") > 0)


def cell_matches(rows: DataFrame, rules: Iterable[tuple], table: str, key: str, columns: Iterable[str], label: Column, prefiltered: bool = True) -> DataFrame:
    """(locator, label, position, sig, pos, excerpt): every rule that matches a cell, over bytes, each column by itself.
    Without ``prefiltered`` each rule meets every row. Patterns that can't be read are left out.
    Patterns that Java would read otherwise run in Arrow batches over the admitted cells."""
    rules, columns = list(rules), list(columns)
    java, others, _ = readings([r[2] for r in rules])
    admitted = rows.filter(like_prefilter(rules, columns)) if prefiltered else rows
    cells = None
    for c in columns:
        cell = F.substring(latin1(F.encode(F.col(c), "UTF-8")), 1, CELL)
        one = admitted.select(row_locator(table, c, F.col(key)).alias("locator"), label.alias("label"), cell.alias("cell")).filter("cell <> ''")
        cells = one if cells is None else cells.unionByName(one)
    native = [(i, r[1], java[r[2]]) for i, r in enumerate(rules) if r[2] in java]
    other = [(i, r[1], r[2]) for i, r in enumerate(rules) if r[2] in others]
    hits = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(sig).alias("sig"), F.regexp_instr("cell", F.lit(p)).alias("pos")) for i, sig, p in native])
    schema = "locator string, label string, cell string, position int, sig int, pos int"
    found = cells.sparkSession.createDataFrame([], schema)
    if native:
        found = cells.withColumn("h", F.explode(hits)).filter("h.pos > 0").select("locator", "label", "cell", "h.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        patterns = [(i, sig, byte_pattern(p)) for i, sig, p in other]
        for batch in batches:
            out = [
                (*row, i, sig, at)
                for row in zip(batch["locator"], batch["label"], batch["cell"], strict=True) for i, sig, p in patterns if (at := first_match(p, row[2].encode("latin-1"))) > 0
            ]
            yield pd.DataFrame(out, columns=["locator", "label", "cell", "position", "sig", "pos"])

    if other:
        found = found.unionByName(cells.mapInPandas(run, schema))
    return found.select("locator", "label", "position", "sig", "pos", excerpt(F.col("cell"), F.col("pos")).alias("excerpt"))


def cell_findings(matches: DataFrame, signatures: DataFrame) -> DataFrame:
    """One finding a cell: ids in order of rules, the highest tier, category and excerpt of the first match, the label and
    that match's name as the reason."""
    rows = named(matches, signatures).groupBy("locator", "label").agg(F.array_sort(F.collect_list(F.struct("position", "sig_id", "name", "category", "tier", "excerpt"))).alias("m"))
    tier = F.array_max(F.transform("m", lambda x: F.struct(tier_rank(x["tier"]).alias("rank"), x["tier"].alias("tier"))))["tier"]
    first = F.col("m")[0]
    return rows.select(
        "locator", F.array_distinct(F.transform("m", lambda x: x["sig_id"])).alias("signature_ids"), tier.alias("tier"), first["category"].alias("category"), first["excerpt"].alias("excerpt"),
        F.concat("label", F.lit(": "), first["name"]).alias("reason"),
    )


def options_rows(options: DataFrame, names: Iterable[str], skipped_prefixes: Iterable[str], autoload: Iterable[str] = AUTOLOADED) -> DataFrame:
    """Options worth matching: loaded on every page, of a listed name or a widget, and not under a skipped prefix."""
    wanted = F.col("autoload").isin(*autoload) | F.col("option_name").isin(*names) | F.col("option_name").contains("widget")
    for p in skipped_prefixes:
        wanted = wanted & ~F.col("option_name").startswith(p)
    return options.filter(wanted)


def posts_rows(posts: DataFrame) -> DataFrame:
    return posts.filter("post_status <> 'trash' AND post_type <> 'revision'")


def meta_rows(meta: DataFrame, keys: Iterable[str] = META_KEYS) -> DataFrame:
    return meta.filter(F.col("meta_key").isin(*keys))


def administrators(usermeta: DataFrame, prefix: str = "wp_") -> DataFrame:
    """Distinct user_id of those whose capabilities name the administrator role."""
    return usermeta.filter((F.col("meta_key") == f"{prefix}capabilities") & F.col("meta_value").ilike("%administrator%")).select("user_id").distinct()


def new_members(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    """Members that an earlier list lacks; an empty earlier list is a first run and finds nothing."""
    any_before = previous.limit(1).select(F.lit(True).alias("_seen"))
    return current.join(previous.select(key), key, "left_anti").join(F.broadcast(any_before)).drop("_seen")


def row_locator(table: Column | str, column: Column | str, row_id: Column) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat_ws(":", lit(table), lit(column), row_id.cast("string"))


def row_label(post_type: Column, row_id: Column, title: Column) -> Column:
    return F.concat(post_type, F.lit(" #"), row_id.cast("string"), F.lit(" "), F.substring(title, 1, 40))
