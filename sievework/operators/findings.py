"""The findings table: fingerprints, assembly, keyed merge, review states, filters, pages and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.matching import tier_rank

STATES, SEVERITIES, TYPES = ("new", "acknowledged", "ignored"), ("alert", "review"), ("file", "integrity", "db", "vulnerability")
#: Path signal from which a suspicious file is an alert; matches kept in a finding; rows of a page.
ALERT_SIGNAL, PER_PAGE, MOST_PER_PAGE = 40, 50, 200


def fingerprint(kind: Column, locator: Column) -> Column:
    return F.sha2(F.concat(kind, F.lit("|"), locator), 256)


def severity(tier: Column, signal: Column) -> Column:
    return F.when(tier.isin("integrity", "infected") | ((tier == "suspicious") & (signal >= ALERT_SIGNAL)), "alert").otherwise("review")


def max_tier(matches: DataFrame, key: str = "path") -> DataFrame:
    return matches.groupBy(key).agg(F.max_by("tier", tier_rank(F.col("tier"))).alias("tier"))


def assemble(matches: DataFrame, key: str = "path") -> DataFrame:
    """One finding a file from its matches (key, chunk, layer, position, sig_id, name, category, tier, line, excerpt): ids in
    order without repeats, the highest tier, and the first match's category, line and excerpt."""
    order = F.struct("chunk", "layer", "position", "sig_id", "category", "tier", "line", "excerpt")
    rows = matches.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("m"))
    tier = F.array_max(F.transform("m", lambda x: F.struct(tier_rank(x["tier"]).alias("rank"), x["tier"].alias("tier"))))["tier"]
    first = F.col("m")[0]
    return rows.select(key, F.array_distinct(F.transform("m", lambda x: x["sig_id"])).alias("signature_ids"), tier.alias("tier"), first["category"].alias("category"), first["line"].alias("line"), first["excerpt"].alias("excerpt"), F.size("m").alias("n_matches"))


def reason(heuristics: Column, signals: Column) -> Column:
    """Heuristic reasons, then the path's."""
    parts = F.array_compact(F.array(F.when(F.size(heuristics) > 0, F.concat_ws("; ", heuristics)), F.when(F.size(signals) > 0, F.concat(F.lit("path: "), F.concat_ws(", ", signals)))))
    return F.concat_ws(" | ", parts)


def merge(existing: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Keyed upsert by fingerprint ``locator_hash``: ids are united, the tier never falls, the severity follows the higher tier,
    the evidence is the newest, ``first_seen`` and the review state stay; an ignored finding with new ids is new again."""
    key = "locator_hash"
    e, i = existing.alias("e"), incoming.alias("i")
    old, new = (lambda c: F.col(f"e.{c}")), (lambda c: F.col(f"i.{c}"))
    only_old, only_new = new(key).isNull(), old(key).isNull()
    ids = F.when(only_old, old("signature_ids")).when(only_new, new("signature_ids")).otherwise(F.array_union(old("signature_ids"), new("signature_ids")))
    rise = tier_rank(new("tier")) >= tier_rank(old("tier"))
    grown = F.size(ids) > F.size(old("signature_ids"))
    reopened = ~only_old & ~only_new & (old("state") == "ignored") & grown
    newest = lambda c: F.when(only_old, old(c)).otherwise(new(c)).alias(c)
    higher = lambda c: F.when(only_old | (~only_new & ~rise), old(c)).otherwise(new(c)).alias(c)
    return e.join(i, F.col(f"e.{key}") == F.col(f"i.{key}"), "full_outer").select(
        F.coalesce(old(key), new(key)).alias(key), newest("type"), newest("locator"), ids.alias("signature_ids"), higher("tier"), higher("severity"), newest("category"), newest("line"), newest("excerpt"),
        newest("reason"), F.coalesce(old("first_seen"), now).alias("first_seen"), F.when(only_old, old("last_seen")).otherwise(now).alias("last_seen"),
        F.when(only_new | reopened, "new").otherwise(old("state")).alias("state"), F.when(reopened, now).otherwise(F.coalesce(old("state_changed_at"), F.lit(0))).alias("state_changed_at"),
        F.when(only_old, "kept").when(only_new, "added").when(grown | (tier_rank(new("tier")) > tier_rank(old("tier"))), "changed").otherwise("seen").alias("change"),
    )


def set_state(findings: DataFrame, keys: DataFrame, state: str, now: Column) -> DataFrame:
    """Findings listed in ``keys`` (locator_hash) put in a state and stamped."""
    if state not in STATES:
        raise ValueError(f"no state {state!r}")
    hit = F.col("_hit").isNotNull()
    joined = findings.join(keys.select("locator_hash", F.lit(1).alias("_hit")).distinct(), "locator_hash", "left")
    return joined.withColumn("state", F.when(hit, state).otherwise(F.col("state"))).withColumn("state_changed_at", F.when(hit, now).otherwise(F.col("state_changed_at"))).drop("_hit")


def without(findings: DataFrame, keys: DataFrame, on: str = "locator_hash", kind: str | None = None) -> DataFrame:
    """Findings that ``keys`` doesn't list; with ``kind`` only that type is dropped."""
    gone = findings.join(keys.select(on).distinct(), on, "left_semi")
    if kind:
        gone = gone.filter(F.col("type") == kind)
    return findings.join(gone.select("locator_hash"), "locator_hash", "left_anti")


def only_listed(findings: DataFrame, keys: DataFrame, kind: str) -> DataFrame:
    """Findings of other types, and those of ``kind`` that ``keys`` lists; an empty list drops all of the type."""
    gone = findings.filter(F.col("type") == kind).join(keys.select("locator_hash").distinct(), "locator_hash", "left_anti")
    return findings.join(gone.select("locator_hash"), "locator_hash", "left_anti")


def select_findings(findings: DataFrame, severity: str | None = None, kind: str | None = None, state: str | None = None, search: str | None = None) -> DataFrame:
    """Filters by equality; ``search`` is looked for in locator, ids and reason without regard to case. Unknown values count as no filter."""
    out = findings
    for column, value, allowed in (("severity", severity, SEVERITIES), ("type", kind, TYPES), ("state", state, STATES)):
        if value in allowed:
            out = out.filter(F.col(column) == value)
    if search:
        text = F.lower(F.concat_ws("\n", "locator", F.to_json("signature_ids"), F.coalesce("reason", F.lit(""))))
        out = out.filter(text.contains(search.lower()))
    return out


def page(findings: DataFrame, number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """A page of the newest findings; equal times are ordered by fingerprint."""
    per_page = min(max(1, per_page), MOST_PER_PAGE)
    return findings.orderBy(F.desc("last_seen"), "locator_hash").offset((max(1, number) - 1) * per_page).limit(per_page)


def page_with_total(findings: DataFrame, number: int = 1, per_page: int = PER_PAGE) -> DataFrame:
    """A page whose rows carry ``total``, the number of findings that the pages are cut from."""
    return page(findings, number, per_page).join(F.broadcast(findings.agg(F.count(F.lit(1)).alias("total"))))


def page_after(findings: DataFrame, last_seen: Column, locator_hash: Column, per_page: int = PER_PAGE) -> DataFrame:
    """The page after a finding in the order of ``page``: the key is a filter, so no earlier rows are sorted or skipped."""
    after = (F.col("last_seen") < last_seen) | ((F.col("last_seen") == last_seen) & (F.col("locator_hash") > locator_hash))
    return findings.filter(after).orderBy(F.desc("last_seen"), "locator_hash").limit(min(max(1, per_page), MOST_PER_PAGE))


def page_count(total: Column, per_page: int = PER_PAGE) -> Column:
    return F.ceil(total / F.lit(per_page))


def new_since(findings: DataFrame, since: Column) -> DataFrame:
    return findings.filter((F.col("state") == "new") & ((F.col("first_seen") >= since) | (F.col("state_changed_at") >= since)))


def counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("state", "severity").agg(F.count(F.lit(1)).alias("n"))


def counts_by_type(findings: DataFrame) -> DataFrame:
    """Findings of each state and type, 0 where there is none."""
    dims = findings.sparkSession.createDataFrame([(s, t) for s in STATES for t in TYPES], "state string, type string")
    n = findings.groupBy("state", "type").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(dims).join(n, ["state", "type"], "left").select("state", "type", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dense_counts(findings: DataFrame) -> DataFrame:
    """Every state and severity, 0 where there is none; the dimensions are six literals."""
    dims = findings.sparkSession.createDataFrame([(s, v) for s in STATES for v in SEVERITIES], "state string, severity string")
    return F.broadcast(dims).join(counts(findings), ["state", "severity"], "left").select("state", "severity", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chips(findings: DataFrame) -> DataFrame:
    """One row: findings by view."""
    n = lambda c: F.count_if(c).alias
    open_ = F.col("state") != "ignored"
    return findings.agg(
        n(open_)("all"), n((F.col("state") == "new") & (F.col("severity") == "alert"))("alerts"), n((F.col("state") == "new") & (F.col("severity") == "review"))("review"),
        n(F.col("state") == "acknowledged")("acknowledged"), n(F.col("state") == "ignored")("ignored"),
    )


def digest(findings: DataFrame, level: str = "alert", cap: int | None = 20) -> DataFrame:
    """Lines of a message: alerts first, at most ``cap``, each with how many there are in all."""
    chosen = findings if level == "review" else findings.filter("severity = 'alert'")
    total = chosen.agg(F.count(F.lit(1)).alias("total"))
    rows = chosen.orderBy(F.col("severity"), "locator_hash").select("locator_hash", "severity", F.concat(F.upper("severity"), F.lit(": "), F.col("locator")).alias("line"))
    return (rows.limit(cap) if cap else rows).join(F.broadcast(total))
