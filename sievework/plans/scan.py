"""A whole scan: inventory from names and times, hashing of what changed, integrity, matching, findings, one commit at the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sievework.functions import classify
from sievework.functions.text import extension, latin1
from sievework.operators import findings, heuristics, integrity, inventory, matching, runs, vulnerability
from sievework.operators import rows as table_rows
from sievework.plans import snapshots
from sievework.sources import files as source
from sievework.sources import records as published
from sievework.sources.database import RowTable
from sievework.sources.pack import Pack

SCOPES = ("full", "changed", "path")
#: The chunk number of what follows a file's matches.
AFTER_CHUNKS = (1 << 31) - 1


@dataclass
class Result:
    files: DataFrame
    findings: DataFrame
    version: int
    runs: DataFrame | None = None


#: Columns of the file inventory that a snapshot keeps.
FILES = (
    "path_hash string, path string, size long, mtime long, origin string, md5 string, sha256 string, kind string, known_good boolean, scanned_bundle int, path_signal int, seen_run int, "
    "pattern_errors int"
)
FINDINGS = (
    "locator_hash string, type string, locator string, signature_ids array<string>, tier string, severity string, category string, line int, excerpt string, reason string, first_seen long, "
    "last_seen long, state string, state_changed_at long"
)


def judged(rows: DataFrame, checksums: DataFrame | None, own: DataFrame | None = None) -> DataFrame:
    """``rows`` (path, md5, kind, origin, ...) with integrity, known_good and path signal. Contents aren't needed, so changed lists reach
    files that haven't changed."""
    if checksums is None and own is not None:
        checksums = rows.sparkSession.createDataFrame([], "package string, path string, md5s array<string>")
    parts = F.split("origin", ":")
    inner = F.regexp_replace("path", r"^wp-content/(plugins|themes)/[^/]+/", "")
    out = rows.withColumn("package", F.col("origin")).withColumn("package_path", F.when(F.size(parts) > 1, inner).otherwise(F.col("path")))
    if checksums is None:
        out = out.withColumns({"integrity": F.lit("unknown"), "expected_md5": F.lit(None).cast("string")})
        in_core = F.lit(None).cast("boolean")
    else:
        out = integrity.status(out, checksums, own)
        in_core = F.col("integrity") != "unknown"
    known = F.col("integrity") == "match"
    rules = classify.signals(F.col("path"), F.col("origin"), F.col("kind"), in_core, known)
    return out.withColumn("known_good", known).withColumn("signal", classify.path_signal(rules))


def hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (path, content, ...) with hashes and kind."""
    return source.hashed(rows).withColumn("kind", classify.content_kind(classify.head_of(F.col("content")), extension(F.col("path"))))


def origin_of(path: Column, slugs: list[str]) -> Column:
    return classify.origin(path, F.array(*[F.lit(s) for s in slugs]).cast("array<string>"))


def classified(rows: DataFrame, slugs: list[str], checksums: DataFrame | None, own: DataFrame | None = None) -> DataFrame:
    """``rows`` (path, content) with hashes, kind, origin, integrity and path signal."""
    return judged(hashed(rows).withColumn("origin", origin_of(F.col("path"), slugs)), checksums, own)


def matched(rows: DataFrame, pack: Pack, added: dict[str, dict[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Named matches of files (path, content, md5, sha256, size, kind), with ``pos`` counted from the file's start, and (path, n) of
    searches that failed. Files of every size are cut into chunks that joins and expressions match. With ``added``, the pack that brought
    each rule by its position, rows have ``known``: literals and regular expressions of that pack and older ones aren't tried."""
    spark = rows.sparkSession
    t, key = pack.frames(spark), ("path", "chunk")
    rows = matching.allowed(rows, t["allow"]).filter("NOT is_allowed").withColumn("targets", matching.targets_of(F.col("path"), F.col("kind")))
    rows = rows if added is not None else rows.withColumn("known", F.lit(0))
    hashes = matching.hash_matches(rows, t["hash"]).select("path", F.lit(0).alias("chunk"), F.lit(0).alias("layer"), "position", "sig", F.lit(1).alias("pos"), F.lit(0).alias("line"), F.lit("").alias("excerpt"))
    readable = rows.filter(~F.col("kind").isin("binary", "archive", "unreadable"))
    chunk = source.chunks(readable.select("path", "content", "targets", "known"))
    found = snapshots.cut(matching.located(chunk, t["text"], snapshots.cut(matching.possible(chunk, t["text"]))))
    literal, regex_added = t["literal"], None
    lits = found
    if added is not None:
        regex_added = added["regex"]
        young = spark.createDataFrame(sorted(added["literal"].items()), "position int, added int")
        literal = literal.join(young, "position")
        lits = found.join(rows.select("path", "known"), "path")
    lits = lits.join(matching.small(literal.drop("text"), literal.count()), "lit").filter(F.array_contains("targets", F.col("target")))
    lits = (lits if added is None else lits.filter("added > known")).select(*key, F.lit(1).alias("layer"), "position", "sig", "pos", "line", "excerpt")
    regexes = snapshots.cut(matching.regex_matches(chunk, pack.needed(), matching.presence(chunk, found, pack.words, set(pack.pure)), errors=True, added=regex_added))
    failed = regexes.filter("pos < 0").groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n"))
    every = lits.unionByName(regexes.filter("pos > 0")).unionByName(hashes)
    kept = matching.suppress(matching.drop_overlaps(matching.named(every, t["signature"])))
    return kept.withColumn("pos", F.col("chunk").cast("long") * (source.CHUNK - source.OVERLAP) + F.col("pos")), failed


def match(rows: DataFrame, pack: Pack) -> DataFrame:
    """Named matches of files (path, content, md5, sha256, size, kind)."""
    return matched(rows, pack)[0]


def rescan(decoded: DataFrame, pack: Pack) -> DataFrame:
    """Named matches (path, chunk, sig_id, category) of decoded constants (path, chunk, text), each as a first chunk of php."""
    t = pack.frames(decoded.sparkSession)
    chunk = decoded.withColumns({"targets": F.array(F.lit("file_php"), F.lit("file_any")), "first": F.lit(True), "line_base": F.lit(0)})
    found = snapshots.cut(matching.located(chunk, t["text"], snapshots.cut(matching.possible(chunk, t["text"]))))
    there = matching.presence(chunk, found, pack.words, set(pack.pure))
    hits = matching.literal_rules(found, t["literal"]).unionByName(matching.regex_matches(chunk, pack.needed(), there)).select("path", "chunk", "sig")
    return matching.named(hits.distinct(), t["signature"]).select("path", "chunk", "sig_id", "category")


def incoming_rows(table: RowTable, pack: Pack, signatures: DataFrame) -> DataFrame:
    """Findings of a table's cells."""
    rules = [r for r in pack.row_rules if r[0] == table.target]
    found = table_rows.cell_findings(table_rows.cell_matches(table.rows, rules, table.name, table.key, table.columns, table.label, table.prefiltered), signatures)
    return found.select(
        findings.fingerprint(F.lit("db"), F.col("locator")).alias("locator_hash"), F.lit("db").alias("type"), "locator", "signature_ids", "tier",
        findings.severity(F.col("tier"), F.lit(0)).alias("severity"), "category", F.lit(0).alias("line"), "excerpt", "reason",
    )


def incoming_software(software: DataFrame, records: DataFrame) -> DataFrame:
    """Findings of installed software that vulnerability records name."""
    found = vulnerability.findings(vulnerability.matches(software.select("kind", "slug", "version").distinct(), records))
    end = F.when(F.col("fixed_in").isNotNull(), F.concat(F.lit(", patched in "), "fixed_in")).otherwise(", no fix available")
    return found.select(
        findings.fingerprint(F.lit("vulnerability"), F.col("locator")).alias("locator_hash"), F.lit("vulnerability").alias("type"), "locator", "signature_ids", "tier", "severity",
        F.lit("vulnerability").alias("category"), F.lit(0).alias("line"), F.lit("").alias("excerpt"), F.concat("reason", F.lit(" — installed "), "version", end).alias("reason"),
    )


def incoming_members(new: DataFrame) -> DataFrame:
    """Findings of administrators (user_id, login, registered) that an earlier run didn't know."""
    locator = F.concat(F.lit("users:capabilities:"), F.col("user_id").cast("string"))
    return new.select(
        findings.fingerprint(F.lit("db"), locator).alias("locator_hash"), F.lit("db").alias("type"), locator.alias("locator"), F.array().cast("array<string>").alias("signature_ids"), F.lit("suspicious").alias("tier"),
        F.lit("review").alias("severity"), F.lit("credential").alias("category"), F.lit(0).alias("line"), F.lit("").alias("excerpt"),
        F.concat(F.lit("New administrator account: "), "login", F.lit(" (registered "), "registered", F.lit(")")).alias("reason"),
    )


def rules_added(spark: SparkSession, state: str, pack: Pack) -> tuple[dict[str, dict[int, int]], DataFrame]:
    """The pack that brought each rule, by layer and position, and the table of it that the next scan reads: a rule that the snapshot
    knows keeps its pack, others are this one's. Both tables have a row a rule of one pack."""
    had = snapshots.load(spark, state, "rules")
    before = {} if had is None else {r.key: r.added for r in had.collect()}
    keys = pack.rule_keys()
    added = {layer: {at: before.get(k, pack.version) for at, k in zip([r[0] for r in rows], keys[layer], strict=True)} for layer, rows in (("literal", pack.literals), ("regex", pack.regexes))}
    return added, spark.createDataFrame(sorted({k: before.get(k, pack.version) for of in keys.values() for k in of}.items()), "key string, added int")


@snapshots.scratched
def scan(spark: SparkSession, root: str, pack: Pack, state: str, scope: str = "full", prefix: str | None = None, slugs: list[str] | None = None, checksums: DataFrame | None = None, excluded=(), software: DataFrame | None = None, records: DataFrame | None = None, tables: list[RowTable] = (), own: DataFrame | None = None, rehash: bool = False, members: DataFrame | None = None, answers: DataFrame | None = None, mounted: bool = False, follow_links: bool = False) -> Result:
    """Scan the tree below ``root`` into the snapshots below ``state``. Names, sizes and times come first; only files that are new, whose
    size or time differs (all with ``rehash``) or that are due for matching are opened. ``full`` matches every file that isn't known good,
    ``changed`` those that this pack hasn't matched: an unchanged one without a finding is tried with the rules that its last pack
    lacked. ``path`` matches all files below ``prefix``.

    The pack is pinned by its version: all tables of a run carry it, and are committed together. ``own`` (path, md5) lists the scanner's
    own files. ``software`` (kind, slug, version) with its vulnerability ``records``, and ``tables`` of rows, are matched where they are
    given; without them earlier findings of that type stay. ``answers`` (kind, slug, fetched_at, answer) tells what the provider of records
    said of each software and when; without a fresh answer a software's finding stays as it is. ``members`` (user_id, login, registered) are
    compared with those of the last run that had any. A ``mounted`` tree is listed by the tasks, which leave linked folders out
    (or ``follow_links``) and keep files that can't be read. A row of the run's counts is committed with its tables."""
    if scope not in SCOPES:
        raise ValueError(f"no scope {scope!r}")
    clock = runs.Clock()
    within = scope == "path" and prefix
    old = snapshots.load(spark, state, "files")
    run = ((snapshots.current(spark, state) or {}).get("run") or 0) + 1
    before = spark.createDataFrame([], FILES) if old is None else old if "pattern_errors" in old.columns else old.withColumn("pattern_errors", F.lit(0))
    before = inventory.reset_hashes(before) if rehash else inventory.reset_scanned(before) if scope == "full" else inventory.reset_scanned(before, prefix) if within else before
    walked = source.walk_mounted(spark, root, excluded, follow_links) if mounted else source.walk(spark, root, excluded).withColumn("unreadable", F.lit(False))
    walked = (walked.filter(F.col("path").startswith(prefix)) if within else walked).withColumns({"path_hash": inventory.path_hash(F.col("path")), "origin": origin_of(F.col("path"), slugs or []), "path_signal": F.lit(0)})
    listed = snapshots.cut(inventory.upsert(before, walked, run))
    clock.end("index")
    unhashed = inventory.present(inventory.unhashed(listed), run)
    closed = walked.filter("unreadable").select("path", F.lit("-").alias("md5"), F.lit("-").alias("sha256"), F.lit("unreadable").alias("kind"))
    if mounted:
        closed = snapshots.cut(closed)
        unhashed = unhashed.join(closed.select("path"), "path", "left_anti")
    opened = hashed(source.contents_of(spark, root, unhashed, excluded)).select("path", *[F.col(c).alias(f"_{c}") for c in ("md5", "sha256", "kind")])
    hashes = snapshots.cut(opened.unionByName(closed.toDF("path", "_md5", "_sha256", "_kind")) if mounted else opened)
    renewed = {c: F.coalesce(f"_{c}", c) for c in ("md5", "sha256", "kind")}
    states = snapshots.cut(judged(listed.join(hashes, "path", "left").withColumns(renewed).drop("_md5", "_sha256", "_kind"), checksums, own))
    here = inventory.present(states, run)
    clock.end("hash")
    added, rules = rules_added(spark, state, pack)
    had = snapshots.load(spark, state, "findings")
    had = spark.createDataFrame([], FINDINGS) if had is None else had
    due = inventory.queue(here, pack.version, prefix if within else None)
    flagged = had.filter("type = 'file'").select(inventory.path_hash(F.col("locator")).alias("path_hash"))
    due = inventory.only_new_rules(due, flagged, 1, True, scope)
    known = F.when(F.col("only_new") & (F.col("scanned_bundle") < pack.version), F.col("scanned_bundle")).otherwise(0)
    due = snapshots.cut(due.withColumn("known", known).select("path", "path_hash", "size", "md5", "sha256", "kind", "origin", "known_good", "known"))
    order = ("path", "chunk", "layer", "position", "sig_id", "category", "tier", "line", "excerpt")
    if due.limit(1).count():
        rows = source.contents_of(spark, root, due, excluded).select("path", "content").join(due, "path")
        hits, failed = matched(rows, pack, added)
        hits = snapshots.cut(hits.select(*order))
        clock.end("match")
        infected = hits.filter("tier = 'infected'").select("path", F.lit(True).alias("infected")).distinct()
        gated = heuristics.gate(rows.join(infected, "path", "left").withColumn("infected", F.coalesce("infected", F.lit(False))))
        signs = snapshots.cut(heuristics.evidence(gated.select("path", latin1(F.col("content")).alias("text"), "origin", "known_good"), lambda d: rescan(d, pack)))
        clock.end("analysis")
    else:  # nothing to open
        none = lambda schema: spark.createDataFrame([], schema)
        hits, failed = none("path string, chunk int, layer int, position int, sig_id string, category string, tier string, line int, excerpt string"), none("path string, n int")
        signs = none("path string, position int, sig_id string, category string, line int, excerpt string, reason string")
        clock.end("match")
        clock.end("analysis")
    as_matches = signs.withColumns({"chunk": F.lit(AFTER_CHUNKS), "layer": F.lit(3), "tier": F.lit("suspicious")}).select(*order)
    found = findings.assemble(hits.unionByName(as_matches))
    said = signs.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "reason"))), lambda x: x["reason"]).alias("said"))
    found = found.join(said, "path", "left").withColumn("said", F.coalesce("said", F.array().cast("array<string>")))
    now = F.unix_timestamp(F.current_timestamp())
    fresh = found.join(here.select("path", F.col("signal.score").alias("score"), F.col("signal.reasons").alias("reasons")), "path")
    fresh = fresh.select(
        findings.fingerprint(F.lit("file"), F.col("path")).alias("locator_hash"), F.lit("file").alias("type"), F.col("path").alias("locator"), "signature_ids", "tier",
        findings.severity(F.col("tier"), F.col("score")).alias("severity"), "category", "line", "excerpt", findings.reason(F.col("said"), F.col("reasons")).alias("reason"),
    )
    changed = here.filter("integrity = 'mismatch'").select(
        findings.fingerprint(F.lit("integrity"), F.col("path")).alias("locator_hash"), F.lit("integrity").alias("type"), F.col("path").alias("locator"), F.array(F.lit("integrity")).alias("signature_ids"),
        F.lit("integrity").alias("tier"), F.lit("alert").alias("severity"), F.lit("integrity").alias("category"), F.lit(0).alias("line"), F.lit("").alias("excerpt"), F.lit("checksum differs").alias("reason"),
    )
    incoming = snapshots.cut(fresh.unionByName(changed))
    clean = due.select("path").join(incoming.select(F.col("locator").alias("path")), "path", "left_anti").select(findings.fingerprint(F.lit("file"), F.col("path")).alias("locator_hash"))
    good = here.filter("known_good").select(F.explode(F.array(findings.fingerprint(F.lit("file"), F.col("path")), findings.fingerprint(F.lit("integrity"), F.col("path")))).alias("locator_hash"))
    kept = findings.without(had, clean.unionByName(good))
    if not within:
        gone = kept.filter(F.col("type").isin("file", "integrity")).join(here.select(F.col("path").alias("locator")), "locator", "left_anti")
        kept = findings.without(kept, gone)
    if software is not None and records is not None:
        known_of, complete = published.answered(software, answers, now) if answers is not None else (software, F.lit(True))
        weak = snapshots.cut(incoming_software(known_of, records))
        incoming, checked = incoming.unionByName(weak), known_of.select(F.concat_ws(":", "kind", "slug").alias("locator")).distinct()
        installed = software.select(F.concat_ws(":", "kind", "slug").alias("locator")).distinct()
        open_ = vulnerability.settle(kept.filter("type = 'vulnerability'"), checked, weak, complete, installed)
        kept = kept.filter("type <> 'vulnerability'").unionByName(open_)
    signatures = pack.frames(spark)["signature"]
    for table in tables:
        incoming = incoming.unionByName(incoming_rows(table, pack, signatures))
    before_members = snapshots.load(spark, state, "members")
    if members is not None:
        members = snapshots.cut(members.select("user_id", "login", "registered"))
        if before_members is not None:
            incoming = incoming.unionByName(incoming_members(table_rows.new_members(members, before_members, "user_id")))
    kept_members = members if members is not None else before_members
    files = inventory.mark_scanned(states if within else here, due, pack.version, "_due").join(failed, "path", "left")
    files = files.withColumns({"path_signal": F.col("signal.score"), "pattern_errors": F.coalesce("n", F.when(F.col("_due"), 0).otherwise(F.col("pattern_errors")), F.lit(0))})
    of_files, of_findings = Observation(), Observation()
    files = files.observe(of_files, *[F.count_if(c).alias(n) for n, c in (
        ("files", F.col("seen_run") == run), ("added", F.col("change") == "added"), ("changed", F.col("change") == "changed"), ("known_good", F.col("known_good")), ("matched", F.col("_due")), ("pattern_errors", F.col("pattern_errors") > 0),
    )])
    merged = findings.merge(kept, incoming, now).observe(of_findings, F.count_if(F.col("change") == "added").alias("new"), F.count_if((F.col("state") == "new") & (F.col("severity") == "alert")).alias("alerts"), F.count(F.lit(1)).alias("findings"))
    columns = [c.split()[0] for c in FILES.split(", ")]

    def log() -> dict[str, DataFrame]:
        clock.end("commit")
        row = {"id": run, "status": "done", "scope": scope, "bundle": pack.version, "started_at": clock.started, "finished_at": clock.now(), "unread_patterns": len(pack.unread()), "phases": clock.phases, "counts": {**of_files.get, **of_findings.get}}
        return {"runs": runs.appended(runs.log_of(spark, state), row)}

    version = snapshots.commit({"files": files.select(*columns), "findings": merged.drop("change"), "rules": rules, **({} if kept_members is None else {"members": kept_members})}, state, {"run": run, "bundle": pack.version, "scope": scope}, log)
    load = lambda name: snapshots.load(spark, state, name)
    return Result(load("files"), load("findings"), version, load("runs"))
