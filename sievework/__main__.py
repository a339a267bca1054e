"""Command line: python -m sievework COMMAND. Exit codes of run: 0 nothing new, 1 new alerts, 2 failure."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.functions.present import presented
from sievework.operators import findings, inventory, runs
from sievework.plans import scan, snapshots
from sievework.sources import database, records
from sievework.sources.pack import PackError, load_pack

STATES = {"ack": "acknowledged", "ignore": "ignored", "reopen": "new"}


def show(df, form: str) -> None:
    """Print rows: one JSON object, comma-separated line or YAML list item each, or a table of the first 200."""
    if form == "csv":
        out = csv.writer(sys.stdout, lineterminator="\n")
        out.writerow(df.columns)
        out.writerows(df.toLocalIterator())
    elif form in ("json", "yaml"):
        for line in df.toJSON().toLocalIterator():
            fields = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in json.loads(line).items()]
            print(line if form == "json" else "- " + "\n  ".join(fields or ["{}"]))
    else:
        df.show(200, truncate=80)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sievework")
    p.add_argument("--state", required=True, help="snapshot folder")
    p.add_argument("--format", choices=("table", "json", "csv", "yaml"), default="table")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("root")
    run.add_argument("--pack", required=True)
    run.add_argument("--meta")
    run.add_argument("--scope", choices=scan.SCOPES, default="changed")
    run.add_argument("--path")
    run.add_argument("--exclude", action="append", default=[])
    run.add_argument("--slug", action="append", default=[], help="an installed package, plugin:x or theme:x")
    run.add_argument("--checksums", help="JSON lines of package, path, md5")
    run.add_argument("--own", help="JSON object of the scanner's own paths and their md5")
    run.add_argument("--software", help="JSON lines of kind, slug, version")
    run.add_argument("--records", help="JSON lines of vulnerability records")
    run.add_argument("--answers", help="JSON lines of kind, slug, fetched_at, answer: found, none, failed or missing")
    run.add_argument("--database", help="folder of landed tables, or a JDBC address")
    run.add_argument("--table-prefix", default="wp_")
    run.add_argument("--mounted", action="store_true", help="every executor has the tree mounted: list it in the tasks")
    run.add_argument("--follow-links", action="store_true")
    run.add_argument("--rehash", action="store_true", help="read every file again")
    sub.add_parser("status")
    sub.add_parser("runs")
    sub.add_parser("overview").add_argument("--interval", type=int, default=0, help="seconds between scheduled runs")
    sub.add_parser("index")
    lister = sub.add_parser("findings")
    for name in ("severity", "type", "review", "search"):
        lister.add_argument(f"--{name}")
    lister.add_argument("--page", type=int, default=1)
    for name in STATES:
        sub.add_parser(name).add_argument("keys", nargs="+", help="fingerprints")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "run":
        tables, members, now = [], None, F.unix_timestamp(F.current_timestamp())
        if a.database:
            found = database.over_jdbc(spark, a.database, a.table_prefix) if a.database.startswith("jdbc:") else database.landed(spark, a.database)
            tables, members = database.row_tables(found), database.administrators(found, a.table_prefix)
        try:
            result = scan.scan(
                spark, a.root, load_pack(a.pack, a.meta), a.state, a.scope, a.path, slugs=a.slug, excluded=a.exclude,
                checksums=records.checksums(spark, a.checksums, now) if a.checksums else None, own=records.own_manifest(spark, a.own) if a.own else None,
                software=spark.read.schema("kind string, slug string, version string").json(a.software) if a.software else None,
                records=records.vulnerabilities(spark, a.records) if a.records else None, tables=tables, members=members, rehash=a.rehash, mounted=a.mounted, follow_links=a.follow_links,
                answers=spark.read.schema("kind string, slug string, fetched_at long, answer string").json(a.answers) if a.answers else None,
            )
        except (PackError, ValueError) as e:
            print(e, file=sys.stderr)
            return 2
        show(findings.dense_counts(result.findings), a.format)
        return int(result.findings.filter("state = 'new' AND severity = 'alert'").limit(1).count() > 0)
    now = snapshots.current(spark, a.state)
    if now is None:
        print("no scan yet", file=sys.stderr)
        return 2
    found, files = snapshots.load(spark, a.state, "findings"), snapshots.load(spark, a.state, "files")
    if a.command == "status":
        show(findings.chips(found), a.format)
    elif a.command == "overview":
        show(runs.overview(files, found, runs.log_of(spark, a.state), now["bundle"], F.unix_timestamp(F.current_timestamp()), a.interval), a.format)
    elif a.command == "runs":
        show(runs.latest(runs.log_of(spark, a.state)), a.format)
    elif a.command == "index":
        show(inventory.statistics(files, now["bundle"]), a.format)
    elif a.command == "findings":
        chosen = findings.select_findings(found, a.severity, a.type, a.review, a.search)
        show(presented(findings.page(chosen, a.page)).select("locator_hash", "severity", "state", "title", "subtitle", "detected_by", "shown"), a.format)
    else:
        keys = spark.createDataFrame([(k,) for k in a.keys], "locator_hash string")
        changed = findings.set_state(found, keys, STATES[a.command], F.unix_timestamp(F.current_timestamp()))
        tables = {name: snapshots.load(spark, a.state, name) for name in now["tables"]}
        snapshots.commit({**tables, "findings": changed}, a.state, {k: now[k] for k in ("run", "bundle", "scope")})
    return 0


if __name__ == "__main__":
    sys.exit(main())
