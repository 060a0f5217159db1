"""Command line for spark-submit: extract, build, report, quality.

    spark-submit -m sparkmarts extract --jdbc-url URL --schema analytics --warehouse ROOT
    spark-submit -m sparkmarts build --warehouse ROOT
    spark-submit -m sparkmarts report --warehouse ROOT --start 2026-05-01 --end 2026-05-31 \
        --out DIR
    spark-submit -m sparkmarts quality --warehouse ROOT --out DIR

The session comes from the cluster (``getOrCreate``); no setting is overridden here.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from sparkmarts.contracts import SOURCE_TABLES


def _store(spark: SparkSession, args):
    from sparkmarts.sources.warehouse import CatalogWarehouse, Warehouse

    if args.database:
        return CatalogWarehouse(spark, args.database)
    return Warehouse(spark, args.warehouse)


def _properties(path: str | None) -> dict[str, str]:
    """``key=value`` lines (user, password, driver, ...); keeps secrets off the command line."""
    if not path:
        return {}
    props = {}
    with open(path, encoding="utf-8") as fh:
        for line in fh:
            line = line.strip()
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                props[key.strip()] = value.strip()
    return props


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkmarts")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("extract", "build", "report", "quality"):
        s = sub.add_parser(name)
        target = s.add_mutually_exclusive_group(required=True)
        target.add_argument("--warehouse", help="root folder of the table store")
        target.add_argument("--database", help="catalog database instead of a folder")
        if name == "extract":
            s.add_argument("--jdbc-url", required=True)
            s.add_argument("--schema", required=True)
            s.add_argument("--properties-file")
            s.add_argument("--tables", nargs="*", default=None)
            s.add_argument("--full-refresh", action="store_true")
            s.add_argument("--split", nargs="*", default=[], type=split_of,
                           metavar="TABLE=COLUMN,LOWER,UPPER,PARTITIONS",
                           help="read TABLE in equal strides of COLUMN between given bounds")
            s.add_argument("--split-on", nargs="*", default=[], type=split_column,
                           metavar="TABLE=COLUMN", help="column whose quantiles cut TABLE "
                           "(without it: created_at)")
            s.add_argument("--ranges", type=int, default=64, help="ranges a table is cut into")
            s.add_argument("--single-task", nargs="*", default=[], metavar="TABLE",
                           help="tables small enough to be read by one task")
            s.add_argument("--timeout", type=int, default=60, help="seconds a statement may take")
        if name == "build":
            s.add_argument("--no-staging", action="store_true")
        if name == "report":
            s.add_argument("--start")
            s.add_argument("--end")
        if name in ("report", "quality"):
            s.add_argument("--out", required=True, help="folder for one parquet per result")
    return p


def main(argv: Sequence[str] | None = None) -> list[str]:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = _store(spark, args)
    if args.command == "extract":
        from sparkmarts.sources.jdbc import JdbcSource, extract_tables, planned_splits

        splits = dict(args.split)
        source = JdbcSource(args.jdbc_url, args.schema, _properties(args.properties_file),
                            timeout_seconds=args.timeout)
        planned = planned_splits(spark, source, to_plan(args.tables, splits, args.single_task),
                                 dict(args.split_on), args.ranges)
        frames = extract_tables(spark, source, args.tables, splits=splits, predicates=planned)
        return store.write_raw(frames, full_refresh=args.full_refresh)
    if args.command == "build":
        from sparkmarts.plans.pipeline import build_marts

        return build_marts(store, write_staging=not args.no_staging)
    from sparkmarts.plans.pipeline import MART_NAMES

    marts = {n: store.read(n) for n in MART_NAMES}
    if args.command == "report":
        from sparkmarts.operators.reports import dashboard

        results = dashboard(marts, args.start, args.end)
    else:
        results = quality_checks(store, marts)
    written = []
    for name, df in results.items():
        df.write.mode("overwrite").parquet(f"{args.out.rstrip('/')}/{name}")
        written.append(name)
    return written


def split_of(text: str) -> tuple:
    """("table", JdbcSplit) of ``TABLE=COLUMN,LOWER,UPPER,PARTITIONS``."""
    from sparkmarts.sources.jdbc import JdbcSplit

    table, _, rest = text.partition("=")
    column, lower, upper, count = rest.split(",")
    return table, JdbcSplit(column.strip(), lower.strip(), upper.strip(), int(count))


def split_column(text: str) -> tuple[str, str]:
    """("table", "column") of ``TABLE=COLUMN``."""
    table, found, column = text.partition("=")
    if not (table and found and column):
        raise argparse.ArgumentTypeError(f"{text!r} is not TABLE=COLUMN")
    return table.strip(), column.strip()


def to_plan(tables, splits, single_task) -> list[str]:
    """Tables whose ranges come from the source: those without given strides and not named as small."""
    return [t for t in tables or SOURCE_TABLES if t not in splits and t not in single_task]


def quality_checks(store, marts) -> dict:
    """Every data-quality check over the stored raw tables and marts, as DataFrames."""
    from sparkmarts.operators import quality as Q
    from sparkmarts.operators.staging import stg_analytics_events

    raw = store.read_raw()
    events = raw["analytics_events"]
    return {
        "event_allowlist": Q.event_allowlist_violations(events),
        "not_null": Q.null_counts(events),
        "unique_id": Q.duplicate_ids(raw),
        "orphans": Q.orphan_references(events, {"organizations": raw["organizations"],
                                                "clubs": raw["clubs"]}),
        "pii": Q.pii_rows(stg_analytics_events(events)),
        "finance_domains": Q.finance_domains(marts["mart_finance"]),
        "finance_totals": Q.finance_totals(marts["mart_finance"]),
        "non_empty": Q.non_empty(marts),
    }
