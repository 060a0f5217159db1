"""Normalisation, file sources, the table store and the JDBC option builders.

JDBC reads themselves are not exercised: that needs a database server or an embedded database,
and neither is started by the tests. The builders and guards around them are.
"""

from __future__ import annotations

import json
import math
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.contracts import SOURCE_TABLES
from sparkmarts.plans import pipeline
from sparkmarts.sources.files import read_files
from sparkmarts.sources.jdbc import (
    JdbcSource,
    JdbcSplit,
    extract_tables,
    qualified_table,
    reader_options,
    time_slice_predicates,
)
from sparkmarts.sources.normalize import empty_frame, normalize
from sparkmarts.sources.warehouse import IncompleteTableError, Warehouse, built_schema
from tests.conftest import bag
from tests.fixtures import GOLDEN, MART_COLUMNS


def test_normalize_adds_drops_and_orders(spark):
    df = spark.createDataFrame([("p2", "x", "org-1", float("nan"))],
                               "organization_id string, extra string, id string, junk double")
    out = normalize(df, "players")
    assert out.columns == ["id", "created_at", "organization_id", "active"]
    assert out.schema["created_at"].dataType == T.TimestampNTZType()
    assert out.schema["active"].dataType == T.BooleanType()
    assert tuple(out.first()) == ("org-1", None, "p2", None)


def test_normalize_json_and_nan(spark):
    df = spark.createDataFrame([("e", None, float("nan")), ("f", '{"a": 1}', 2.0)],
                               "id string, properties string, amount double")
    ev = normalize(df, "analytics_events")
    assert [r[0] for r in ev.select("properties").collect()] == ["{}", '{"a": 1}']
    missing = normalize(df.select("id"), "analytics_events")
    assert missing.first()["properties"] == "{}"
    pay = normalize(df, "league_billing_payments")
    assert [r[0] for r in pay.select("amount").collect()] == [None, 2.0]


def test_empty_frame_has_contract(spark):
    for table, spec in SOURCE_TABLES.items():
        df = empty_frame(spark, table)
        assert df.schema == spec.schema
        assert df.count() == 0


def test_csv_and_json_sources(spark, tmp_path):
    csv_dir = tmp_path / "players_csv"
    csv_dir.mkdir()
    (csv_dir / "part.csv").write_text(
        "organization_id,id,created_at,nickname\norg-1,p1,2026-05-03T12:00:00Z,Ana\n"
        "org-2,p2,garbage,Bo\n")
    players = read_files(spark, str(csv_dir), "players", "csv")
    assert players.columns == ["id", "created_at", "organization_id", "active"]
    assert sorted(tuple(r) for r in players.collect()) == [
        ("p1", "2026-05-03T12:00:00Z", "org-1", None), ("p2", "garbage", "org-2", None)]

    js = tmp_path / "events.json"
    js.write_text(json.dumps({"id": "e1", "created_at": "2026-05-03T12:00:00Z",
                              "event_name": "cta_clicked", "properties": {"b": 1, "a": [1, 2]}})
                  + "\n")
    ev = read_files(spark, str(js), "analytics_events", "json")
    row = ev.first()
    assert row["event_name"] == "cta_clicked"
    assert json.loads(row["properties"]) == {"a": [1, 2], "b": 1}
    stg = pipeline.stage({"analytics_events": ev, "organizations": empty_frame(
        spark, "organizations"), "matches": empty_frame(spark, "matches")})
    assert stg["stg_analytics_events"].first()["event_at"] == datetime(2026, 5, 3, 12)
    with pytest.raises(ValueError):
        read_files(spark, str(js), "analytics_events", "xml")


def test_warehouse_raw_refresh_and_log(spark, sample, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh"))
    assert not wh.exists("raw_players")
    written = wh.write_raw({"players": sample["players"]})
    assert written == ["raw_players"]
    assert wh.exists("raw_players") and not wh.exists("raw_matches")
    log = wh.read("etl_runs").first()
    assert log["table_count"] == 1 and log["loaded_at"] is not None
    written = wh.write_raw({"players": sample["players"]}, full_refresh=True)
    assert len(written) == 11
    assert wh.read("raw_matches").count() == 0
    assert wh.read("etl_runs").count() == 1
    assert wh.present(["raw_organization_billing_payments", "raw_players"]) == ["raw_players"]


def test_build_marts_end_to_end(spark, sample, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh2"))
    wh.write_raw(sample)
    names = pipeline.build_marts(wh)
    assert names == list(pipeline.MART_NAMES)
    for name in names:
        assert bag(wh.read(name).select(*GOLDEN_COLUMNS(name))) == sorted(GOLDEN[name], key=repr)
    from datetime import date

    q = wh.query("SELECT funnel_stage, SUM(events) AS events FROM {mart_growth_daily} "
                 "WHERE event_date BETWEEN :start AND :end GROUP BY funnel_stage",
                 {"start": date(2025, 9, 1), "end": date(2025, 9, 2)})
    assert sorted(tuple(r) for r in q.collect()) == [("acquisition", 2), ("activation", 2)]
    # date-keyed marts are stored one folder per date, so report filters prune partitions
    version = wh.pointer("mart_finance").version
    folder = tmp_path / "wh2" / "mart_finance" / version
    assert any(p.startswith("payment_date=") for p in os.listdir(folder))
    assert wh.exists("stg_analytics_events")


def test_build_marts_creates_missing_raw(spark, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh3"))
    pipeline.build_marts(wh)
    for name in (*pipeline.STAGING_NAMES, *pipeline.MART_NAMES):
        assert wh.exists(name) and wh.read(name).count() == 0
        assert wh.read(name).schema == built_schema(name)
    assert wh.read("raw_analytics_events").schema == SOURCE_TABLES["analytics_events"].schema


def test_stored_marts_keep_schema_and_column_order(spark, sample, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh4"))
    some = {k: v for k, v in sample.items() if "payments" not in k}
    wh.write_raw(some)
    pipeline.build_marts(wh)
    assert wh.read("mart_finance").count() == 0
    lazy = pipeline.marts(wh.read_raw())
    for name in pipeline.MART_NAMES:
        assert wh.read(name).columns == lazy[name].columns == list(MART_COLUMNS[name])
        assert wh.read(name).schema == built_schema(name)


def versions(folder):
    return sorted(p.name for p in folder.iterdir() if p.is_dir())


def test_a_write_that_dies_leaves_the_old_table(spark, sample, tmp_path):
    wh = Warehouse(spark, str(tmp_path / "wh5"))
    wh.write("t", spark.range(3))
    reader = wh.read("t")
    bad = spark.range(5).select(F.expr("if(id = 4, raise_error('dies'), id)").alias("id"))
    with pytest.raises(Exception, match="dies"):
        wh.write("t", bad)
    assert wh.read("t").count() == 3 == reader.count() and wh.stats("t") == {"rows": 3.0}
    dead, running = (tmp_path / "wh5" / "t" / v for v in ("v0-killed", "v1-running"))
    for folder in (dead, running):  # as a killed driver and a running one leave them
        (folder / "_temporary").mkdir(parents=True)
    os.utime(dead, (1, 1))
    assert wh.read("t").count() == 3
    wh.write("t", wh.read("t").union(spark.range(1)))  # from its own old version
    assert wh.read("t").count() == 4 and reader.count() == 3
    assert len(versions(tmp_path / "wh5" / "t")) == 3 and running.exists() and not dead.exists()
    wh.write("t", spark.range(9))
    assert len(versions(tmp_path / "wh5" / "t")) == 3 and wh.read("t").count() == 9  # the oldest went
    # a version that lost its marker is not read
    (tmp_path / "wh5" / "t" / wh.pointer("t").version / "_SUCCESS").unlink()
    with pytest.raises(IncompleteTableError):
        wh.read("t")
    with pytest.raises(ValueError):
        wh.read("mart_finance")
    with pytest.raises(ValueError):
        wh.stats("mart_finance")


def test_a_build_switches_all_its_tables_at_the_end(spark, sample, tmp_path, monkeypatch):
    wh = Warehouse(spark, str(tmp_path / "wh6"))
    wh.write_raw(sample)
    pipeline.build_marts(wh)
    before = {n: wh.pointer(n).version for n in (*pipeline.STAGING_NAMES, *pipeline.MART_NAMES)}
    wh.write_raw({"analytics_events": sample["analytics_events"].limit(0)})

    def dies(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr("sparkmarts.operators.marts.entity_ranking", dies)
        with pytest.raises(RuntimeError, match="killed"):
            pipeline.build_marts(wh)
    other = Warehouse(spark, str(tmp_path / "wh6"))
    assert {n: other.pointer(n).version for n in before} == before
    assert other.read("mart_growth_daily").count() == len(GOLDEN["mart_growth_daily"])
    with wh.switch_at_end():
        wh.write("a", spark.range(1))
        assert wh.read("a").count() == 1 and not other.exists("a")
    assert other.exists("a")
    pipeline.build_marts(wh)
    assert other.read("mart_growth_daily").count() == 0
    assert all(other.pointer(n).version != v for n, v in before.items())


def test_observed_figures_equal_the_checks(spark, sample, tmp_path):
    from sparkmarts.operators import quality as Q
    from tests.test_quality import dirty_events

    raw = {**sample, "analytics_events": dirty_events(spark, sample)}
    wh = Warehouse(spark, str(tmp_path / "wh7"))
    wh.write_raw(raw)
    pipeline.build_marts(wh)
    events, finance = wh.read("raw_analytics_events"), wh.read("mart_finance")
    seen = wh.stats("raw_analytics_events")
    nulls = Q.null_counts(events).first().asDict()
    assert {**{k: seen[k] for k in nulls if k != "total_rows"}, "total_rows": seen["rows"]} == nulls
    assert seen["event_name_not_allowed"] == Q.event_allowlist_violations(events).count() == 1
    staged = wh.read("stg_analytics_events")
    assert wh.stats("stg_analytics_events")["pii_hits"] == Q.pii_hits(staged).first()["pii_hits"] == 1
    totals = Q.finance_totals(finance, money_digits=None).first()
    seen = wh.stats("mart_finance")
    assert (seen["rows"], seen["expected_amount"], seen["paid_amount"]) == tuple(totals)
    assert {d for d in ("league", "tournament", "club_match") if seen[f"domain:{d}"]} == {
        r["domain"] for r in Q.finance_domains(finance).where("in_data").collect()}
    for name in pipeline.MART_NAMES:
        assert wh.stats(name)["rows"] == wh.read(name).count()
    log = {(r["table_name"], r["metric"]): r["value"] for r in wh.read("etl_table_stats").collect()}
    assert log[("mart_finance", "rows")] == totals["payments"]
    assert log[("raw_players", "rows")] == sample["players"].count()
    stats = {n: wh.stats(n) for n in ("raw_analytics_events", "stg_analytics_events", *pipeline.MART_NAMES)}
    assert Q.observed_findings(stats) == [
        "raw_analytics_events: id_nulls = 1", "raw_analytics_events: created_at_nulls = 1",
        "raw_analytics_events: event_name_nulls = 1", "raw_analytics_events: source_nulls = 1",
        "raw_analytics_events: event_name_not_allowed = 1", "stg_analytics_events: pii_hits = 1"]
    assert Q.observed_findings({"mart_finance": {"rows": 0.0}, "mart_admin_usage": {"rows": 0.0}}) == [
        "mart_finance: no rows of domain league", "mart_finance: no rows of domain tournament",
        "mart_finance: no rows of domain club_match", "mart_admin_usage: no rows"]


def GOLDEN_COLUMNS(name):
    from tests.fixtures import MART_COLUMNS

    return MART_COLUMNS[name]


def test_time_slice_predicates_cover_everything():
    preds = time_slice_predicates("created_at", ["2026-01-01", "2026-02-01", "2026-03-01"])
    assert preds == [
        '("created_at" < \'2026-01-01\' OR "created_at" IS NULL)',
        '("created_at" >= \'2026-01-01\' AND "created_at" < \'2026-02-01\')',
        '("created_at" >= \'2026-02-01\' AND "created_at" < \'2026-03-01\')',
        '"created_at" >= \'2026-03-01\'',
    ]
    with pytest.raises(ValueError):
        time_slice_predicates("created_at; drop", ["2026-01-01"])


def test_jdbc_options_and_guards(spark):
    src = JdbcSource("jdbc:postgresql://db/app", "analytics", {"user": "reader"})
    opts = reader_options(src)
    assert opts["queryTimeout"] == "60" and opts["user"] == "reader"
    assert opts["preferTimestampNTZ"] == "true"
    assert qualified_table(src, "players") == '"analytics"."players"'
    split = JdbcSplit("created_at", "2026-01-01 00:00:00", "2026-06-01 00:00:00", 64).options()
    assert split["numPartitions"] == "64" and split["partitionColumn"] == "created_at"
    with pytest.raises(ValueError):
        JdbcSource("jdbc:postgresql://db/app", "bad-schema")
    with pytest.raises(KeyError):
        extract_tables(spark, src, ["organization_billing_payments"])
    with pytest.raises(KeyError):
        extract_tables(spark, src, ["no_such_table"])


def test_nan_amount_is_not_paid(spark):
    from sparkmarts.operators.marts import finance

    club = normalize(spark.createDataFrame([("a", "2026-01-01", "m", float("nan"), 100.0)],
                                           "id string, created_at string, match_id string, "
                                           "expected_cents double, paid_cents double"),
                     "club_match_payments")
    row = finance(empty_frame(spark, "league_billing_payments"),
                  empty_frame(spark, "tournament_billing_payments"), club).first()
    assert row["status"] == "paid" and row["expected_amount"] == 0.0
    assert not math.isnan(row["expected_amount"])


def test_catalog_warehouse_round_trip(spark, sample, tmp_path):
    from sparkmarts.sources.warehouse import CatalogWarehouse

    spark.sql(f"CREATE DATABASE IF NOT EXISTS marts_test LOCATION '{tmp_path / 'db'}'")
    try:
        wh = CatalogWarehouse(spark, "marts_test")
        assert not wh.exists("raw_players")
        wh.write_raw(sample)
        assert wh.exists("raw_players") and wh.exists("etl_runs")
        pipeline.build_marts(wh)
        got = bag(wh.read("mart_entity_ranking").select(*GOLDEN_COLUMNS("mart_entity_ranking")))
        assert got == sorted(GOLDEN["mart_entity_ranking"], key=repr)
        assert spark.catalog.tableExists("marts_test.mart_finance")
        assert wh.stats("mart_finance")["rows"] == wh.read("mart_finance").count() == 6
        old = wh.pointer("mart_finance").version
        pipeline.build_marts(wh)
        pipeline.build_marts(wh)
        tables = {t.name for t in spark.catalog.listTables("marts_test")}
        assert wh._version_table("mart_finance", old).split(".")[1] not in tables
        assert sum(t.startswith("mart_finance__") for t in tables) == 2
        with pytest.raises(ValueError):
            CatalogWarehouse(spark, "bad name")
    finally:
        spark.sql("DROP DATABASE IF EXISTS marts_test CASCADE")


def test_ranking_from_bucketed_tables_needs_no_exchange(spark, sample, tmp_path):
    from sparkmarts.plans.inspect import count_nodes, plan_text
    from sparkmarts.sources.warehouse import CatalogWarehouse

    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in off}
    spark.sql(f"CREATE DATABASE IF NOT EXISTS marts_buckets LOCATION '{tmp_path / 'db2'}'")
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        plain, bucketed = (CatalogWarehouse(spark, "marts_buckets", buckets=n) for n in (0, 4))
        exchanges = {}
        for name, wh in (("plain", plain), ("bucketed", bucketed)):
            wh.write_raw(sample)
            pipeline.build_marts(wh)
            staged = {n: wh.read(n) for n in pipeline.STAGING_NAMES}
            mart = pipeline.marts(wh.read_raw(), staged)["mart_entity_ranking"]
            plan = plan_text(mart)
            exchanges[name] = count_nodes(plan, "Exchange")
            assert count_nodes(plan, "SortMergeJoin") == 2
            assert bag(mart) == sorted(GOLDEN["mart_entity_ranking"], key=repr)
        assert exchanges["plain"] >= 3 and exchanges["bucketed"] == 0
    finally:
        spark.sql("DROP DATABASE IF EXISTS marts_buckets CASCADE")
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_planned_ranges_are_even_and_cover_every_row(spark):
    """The planner's SQL and predicates on a Spark relation: uneven values, a hot one, NULLs."""
    from sparkmarts.sources.jdbc import quantile_query, range_predicates

    rows = spark.range(4000).select(
        F.when(F.col("id") % 10 != 0, F.pow(F.col("id") / 1000, 4).cast("int")).alias("n"),
        F.expr("cast(date'2026-01-01' + cast(pow(id / 1000, 4) as int) as timestamp_ntz)").alias("created_at"),
        F.when(F.col("id") % 3 != 0, F.concat(F.lit("it's "), F.col("id").cast("string")))
        .otherwise("hot").alias("name"))
    rows.createOrReplaceTempView("planned_rows")
    name = "spark.sql.ansi.doubleQuotedIdentifiers"
    spark.conf.set(name, "true")
    try:
        for column, most in (("n", 950), ("created_at", 1050), ("name", 1750)):
            ends = spark.sql(quantile_query('"planned_rows"', column, 8)).collect()
            assert len(ends) == 8 and sum(r["row_count"] for r in ends) == rows.where(
                F.col(column).isNotNull()).count()
            predicates = range_predicates(column, sorted(r["lower_end"] for r in ends))
            sizes = [spark.sql(f"SELECT * FROM planned_rows WHERE {p}").count() for p in predicates]
            assert sum(sizes) == 4000  # disjoint and covering
            assert sizes[-1] == rows.where(F.col(column).isNull()).count()
            assert max(sizes) <= most
            for one, other in zip(predicates, predicates[1:]):
                assert spark.sql(f"SELECT * FROM planned_rows WHERE {one} AND {other}").count() == 0
        none = [spark.sql(f"SELECT * FROM planned_rows WHERE {p}").count() for p in range_predicates("n", [])]
        assert sum(none) == 4000
    finally:
        spark.conf.unset(name)
        spark.catalog.dropTempView("planned_rows")
    with pytest.raises(ValueError):
        quantile_query('"t"', "bad column", 8)
    with pytest.raises(ValueError):
        quantile_query('"t"', "n", 0)
    with pytest.raises(ValueError):
        range_predicates("n", [False, True])
