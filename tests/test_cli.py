"""The spark-submit entry points on a temporary table store."""

from __future__ import annotations

from sparkmarts.cli import _properties, main
from sparkmarts.sources.warehouse import Warehouse


def test_build_and_report(spark, sample, tmp_path):
    root = str(tmp_path / "wh")
    Warehouse(spark, root).write_raw(sample)
    assert main(["build", "--warehouse", root]) == [
        "mart_growth_daily", "mart_admin_usage", "mart_product_activity", "mart_finance",
        "mart_retention", "mart_entity_ranking"]
    out = str(tmp_path / "reports")
    written = main(["report", "--warehouse", root, "--out", out])
    assert "kpis" in written and "ranking_top" in written
    k = spark.read.parquet(f"{out}/kpis").first().asDict()
    assert k == {"total_events": 11, "active_admins": 3, "paid_amount": 7250.5,
                 "finished_matches": 3}
    dq = str(tmp_path / "quality")
    checks = main(["quality", "--warehouse", root, "--out", dq])
    assert len(checks) == 8
    assert spark.read.parquet(f"{dq}/unique_id").count() == 0
    assert spark.read.parquet(f"{dq}/finance_totals").first()["paid_amount"] == 7275.51


def test_properties_file(tmp_path):
    f = tmp_path / "db.properties"
    f.write_text("# comment\nuser = reader\npassword=s3cr=t\n\n")
    assert _properties(str(f)) == {"user": "reader", "password": "s3cr=t"}
    assert _properties(None) == {}


def test_extract_plans_the_tables_without_own_splits():
    import pytest

    from sparkmarts.cli import parser, to_plan

    args = parser().parse_args([
        "extract", "--jdbc-url", "u", "--schema", "s", "--warehouse", "w", "--timeout", "900",
        "--split", "players=created_at,2025-01-01,2026-01-01,64", "--single-task", "clubs",
        "--split-on", "matches=scheduled_at", "--ranges", "8"])
    split = dict(args.split)["players"].options()
    assert split["numPartitions"] == "64" and split["lowerBound"] == "2025-01-01"
    assert args.timeout == 900 and args.ranges == 8 and dict(args.split_on) == {"matches": "scheduled_at"}
    assert to_plan(["players", "matches", "clubs"], dict(args.split), args.single_task) == ["matches"]
    assert len(to_plan(None, dict(args.split), args.single_task)) == 9
    with pytest.raises(SystemExit):
        parser().parse_args(["extract", "--jdbc-url", "u", "--schema", "s", "--warehouse", "w",
                             "--split-on", "matches"])


def test_report_and_quality_of_an_empty_product(spark, tmp_path):
    root = str(tmp_path / "empty")
    main(["build", "--warehouse", root])
    main(["report", "--warehouse", root, "--out", str(tmp_path / "r")])
    main(["quality", "--warehouse", root, "--out", str(tmp_path / "q")])
    assert spark.read.parquet(str(tmp_path / "r" / "kpis")).first()["total_events"] == 0
