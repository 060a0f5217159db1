"""The six marts on the sample fixture against hand-derived goldens, plus the product's own
end-to-end assertions (finance totals, domains, no money columns in the ranking)."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

from sparkmarts.operators.ordering import ordered_mart
from tests.conftest import bag, rows
from tests.fixtures import EXPECTED_TOTAL, GOLDEN, MART_COLUMNS, PAID_TOTAL


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_mart_equals_golden(sample_marts, name):
    df = sample_marts[name]
    assert df.columns == MART_COLUMNS[name]
    assert bag(df) == sorted(GOLDEN[name], key=repr)


@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_mart_canonical_order(sample_marts, name):
    got = rows(ordered_mart(sample_marts[name], name))
    if name == "mart_growth_daily":
        keys = [(r[0], r[2], r[3]) for r in got]
    elif name == "mart_admin_usage":
        keys = [(r[0], r[1]) for r in got]
    elif name == "mart_product_activity":
        keys = [(r[0], r[2]) for r in got]
    elif name == "mart_finance":
        keys = [(r[0], r[1], r[2]) for r in got]
    elif name == "mart_retention":
        keys = [(r[0] is None, str(r[0]), r[1] is None, r[1] or 0) for r in got]
    else:
        keys = [(-r[6], -r[2].toordinal() if r[2] else 0) for r in got]
    assert keys == sorted(keys)


def test_mart_types(sample_marts):
    growth = sample_marts["mart_growth_daily"].schema
    assert growth["event_date"].dataType == T.DateType()
    assert growth["events"].dataType == T.LongType()
    usage = sample_marts["mart_admin_usage"].schema
    assert usage["first_login_at"].dataType == T.TimestampNTZType()
    assert sample_marts["mart_retention"].schema["day_number"].dataType == T.LongType()
    assert sample_marts["mart_finance"].schema["expected_amount"].dataType == T.DoubleType()
    assert sample_marts["mart_entity_ranking"].schema["health_score"].dataType == T.LongType()


def test_product_assertions(sample_marts):
    fin = sample_marts["mart_finance"]
    totals = fin.agg({"expected_amount": "sum", "paid_amount": "sum"}).first()
    assert (totals["sum(expected_amount)"], totals["sum(paid_amount)"]) == (EXPECTED_TOTAL, PAID_TOTAL)
    assert {r[0] for r in fin.select("domain").distinct().collect()} == {
        "league", "tournament", "club_match"}
    ranking_cols = set(sample_marts["mart_entity_ranking"].columns)
    assert "expected_amount" not in ranking_cols and "paid_amount" not in ranking_cols
    for name in ("mart_growth_daily", "mart_admin_usage", "mart_entity_ranking"):
        assert sample_marts[name].count() > 0


def test_retention_null_day_and_null_cohort(spark, sample):
    """An organisation whose admin never acts yields day_number NULL; an unparseable creation
    time is its own NULL cohort."""
    from sparkmarts.plans import pipeline
    from sparkmarts.sources.normalize import normalize

    extra = spark.createDataFrame(
        [("org-3", "2026-05-09T09:00:00Z", "admin-9"), ("org-4", "not a time", "a-ines")],
        "id string, created_at string, created_by string",
    )
    raw = dict(sample)
    raw["organizations"] = sample["organizations"].unionByName(normalize(extra, "organizations"))
    got = bag(pipeline.marts(raw)["mart_retention"])
    assert (sample["organizations"].count() + 2) == raw["organizations"].count()
    from datetime import date
    assert (date(2026, 5, 9), None, 1, 1) in got
    assert (None, None, 2, 2) in got  # with the undated group of the fixture


def test_retention_counts_all_orgs_of_an_active_admin(spark, sample):
    """Activity belongs to the admin, not to the organisation: a second organisation of
    a-ines on the same day is active whenever a-ines is, even without events of its own."""
    from sparkmarts.plans import pipeline
    from sparkmarts.sources.normalize import normalize

    extra = spark.createDataFrame([("g-new", "2025-09-01T23:00:00Z", "a-ines")],
                                  "id string, created_at string, created_by string")
    raw = dict(sample)
    raw["organizations"] = sample["organizations"].unionByName(normalize(extra, "organizations"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(pipeline.marts(raw)["mart_retention"])}
    from datetime import date
    assert got[(date(2025, 9, 1), 2)] == (1, 3)
    assert got[(date(2025, 9, 1), 30)] == (1, 3)


def test_ranking_counts_undated_players_and_activity_does_not(spark, sample):
    from sparkmarts.plans import pipeline
    from sparkmarts.sources.normalize import normalize

    extra = spark.createDataFrame([("p-x", "garbage", "g-hill", False)],
                                  "id string, created_at string, organization_id string, "
                                  "active boolean")
    raw = dict(sample)
    raw["players"] = sample["players"].unionByName(normalize(extra, "players"))
    m = pipeline.marts(raw)
    ranking = {r[0]: r[3] for r in rows(m["mart_entity_ranking"])}
    assert ranking["g-hill"] == 1
    activity = bag(m["mart_product_activity"].where("metric = 'players_created'"))
    assert sum(r[3] for r in activity) == 7


def test_finance_club_rules(spark):
    from sparkmarts.operators.marts import finance
    from sparkmarts.sources.normalize import empty_frame, normalize

    club = normalize(spark.createDataFrame(
        [("a", "2026-01-01", "m", None, None), ("b", "2026-01-01", "m", 500, None),
         ("c", "2026-01-01", "m", None, 300), ("d", "bad", "m", 1, 1)],
        "id string, created_at string, match_id string, expected_cents bigint, "
        "paid_cents bigint"), "club_match_payments")
    league = normalize(spark.createDataFrame(
        [("l", "2026-01-02", "x", "1,5", None, None, ""), ("k", "2026-01-02", "y", " 7 ", "USD",
                                                            "approved", None)],
        "id string, created_at string, created_league_id string, amount string, "
        "currency_id string, status string, purpose string"), "league_billing_payments")
    got = bag(finance(league, empty_frame(spark, "tournament_billing_payments"), club),
              ["entity_id", "flow", "status", "expected_amount", "paid_amount", "currency"])
    assert got == sorted([
        ("m", "field_cost_collection", "paid", 0.0, 0.0, "ARS"),
        ("m", "field_cost_collection", "pending", 5.0, 0.0, "ARS"),
        ("m", "field_cost_collection", "paid", 0.0, 3.0, "ARS"),
        ("x", "league_payment", None, 0.0, 0.0, "ARS"),
        ("y", "league_payment", "approved", 7.0, 7.0, "USD"),
    ], key=repr)


def test_retention_window_edges_across_periods(spark):
    """Cohorts on every offset of a 31-day period (also before 1970, where period numbers are
    negative), with activity one day before, on, inside, on the last day of and one day after
    the window: exactly days 0, 15 and 30 count, whatever period boundaries the window crosses."""
    from datetime import date, timedelta

    from sparkmarts.operators.marts import retention
    from sparkmarts.operators.staging import stg_analytics_events, stg_organizations
    from sparkmarts.sources.normalize import normalize

    orgs, events = [], []
    for base in (date(1969, 11, 1), date(2026, 3, 1)):
        for r in range(31):
            c = base + timedelta(days=r)
            admin = f"a-{base.year}-{r}"
            orgs.append((f"o-{base.year}-{r}", f"{c} 08:00:00", admin))
            for k in (-1, 0, 15, 30, 31):
                events.append((f"e-{admin}-{k}", f"{c + timedelta(days=k)} 09:00:00",
                               "admin_login_succeeded", admin))
    o = normalize(spark.createDataFrame(orgs, "id string, created_at string, created_by string"),
                  "organizations")
    e = normalize(spark.createDataFrame(events, "id string, created_at string, "
                                                "event_name string, admin_id string"),
                  "analytics_events")
    got = rows(retention(stg_organizations(o), stg_analytics_events(e)))
    assert sorted({r[1] for r in got}) == [0, 15, 30]
    assert all(r[2] == 1 and r[3] == 1 for r in got)
    assert len(got) == 62 * 3
