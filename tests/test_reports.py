"""Dashboard reports on the sample fixture."""

from __future__ import annotations

from datetime import date

from sparkmarts.operators import reports as R
from tests.conftest import bag, rows


def test_default_range_and_kpis(sample_marts):
    assert R.default_range(sample_marts["mart_growth_daily"]) == (date(2025, 9, 1),
                                                                  date(2025, 10, 1))
    dash = R.dashboard(sample_marts)
    k = dash["kpis"].first().asDict()
    # payments of 2 October lie outside the growth mart's range
    assert k == {"total_events": 11, "active_admins": 3, "paid_amount": 7250.5,
                 "finished_matches": 3}
    bounds = dash["date_bounds"].first()
    assert tuple(bounds) == (date(2025, 9, 1), date(2025, 10, 1))
    half = R.dashboard(sample_marts, start=date(2025, 9, 22))["kpis"].first().asDict()
    assert half == k  # an incomplete range counts as the full one


def test_kpis_empty_range_is_zero(sample_marts):
    dash = R.dashboard(sample_marts, date(2020, 1, 1), date(2020, 1, 2))
    assert dash["kpis"].first().asDict() == {"total_events": 0, "active_admins": 0,
                                             "paid_amount": 0.0, "finished_matches": 0}


def test_events_by_stage(sample_marts):
    dash = R.dashboard(sample_marts)
    assert dict(rows(dash["events_by_stage"])) == {
        "acquisition": 2, "activation": 2, "product": 1, "referral": 1, "retention": 4,
        "revenue": 1}


def test_full_range_finance(sample_marts):
    dash = R.dashboard(sample_marts, "2025-09-01", "2025-10-31")
    assert dash["kpis"].first()["paid_amount"] == 7275.51
    by_status = dict((r[0], (r[1], r[2])) for r in rows(dash["finance_by_status"]))
    assert by_status == {"approved": (7250.5, 7250.5), "paid": (25.0, 25.0),
                         "partial": (25.0, 0.01), "pending": (925.0, 0.0), "rejected": (4100.0, 0.0)}
    by_flow = {(r[0], r[1]): (r[2], r[3]) for r in rows(dash["finance_by_flow"])}
    assert by_flow[("club_match", "field_cost_collection")] == (75.0, 25.01)


def test_finance_by_status_drops_null_status(spark):
    fin = spark.createDataFrame(
        [(date(2026, 1, 1), None, 5.0, 0.0), (date(2026, 1, 1), "approved", 2.0, 2.0)],
        "payment_date date, status string, expected_amount double, paid_amount double")
    assert rows(R.finance_by_status(fin)) == [("approved", 2.0, 2.0)]


def test_usage_by_day_and_series(sample_marts):
    dash = R.dashboard(sample_marts)
    assert sorted(rows(dash["usage_by_day"])) == [(date(2025, 9, 3), 2, 1),
                                                (date(2025, 9, 22), 2, 2)]
    series = bag(dash["growth_series"])
    assert (date(2025, 9, 1), "acquisition", 2) in series
    assert len(bag(dash["retention_series"])) == 7


def test_growth_detail_order(sample_marts):
    got = rows(R.growth_detail(sample_marts["mart_growth_daily"]), ["event_date", "events"])
    assert got == sorted(got, key=lambda r: (-r[0].toordinal(), -r[1]))


def test_finance_detail_order(sample_marts):
    got = [r[0] for r in rows(R.finance_detail(sample_marts["mart_finance"]), ["payment_date"])]
    assert got == sorted(got, reverse=True)


def test_ranking_top_ties_and_limit(spark):
    df = spark.createDataFrame(
        [(f"org-{i:02d}", "n", date(2026, 1, 1 + i % 3), 0, 0, 0, 10 - i // 10)
         for i in range(30)],
        "organization_id string, organization_name string, created_date date, players bigint, "
        "matches_created bigint, matches_finished bigint, health_score bigint")
    top = rows(R.ranking_top(df, 20))
    assert len(top) == 20
    keys = [(-r[6], -r[2].toordinal(), r[0]) for r in top]
    assert keys == sorted(keys)
    assert all(r[6] >= 9 for r in top)


def test_in_range_is_inclusive(sample_marts):
    g = R.in_range(sample_marts["mart_growth_daily"], "event_date", date(2025, 9, 3),
                   date(2025, 9, 3))
    assert g.count() == 2


def test_dashboard_on_empty_marts(spark, sample_marts):
    empty = {name: df.limit(0) for name, df in sample_marts.items()}
    assert R.default_range(empty["mart_growth_daily"]) == (None, None)
    dash = R.dashboard(empty)
    assert dash["kpis"].first().asDict() == {"total_events": 0, "active_admins": 0,
                                             "paid_amount": 0.0, "finished_matches": 0}
    assert dash["events_by_stage"].count() == 0
    assert dash["ranking_top"].count() == 0
