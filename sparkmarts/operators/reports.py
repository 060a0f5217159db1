"""Dashboard report operators over the marts.

Each function takes a mart DataFrame (already restricted to the report's date range where the
dashboard does that) and returns a lazy DataFrame. Grouped sums drop NULL group keys only where
the dashboard's frame library does (the finance status); money sums are rounded to cents by
default, which makes them independent of the summation order across partitions.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmarts.operators.ordering import ordered, ordered_spread

MONEY_DIGITS = 2
TOP_N = 20


def _as_date(value: date | str | Column) -> Column:
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, date):
        return F.lit(value)
    return F.lit(value).cast("date")


def in_range(df: DataFrame, date_column: str, start, end) -> DataFrame:
    """Rows whose ``date_column`` lies in [start, end] (inclusive both ends).

    On a mart stored partitioned by ``date_column`` this prunes partitions at planning time.
    """
    return df.where(F.col(date_column).between(_as_date(start), _as_date(end)))


def _money(total: Column, digits: int | None) -> Column:
    return total if digits is None else F.round(total, digits)


def _sum0(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def date_bounds(growth: DataFrame) -> DataFrame:
    """First and last event day of the growth mart (the dashboard's default range)."""
    return growth.agg(F.min("event_date").alias("min_date"), F.max("event_date").alias("max_date"))


def default_range(growth: DataFrame) -> tuple[date | None, date | None]:
    """The default range as two Python dates (one bounded aggregate row)."""
    row = date_bounds(growth).first()
    return (row["min_date"], row["max_date"]) if row else (None, None)


def kpis(
    growth: DataFrame,
    usage: DataFrame,
    activity: DataFrame,
    finance: DataFrame,
    money_digits: int | None = MONEY_DIGITS,
) -> DataFrame:
    """One row: total_events, active_admins, paid_amount, finished_matches (0 when empty).

    The four one-row aggregates are stacked with a union and folded by one global aggregate,
    so the plan has no join at all.
    """
    parts = [
        growth.agg(_sum0("events").cast("bigint").alias("total_events")),
        usage.agg(F.count_distinct("admin_id").alias("active_admins")),
        finance.agg(_money(F.coalesce(F.sum("paid_amount"), F.lit(0.0)), money_digits)
                    .alias("paid_amount")),
        activity.agg(
            F.coalesce(F.sum(F.when(F.col("metric") == "matches_finished", F.col("value"))),
                       F.lit(0)).cast("bigint").alias("finished_matches")
        ),
    ]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    names = ["total_events", "active_admins", "paid_amount", "finished_matches"]
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def events_by_stage(growth: DataFrame) -> DataFrame:
    """Events per funnel stage."""
    return growth.groupBy("funnel_stage").agg(F.sum("events").cast("bigint").alias("events"))


def finance_by_status(finance: DataFrame, money_digits: int | None = MONEY_DIGITS) -> DataFrame:
    """Expected and paid amounts per payment status (payments without status are left out)."""
    return (
        finance.where(F.col("status").isNotNull())
        .groupBy("status")
        .agg(
            _money(F.sum("expected_amount"), money_digits).alias("expected_amount"),
            _money(F.sum("paid_amount"), money_digits).alias("paid_amount"),
        )
    )


def growth_series(growth: DataFrame) -> DataFrame:
    """Events per day and funnel stage."""
    return growth.groupBy("event_date", "funnel_stage").agg(
        F.sum("events").cast("bigint").alias("events")
    )


def growth_detail(growth: DataFrame) -> DataFrame:
    """Growth rows, latest day first and busiest row first within a day."""
    return ordered_spread(growth, ("-event_date", "-events"))


def usage_by_day(usage: DataFrame) -> DataFrame:
    """Login events and distinct admins per day."""
    return usage.groupBy("event_date").agg(
        F.sum("login_events").cast("bigint").alias("login_events"),
        F.count_distinct("admin_id").alias("active_admins"),
    )


def finance_by_flow(finance: DataFrame, money_digits: int | None = MONEY_DIGITS) -> DataFrame:
    """Expected and paid amounts per domain and flow."""
    return finance.groupBy("domain", "flow").agg(
        _money(F.sum("expected_amount"), money_digits).alias("expected_amount"),
        _money(F.sum("paid_amount"), money_digits).alias("paid_amount"),
    )


def finance_detail(finance: DataFrame) -> DataFrame:
    """Payments, latest day first."""
    return ordered_spread(finance, ("-payment_date",))


def ranking_top(ranking: DataFrame, n: int = TOP_N) -> DataFrame:
    """The ``n`` healthiest organisations (ties broken by the later creation day, then id).

    ``orderBy(...).limit(n)`` plans as a per-partition top-n plus a final merge of n rows per
    partition, not a full sort.
    """
    return ordered(ranking, ("-health_score", "-created_date", "organization_id")).limit(n)


def retention_series(retention: DataFrame) -> DataFrame:
    """Active admins by day number for each cohort day."""
    return retention.select("cohort_date", "day_number", "active_admins")


def dashboard(
    marts: Mapping[str, DataFrame], start=None, end=None, top_n: int = TOP_N
) -> dict[str, DataFrame]:
    """Every report of the dashboard for the range [start, end].

    Unless both bounds are given, the growth mart's full range counts (one aggregate row is
    fetched to the driver for that). Retention and ranking are not date-filtered.
    """
    growth_all = marts["mart_growth_daily"]
    if start is None or end is None:
        start, end = default_range(growth_all)
    growth = in_range(growth_all, "event_date", start, end)
    usage = in_range(marts["mart_admin_usage"], "event_date", start, end)
    activity = in_range(marts["mart_product_activity"], "activity_date", start, end)
    fin = in_range(marts["mart_finance"], "payment_date", start, end)
    return {
        "date_bounds": date_bounds(growth_all),
        "kpis": kpis(growth, usage, activity, fin),
        "events_by_stage": events_by_stage(growth),
        "finance_by_status": finance_by_status(fin),
        "growth_series": growth_series(growth),
        "growth_detail": growth_detail(growth),
        "usage_by_day": usage_by_day(usage),
        "usage_detail": usage,
        "activity_series": activity,
        "finance_by_flow": finance_by_flow(fin),
        "finance_detail": finance_detail(fin),
        "ranking_top": ranking_top(marts["mart_entity_ranking"], top_n),
        "retention_series": retention_series(marts["mart_retention"]),
    }
