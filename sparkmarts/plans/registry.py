"""Named queries over the generic test tables.

Each entry takes (spark, sf_dir) and returns a lazy DataFrame computed from the whole driver
tables through ``sources.driver_tables``; nothing is sampled or capped. Dashboard queries use
fixed date ranges so that the SQL oracle can run the same filter.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmarts.functions import json_text
from sparkmarts.operators import id_sets as I
from sparkmarts.operators import quality as Q
from sparkmarts.operators import reports as R
from sparkmarts.plans import pipeline
from sparkmarts.sources.driver_tables import raw_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

GROWTH_RANGE = (date(2024, 1, 5), date(2024, 1, 20))
LONG_RANGE = (date(1996, 1, 1), date(2024, 1, 20))


def _raw(spark: SparkSession, sf_dir: str):
    return raw_tables(spark, sf_dir)


def _staged(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pipeline.stage(_raw(spark, sf_dir))[name]

    run.__name__ = name
    return run


def _mart(name: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pipeline.mart(_raw(spark, sf_dir), name)

    run.__name__ = name
    return run


def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _raw(spark, sf_dir)["analytics_events"]


def funnel_stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stg = pipeline.stage(_raw(spark, sf_dir))["stg_analytics_events"]
    return stg.groupBy("funnel_stage").agg(F.count(F.lit(1)).alias("events"))


def json_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured event attributes serialised as JSON text with sorted keys and NULL fields kept
    (the conversion the extractor applies to structured JSON columns)."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    doc = F.struct(
        F.col("user_id").alias("user"),
        F.col("event_type").alias("type"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("admin"),
    )
    dtype = ev.select(doc.alias("d")).schema["d"].dataType
    return ev.select(
        F.col("event_id").cast("string").alias("id"),
        json_text(doc, dtype).alias("properties"),
    )


def json_text_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON columns as text: objects in arrays in objects, maps, NULL objects, arrays and scalars."""
    ev = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    even = F.col("event_id") % 2 == 0
    doc = F.struct(
        F.array(F.col("event_id"), F.when(F.col("event_id") % 7 != 0, F.col("user_id"))).alias("ids"),
        F.struct(F.array(F.struct(F.lit("x").alias("c"), F.col("user_id").alias("b"))).alias("z"),
                 F.col("event_type").alias("a")).alias("inner_"),
        F.when(F.col("event_id") < 0, F.struct(F.lit(1).alias("y"))).alias("none"),
        F.create_map(F.lit("even"), even, F.lit("click"), F.col("event_type") == "click").alias("flags"),
    )
    given = F.col("event_id") % 5 != 0
    shown = ev.select(F.col("event_id").cast("string").alias("id"), doc.alias("properties"),
                      F.array(F.col("event_type"), F.lit(None)).alias("list_properties"),
                      F.when(given, F.col("event_id")).alias("number_properties"),
                      F.when(given, even).alias("flag_properties"))
    return shown.select("id", *[json_text(F.col(f.name), f.dataType).alias(f.name)
                                for f in shown.schema.fields[1:]])


def _marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return pipeline.marts(_raw(spark, sf_dir))


def _growth(spark, sf_dir):
    return R.in_range(pipeline.mart(_raw(spark, sf_dir), "mart_growth_daily"), "event_date",
                      *GROWTH_RANGE)


def _usage(spark, sf_dir):
    return R.in_range(pipeline.mart(_raw(spark, sf_dir), "mart_admin_usage"), "event_date",
                      *GROWTH_RANGE)


def _activity(spark, sf_dir):
    return R.in_range(pipeline.mart(_raw(spark, sf_dir), "mart_product_activity"),
                      "activity_date", *LONG_RANGE)


def _finance(spark, sf_dir):
    return R.in_range(pipeline.mart(_raw(spark, sf_dir), "mart_finance"), "payment_date",
                      *LONG_RANGE)


def dash_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _marts(spark, sf_dir)
    lo, hi = LONG_RANGE
    return R.kpis(
        R.in_range(m["mart_growth_daily"], "event_date", lo, hi),
        R.in_range(m["mart_admin_usage"], "event_date", lo, hi),
        R.in_range(m["mart_product_activity"], "activity_date", lo, hi),
        R.in_range(m["mart_finance"], "payment_date", lo, hi),
    )


def _growth_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = pipeline.stage(_raw(spark, sf_dir))["stg_analytics_events"]
    return I.growth_id_sets(events, I.number_ids(events, "admin_id"),
                            I.number_ids(events, "organization_id"))


def _set_queries() -> dict[str, QueryFn]:
    """Exact distinct counts from mergeable id sets: the mart, date ranges, looking back."""
    return {
        "growth_from_sets": lambda s, d: I.growth_daily_from_sets(_growth_sets(s, d)),
        "active_ids_by_stage": lambda s, d: I.active_ids(_growth_sets(s, d), *GROWTH_RANGE,
                                                         by=["funnel_stage"]),
        "active_ids_total": lambda s, d: I.active_ids(_growth_sets(s, d), *GROWTH_RANGE),
        "rolling_active_ids": lambda s, d: I.rolling_ids(_growth_sets(s, d), 7, by=["funnel_stage"]),
    }


def _report_queries() -> dict[str, QueryFn]:
    mart = pipeline.mart
    return {
        "growth_date_filter": _growth,
        "dash_date_bounds": lambda s, d: R.date_bounds(mart(_raw(s, d), "mart_growth_daily")),
        "dash_kpis": dash_kpis,
        "dash_events_by_stage": lambda s, d: R.events_by_stage(_growth(s, d)),
        "dash_finance_by_status": lambda s, d: R.finance_by_status(_finance(s, d)),
        "dash_growth_series": lambda s, d: R.growth_series(_growth(s, d)),
        "growth_detail": lambda s, d: R.growth_detail(_growth(s, d)),
        "dash_usage_by_day": lambda s, d: R.usage_by_day(_usage(s, d)),
        "usage_detail": _usage,
        "activity_series": _activity,
        "dash_finance_by_flow": lambda s, d: R.finance_by_flow(_finance(s, d)),
        "finance_detail": lambda s, d: R.finance_detail(_finance(s, d)),
        "ranking_top20": lambda s, d: R.ranking_top(mart(_raw(s, d), "mart_entity_ranking"), 20),
        "retention_series": lambda s, d: R.retention_series(mart(_raw(s, d), "mart_retention")),
    }


DQ_ID_TABLES = ("analytics_events", "organizations", "players", "matches",
                "league_billing_payments", "tournament_billing_payments", "club_match_payments")


def _quality_queries() -> dict[str, QueryFn]:
    def events(s, d):
        return _raw(s, d)["analytics_events"]

    def orphans(s, d):
        raw = _raw(s, d)
        return Q.orphan_references(raw["analytics_events"],
                                   {"organizations": raw["organizations"], "clubs": raw["clubs"]})

    def pii(s, d):
        return Q.pii_hits(pipeline.stage(_raw(s, d))["stg_analytics_events"])

    def full_finance(s, d):
        return pipeline.mart(_raw(s, d), "mart_finance")

    return {
        "dq_event_allowlist": lambda s, d: Q.event_allowlist_violations(events(s, d)),
        "dq_not_null": lambda s, d: Q.null_counts(events(s, d)),
        "dq_unique_id": lambda s, d: Q.duplicate_ids(_raw(s, d), DQ_ID_TABLES),
        "dq_orphans": orphans,
        "dq_pii_scan": pii,
        "dq_finance_domains": lambda s, d: Q.finance_domains(full_finance(s, d)),
        "dq_finance_totals": lambda s, d: Q.finance_totals(full_finance(s, d)),
        "dq_non_empty": lambda s, d: Q.non_empty(_marts(s, d)),
    }


def queries() -> dict[str, QueryFn]:
    q: dict[str, QueryFn] = {
        "normalize_events": normalize_events,
        "json_text": json_text_events,
        "json_text_nested": json_text_nested,
        "funnel_stage": funnel_stage_counts,
    }
    for name in pipeline.STAGING_NAMES:
        q[name] = _staged(name)
    for name in pipeline.MART_NAMES:
        q[name] = _mart(name)
    q.update(_report_queries())
    q.update(_set_queries())
    q.update(_quality_queries())
    return q
