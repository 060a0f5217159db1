"""Hot keys: one admin creates a third of all organisations and produces most events.

With broadcasts disabled (as for large sides on a cluster) the retention join is a sort-merge
join of cohort days and activity masks on (admin, 31-day period), a few rows per admin; the result
must equal the plain residual-join formulation of the mart.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkmarts.operators.day_masks import activity_masks
from sparkmarts.operators.marts import admin_usage, growth_daily, retention
from sparkmarts.operators.staging import stg_analytics_events, stg_organizations
from sparkmarts.plans.inspect import plan_text
from sparkmarts.sources.normalize import normalize

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


def skewed_raw(spark, n_orgs=3000, n_events=30000):
    orgs = spark.range(n_orgs).select(
        F.concat(F.lit("org-"), F.col("id").cast("string")).alias("id"),
        F.concat(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 20).cast("int"))
                 .cast("string"), F.lit(" 08:00:00")).alias("created_at"),
        F.when(F.col("id") % 3 == 0, F.lit("admin-hot"))
        .otherwise(F.concat(F.lit("admin-"), (F.col("id") % 500).cast("string")))
        .alias("created_by"),
    )
    events = spark.range(n_events).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 45).cast("int"))
                 .cast("string"), F.lit(" 12:00:00")).alias("created_at"),
        F.when(F.col("id") % 7 == 3, F.lit("cta_clicked"))
        .otherwise(F.lit("admin_login_succeeded")).alias("event_name"),
        F.when(F.col("id") % 2 == 0, F.lit("admin-hot"))
        .otherwise(F.concat(F.lit("admin-"), (F.col("id") % 500).cast("string")))
        .alias("admin_id"),
    )
    return normalize(orgs, "organizations"), normalize(events, "analytics_events")


def _with_conf(spark, conf, fn):
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        return fn()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _retention_by_residual_join(orgs, events):
    """The mart's definition written plainly: left join on the admin with the window as a
    residual condition (every cohort row meets every active day of its admin)."""
    cohorts = stg_organizations(orgs).where(F.col("admin_id").isNotNull()).select(
        "admin_id", "organization_id", F.col("created_date").alias("cohort_date"))
    act = (stg_analytics_events(events).where(F.col("admin_id").isNotNull())
           .select(F.col("admin_id").alias("a"), F.col("event_date").alias("d")).distinct())
    cond = ((F.col("a") == F.col("admin_id")) & (F.col("d") >= F.col("cohort_date"))
            & (F.col("d") < F.date_add(F.col("cohort_date"), 31)))
    return cohorts.join(act, cond, "left").groupBy(
        "cohort_date", F.datediff("d", "cohort_date").cast("bigint").alias("day_number")
    ).agg(F.count_distinct("admin_id"), F.count_distinct("organization_id"))


def _both(spark, orgs, events):
    got, plan = _with_conf(spark, SKEW_CONF, lambda: _run(retention(
        stg_organizations(orgs), stg_analytics_events(events))))
    want = sorted((tuple(r) for r in _with_conf(
        spark, SKEW_CONF, lambda: _retention_by_residual_join(orgs, events).collect())), key=repr)
    return got, want, plan


def _run(df):
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    return got, plan_text(df, "simple")


def test_retention_hot_admin_is_a_few_joined_rows(spark):
    """One admin creates a third of all organisations, all on one day."""
    orgs, events = skewed_raw(spark)
    orgs = orgs.withColumn("created_at", F.when(F.col("created_by") == "admin-hot", F.lit(
        "2026-01-03 08:00:00")).otherwise(F.col("created_at")))
    got, want, plan = _both(spark, orgs, events)
    assert got == want
    join_lines = [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert join_lines and all("period" in line for line in join_lines)
    # what the join meets: one row an (admin, day) and one mask an (admin, period)
    stg = stg_organizations(orgs)
    masks = activity_masks(stg_analytics_events(events), "admin_id", "event_date", 31)
    hot = masks.where("admin_id = 'admin-hot'")
    assert hot.count() <= 4
    assert stg.where("admin_id = 'admin-hot'").count() == 1000
    assert stg.where("admin_id = 'admin-hot'").select("created_date").distinct().count() == 1


def test_retention_counts_repeated_organisations_once(spark):
    """Organisation ids that repeat: for one admin, for several on one day, on several days; and rows
    without an admin, a creation day or an organisation id."""
    rows = [("o1", "2026-01-01", "a"), ("o1", "2026-01-01", "a"), ("o1", "2026-01-01", "b"),
            ("o1", "2026-01-01", "c"), ("o1", "2026-01-02", "a"), ("o2", "2026-01-01", "b"),
            ("o2", "2026-01-01", "idle"), ("o3", "2026-01-01", "idle"), ("o4", "bad", "a"),
            ("o4", None, "b"), ("o5", "2026-01-31", None), ("o6", "2025-12-31", "a"), ("o7", "1969-12-30", "old")]
    days = [("a", d) for d in ("2026-01-01", "2026-01-31", "2026-02-01", "2026-02-02")]
    days += [("b", "2026-01-01"), ("b", "2026-01-15"), ("c", "2026-01-15"), (None, "2026-01-01"),
             ("old", "1969-12-31"), ("old", "1970-01-05"), ("other", "2026-01-01")]
    orgs = normalize(spark.createDataFrame(rows, "id string, created_at string, created_by string"),
                     "organizations")
    events = normalize(spark.createDataFrame(
        [(str(i), d, "cta_clicked", a) for i, (a, d) in enumerate(days)],
        "id string, created_at string, event_name string, admin_id string"), "analytics_events")
    got, want, _ = _both(spark, orgs, events)
    assert got == want
    # an organisation id may be missing in an own staging frame: its admin counts, it doesn't
    stg = stg_organizations(orgs).withColumn("organization_id", F.when(
        F.col("organization_id") != "o2", F.col("organization_id")))
    out = {(str(r[0]), r[1]): tuple(r[2:]) for r in retention(stg, stg_analytics_events(events)).collect()}
    assert out[("2026-01-01", 0)] == (2, 1) and out[("2026-01-01", None)] == (1, 1)


def test_hot_login_bucket_is_combined_map_side(spark):
    _, events = skewed_raw(spark)
    anon = events.withColumn("admin_id", F.when(F.col("id").cast("int") % 3 == 0,
                                                F.lit(None)).otherwise(F.col("admin_id")))
    stg = stg_analytics_events(anon)
    usage = admin_usage(stg)
    plan = plan_text(usage)
    assert "partial_count" in plan and "partial_min" in plan
    total = usage.agg(F.sum("login_events")).first()[0]
    assert total == stg.where("event_name = 'admin_login_succeeded'").count()
    g = growth_daily(stg)
    assert g.agg(F.sum("events")).first()[0] == stg.count()


def test_hot_duplicate_id_is_combined_map_side(spark):
    from sparkmarts.operators.quality import duplicate_ids

    n = 30000
    players = normalize(spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("p-hot"))
        .otherwise(F.concat(F.lit("p-"), F.col("id").cast("string"))).alias("id")), "players")
    dup = duplicate_ids({"players": players})
    plan = plan_text(dup)
    assert "partial_count" in plan
    assert [tuple(r) for r in dup.collect()] == [("players", "p-hot", n // 3)]
