"""Canonical row orders of the marts and reports.

A stored table has no order for its readers, so order is applied when reading (``orderBy``) and
written files are only sorted within partitions. NULLs go last in both directions, as in the SQL
engine the marts are specified against.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: sort keys of each mart, ("-" prefix = descending) ---
MART_ORDER: dict[str, tuple[str, ...]] = {
    "mart_growth_daily": ("event_date", "funnel_stage", "event_name"),
    "mart_admin_usage": ("event_date", "admin_id"),
    "mart_product_activity": ("activity_date", "metric"),
    "mart_finance": ("payment_date", "domain", "flow"),
    "mart_retention": ("cohort_date", "day_number"),
    "mart_entity_ranking": ("-health_score", "-created_date"),
}


def sort_keys(keys: tuple[str, ...] | list[str]) -> list[Column]:
    """Sort expressions for ``keys``; a leading ``-`` sorts descending. NULLs last."""
    out = []
    for key in keys:
        if key.startswith("-"):
            out.append(F.col(key[1:]).desc_nulls_last())
        else:
            out.append(F.col(key).asc_nulls_last())
    return out


def ordered(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """``df`` globally sorted by ``keys`` (a range shuffle; use at read time)."""
    return df.orderBy(*sort_keys(keys))


def ordered_spread(df: DataFrame, keys: tuple[str, ...] | list[str]) -> DataFrame:
    """``ordered``, with rows of equal keys divisible between tasks.

    The range partitioner can't cut between rows that compare equal, so a day with a third of all
    rows would be one task's. Row numbers end the sort key and are dropped again.
    """
    numbered = df.withColumn("_spread", F.monotonically_increasing_id())
    return numbered.orderBy(*sort_keys(keys), "_spread").drop("_spread")


def ordered_mart(df: DataFrame, mart_name: str) -> DataFrame:
    """A mart in its canonical order."""
    return ordered_spread(df, MART_ORDER[mart_name])
