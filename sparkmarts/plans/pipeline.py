"""Wire raw tables to staging views and marts.

``stage`` and ``marts`` are lazy: they return DataFrames whose plans Catalyst optimises end to end
(each mart prunes the raw scans to the columns it needs and pushes its filters into them).
``build_marts`` is the batch job: it lands staging as tables, reads them back to cut lineage, and
writes the six marts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from sparkmarts.contracts import SOURCE_TABLES
from sparkmarts.operators import marts as M
from sparkmarts.operators import staging as S
from sparkmarts.plans.lazy import LazyFrames

STAGING_NAMES = ("stg_analytics_events", "stg_organizations", "stg_matches")
MART_NAMES = M.MART_NAMES


def stage(raw: Mapping[str, DataFrame]) -> LazyFrames:
    """The three staging views of the raw tables (each defined on first access)."""
    return LazyFrames({
        "stg_analytics_events": lambda: S.stg_analytics_events(raw["analytics_events"]),
        "stg_organizations": lambda: S.stg_organizations(raw["organizations"]),
        "stg_matches": lambda: S.stg_matches(raw["matches"]),
    })


def marts(
    raw: Mapping[str, DataFrame], staged: Mapping[str, DataFrame] | None = None
) -> LazyFrames:
    """The six marts, in build order, from raw tables (and staging, if already landed).

    Each mart is defined on first access, so asking for one mart only touches its inputs.
    """
    st = staged if staged is not None else stage(raw)
    return LazyFrames({
        "mart_growth_daily": lambda: M.growth_daily(st["stg_analytics_events"]),
        "mart_admin_usage": lambda: M.admin_usage(st["stg_analytics_events"]),
        "mart_product_activity": lambda: M.product_activity(
            st["stg_organizations"], raw["players"], st["stg_matches"]),
        "mart_finance": lambda: M.finance(
            raw["league_billing_payments"],
            raw["tournament_billing_payments"],
            raw["club_match_payments"],
        ),
        "mart_retention": lambda: M.retention(st["stg_organizations"],
                                              st["stg_analytics_events"]),
        "mart_entity_ranking": lambda: M.entity_ranking(
            st["stg_organizations"], raw["players"], st["stg_matches"]),
    })


def mart(raw: Mapping[str, DataFrame], name: str) -> DataFrame:
    """One mart by name."""
    return marts(raw)[name]


def build_marts(warehouse, write_staging: bool = True) -> list[str]:
    """Batch build: raw tables in ``warehouse`` -> staging -> the six marts, all written back.

    Missing raw tables are first created empty. With ``write_staging`` the three staging
    tables are landed and read back, so each is computed once and every mart starts from a
    durable table (lineage cut at shared storage, not in executor memory); without it each
    mart plans straight from the raw scans. Readers see all new tables at the end, or, if the
    build fails, the old ones. The figures observed on the way are logged as a table. Returns the
    mart names in build order.
    """
    warehouse.ensure_raw()
    with warehouse.switch_at_end():
        raw = warehouse.read_raw()
        staged = stage(raw)
        if write_staging:
            for name, df in staged.items():
                warehouse.write_table(name, df)
            staged = {name: warehouse.read(name) for name in STAGING_NAMES}
        for name, df in marts(raw, staged).items():
            warehouse.write_table(name, df)
        logged = [spec.raw_name for spec in SOURCE_TABLES.values()] + list(MART_NAMES)
        warehouse.log_stats([*logged, *(STAGING_NAMES if write_staging else ())])
    return list(MART_NAMES)
