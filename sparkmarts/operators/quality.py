"""Data-quality checks, as DataFrames of findings.

The checks restate the source database's constraints (allowed event names, NOT NULL columns,
primary key, foreign keys) and the product's contract rules (no e-mail addresses in event
properties, the three payment domains, the finance totals, non-empty marts, forbidden tables
and columns). Each check is one scan with an aggregate; referential checks aggregate the
referencing side per key before the anti join, so their shuffle is bounded by distinct keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmarts.contracts import EVENT_ALLOWLIST, FINANCE_DOMAINS, FORBIDDEN_TABLES
from sparkmarts.functions import email_like, to_text

# --- fixed values: NOT NULL columns of the event table ---
EVENT_NOT_NULL = ("id", "created_at", "event_name", "source", "properties")
# --- fixed values: foreign keys of the event table to extracted tables (column -> table) ---
EVENT_FOREIGN_KEYS = {"organization_id": "organizations", "club_id": "clubs"}
# --- fixed values: marts that must have rows, and money columns the ranking must not carry ---
NON_EMPTY_MARTS = ("mart_growth_daily", "mart_admin_usage", "mart_entity_ranking")
RANKING_FORBIDDEN_COLUMNS = ("expected_amount", "paid_amount")


def event_allowlist_violations(raw_events: DataFrame,
                               allowlist: Sequence[str] = EVENT_ALLOWLIST) -> DataFrame:
    """Events whose name is set but not allowed: (id, created_at, event_name), to quarantine."""
    return raw_events.where(
        F.col("event_name").isNotNull() & ~F.col("event_name").isin(list(allowlist))
    ).select(
        to_text(F.col("id")).alias("id"),
        to_text(F.col("created_at")).alias("created_at"),
        to_text(F.col("event_name")).alias("event_name"),
    )


def null_counts(df: DataFrame, columns: Sequence[str] = EVENT_NOT_NULL) -> DataFrame:
    """One row: total_rows and, per column, the number of NULLs (``<column>_nulls``)."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns],
    )


def duplicate_keys(df: DataFrame, key: str = "id", table: str | None = None) -> DataFrame:
    """Key values that occur more than once: ([table,] key, occurrences).

    A hot key is combined on the map side, so it costs one row per map task in the shuffle.
    """
    counted = (
        df.select(to_text(F.col(key)).alias(key))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )
    if table is not None:
        counted = counted.select(F.lit(table).alias("table_name"), key, "occurrences")
    return counted


def duplicate_ids(raw: Mapping[str, DataFrame], tables: Iterable[str] | None = None) -> DataFrame:
    """Repeated ``id`` values across raw tables: (table_name, id, occurrences).

    The ids of all tables are one union of tagged rows and one aggregate, so the check costs a
    single shuffle however many tables it covers.
    """
    names = list(tables) if tables is not None else list(raw)
    ids = None
    for t in names:
        part = raw[t].select(F.lit(t).alias("table_name"), to_text(F.col("id")).alias("id"))
        ids = part if ids is None else ids.unionByName(part)
    return (
        ids.groupBy("table_name", "id")
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def orphan_references(raw_events: DataFrame, targets: Mapping[str, DataFrame],
                      foreign_keys: Mapping[str, str] = EVENT_FOREIGN_KEYS) -> DataFrame:
    """Foreign-key values of events with no row in the referenced table.

    Returns (fk_column, fk_value, events). Events are read once: each row emits one tagged row
    per non-NULL foreign key, and these are reduced to one row per (column, value) with its
    event count before they meet the referenced ids in a left anti join.
    """
    tagged = F.array(*[
        F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("fk_column"),
                                              to_text(F.col(c)).alias("fk_value")))
        for c in foreign_keys
    ])
    # A NULL key gives a NULL element, which inlines to an all-NULL row: drop it (a plain
    # inline stays inside whole-stage code generation, a lambda filter would not).
    refs = raw_events.select(F.inline(tagged)).where(F.col("fk_value").isNotNull())
    ids = None
    for column, table in foreign_keys.items():
        known = targets[table].where(F.col("id").isNotNull()).select(
            F.lit(column).alias("fk_column"), to_text(F.col("id")).alias("fk_value")
        )
        ids = known if ids is None else ids.unionByName(known)
    per_value = refs.groupBy("fk_column", "fk_value").agg(F.count(F.lit(1)).alias("events"))
    return per_value.join(ids, ["fk_column", "fk_value"], "left_anti")


def pii_rows(df: DataFrame, columns: Sequence[str] = ("properties",)) -> DataFrame:
    """Rows with e-mail-shaped text: (id, column) per hit."""
    hits = None
    for c in columns:
        part = df.where(email_like(F.col(c))).select(
            to_text(F.col("id")).alias("id"), F.lit(c).alias("column_name")
        )
        hits = part if hits is None else hits.unionByName(part)
    return hits


def pii_hits(df: DataFrame, column: str = "properties") -> DataFrame:
    """One row: number of rows whose ``column`` contains an e-mail-shaped value."""
    return df.agg(F.count_if(F.coalesce(email_like(F.col(column)), F.lit(False)))
                  .alias("pii_hits"))


def finance_domains(finance: DataFrame,
                    expected: Sequence[str] = FINANCE_DOMAINS) -> DataFrame:
    """Domains found in the finance mart against the contract: (domain, in_data, in_contract).

    A healthy mart has every row with both flags true.
    """
    spark = finance.sparkSession
    contract = spark.range(1).select(
        F.explode(F.array(*[F.lit(d) for d in expected])).alias("domain"),
        F.lit(True).alias("in_contract"),
    )
    found = finance.select("domain").distinct().withColumn("in_data", F.lit(True))
    return found.join(contract, "domain", "full").select(
        "domain",
        F.coalesce(F.col("in_data"), F.lit(False)).alias("in_data"),
        F.coalesce(F.col("in_contract"), F.lit(False)).alias("in_contract"),
    )


def finance_totals(finance: DataFrame, money_digits: int | None = 2) -> DataFrame:
    """One row: payments, total expected and total paid amount."""
    def money(c):
        total = F.coalesce(F.sum(c), F.lit(0.0))
        return total if money_digits is None else F.round(total, money_digits)

    return finance.agg(
        F.count(F.lit(1)).alias("payments"),
        money("expected_amount").alias("expected_amount"),
        money("paid_amount").alias("paid_amount"),
    )


def reconcile_totals(finance: DataFrame, expected_amount: float, paid_amount: float,
                     tolerance: float = 0.005) -> DataFrame:
    """One row comparing the finance mart's totals with known control totals.

    Columns: expected_amount, paid_amount (the mart's totals), expected_target, paid_target and
    ``reconciled`` (both totals within ``tolerance``).
    """
    totals = finance_totals(finance, money_digits=None)
    return totals.select(
        "expected_amount",
        "paid_amount",
        F.lit(float(expected_amount)).alias("expected_target"),
        F.lit(float(paid_amount)).alias("paid_target"),
        ((F.abs(F.col("expected_amount") - F.lit(float(expected_amount))) <= tolerance)
         & (F.abs(F.col("paid_amount") - F.lit(float(paid_amount))) <= tolerance))
        .alias("reconciled"),
    )


def non_empty(marts: Mapping[str, DataFrame],
              names: Sequence[str] = NON_EMPTY_MARTS) -> DataFrame:
    """(mart, has_rows) for each mart in ``names``; each mart is probed with ``limit(1)``."""
    out = None
    for name in names:
        probe = marts[name].limit(1).agg(
            F.lit(name).alias("mart"), (F.count(F.lit(1)) > 0).alias("has_rows")
        )
        out = probe if out is None else out.unionByName(probe)
    return out


def forbidden_findings(table_names: Iterable[str], ranking_columns: Iterable[str]) -> list[str]:
    """Contract breaches in metadata: forbidden raw tables present, money columns in ranking."""
    found = []
    names = set(table_names)
    for t in FORBIDDEN_TABLES:
        for candidate in (t, f"raw_{t}"):
            if candidate in names:
                found.append(f"forbidden table {candidate}")
    for c in RANKING_FORBIDDEN_COLUMNS:
        if c in set(ranking_columns):
            found.append(f"mart_entity_ranking carries {c}")
    return found


# -- figures observed while tables are written -------------------------------------------------


def _event_figures() -> list[Column]:
    allowed = F.col("event_name").isin(list(EVENT_ALLOWLIST))
    return [
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in EVENT_NOT_NULL],
        F.count_if(F.col("event_name").isNotNull() & ~allowed).alias("event_name_not_allowed"),
    ]


def _staged_event_figures() -> list[Column]:
    return [F.count_if(F.coalesce(email_like(F.col("properties")), F.lit(False))).alias("pii_hits")]


def _finance_figures() -> list[Column]:
    known = F.col("domain").isin(list(FINANCE_DOMAINS))
    return [
        F.sum("expected_amount").alias("expected_amount"),
        F.sum("paid_amount").alias("paid_amount"),
        *[F.count_if(F.col("domain") == d).alias(f"domain:{d}") for d in FINANCE_DOMAINS],
        F.count_if(F.coalesce(~known, F.lit(True))).alias("domain_not_in_contract"),
    ]


#: Figures of each table beside its row count, as aggregates over its columns.
OBSERVED: dict[str, Callable[[], list[Column]]] = {
    "raw_analytics_events": _event_figures,
    "stg_analytics_events": _staged_event_figures,
    "mart_finance": _finance_figures,
}


def log_rows(spark: SparkSession, stats: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(table_name, metric, value) rows of observed figures (a few per table)."""
    rows = [(table, metric, float(value)) for table, figures in stats.items()
            for metric, value in figures.items()]
    return spark.createDataFrame(rows, "table_name string, metric string, value double")


def observed_findings(stats: Mapping[str, Mapping[str, float]],
                      names: Sequence[str] = NON_EMPTY_MARTS) -> list[str]:
    """Breaches that observed figures show, without a scan: the checks on nulls, allowed events, addresses,
    payment domains and empty marts. An empty list is a healthy build."""
    found = []
    events = stats.get("raw_analytics_events", {})
    for figure in (*[f"{c}_nulls" for c in EVENT_NOT_NULL], "event_name_not_allowed"):
        if events.get(figure):
            found.append(f"raw_analytics_events: {figure} = {events[figure]:.0f}")
    if stats.get("stg_analytics_events", {}).get("pii_hits"):
        found.append(f"stg_analytics_events: pii_hits = {stats['stg_analytics_events']['pii_hits']:.0f}")
    finance = stats.get("mart_finance")
    if finance is not None:
        found += [f"mart_finance: no rows of domain {d}" for d in FINANCE_DOMAINS
                  if not finance.get(f"domain:{d}")]
        if finance.get("domain_not_in_contract"):
            found.append(f"mart_finance: domain_not_in_contract = {finance['domain_not_in_contract']:.0f}")
    found += [f"{name}: no rows" for name in names if name in stats and not stats[name].get("rows")]
    return found
