"""Map the generic test tables (TPC-H-like star schema plus an event log) to the product's raw
source tables, so that the marts can be checked and timed on data of any scale.

Every output row comes from one input row (narrow projections only, no shuffle), and every input
row is used: the mapping never samples or caps. Dirty values are planted on purpose by the row key
(unparseable timestamps, blank or missing sources, unknown event names, NULL foreign keys, foreign keys
without a row, e-mail addresses in properties, text in numeric columns) so that the defensive typing of
staging and the quality checks are exercised at every scale.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.contracts import SOURCE_TABLES
from sparkmarts.plans.lazy import LazyFrames
from sparkmarts.sources.normalize import empty_frame, normalize

DRIVER_TABLES = ("events", "customer", "part", "orders", "lineitem", "supplier")

# --- fixed values: event name planted for each (event_type, event_id mod k) ---
EVENT_NAME_BY_TYPE: dict[str, tuple[str | None, ...]] = {
    "click": ("cta_clicked", "group_shared", "match_shared", "ranking_shared"),
    "signup": ("signup_started", "admin_register_succeeded", "group_created"),
    "view": (
        "players_page_opened",
        "admin_login_succeeded",
        "admin_oauth_login_succeeded",
        "super_metrics_exported",
    ),
    "purchase": ("billing_started", "payment_created", "payment_returned", "payment_approved"),
    "error": ("match_created", "match_finished", None, "unlisted_event", "match_created"),
}
# --- fixed values: source planted by event_id mod 6 ---
EVENT_SOURCES: tuple[str | None, ...] = ("", None, "server", "whatsapp", "home_hero", "  ")
# --- fixed values: status codes of orders and line items ---
MATCH_STATUS = {"F": "finished", "P": "played", "O": "confirmed"}
LEAGUE_STATUS = {"F": "approved", "O": "pending"}
TOURNAMENT_STATUS = {"A": "approved", "N": "rejected", "R": "pending"}
# --- fixed values: base day of the synthetic organisation and player calendars ---
CALENDAR_START = "2024-01-01"


def _sql_literal(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _pick_sql(key: str, options: tuple[str | None, ...]) -> str:
    """SQL for ``options[key mod len(options)]`` (NULL for a negative key).

    A lookup in a constant array keeps the generated code small: long CASE chains, repeated in
    the pushed-down filter and the projection, can push a fused stage past the size the JVM
    compiles, and such a stage then runs several times slower."""
    values = ", ".join(_sql_literal(v) for v in options)
    n = len(options)
    return f"IF({key} >= 0, element_at(array({values}), CAST({key} % {n} AS INT) + 1), NULL)"


def _pick(key: str, options: tuple[str | None, ...]) -> Column:
    return F.expr(_pick_sql(key, options))


def _decode(code: str, mapping: Mapping[str, str]) -> Column:
    arms = " ".join(f"WHEN {_sql_literal(k)} THEN {_sql_literal(v)}" for k, v in mapping.items())
    return F.expr(f"CASE {code} {arms} END")


def _prefixed(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _unless(test: Column, value: Column) -> Column:
    return F.when(~test, value)


def raw_analytics_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    name = F.expr("CASE event_type " + " ".join(
        f"WHEN {_sql_literal(t)} THEN {_pick_sql('event_id', names)}"
        for t, names in EVENT_NAME_BY_TYPE.items()) + " END")
    df = events.select(
        eid.cast("string").alias("id"),
        F.when(eid % 97 == 0, F.lit("bad"))
        .otherwise(F.col("ts").cast("string"))
        .alias("created_at"),
        name.alias("event_name"),
        _pick("event_id", EVENT_SOURCES).alias("source"),
        _unless(eid % 7 == 0, _prefixed("admin-", F.col("user_id"))).alias("admin_id"),
        F.when(eid % 53 == 1, _prefixed("org-gone-", F.col("user_id") % 7))
        .when(eid % 5 != 0, _prefixed("org-", F.col("user_id") % 40)).alias("organization_id"),
        _unless(eid % 3 == 0, _prefixed("club-", F.col("user_id") % 30)).alias("club_id"),
        F.when(eid % 41 == 0, F.concat(F.lit('{"note": "write to user'), F.col("user_id").cast("string"),
                                       F.lit('@mail.example.com"}')))
        .otherwise(F.col("props")).alias("properties"),
    )
    return normalize(df, "analytics_events")


def raw_organizations(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    day = F.date_add(F.lit(CALENDAR_START).cast("date"), (key % 28).cast("int"))
    df = customer.select(
        _prefixed("org-", key).alias("id"),
        _unless(key % 13 == 0, F.concat(day.cast("string"), F.lit(" 10:00:00")))
        .alias("created_at"),
        _unless(key % 11 == 0, _prefixed("admin-", key % 200)).alias("created_by"),
        F.col("c_name").alias("name"),
        F.lower(F.col("c_name")).alias("slug"),
        _pick("c_custkey", ("true", "no", "bad", None)).alias("is_public"),
    )
    return normalize(df, "organizations")


def raw_clubs(supplier: DataFrame) -> DataFrame:
    """Clubs with even numbers, so that events of odd ones refer to none."""
    df = supplier.select(
        _prefixed("club-", F.col("s_suppkey") * 2).alias("id"),
        F.lit(CALENDAR_START).alias("created_at"),
        _prefixed("admin-", F.col("s_suppkey") % 200).alias("created_by"),
        F.col("s_name").alias("name"),
        F.lower(F.col("s_name")).alias("slug"),
    )
    return normalize(df, "clubs")


def raw_players(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    day = F.date_add(F.lit(CALENDAR_START).cast("date"), (key % 30).cast("int"))
    df = part.select(
        _prefixed("player-", key).alias("id"),
        F.concat(day.cast("string"), F.lit(" 12:00:00")).alias("created_at"),
        _unless(key % 29 == 0, _prefixed("org-", key % 100)).alias("organization_id"),
        (F.col("p_size") % 2 == 0).alias("active"),
    )
    return normalize(df, "players")


def raw_matches(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("string")
    finished_day = F.date_add(F.col("o_orderdate").cast("date"), (key % 3).cast("int"))
    df = orders.select(
        _prefixed("match-", key).alias("id"),
        created.alias("created_at"),
        _prefixed("admin-", F.col("o_custkey") % 200).alias("created_by"),
        _unless(key % 17 == 0, _prefixed("org-", F.col("o_custkey"))).alias("organization_id"),
        _decode("o_orderstatus", MATCH_STATUS).alias("status"),
        F.col("o_orderpriority").alias("modality"),
        created.alias("scheduled_at"),
        F.when(F.col("o_orderstatus") == "F", finished_day.cast("string")).alias("finished_at"),
    )
    return normalize(df, "matches")


def raw_league_billing_payments(orders: DataFrame) -> DataFrame:
    key = F.col("o_orderkey")
    priority = F.col("o_orderpriority")
    df = orders.select(
        key.cast("string").alias("id"),
        F.col("o_orderdate").cast("string").alias("created_at"),
        _prefixed("league-", F.col("o_custkey")).alias("created_league_id"),
        F.when(key % 19 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("amount"),
        F.when(key % 23 == 0, F.lit(None).cast("string"))
        .when(key % 2 == 0, F.lit("USD"))
        .otherwise(F.lit("ARS"))
        .alias("currency_id"),
        _decode("o_orderstatus", LEAGUE_STATUS).alias("status"),
        F.when(priority == "5-LOW", F.lit(""))
        .when(priority == "4-NOT SPECIFIED", F.lit(None).cast("string"))
        .otherwise(priority)
        .alias("purpose"),
    )
    return normalize(df, "league_billing_payments")


def raw_tournament_billing_payments(lineitem: DataFrame) -> DataFrame:
    df = lineitem.where(F.col("l_linenumber") == 1).select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("l_shipdate").cast("string").alias("created_at"),
        _prefixed("tournament-", F.col("l_suppkey")).alias("created_tournament_id"),
        F.col("l_extendedprice").alias("amount"),
        _decode("l_returnflag", TOURNAMENT_STATUS).alias("status"),
    )
    return normalize(df, "tournament_billing_payments")


def raw_club_match_payments(lineitem: DataFrame) -> DataFrame:
    price_cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    flag = F.col("l_returnflag")
    df = lineitem.where(F.col("l_linenumber") != 1).select(
        F.col("l_orderkey").cast("string").alias("id"),
        F.col("l_shipdate").cast("string").alias("created_at"),
        _prefixed("club-match-", F.col("l_orderkey")).alias("match_id"),
        _unless(F.col("l_partkey") % 31 == 0, price_cents).alias("expected_cents"),
        F.when(flag == "A", price_cents)
        .when(flag == "N", (F.col("l_quantity") * 100).cast("bigint"))
        .when(flag == "R", F.lit(0).cast("bigint"))
        .alias("paid_cents"),
    )
    return normalize(df, "club_match_payments")


def read_driver_tables(spark: SparkSession, sf_dir: str) -> LazyFrames:
    """Parquet scans of the driver tables the mapping needs (defined on first use)."""
    root = sf_dir.rstrip("/")
    return LazyFrames({t: partial(spark.read.parquet, f"{root}/{t}.parquet") for t in DRIVER_TABLES})


_MAPPING = {
    "analytics_events": ("events", raw_analytics_events),
    "organizations": ("customer", raw_organizations),
    "clubs": ("supplier", raw_clubs),
    "players": ("part", raw_players),
    "matches": ("orders", raw_matches),
    "league_billing_payments": ("orders", raw_league_billing_payments),
    "tournament_billing_payments": ("lineitem", raw_tournament_billing_payments),
    "club_match_payments": ("lineitem", raw_club_match_payments),
}


def raw_tables(spark: SparkSession, sf_dir: str) -> LazyFrames:
    """All eleven raw source tables derived from the driver tables in ``sf_dir``.

    Tables without a driver counterpart (admins, organization_admins, club_matches) are empty
    frames of their contract. Each table is defined on first access.
    """
    d = read_driver_tables(spark, sf_dir)

    def factory(table: str):
        if table in _MAPPING:
            source, mapper = _MAPPING[table]
            return lambda: mapper(d[source])
        return lambda: empty_frame(spark, table)

    return LazyFrames({t: factory(t) for t in SOURCE_TABLES})
