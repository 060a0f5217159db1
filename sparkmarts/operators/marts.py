"""The six marts, as lazy DataFrames over the staging views.

Plans are built for volume: every aggregate is a hash aggregate with a map-side partial step, so a
hot key (one organisation or one anonymous login bucket holding a third of the rows) is combined
on the map side before it is shuffled; distinct counts are exact (``count_distinct``), never
approximate. Nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmarts.contracts import (
    ANONYMOUS_ADMIN,
    APPROVED_STATUS,
    CLUB_MATCH_FLOW,
    DEFAULT_CURRENCY,
    FINISHED_STATUSES,
    HEALTH_WEIGHTS,
    LEAGUE_DEFAULT_FLOW,
    LOGIN_EVENTS,
    RETENTION_DAYS,
    TOURNAMENT_FLOW,
)
from sparkmarts.functions import blank_to, parsed, to_day, to_text
from sparkmarts.functions.once import with_parsed
from sparkmarts.operators.day_masks import activity_masks, period_of, place_of, set_bits, window_mask
from sparkmarts.operators.staging import players_by_organization, players_with_day

MART_NAMES = (
    "mart_growth_daily",
    "mart_admin_usage",
    "mart_product_activity",
    "mart_finance",
    "mart_retention",
    "mart_entity_ranking",
)


def growth_daily(stg_events: DataFrame) -> DataFrame:
    """Daily events by source, funnel stage and event name, with distinct admins and
    organisations (NULL ids are not counted)."""
    return stg_events.groupBy("event_date", "source", "funnel_stage", "event_name").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("admin_id").alias("admins"),
        F.count_distinct("organization_id").alias("organizations"),
    )


def admin_usage(stg_events: DataFrame) -> DataFrame:
    """Logins per day and admin (``anonymous`` when the admin is unknown), with the first and
    last login time of the day."""
    logins = stg_events.where(F.col("event_name").isin(list(LOGIN_EVENTS))).select(
        "event_date",
        F.coalesce(F.col("admin_id"), F.lit(ANONYMOUS_ADMIN)).alias("admin_id"),
        "event_at",
    )
    return logins.groupBy("event_date", "admin_id").agg(
        F.count(F.lit(1)).alias("login_events"),
        F.min("event_at").alias("first_login_at"),
        F.max("event_at").alias("last_login_at"),
    )


def product_activity(
    stg_organizations: DataFrame, raw_players: DataFrame, stg_matches: DataFrame
) -> DataFrame:
    """Long table (activity_date, organization_id, metric, value) of groups, players and
    matches created and matches finished per day and organisation.

    All four metrics are tagged rows of one union followed by a single aggregate, so the whole
    mart costs one shuffle; matches are read once and emit up to two tagged rows each. Rows with
    no date are dropped; a NULL organisation is a group of its own.
    """
    groups = stg_organizations.select(
        F.col("created_date").alias("activity_date"),
        "organization_id",
        F.lit("groups_created").alias("metric"),
    )
    players = players_with_day(raw_players).select(
        F.col("created_date").alias("activity_date"),
        "organization_id",
        F.lit("players_created").alias("metric"),
    )
    finished_day = to_day(F.coalesce(F.col("finished_at"), F.col("created_at")))
    tagged = F.array(
        F.struct(F.col("created_date").alias("activity_date"),
                 F.lit("matches_created").alias("metric")),
        F.when(
            F.col("status").isin(list(FINISHED_STATUSES)),
            F.struct(finished_day.alias("activity_date"),
                     F.lit("matches_finished").alias("metric")),
        ),
    )
    # A match that is not finished contributes a NULL element, which inlines to an all-NULL row;
    # the date filter below drops it. (No lambda filter here: higher-order functions are not
    # code-generated and would split the whole-stage codegen span.)
    matches = stg_matches.select("organization_id", F.inline(tagged)).select(
        "activity_date", "organization_id", "metric")
    rows = groups.unionByName(players).unionByName(matches)
    return (
        rows.where(F.col("activity_date").isNotNull())
        .groupBy("activity_date", "organization_id", "metric")
        .agg(F.count(F.lit(1)).alias("value"))
    )


def _payment_day(raw: DataFrame) -> DataFrame:
    """``raw`` with its payment day; text is parsed once although the mart filters on it, typed times
    stay a plain projection, so that a report's date range reaches the scan."""
    timed = with_parsed(raw, "_created_at", "created_at", parsed(raw, "created_at", "timestamp"))
    return timed.withColumn("_payment_date", to_day(F.col("_created_at")))


def _billing_branch(raw: DataFrame, domain: str, flow, entity_column: str) -> DataFrame:
    amount = F.coalesce(parsed(raw, "amount", "double"), F.lit(0.0))
    status = to_text(F.col("status"))
    return _payment_day(raw).select(
        F.col("_payment_date").alias("payment_date"),
        F.lit(domain).alias("domain"),
        flow.alias("flow"),
        to_text(F.col(entity_column)).alias("entity_id"),
        status.alias("status"),
        amount.alias("expected_amount"),
        F.when(status == APPROVED_STATUS, amount).otherwise(F.lit(0.0)).alias("paid_amount"),
        F.coalesce(to_text(F.col("currency_id")), F.lit(DEFAULT_CURRENCY)).alias("currency"),
    )


def finance(
    raw_league_payments: DataFrame,
    raw_tournament_payments: DataFrame,
    raw_club_match_payments: DataFrame,
) -> DataFrame:
    """One row per payment of the three payment domains (no aggregation, no shuffle).

    League and tournament: the amount is expected, and paid only when approved. Club match:
    cents become units; status is paid when paid >= expected (NULL counts as 0), partial when
    something was paid, else pending. Rows without a parseable date are dropped.
    """
    league = _billing_branch(
        raw_league_payments, "league",
        blank_to(F.col("purpose"), LEAGUE_DEFAULT_FLOW), "created_league_id",
    )
    tournament = _billing_branch(
        raw_tournament_payments, "tournament", F.lit(TOURNAMENT_FLOW), "created_tournament_id",
    )
    club = raw_club_match_payments
    expected = F.coalesce(parsed(club, "expected_cents", "double"), F.lit(0.0))
    paid = F.coalesce(parsed(club, "paid_cents", "double"), F.lit(0.0))
    club_rows = _payment_day(club).select(
        F.col("_payment_date").alias("payment_date"),
        F.lit("club_match").alias("domain"),
        F.lit(CLUB_MATCH_FLOW).alias("flow"),
        to_text(F.col("match_id")).alias("entity_id"),
        F.when(paid >= expected, F.lit("paid"))
        .when(paid > 0, F.lit("partial"))
        .otherwise(F.lit("pending"))
        .alias("status"),
        (expected / 100).alias("expected_amount"),
        (paid / 100).alias("paid_amount"),
        F.lit(DEFAULT_CURRENCY).alias("currency"),
    )
    return (
        league.unionByName(tournament)
        .unionByName(club_rows)
        .where(F.col("payment_date").isNotNull())
    )


def retention(stg_organizations: DataFrame, stg_events: DataFrame) -> DataFrame:
    """Cohort retention over days 0..30 after an organisation's creation.

    A cohort row is (creating admin, organisation, creation day). It is active on day ``d`` when
    its admin has any event on creation day + ``d``. Per (cohort_date, day_number) the mart
    counts distinct cohort admins and cohort organisations; a cohort row with no activity in
    the window (or without a creation day) yields ``day_number = NULL``.

    Plan, built for hot admins (one admin may own a third of all organisations, created on one day):

    * activity is one bit mask per (admin, 31-day period), folded on the map side, so neither events
      nor single days reach the join;
    * cohorts are reduced to (admin, day) with a count of organisations before the join. Each meets
      at most one mask, that of its day's period with the next one; the window is a shift and an
      "and", one more bit stands for no activity;
    * set bits become days after the join: at most 31 rows per (admin, day), summed on the map side.

    An organisation id that several admins own on one day must count once per day number. Such ids
    (rare) are told apart by the least and greatest admin of (day, organisation), keep a row per admin,
    and their admins' windows are joined bit by bit before they are counted. Rows without an
    organisation id go the same way and count for their admin only.
    """
    days, idle = RETENTION_DAYS, RETENTION_DAYS  # the bit after the window: no activity
    masks = activity_masks(stg_events, "admin_id", "event_date", days)
    own_rows = stg_organizations.where(F.col("admin_id").isNotNull()).select(
        "admin_id", "organization_id", F.col("created_date").alias("cohort_date"))
    owners = own_rows.groupBy("cohort_date", "organization_id").agg(
        F.min("admin_id").alias("admin_id"), F.max("admin_id").alias("_last"))
    has_id = F.col("organization_id").isNotNull()
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    single = owners.where(has_id & (F.col("admin_id") == F.col("_last"))).select(
        "admin_id", "cohort_date", one.alias("organizations"))
    keys = owners.where(~has_id | (F.col("admin_id") != F.col("_last"))).select(
        F.col("cohort_date").alias("_day"), F.col("organization_id").alias("_organization"))
    shared = own_rows.join(keys, F.col("organization_id").eqNullSafe(F.col("_organization"))
                           & F.col("cohort_date").eqNullSafe(F.col("_day")), "left_semi")
    cohorts = single.unionByName(
        shared.select("admin_id", "cohort_date", none.alias("organizations"))
    ).groupBy("admin_id", "cohort_date").agg(F.sum("organizations").alias("organizations"))

    def windows(rows: DataFrame) -> DataFrame:
        keyed = rows.withColumn("period", period_of("cohort_date", days))
        window = window_mask(F.col("mask"), place_of("cohort_date", days), days)
        active = F.when(window == 0, F.lit(1 << idle).cast("bigint")).otherwise(window)
        return keyed.join(masks, ["admin_id", "period"], "left").withColumn("active", active)

    def by_day(rows: DataFrame, admins: Column, organizations: Column) -> DataFrame:
        return rows.select("cohort_date", F.explode(set_bits(F.col("active"), days + 1)).alias("bit"),
                           admins.alias("admins"), organizations.alias("organizations"))

    shared_days = windows(shared.where(has_id)).groupBy("cohort_date", "organization_id").agg(
        F.bit_or("active").alias("active"))
    counted = by_day(windows(cohorts), one, F.col("organizations")).unionByName(
        by_day(shared_days, none, one))
    return counted.groupBy("cohort_date", "bit").agg(
        F.sum("admins").alias("active_admins"), F.sum("organizations").alias("active_organizations"),
    ).select(
        "cohort_date", F.when(F.col("bit") != idle, F.col("bit").cast("bigint")).alias("day_number"),
        "active_admins", "active_organizations")


def entity_ranking(
    stg_organizations: DataFrame, raw_players: DataFrame, stg_matches: DataFrame
) -> DataFrame:
    """One row per organisation with players, matches created and finished (0 when none) and
    health_score = players + 3 * created + 5 * finished.

    Players and matches are aggregated per organisation first (map-side partial aggregation),
    so each join sees at most one row per organisation on the right. Both aggregates come out
    hash-partitioned on organization_id, which the sort-merge joins reuse; AQE turns them into
    broadcast joins at run time only when the measured side is small. Players and matches with
    a NULL organisation form a group that matches nothing.
    """
    players = players_by_organization(raw_players).groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("players")
    )
    matches = stg_matches.groupBy("organization_id").agg(
        F.count(F.lit(1)).alias("matches_created"),
        F.count_if(F.col("status").isin(list(FINISHED_STATUSES))).alias("matches_finished"),
    )
    orgs = stg_organizations.select("organization_id", "organization_name", "created_date")
    joined = orgs.join(players, "organization_id", "left").join(matches, "organization_id", "left")
    counts = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in HEALTH_WEIGHTS}
    score = None
    for c, weight in HEALTH_WEIGHTS.items():
        term = counts[c] * weight
        score = term if score is None else score + term
    return joined.select(
        "organization_id",
        "organization_name",
        "created_date",
        *[counts[c].alias(c) for c in HEALTH_WEIGHTS],
        score.cast("bigint").alias("health_score"),
    )
