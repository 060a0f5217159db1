"""Staging: typed, cleaned views of the raw tables.

Each function is one projection plus a filter over its raw table, so it adds no shuffle and
Catalyst prunes the raw scan to the columns a downstream mart actually reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmarts.contracts import UNKNOWN_SOURCE
from sparkmarts.functions import blank_to, funnel_stage, parsed, to_day, to_text
from sparkmarts.functions.once import with_parsed


def stg_analytics_events(raw_events: DataFrame) -> DataFrame:
    """One row per event with a name and a parseable timestamp.

    Columns: id, event_at, event_date, event_name, source (``unknown`` when NULL or empty),
    admin_id, organization_id, club_id, league_id, entity_type, entity_id, path, properties,
    funnel_stage.
    """
    passthrough = ["admin_id", "organization_id", "club_id", "league_id", "entity_type",
                   "entity_id", "path", "properties"]
    named = raw_events.where(F.col("event_name").isNotNull())
    timed = with_parsed(named, "_event_at", "created_at", parsed(raw_events, "created_at", "timestamp"))
    event_at = F.col("_event_at")
    return timed.where(event_at.isNotNull()).select(
        to_text(F.col("id")).alias("id"),
        event_at.alias("event_at"),
        to_day(event_at).alias("event_date"),
        to_text(F.col("event_name")).alias("event_name"),
        blank_to(F.col("source"), UNKNOWN_SOURCE).alias("source"),
        *[to_text(F.col(c)).alias(c) for c in passthrough],
        funnel_stage(F.col("event_name")).alias("funnel_stage"),
    )


def stg_organizations(raw_organizations: DataFrame) -> DataFrame:
    """One row per organisation with an id; an unparseable creation time stays as NULL."""
    is_public = parsed(raw_organizations, "is_public", "boolean")
    # marts filter on the creation day, so the parse is emitted once (see with_parsed)
    dated = with_parsed(raw_organizations.where(F.col("id").isNotNull()), "_created_at", "created_at",
                             parsed(raw_organizations, "created_at", "timestamp"))
    created_at = F.col("_created_at")
    return dated.select(
        to_text(F.col("id")).alias("organization_id"),
        created_at.alias("created_at"),
        to_day(created_at).alias("created_date"),
        to_text(F.col("created_by")).alias("admin_id"),
        to_text(F.col("name")).alias("organization_name"),
        to_text(F.col("slug")).alias("organization_slug"),
        F.coalesce(is_public, F.lit(False)).alias("is_public"),
    )


def stg_matches(raw_matches: DataFrame) -> DataFrame:
    """One row per match with an id, all timestamps parsed defensively."""
    created_at = parsed(raw_matches, "created_at", "timestamp")
    return raw_matches.where(F.col("id").isNotNull()).select(
        to_text(F.col("id")).alias("match_id"),
        created_at.alias("created_at"),
        to_day(created_at).alias("created_date"),
        to_text(F.col("created_by")).alias("admin_id"),
        to_text(F.col("organization_id")).alias("organization_id"),
        to_text(F.col("status")).alias("status"),
        to_text(F.col("modality")).alias("modality"),
        parsed(raw_matches, "scheduled_at", "timestamp").alias("scheduled_at"),
        parsed(raw_matches, "finished_at", "timestamp").alias("finished_at"),
    )


def players_with_day(raw_players: DataFrame) -> DataFrame:
    """Players with an id, their organisation as text and their creation day (may be NULL)."""
    dated = with_parsed(raw_players.where(F.col("id").isNotNull()), "_created_at", "created_at",
                             parsed(raw_players, "created_at", "timestamp"))
    return dated.select(
        to_text(F.col("organization_id")).alias("organization_id"),
        to_day(F.col("_created_at")).alias("created_date"),
    )


def players_by_organization(raw_players: DataFrame) -> DataFrame:
    """Players with an id and their organisation as text (no date: nothing to parse)."""
    return raw_players.where(F.col("id").isNotNull()).select(
        to_text(F.col("organization_id")).alias("organization_id"))


__all__ = ["players_by_organization", "players_with_day", "stg_analytics_events", "stg_matches",
           "stg_organizations"]
