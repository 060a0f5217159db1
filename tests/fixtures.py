"""An own small data set: four groups, two of them founded by one admin on one day, and dirty rows
(times that can't be read, blank and missing values, a member without a group). The goldens follow
from the mart rules by hand."""

from __future__ import annotations

import json
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkmarts.contracts import SOURCE_TABLES
from sparkmarts.sources.normalize import normalize


def _text_schema(columns, overrides=None):
    overrides = overrides or {}
    return T.StructType([T.StructField(c, overrides.get(c, T.StringType()), True)
                         for c in columns])


EVENTS = [
    # id, created_at, event_name, source, admin_id, organization_id, league_id, entity_type, path
    ("v1", "2025-09-01 07:50:00", "cta_clicked", "ad_banner", None, None, None, "page", "/start"),
    ("v2", "2025-09-01 07:58:00", "cta_clicked", "ad_banner", None, None, None, "page", "/start"),
    ("v3", "2025-09-01T08:10:00+0200", "admin_register_succeeded", "", "a-ines", None, None, None, None),
    ("v4", "2025-09-01 08:16:00", "group_created", "server", "a-ines", "g-north", None, "group", None),
    ("v5", "2025-09-03 06:00:00", "admin_login_succeeded", "server", "a-ines", "g-north", None, None, None),
    ("v6", "2025-09-03 21:00:00", "admin_oauth_login_succeeded", "server", "a-ines", "g-lake", None,
     None, None),
    ("v7", "2025-09-05 18:00:00", "match_created", "app", "a-ines", "g-north", None, "match", None),
    ("v8", "2025-09-22 08:59:00", "admin_login_succeeded", "server", None, "g-hill", None, None, None),
    ("v9", "2025-09-22 09:10:00", "admin_login_succeeded", "server", "a-tomas", "g-hill", None, None, None),
    ("v10", "2025-10-01 00:00:00", "ranking_shared", "whatsapp", "a-ines", "g-lake", None, None, None),
    ("v11", "yesterday", "payment_created", "server", "a-tomas", None, None, None, None),
    ("v12", "2025-09-23 08:05:00", "payment_returned", "server", "a-tomas", None, "lg-7", "payment", None),
]
PLAYERS = [
    ("s1", "2025-09-02 10:00:00", "g-north"), ("s2", "2025-09-02 10:00:00", "g-north"),
    ("s3", "2025-09-02 23:59:59", "g-north"), ("s4", "2025-09-03 00:00:00", "g-north"),
    ("s5", "2025-09-02 11:00:00", "g-lake"), ("s6", "2025-09-02 12:00:00", "g-lake"),
    ("s7", "??", "g-lake"), ("s8", "2025-09-04 09:00:00", None),
]


def sample_rows() -> dict[str, tuple[T.StructType, list[tuple]]]:
    text, flag, whole, real = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
    return {
        "admins": (_text_schema(["id", "created_at", "display_name"]), [
            ("a-ines", "2025-09-01 08:00:00", "Ines"), ("a-tomas", "2025-09-19 17:30:00", "Tomas"),
            ("a-lea", None, "Lea")]),
        "organizations": (
            _text_schema(["id", "created_at", "created_by", "name", "slug", "is_public"],
                         {"is_public": flag}),
            [("g-north", "2025-09-01 08:15:00", "a-ines", "Northside", "north", True),
             ("g-lake", "2025-09-01 20:40:00", "a-ines", "Lakers United", "lake", None),
             ("g-hill", "2025-09-20 07:05:00", "a-tomas", "Hilltop", "hill", False),
             ("g-odd", "not a date", "a-lea", "Undated", None, True)]),
        "organization_admins": (
            _text_schema(["id", "created_at", "organization_id", "admin_id", "role"]),
            [("r1", "2025-09-01 08:15:00", "g-north", "a-ines", "owner")]),
        "players": (_text_schema(["id", "created_at", "organization_id", "active"], {"active": flag}),
                    [(*p, k % 2 == 0) for k, p in enumerate(PLAYERS)]),
        "matches": (
            _text_schema(["id", "created_at", "created_by", "organization_id", "status",
                          "modality", "scheduled_at", "finished_at"]),
            [("k1", "2025-09-05 18:00:00", "a-ines", "g-north", "finished", "5v5", None,
              "2025-09-06 20:30:00"),
             ("k2", "2025-09-05 18:30:00", "a-ines", "g-north", "played", "5v5", "soon", None),
             ("k3", "2025-09-22 09:00:00", "a-tomas", "g-hill", "scheduled", "11v11",
              "2025-10-04 15:00:00", None),
             ("k4", "2025-09-22 10:00:00", "a-tomas", "g-hill", "finished", "11v11", None,
              "2025-09-22 23:59:59")]),
        "clubs": (
            _text_schema(["id", "created_at", "created_by", "name", "slug", "status",
                          "is_public"], {"is_public": flag}),
            [("club-s", "2025-09-15 12:00:00", "a-lea", "Harbour", "harbour", "active", None)]),
        "club_matches": (
            _text_schema(["id", "created_at", "created_by", "club_id", "status", "played_at",
                          "field_cost_cents"], {"field_cost_cents": whole}),
            [("cm-4", "2025-09-28 12:00:00", "a-lea", "club-s", "played", None, 7500),
             ("cm-5", "2025-09-29 12:00:00", "a-lea", "club-s", "open", None, None)]),
        "club_match_payments": (
            _text_schema(["id", "created_at", "match_id", "expected_cents", "paid_cents",
                          "paid_at"], {"expected_cents": whole, "paid_cents": whole}),
            [("q1", "2025-10-02 10:00:00", "cm-4", 2500, 2500, "2025-10-02 10:00:01"),
             ("q2", "2025-10-02 10:00:00", "cm-4", 2500, 1, None),
             ("q3", "2025-10-02 10:00:00", "cm-5", 2500, None, None)]),
        "league_billing_payments": (
            _text_schema(["id", "created_at", "admin_id", "created_league_id", "amount",
                          "currency_id", "status", "purpose", "approved_at"], {"amount": real}),
            [("w1", "2025-09-23 08:00:00", "a-tomas", "lg-7", 7250.5, "USD", "approved", "", None),
             ("w2", "2025-09-23 09:00:00", "a-ines", "lg-7", 900.0, None, "pending", "season_fee",
              None)]),
        "tournament_billing_payments": (
            _text_schema(["id", "created_at", "admin_id", "created_tournament_id", "amount",
                          "currency_id", "status", "approved_at"], {"amount": text}),
            [("u1", "2025-09-30 12:00:00", "a-ines", "tr-3", "4100", "ARS", "rejected", None),
             ("u2", "31/31/2025", "a-ines", "tr-3", "50", "ARS", "approved", None)]),
        "analytics_events": (
            _text_schema(["id", "created_at", "event_name", "source", "admin_id", "organization_id",
                          "league_id", "entity_type", "path", "properties"]),
            [(*row, json.dumps({"row": k})) for k, row in enumerate(EVENTS)]),
    }


def sample_frames(spark: SparkSession, normalized: bool = True) -> dict[str, DataFrame]:
    out = {}
    for table, (schema, data) in sample_rows().items():
        df = spark.createDataFrame(data, schema)
        out[table] = normalize(df, table) if normalized else df
    return {t: out[t] for t in SOURCE_TABLES}


def _sep(day: int) -> date:
    return date(2025, 9, day)


def _at(day: int, hh: int, mm: int = 0) -> datetime:
    return datetime(2025, 9, day, hh, mm)


OCT_1, OCT_2 = date(2025, 10, 1), date(2025, 10, 2)
EXPECTED_TOTAL, PAID_TOTAL = 12325.5, 7275.51  # 7250.5 + 900 + 4100 + 3 x 25; 7250.5 + 25 + 0.01

GOLDEN = {
    "mart_growth_daily": [
        (_sep(1), "ad_banner", "acquisition", "cta_clicked", 2, 0, 0),
        (_sep(1), "unknown", "activation", "admin_register_succeeded", 1, 1, 0),
        (_sep(1), "server", "activation", "group_created", 1, 1, 1),
        (_sep(3), "server", "retention", "admin_login_succeeded", 1, 1, 1),
        (_sep(3), "server", "retention", "admin_oauth_login_succeeded", 1, 1, 1),
        (_sep(5), "app", "product", "match_created", 1, 1, 1),
        (_sep(22), "server", "retention", "admin_login_succeeded", 2, 1, 1),
        (_sep(23), "server", "revenue", "payment_returned", 1, 1, 0),
        (OCT_1, "whatsapp", "referral", "ranking_shared", 1, 1, 1),
    ],
    "mart_admin_usage": [
        (_sep(3), "a-ines", 2, _at(3, 6), _at(3, 21)),
        (_sep(22), "a-tomas", 1, _at(22, 9, 10), _at(22, 9, 10)),
        (_sep(22), "anonymous", 1, _at(22, 8, 59), _at(22, 8, 59)),
    ],
    "mart_product_activity": [
        (_sep(1), "g-lake", "groups_created", 1),
        (_sep(1), "g-north", "groups_created", 1),
        (_sep(2), "g-lake", "players_created", 2),
        (_sep(2), "g-north", "players_created", 3),
        (_sep(3), "g-north", "players_created", 1),
        (_sep(4), None, "players_created", 1),
        (_sep(5), "g-north", "matches_created", 2),
        (_sep(5), "g-north", "matches_finished", 1),
        (_sep(6), "g-north", "matches_finished", 1),
        (_sep(20), "g-hill", "groups_created", 1),
        (_sep(22), "g-hill", "matches_created", 2),
        (_sep(22), "g-hill", "matches_finished", 1),
    ],
    "mart_finance": [
        (_sep(23), "league", "league_payment", "lg-7", "approved", 7250.5, 7250.5, "USD"),
        (_sep(23), "league", "season_fee", "lg-7", "pending", 900.0, 0.0, "ARS"),
        (_sep(30), "tournament", "tournament_payment", "tr-3", "rejected", 4100.0, 0.0, "ARS"),
        (OCT_2, "club_match", "field_cost_collection", "cm-4", "paid", 25.0, 25.0, "ARS"),
        (OCT_2, "club_match", "field_cost_collection", "cm-4", "partial", 25.0, 0.01, "ARS"),
        (OCT_2, "club_match", "field_cost_collection", "cm-5", "pending", 25.0, 0.0, "ARS"),
    ],
    # a-ines acts on days 0, 2, 4 and 30 after founding two groups, a-tomas on days 2 and 3
    "mart_retention": [
        (_sep(1), 0, 1, 2), (_sep(1), 2, 1, 2), (_sep(1), 4, 1, 2), (_sep(1), 30, 1, 2),
        (_sep(20), 2, 1, 1), (_sep(20), 3, 1, 1),
        (None, None, 1, 1),
    ],
    "mart_entity_ranking": [
        ("g-north", "Northside", _sep(1), 4, 2, 2, 20),
        ("g-hill", "Hilltop", _sep(20), 0, 2, 1, 11),
        ("g-lake", "Lakers United", _sep(1), 3, 0, 0, 3),
        ("g-odd", "Undated", None, 0, 0, 0, 0),
    ],
}

MART_COLUMNS = {
    "mart_growth_daily": ["event_date", "source", "funnel_stage", "event_name", "events",
                          "admins", "organizations"],
    "mart_admin_usage": ["event_date", "admin_id", "login_events", "first_login_at",
                         "last_login_at"],
    "mart_product_activity": ["activity_date", "organization_id", "metric", "value"],
    "mart_finance": ["payment_date", "domain", "flow", "entity_id", "status", "expected_amount",
                     "paid_amount", "currency"],
    "mart_retention": ["cohort_date", "day_number", "active_admins", "active_organizations"],
    "mart_entity_ranking": ["organization_id", "organization_name", "created_date", "players",
                            "matches_created", "matches_finished", "health_score"],
}
