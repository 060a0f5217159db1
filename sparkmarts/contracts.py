"""Source table contracts and the fixed vocabularies of the product.

Everything in the "fixed values" blocks must equal the product's own definitions: table and
column names, column types, the event allowlist and the funnel classification. They are data,
not logic, and are listed in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Column contract of one operational table.

    ``schema`` gives the contract column order and the declared types; ``json_columns`` are
    carried as JSON text.
    """

    name: str
    schema: T.StructType
    json_columns: tuple[str, ...] = field(default=())

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.schema.fieldNames())

    def type_of(self, column: str) -> T.DataType:
        return self.schema[column].dataType

    @property
    def raw_name(self) -> str:
        return f"raw_{self.name}"


TEXT, TIME, FLAG = T.StringType(), T.TimestampNTZType(), T.BooleanType()
WHOLE, REAL = T.LongType(), T.DoubleType()


def _columns(**types: T.DataType) -> T.StructType:
    """Nullable columns in the order given."""
    return T.StructType([T.StructField(name, kind, True) for name, kind in types.items()])


# --- fixed values: the eleven source table contracts (name, columns in order, types) ---
SOURCE_TABLES: dict[str, TableSpec] = {
    "analytics_events": TableSpec("analytics_events", _columns(
        id=TEXT,
        created_at=TIME,
        event_name=TEXT,
        source=TEXT,
        admin_id=TEXT,
        organization_id=TEXT,
        club_id=TEXT,
        league_id=TEXT,
        entity_type=TEXT,
        entity_id=TEXT,
        path=TEXT,
        properties=TEXT,
    ), json_columns=("properties",)),
    "admins": TableSpec("admins", _columns(
        id=TEXT,
        created_at=TIME,
        display_name=TEXT,
    )),
    "organizations": TableSpec("organizations", _columns(
        id=TEXT,
        created_at=TIME,
        created_by=TEXT,
        name=TEXT,
        slug=TEXT,
        is_public=FLAG,
    )),
    "organization_admins": TableSpec("organization_admins", _columns(
        id=TEXT,
        created_at=TIME,
        organization_id=TEXT,
        admin_id=TEXT,
        role=TEXT,
    )),
    "players": TableSpec("players", _columns(
        id=TEXT,
        created_at=TIME,
        organization_id=TEXT,
        active=FLAG,
    )),
    "matches": TableSpec("matches", _columns(
        id=TEXT,
        created_at=TIME,
        created_by=TEXT,
        organization_id=TEXT,
        status=TEXT,
        modality=TEXT,
        scheduled_at=TIME,
        finished_at=TIME,
    )),
    "clubs": TableSpec("clubs", _columns(
        id=TEXT,
        created_at=TIME,
        created_by=TEXT,
        name=TEXT,
        slug=TEXT,
        status=TEXT,
        is_public=FLAG,
    )),
    "club_matches": TableSpec("club_matches", _columns(
        id=TEXT,
        created_at=TIME,
        created_by=TEXT,
        club_id=TEXT,
        status=TEXT,
        played_at=TIME,
        field_cost_cents=WHOLE,
    )),
    "club_match_payments": TableSpec("club_match_payments", _columns(
        id=TEXT,
        created_at=TIME,
        match_id=TEXT,
        expected_cents=WHOLE,
        paid_cents=WHOLE,
        paid_at=TIME,
    )),
    "tournament_billing_payments": TableSpec("tournament_billing_payments", _columns(
        id=TEXT,
        created_at=TIME,
        admin_id=TEXT,
        created_tournament_id=TEXT,
        amount=REAL,
        currency_id=TEXT,
        status=TEXT,
        approved_at=TIME,
    )),
    "league_billing_payments": TableSpec("league_billing_payments", _columns(
        id=TEXT,
        created_at=TIME,
        admin_id=TEXT,
        created_league_id=TEXT,
        amount=REAL,
        currency_id=TEXT,
        status=TEXT,
        purpose=TEXT,
        approved_at=TIME,
    )),
}

# --- fixed values: tables that must never be extracted or landed ---
FORBIDDEN_TABLES: tuple[str, ...] = (
    "organization_billing_payments",
    "organization_billing_subscriptions",
)

# --- fixed values: event names accepted by the source table's check constraint ---
EVENT_ALLOWLIST: tuple[str, ...] = (
    "billing_started",
    "cta_clicked",
    "group_created",
    "group_shared",
    "match_created",
    "match_shared",
    "payment_returned",
    "players_page_opened",
    "ranking_shared",
    "signup_started",
    "admin_login_succeeded",
    "admin_oauth_login_succeeded",
    "admin_register_succeeded",
    "match_finished",
    "payment_created",
    "payment_approved",
    "super_metrics_exported",
)

# --- fixed values: funnel stage of each classified event; any other event is PRODUCT_STAGE ---
FUNNEL_STAGES: dict[str, tuple[str, ...]] = {
    "acquisition": ("cta_clicked", "signup_started"),
    "activation": ("admin_register_succeeded", "group_created"),
    "referral": ("group_shared", "ranking_shared", "match_shared"),
    "revenue": ("billing_started", "payment_created", "payment_returned", "payment_approved"),
    "retention": ("admin_login_succeeded", "admin_oauth_login_succeeded"),
}
PRODUCT_STAGE = "product"

# --- fixed values: event names that count as an admin login ---
LOGIN_EVENTS: tuple[str, ...] = ("admin_login_succeeded", "admin_oauth_login_succeeded")

# --- fixed values: match statuses that count as a finished match ---
FINISHED_STATUSES: tuple[str, ...] = ("finished", "played")

# --- fixed values: payment domains and flows of the finance mart ---
FINANCE_DOMAINS: tuple[str, ...] = ("league", "tournament", "club_match")
LEAGUE_DEFAULT_FLOW = "league_payment"
TOURNAMENT_FLOW = "tournament_payment"
CLUB_MATCH_FLOW = "field_cost_collection"
DEFAULT_CURRENCY = "ARS"
APPROVED_STATUS = "approved"

# --- fixed values: health score weights of the organisation ranking ---
HEALTH_WEIGHTS = {"players": 1, "matches_created": 3, "matches_finished": 5}

# --- fixed values: retention horizon in days (day 0 .. day 30) ---
RETENTION_DAYS = 31

# --- fixed values: placeholder for a login without admin ---
ANONYMOUS_ADMIN = "anonymous"
UNKNOWN_SOURCE = "unknown"

def check_identifier(identifier: str) -> str:
    """``identifier`` itself, if it is safe to put into SQL text and paths.

    Safe names are ASCII letters, digits and underscores, not starting with a digit; anything
    else (line ends too) raises ``ValueError``.
    """
    safe = isinstance(identifier, str) and identifier.isascii() and identifier.isidentifier()
    if not safe:
        raise ValueError(f"not a plain table or column name: {identifier!r}")
    return identifier


def quote_identifier(identifier: str) -> str:
    """Double-quote a checked identifier for use in a JDBC table or column reference."""
    return f'"{check_identifier(identifier)}"'


def spec_for(table: str) -> TableSpec:
    """Contract of ``table``; unknown or forbidden names raise ``KeyError``."""
    if table in FORBIDDEN_TABLES:
        raise KeyError(f"{table} is excluded from the analytics contract")
    return SOURCE_TABLES[table]
