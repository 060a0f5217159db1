"""Column-level building blocks (built-in Spark expressions only)."""

from sparkmarts.functions.casts import (
    EMAIL_SHAPE,
    blank_to,
    email_like,
    json_text,
    parsed,
    to_boolean,
    to_day,
    to_double,
    to_text,
    to_timestamp_ntz,
)
from sparkmarts.functions.classify import funnel_stage

__all__ = [
    "EMAIL_SHAPE",
    "blank_to",
    "email_like",
    "funnel_stage",
    "json_text",
    "parsed",
    "to_boolean",
    "to_day",
    "to_double",
    "to_text",
    "to_timestamp_ntz",
]
