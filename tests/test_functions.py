"""Column functions on hand-made edge rows."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.contracts import (
    EVENT_ALLOWLIST,
    FORBIDDEN_TABLES,
    FUNNEL_STAGES,
    SOURCE_TABLES,
    check_identifier,
    quote_identifier,
    spec_for,
)
from sparkmarts.functions import (
    blank_to,
    email_like,
    funnel_stage,
    json_text,
    to_boolean,
    to_double,
    to_timestamp_ntz,
)


def one_col(spark, values, dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {dtype}")


def test_contracts_shape():
    assert len(SOURCE_TABLES) == 11
    assert sum(len(s.columns) for s in SOURCE_TABLES.values()) == 75
    assert SOURCE_TABLES["analytics_events"].json_columns == ("properties",)
    assert SOURCE_TABLES["matches"].type_of("finished_at") == T.TimestampNTZType()
    assert SOURCE_TABLES["club_match_payments"].type_of("paid_cents") == T.LongType()
    assert SOURCE_TABLES["league_billing_payments"].type_of("amount") == T.DoubleType()
    for t in FORBIDDEN_TABLES:
        assert t not in SOURCE_TABLES
        with pytest.raises(KeyError):
            spec_for(t)


def test_marts_only_expect_allowed_events():
    classified = [n for names in FUNNEL_STAGES.values() for n in names]
    assert len(classified) == 13
    assert set(classified) <= set(EVENT_ALLOWLIST)
    assert len(set(EVENT_ALLOWLIST)) == 17


def test_identifier_guard():
    assert quote_identifier("public") == '"public"'
    assert check_identifier("_a1") == "_a1"
    for bad in ["1abc", "a-b", "a;drop", "", "a b", 'a"', "abc\n", "é"]:
        with pytest.raises(ValueError):
            check_identifier(bad)


def test_timestamp_text(spark):
    values = ["2026-05-03T11:00:00Z", "2026-05-03T22:00:00-03:00", "2026-05-03 10:00:00",
              "2026-05-03", "bad", "2026", "2026-05", " 2026-05-03", "2026-05-03 ", "infinity",
              None, "2026/05/03  10:00 UTC", "2026-05-03T10:00:00+0300", "2026-05/03"]
    df = one_col(spark, values)
    got = [r[0] for r in df.select(to_timestamp_ntz(F.col("v"), T.StringType())).collect()]
    assert got == [datetime(2026, 5, 3, 11), datetime(2026, 5, 3, 22), datetime(2026, 5, 3, 10),
                   datetime(2026, 5, 3), None, None, None, datetime(2026, 5, 3), None, None,
                   None, datetime(2026, 5, 3, 10), datetime(2026, 5, 3, 10), None]


def test_timestamp_typed_inputs(spark):
    df = spark.createDataFrame([(datetime(2026, 1, 2, 3, 4),)], "v timestamp_ntz")
    assert df.select(to_timestamp_ntz(F.col("v"), T.TimestampNTZType())).first()[0] == \
        datetime(2026, 1, 2, 3, 4)
    dd = spark.sql("select date'2026-01-02' as v")
    assert dd.select(to_timestamp_ntz(F.col("v"), T.DateType())).first()[0] == \
        datetime(2026, 1, 2)


def test_double_text(spark):
    values = ["1", "1.5", " 2 ", "1e3", "-.5", "+3.", "1d", "1f", "n/a", "1,5", "", None, "inf",
              "1_000", "1__0", "nan"]
    df = one_col(spark, values)
    got = [r[0] for r in df.select(to_double(F.col("v"), T.StringType())).collect()]
    assert got == [1.0, 1.5, 2.0, 1000.0, -0.5, 3.0, None, None, None, None, None, None,
                   float("inf"), 1000.0, None, None]


def test_double_nan_becomes_null(spark):
    df = one_col(spark, [float("nan"), 2.5], "double")
    got = [r[0] for r in df.select(to_double(F.col("v"), T.DoubleType())).collect()]
    assert got == [None, 2.5]


def test_boolean_text(spark):
    values = ["true", "TRUE", "t", "1", "yes", "y", "no", "n", "0", "f", "false", "bad",
              " true", "true ", "", None]
    df = one_col(spark, values)
    got = [r[0] for r in df.select(to_boolean(F.col("v"), T.StringType())).collect()]
    assert got == [True] * 6 + [False] * 5 + [None] * 5


def test_blank_to_only_replaces_empty(spark):
    df = one_col(spark, ["", None, "  ", "server"])
    got = [r[0] for r in df.select(blank_to(F.col("v"), "unknown")).collect()]
    assert got == ["unknown", "unknown", "  ", "server"]


def test_funnel_stage(spark):
    names = ["cta_clicked", "group_created", "match_shared", "payment_returned",
             "admin_oauth_login_succeeded", "match_finished", None]
    df = one_col(spark, names)
    got = [r[0] for r in df.select(funnel_stage(F.col("v"))).collect()]
    assert got == ["acquisition", "activation", "referral", "revenue", "retention", "product",
                   "product"]


def test_json_text(spark):
    df = spark.createDataFrame(
        [({"b": 1, "a": 2}, ("x", None), '{"raw": true}'), (None, None, None)],
        "m map<string,int>, s struct<z:string,a:int>, t string",
    )
    m_type, s_type = df.schema["m"].dataType, df.schema["s"].dataType
    got = df.select(json_text(F.col("m"), m_type), json_text(F.col("s"), s_type),
                    json_text(F.col("t"), T.StringType())).collect()
    assert tuple(got[0]) == ('{"a":2,"b":1}', '{"a":null,"z":"x"}', '{"raw": true}')
    assert tuple(got[1]) == ("{}", "{}", "{}")


def test_email_like(spark):
    df = one_col(spark, ['{"contact": "ana@example.org"}', '{"n": 1}', "a@b", "x @y.z", None])
    got = [r[0] for r in df.select(email_like(F.col("v"))).collect()]
    assert got == [True, False, False, False, None]


def test_json_text_sorts_keys_at_every_depth_and_takes_scalars(spark):
    from pyspark.sql import functions as F

    from sparkmarts.functions.casts import json_text

    df = spark.sql("""select named_struct('b', array(named_struct('d', 1, 'c', null)),
        'a', map('z', map('y', 1, 'x', 2), 'k', null)) as deep, 7L as whole, true as flag,
        'plain' as text, cast(null as bigint) as none, cast(null as array<int>) as nothing""")
    got = df.select([json_text(F.col(f.name), f.dataType).alias(f.name) for f in df.schema]).first()
    assert got["deep"] == '{"a":{"k":null,"z":{"x":2,"y":1}},"b":[{"c":null,"d":1}]}'
    assert (got["whole"], got["flag"], got["text"]) == ("7", "true", "plain")
    assert (got["none"], got["nothing"]) == ("{}", "{}")
