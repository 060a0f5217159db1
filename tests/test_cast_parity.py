"""Dirty-text casts against the SQL engine the marts are specified against (DuckDB).

A seeded grammar produces a few thousand plausible and broken timestamps, numbers and booleans;
Spark parses them all in one DataFrame and DuckDB's TRY_CAST parses each. They must agree,
except for the documented rare forms (2-digit or 5+-digit years, hour-only times such as "9:",
hour 24) and text NaN, which is NULL here on purpose.
"""

from __future__ import annotations

import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.functions import to_boolean, to_double, to_timestamp_ntz

RNG_SEED = 20260503


def _ts(rnd: random.Random) -> str:
    y = rnd.choice(["2026", "1999", "0001", "9999", "26", "20261"])
    sep = rnd.choice(["-", "-", "-", "/", "."])
    m = rnd.choice(["05", "5", "12", "13", "00", "1", "02"])
    d = rnd.choice(["03", "3", "31", "30", "32", "00", "29"])
    s = f"{y}{sep}{m}{sep}{d}" if rnd.random() > 0.1 else rnd.choice([y, f"{y}-{m}"])
    if rnd.random() < 0.7:
        t = rnd.choice(["00", "9", "23", "24", "12"]) + ":" + rnd.choice(["00", "5", "59", "60"])
        if rnd.random() < 0.8:
            t += ":" + rnd.choice(["00", "7", "59", "60"])
        if rnd.random() < 0.4:
            t += "." + "".join(rnd.choice("0123456789") for _ in range(rnd.randint(1, 10)))
        s += rnd.choice(["T", " ", "  ", "t", "_"]) + t
        if rnd.random() < 0.35:
            s += rnd.choice(["Z", "+03:00", "-03:00", "+0300", " UTC", "z", "+3",
                             " America/Buenos_Aires", "X"])
    if rnd.random() < 0.08:
        s = " " + s
    if rnd.random() < 0.08:
        s += " "
    return s


def _num(rnd: random.Random) -> str:
    s = rnd.choice(["1", "12", "0", "007", "1.5", ".5", "5.", "1e3", "1E-2", "1e", "-3", "+4",
                    "1,5", "1_000", "1__0", "_1", "1_", "1_0e2", "0x1F", "inf", "-Infinity",
                    "1d", "2f", "3L", "", "abc", "1.2.3"])
    return rnd.choice(["", " ", "\t"]) + s + rnd.choice(["", " "])


def _bool(rnd: random.Random) -> str:
    s = rnd.choice(["true", "false", "t", "f", "yes", "no", "y", "n", "1", "0", "on", "off",
                    "2", "", "truee", "True", "FALSE", "YeS"])
    return rnd.choice(["", "", " "]) + s + rnd.choice(["", "", " "])


def _rare_timestamp(v: str) -> bool:
    return bool(re.match(r"^\s*(\d{5,}|\d{2})\D", v)
                or re.search(r"(^|[ Tt_])\d{1,2}:(\s|$|[+-]|Z| UTC)", v)
                or re.search(r"[ T]24:", v))


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b):
        return True
    return a == b


CASES = [
    ("timestamp", _ts, to_timestamp_ntz, "TIMESTAMP", _rare_timestamp),
    ("double", _num, to_double, "DOUBLE", lambda v: v.strip().lower() == "nan"),
    ("boolean", _bool, to_boolean, "BOOLEAN", lambda v: False),
]


@pytest.mark.parametrize("kind,gen,parser,duck_type,known", CASES, ids=[c[0] for c in CASES])
def test_casts_match_sql_engine(spark, kind, gen, parser, duck_type, known):
    rnd = random.Random(RNG_SEED)
    values = sorted({gen(rnd) for _ in range(2500)})
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = dict(df.select("v", parser(F.col("v"), T.StringType())).collect())
    con = duckdb.connect()
    mismatches = []
    for v in values:
        want = con.execute(f"SELECT TRY_CAST(? AS {duck_type})", [v]).fetchone()[0]
        if not _same(got[v], want) and not known(v):
            mismatches.append((v, got[v], want))
    assert mismatches == []
