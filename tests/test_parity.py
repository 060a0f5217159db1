"""Every registered query against its independent DuckDB SQL on the smallest driver tables
(the driver repeats this at sf0.01)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.parity import compare, duck_connection

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duck_connection(SF_SMALL)
    yield con
    con.close()


def test_every_query_has_an_oracle():
    """The product's queries all have SQL; findings of the quality checks are not empty."""
    from sparkmarts.plans import registry

    assert set(ORACLE) <= set(QUERIES)
    assert set(registry.queries()) - set(ORACLE) == set()


@pytest.mark.parametrize("key", ["dq_event_allowlist", "dq_unique_id", "dq_orphans"])
def test_checks_have_findings(duck, key):
    assert len(duck.execute(ORACLE[key]).fetchall()) > 0


def test_orphans_and_addresses_are_found_in_the_test_tables(duck):
    found = {r[0] for r in duck.execute(ORACLE["dq_orphans"]).fetchall()}
    assert found == {"organization_id", "club_id"}
    assert duck.execute(ORACLE["dq_pii_scan"]).fetchone()[0] > 0


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_parity(spark, duck, key):
    r = compare(spark, duck, key, SF_SMALL, QUERIES[key], ORACLE[key])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort_date", "day_number", "active_admins", "active_organizations"]
    assert df.count() > 0
