from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sparkmarts.session import local_session

    warehouse = str(tmp_path_factory.mktemp("spark-warehouse"))
    session = local_session(cores=4, shuffle_partitions=4, app="sparkmarts-tests",
                            extra={"spark.sql.warehouse.dir": warehouse})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    from tests.fixtures import sample_frames

    return sample_frames(spark)


@pytest.fixture(scope="session")
def sample_marts(sample):
    from sparkmarts.plans import pipeline

    return pipeline.marts(sample)


def rows(df, columns=None):
    """Collected rows as tuples (optionally of selected columns), in DataFrame order."""
    if columns is not None:
        df = df.select(*columns)
    return [tuple(r) for r in df.collect()]


def bag(df, columns=None):
    """Collected rows as a sorted list, for order-insensitive comparison."""
    return sorted(rows(df, columns), key=repr)
