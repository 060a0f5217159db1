"""Helpers that several operators share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmarts.session import checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read from there.

    Lost executors then cost no recomputation of what came before. A session without that setting
    gets a temporary folder if it is a local one; on a cluster the setting is required.
    """
    spark = df.sparkSession
    local = spark.sparkContext.master.startswith("local[")
    if local and not spark.sparkContext.getCheckpointDir():
        checkpoint_dir(spark, tempfile.mkdtemp(prefix="checkpoint-"))
    else:
        checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) under fixed names, null texts as empty; other columns are not read."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``max_bytes`` at most (one row at least)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


@contextlib.contextmanager
def no_collection() -> Iterator[None]:
    """No search for cycles meanwhile: for code that makes many small objects and no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Memo(dict):
    """A dict that computes missing values; beyond ``limit`` entries it keeps only recent ones.

    Two generations: when the current one is full it becomes the old one, from which entries move
    back as they are used. Words follow a power law, so the frequent ones stay.
    """

    def __init__(self, compute, limit: int = 300_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
