"""Rows of whole-number vectors, for exact integer inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.common import cut

EXACT = 2.0**53
#: Stands for a null id, so that it comes after all others.
NO_ID = 2**63 - 1


def integer_rows(rows: DataFrame, scale: float, id_col: str = "vec_id", vec_col: str = "embedding",
                 **extra: Column) -> DataFrame:
    """(row, id, no_id, *extra, vec): whole numbers floor(scale * x) as doubles, cut.

    Vectors that are null or hold null or non-finite components are left out, also where scaling
    overflows. ``row`` numbers the rows, repeated ones too; a null id is NO_ID with no_id true.
    """
    own = rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
        F.col(id_col).isNull().alias("no_id"), *[c.alias(name) for name, c in extra.items()],
        F.col(vec_col).cast("array<double>").alias("vec"))
    limit = F.lit(1.7e308 / max(abs(scale), 1.0))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > limit))
    own = own.filter(F.col("vec").isNotNull() & ~bad)
    at = own.columns.index("vec")

    def floor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False)) + 0.0
            offsets = lists.offsets.to_numpy()
            whole = pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], whole], names=batch.schema.names)

    return cut(own.mapInArrow(floor, T.StructType(own.schema.fields)))


def matrix(vectors: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """One row a vector; missing trailing components are zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes),
        np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def widest(*vectors: pa.ChunkedArray) -> int:
    return max((int(np.diff(c.offsets.to_numpy()).max(initial=0)) for v in vectors for c in v.chunks),
               default=0)


def exact(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where all inner products are exact in them, else as Python integers."""
    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < EXACT:
        return x, q
    whole = lambda m: np.array([[int(v) for v in row] for row in m], object).reshape(m.shape)
    return whole(x), whole(q)


def longs(scores: np.ndarray) -> pa.Array:
    """Scores as longs; what a long can't hold becomes its nearest end."""
    if scores.dtype != object:
        return pa.array(scores.astype(np.int64))
    return pa.array([min(max(int(s), -2**63), 2**63 - 1) for s in scores], pa.int64())


def kth(values: np.ndarray, k: int):
    """The k-th largest value."""
    return np.sort(values)[-k] if values.dtype == object else np.partition(values, len(values) - k)[-k]
