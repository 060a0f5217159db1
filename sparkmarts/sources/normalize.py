"""Bring any source frame to its table contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.contracts import spec_for
from sparkmarts.functions.casts import json_text


def empty_frame(spark: SparkSession, table: str) -> DataFrame:
    """Zero-row frame with the contract columns and declared types of ``table``."""
    return spark.createDataFrame([], spec_for(table).schema)


def normalize(df: DataFrame, table: str) -> DataFrame:
    """Force ``df`` to the contract of ``table`` in one projection.

    Contract columns missing from ``df`` are added as typed NULL (``{}`` for JSON columns),
    extra columns are dropped, order follows the contract. Present columns keep the type the
    source gave them; staging re-types them defensively. JSON columns become text, and NaN in a
    floating column becomes NULL so that it cannot compare greater than every amount.
    """
    spec = spec_for(table)
    present = {f.name: f.dataType for f in df.schema.fields}
    projection = []
    for field in spec.schema.fields:
        name = field.name
        dtype = present.get(name)
        if name in spec.json_columns:
            column = json_text(F.col(name), dtype) if dtype is not None else F.lit("{}")
        elif dtype is None or isinstance(dtype, T.NullType):
            column = F.lit(None).cast(field.dataType)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            column = F.nanvl(F.col(name), F.lit(None).cast(dtype))
        else:
            column = F.col(name)
        projection.append(column.alias(name))
    return df.select(*projection)
