"""Contract tables from files (parquet, ORC, CSV, JSON).

No schema inference pass over the data: parquet and ORC carry their schema, CSV is read as
text by header name, JSON is read with the contract's column names as text, so a nested JSON
object arrives as its JSON text. Staging types every column defensively afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sparkmarts.contracts import SOURCE_TABLES, spec_for
from sparkmarts.sources.normalize import normalize

SELF_DESCRIBING = ("parquet", "orc")


def text_schema(table: str) -> T.StructType:
    """The contract's column names, all as text."""
    return T.StructType([T.StructField(c, T.StringType(), True) for c in spec_for(table).columns])


def read_files(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Files at ``path`` (a file, folder or glob) as the contract table ``table``."""
    reader = spark.read.format(fmt).options(**dict(options or {}))
    if fmt == "csv":
        reader = reader.option("header", "true").option("inferSchema", "false")
    elif fmt == "json":
        reader = reader.schema(text_schema(table))
    elif fmt not in SELF_DESCRIBING:
        raise ValueError(f"unsupported format {fmt!r}")
    return normalize(reader.load(path), table)


def read_folder(
    spark: SparkSession,
    root: str,
    tables: Iterable[str] | None = None,
    fmt: str = "parquet",
    options: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """One table per sub-folder ``root/<table>``."""
    names = list(tables or SOURCE_TABLES)
    return {t: read_files(spark, f"{root.rstrip('/')}/{t}", t, fmt, options) for t in names}
