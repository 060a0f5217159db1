"""Parallel extraction of the contract tables over JDBC.

Each table becomes one lazy DataFrame read by many tasks at once: the source is asked for the quantiles of
a column, and each even range between them is one task's WHERE predicate (``planned_splits``); strides of
a numeric, date or timestamp column (``JdbcSplit``) or own predicates do as well. Rows go from the executors
straight to their sink without passing through the driver. Only metadata (column names, range ends) is
fetched on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from sparkmarts.contracts import SOURCE_TABLES, check_identifier, quote_identifier, spec_for
from sparkmarts.sources.normalize import empty_frame, normalize

STATEMENT_TIMEOUT_SECONDS = 60
SPLIT_COLUMN = "created_at"
UNDEFINED_TABLE = frozenset({"42P01", "42S02"})


@dataclass(frozen=True)
class JdbcSource:
    """Connection to the operational database. ``schema`` has no default on purpose."""

    url: str
    schema: str
    properties: Mapping[str, str] = field(default_factory=dict)
    timeout_seconds: int = STATEMENT_TIMEOUT_SECONDS
    fetch_size: int = 10_000
    session_init: str | None = None

    def __post_init__(self) -> None:
        check_identifier(self.schema)


@dataclass(frozen=True)
class JdbcSplit:
    """Range split of a scan: ``num_partitions`` strides of ``column`` between the bounds.

    Values outside the bounds are still read (by the first and last partitions), and NULLs go
    to the first partition, so no row is lost. ``column`` may be numeric, date or timestamp.
    """

    column: str
    lower: int | date | datetime | str
    upper: int | date | datetime | str
    num_partitions: int

    def options(self) -> dict[str, str]:
        return {
            # Spark resolves the name against the table schema and quotes it per dialect.
            "partitionColumn": check_identifier(self.column),
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.num_partitions),
        }


def time_slice_predicates(column: str, bounds: Sequence[datetime | date | str]) -> list[str]:
    """WHERE predicates that cut ``column`` at ``bounds`` into disjoint, covering slices.

    The first slice also takes NULLs and everything before the first bound, the last one
    everything from the last bound on, so every row is read exactly once.
    """
    q = quote_identifier(column)
    cuts = [f"'{b}'" for b in bounds]
    if not cuts:
        return ["1 = 1"]
    preds = [f"({q} < {cuts[0]} OR {q} IS NULL)"]
    preds += [f"({q} >= {lo} AND {q} < {hi})" for lo, hi in zip(cuts, cuts[1:])]
    preds.append(f"{q} >= {cuts[-1]}")
    return preds


def quantile_query(relation: str, column: str, parts: int) -> str:
    """SQL for the lower ends and row counts of ``parts`` equally large ranges of ``column``.

    ``relation`` is a quoted table name. The statement uses standard window functions, so the source
    ranks the column itself (an index on it serves the order) and answers with one row per range.
    """
    if parts < 1:
        raise ValueError("at least one range is needed")
    q = quote_identifier(column)
    return (f"SELECT MIN({q}) AS lower_end, COUNT(*) AS row_count FROM (SELECT {q}, NTILE({int(parts)}) "
            f"OVER (ORDER BY {q}) AS part FROM {relation} WHERE {q} IS NOT NULL) ranked "
            "GROUP BY part")


def _literal(value) -> str:
    """A number as it is, any other value as quoted text (dates and times in ISO form)."""
    if isinstance(value, bool):
        raise ValueError("a boolean column can't be cut into ranges")
    if isinstance(value, (int, float, Decimal)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def range_predicates(column: str, lower_ends: Sequence) -> list[str]:
    """WHERE predicates for disjoint, covering ranges that begin at ``lower_ends`` (in order).

    Repeated ends are one: a value with more rows than a range is a range of its own. The first range also
    takes everything below, NULLs get a read of their own.
    """
    q = quote_identifier(column)
    ends = list(dict.fromkeys(lower_ends))
    cuts = [_literal(value) for value in ends[1:]]
    if not cuts:
        return [f"{q} IS NOT NULL", f"{q} IS NULL"]
    found = [f"{q} < {cuts[0]}"]
    found += [f"({q} >= {low} AND {q} < {high})" for low, high in zip(cuts, cuts[1:])]
    return [*found, f"{q} >= {cuts[-1]}", f"{q} IS NULL"]


def plan_predicates(spark: SparkSession, source: JdbcSource, table: str, column: str,
                    parts: int) -> list[str]:
    """Predicates of even ranges of ``column``, as the source's own quantiles cut them."""
    query = quantile_query(qualified_table(source, table), column, parts)
    reader = spark.read.format("jdbc").options(**reader_options(source))
    rows = reader.option("query", query).load().collect()  # one row a range
    return range_predicates(column, sorted(row[0] for row in rows))


def planned_splits(spark: SparkSession, source: JdbcSource, tables: Iterable[str],
                   columns: Mapping[str, str] | None = None, parts: int = 64) -> dict[str, list[str]]:
    """Predicates for every table of ``tables`` that has its split column (``created_at`` by default)."""
    found = {}
    for table in tables:
        column = (columns or {}).get(table, SPLIT_COLUMN)
        if column in existing_columns(spark, source, table):
            found[table] = plan_predicates(spark, source, table, column, parts)
    return found


def reader_options(source: JdbcSource) -> dict[str, str]:
    """Options shared by every read: URL, credentials, statement timeout and fetch size."""
    opts = {
        "url": source.url,
        "queryTimeout": str(source.timeout_seconds),
        "fetchsize": str(source.fetch_size),
        "preferTimestampNTZ": "true",
    }
    if source.session_init:
        opts["sessionInitStatement"] = source.session_init
    opts.update({k: str(v) for k, v in source.properties.items()})
    return opts


def qualified_table(source: JdbcSource, table: str) -> str:
    return f"{quote_identifier(source.schema)}.{quote_identifier(spec_for(table).name)}"


def existing_columns(spark: SparkSession, source: JdbcSource, table: str) -> set[str]:
    """Columns of ``table`` as the JDBC relation resolves them; empty when the table is absent.

    Spark asks the driver for the relation's schema, which works for any database. Only the
    standard's "undefined table" states count as absent; any other error is raised.
    """
    relation = spark.read.format("jdbc").options(**reader_options(source))
    try:
        return set(relation.option("dbtable", qualified_table(source, table)).load().columns)
    except Py4JJavaError as error:
        if sql_state(error.java_exception) in UNDEFINED_TABLE:
            return set()
        raise


def sql_state(error) -> str | None:
    """SQL state of a Java exception or of the first of its causes that has one."""
    while error is not None:
        if hasattr(error, "getSQLState") and "SQL" in error.getClass().getName():
            return error.getSQLState()
        error = error.getCause()
    return None


def read_table(
    spark: SparkSession,
    source: JdbcSource,
    table: str,
    split: JdbcSplit | None = None,
    predicates: Sequence[str] | None = None,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """One contract table as a lazy, parallel scan, normalised to its contract.

    Only contract columns that exist in the source are selected (Spark pushes the projection
    into the generated SELECT); a table with none of them yields an empty contract frame.
    ``columns`` skips the catalog lookup when the caller already knows them.
    """
    spec = spec_for(table)
    present = set(columns) if columns is not None else existing_columns(spark, source, table)
    selected = [c for c in spec.columns if c in present]
    if not selected:
        return empty_frame(spark, table)
    opts = reader_options(source)
    if predicates:
        props = {k: v for k, v in opts.items() if k != "url"}
        df = spark.read.jdbc(source.url, qualified_table(source, table),
                             predicates=list(predicates), properties=props)
    else:
        reader = spark.read.format("jdbc").options(**opts)
        reader = reader.option("dbtable", qualified_table(source, table))
        if split is not None:
            reader = reader.options(**split.options())
        df = reader.load()
    return normalize(df.select(*selected), table)


def extract_tables(
    spark: SparkSession,
    source: JdbcSource,
    tables: Iterable[str] | None = None,
    splits: Mapping[str, JdbcSplit] | None = None,
    predicates: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Lazy scans of ``tables`` (all contract tables when None or empty).

    An unknown or forbidden table name raises ``KeyError`` before anything is read.
    """
    names = list(tables or SOURCE_TABLES)
    for name in names:
        spec_for(name)
    splits = splits or {}
    predicates = predicates or {}
    return {
        name: read_table(spark, source, name, split=splits.get(name),
                         predicates=predicates.get(name))
        for name in names
    }
