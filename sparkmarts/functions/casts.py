"""Defensive typing of raw columns.

Every parser turns a malformed value into NULL instead of failing the job (Spark 4 runs with
ANSI mode, where a plain cast of bad text raises). The accepted text shapes are those of the
SQL engine the marts are specified against, which differs from Spark's own parser both ways: it
rejects a bare year, ``1d`` as a double or padded booleans, and accepts ``/`` in dates, several
blanks before the time, zone names and ``1_000``. Each parser checks the shape with a regular
expression and rewrites it to Spark's form before it calls ``try_cast``. Known remaining
differences (rare forms, NULL here): years with 2 or 5+ digits, hour-only times such as ``9:``,
``24:00``, the keywords ``infinity``/``epoch`` as timestamps; text ``nan`` becomes NULL on
purpose, since NaN compares above every amount. All of it stays a
built-in expression, so it runs inside whole-stage code generation.

The functions take the column's data type as well, because the raw layer keeps whatever type the
source delivered: text from files and fixtures, timestamps from JDBC or parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Timestamp text: a 4-digit-year date with "-" or "/" (the same one twice), then optionally a
# time after "T" or blanks, an optional zone designator (Z, +hh, +hh:mm, +hhmm, UTC or a zone
# name; ignored, the wall clock is kept) and trailing blanks. Leading blanks are allowed, a
# date-only value with trailing blanks is not. Groups 1, 3, 4, 5 rebuild "y-m-d time".
TIMESTAMP_PARTS = (
    r"^\s*(\d{4})([-/])(\d{1,2})\2(\d{1,2})"
    r"(?:(?:T|\s+)(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)"
    r"\s*(?:Z|[+-]\d{2}(?::?\d{2})?|UTC|[A-Za-z]+/[A-Za-z_]+)?\s*)?$"
)
# The common ISO form (a subset of the above) that Spark's parser reads exactly the same way.
TIMESTAMP_ISO = (r"^\d{4}-\d{1,2}-\d{1,2}"
                 r"(?:[ T]\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:\d{2})?)?$")
# Plain decimal or scientific notation, optionally padded, single "_" allowed between digits;
# no type suffix such as "1d".
_DIGITS = r"\d+(?:_\d+)*"
NUMBER_SHAPE = (rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
                rf"(?:[eE][+-]?{_DIGITS})?\s*$")
# Infinity spelled out, which the reference engine accepts and Spark's parser does too.
INFINITY_SHAPE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
# A boolean token has no surrounding blanks.
BOOLEAN_SHAPE = r"^\S+$"
# E-mail shape used by the personal-data scan.
EMAIL_SHAPE = r"[^\s@]+@[^\s@]+\.[^\s@]+"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
            T.DecimalType)


def dtype_of(df: DataFrame, column: str) -> T.DataType:
    """Data type of ``column`` in ``df`` (exact name match)."""
    return df.schema[column].dataType


def to_timestamp_ntz(column: Column, dtype: T.DataType) -> Column:
    """Wall-clock timestamp without zone, or NULL when the value does not parse.

    Text keeps its wall clock (an offset or ``Z`` suffix is ignored), zoned timestamps are
    rendered in the session time zone, dates become midnight.
    """
    if isinstance(dtype, T.TimestampNTZType):
        return column
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return column.cast(T.TimestampNTZType())
    if isinstance(dtype, T.StringType):
        # ISO text goes straight to Spark's parser (which ignores a zone for timestamp_ntz);
        # other accepted shapes are parsed directly too and, only if Spark gives up, rewritten
        # to "y-m-d time" and parsed again. The cheap ISO test keeps the common case fast.
        direct = column.try_cast(T.TimestampNTZType())
        canonical = F.trim(F.regexp_replace(column, TIMESTAMP_PARTS, "$1-$3-$4 $5"))
        return (
            F.when(column.rlike(TIMESTAMP_ISO), direct)
            .when(column.rlike(TIMESTAMP_PARTS),
                  F.coalesce(direct, canonical.try_cast(T.TimestampNTZType())))
        )
    return F.lit(None).cast(T.TimestampNTZType())


def to_day(ts: Column) -> Column:
    """Calendar day of a ``timestamp_ntz`` column (day truncation)."""
    return F.to_date(ts)


def to_double(column: Column, dtype: T.DataType) -> Column:
    """Double value, NULL for malformed text and for NaN."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.nanvl(column.cast(T.DoubleType()), F.lit(None).cast(T.DoubleType()))
    if isinstance(dtype, _NUMERIC) or isinstance(dtype, T.BooleanType):
        return column.cast(T.DoubleType())
    if isinstance(dtype, T.StringType):
        ok = column.rlike(NUMBER_SHAPE) | column.rlike(INFINITY_SHAPE)
        digits = F.regexp_replace(F.trim(column), "_", "")
        return F.when(ok, digits.try_cast(T.DoubleType()))
    return F.lit(None).cast(T.DoubleType())


def to_boolean(column: Column, dtype: T.DataType) -> Column:
    """Boolean value: true/false, t/f, yes/no, y/n, 1/0 in any case; NULL otherwise."""
    if isinstance(dtype, T.BooleanType):
        return column
    if isinstance(dtype, T.StringType):
        return F.when(column.rlike(BOOLEAN_SHAPE), column.try_cast(T.BooleanType()))
    if isinstance(dtype, _NUMERIC):
        return column.try_cast(T.BooleanType())
    return F.lit(None).cast(T.BooleanType())


def to_text(column: Column) -> Column:
    """Text value of any column."""
    return column.cast(T.StringType())


def blank_to(column: Column, default: str) -> Column:
    """``default`` when the text is NULL or exactly empty; other blanks are kept."""
    text = to_text(column)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def json_text(column: Column, dtype: T.DataType) -> Column:
    """JSON document as text: NULL becomes ``{}``, text is kept, structured values are
    serialised with object keys in sorted order and NULL fields kept."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(column, F.lit("{}"))
    if isinstance(dtype, T.NullType):
        return F.lit("{}")
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType)):
        shown = F.to_json(_sorted_keys(column, dtype), {"ignoreNullFields": "false"})
    else:  # to_json takes no scalars: the value is the one element of an array
        inner = F.to_json(F.array(column), {"ignoreNullFields": "false"})
        shown = F.when(column.isNotNull(), F.substring(inner, F.lit(2), F.length(inner) - 2))
    return F.coalesce(shown, F.lit("{}"))


def _sorted_keys(column: Column, dtype: T.DataType) -> Column:
    """``column`` with the keys of its objects in order, at every depth."""
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: _sorted_keys(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        ordered = F.array_sort(F.map_keys(column))
        return F.map_from_arrays(ordered, F.transform(
            ordered, lambda key: _sorted_keys(column[key], dtype.valueType)))
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name)
        rebuilt = F.struct(*[_sorted_keys(column[f.name], f.dataType).alias(f.name)
                             for f in fields])
        return F.when(column.isNotNull(), rebuilt)
    return column


def email_like(column: Column) -> Column:
    """True where the text contains something shaped like an e-mail address."""
    return to_text(column).rlike(EMAIL_SHAPE)


def parsed(df: DataFrame, column: str, kind: str) -> Column:
    """Parse ``df[column]`` as ``kind`` (timestamp, double, boolean) by its actual type."""
    dtype = dtype_of(df, column)
    parser = {"timestamp": to_timestamp_ntz, "double": to_double, "boolean": to_boolean}[kind]
    return parser(F.col(column), dtype)
