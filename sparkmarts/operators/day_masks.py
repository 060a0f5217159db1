"""Activity as bit masks of days, and windows over them.

A period is ``days`` calendar days long, counted from 1970-01-01. An id's active days of one period are
the bits of one integer, however many events it had, so a window of ``days`` days from any start is a
shift and an "and" of the masks of two neighbouring periods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _days(day: str | Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def period_of(day: str | Column, days: int) -> Column:
    """Number of the period that holds ``day``; NULL without one."""
    return F.floor(_days(day) / F.lit(days)).cast("bigint")


def place_of(day: str | Column, days: int) -> Column:
    """Place of ``day`` in its period, from 0."""
    return F.pmod(_days(day), F.lit(days)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), place)


def activity_masks(rows: DataFrame, id_col: str, day_col: str, days: int) -> DataFrame:
    """(id_col, period, mask): bit i for day i of the period, bit days + i for day i of the next one.

    First the days of each (id, period) fold into one integer, also on the map side, so that a busy id
    costs one row per task and period; then each period lends its mask to the one before it.
    ``days`` is at most 31, so that two periods fit into a bigint. Rows without id or day are left out.
    """
    if not 0 < days <= 31:
        raise ValueError("a mask holds two periods of at most 31 days")
    own = (
        rows.where(F.col(id_col).isNotNull() & F.col(day_col).isNotNull())
        .groupBy(id_col, period_of(day_col, days).alias("period"))
        .agg(F.bit_or(_bit(place_of(day_col, days))).alias("mask"))
    )
    lent = F.inline(F.array(
        F.struct(F.col("period").alias("period"), F.col("mask").alias("mask")),
        F.struct((F.col("period") - 1).alias("period"),
                 F.call_function("shiftleft", F.col("mask"), F.lit(days)).alias("mask")),
    ))
    return own.select(id_col, lent).groupBy(id_col, "period").agg(F.bit_or("mask").alias("mask"))


def window_mask(mask: Column, place: Column, days: int) -> Column:
    """Bit i: active ``i`` days after the day at ``place`` of the mask's period; 0 without a mask."""
    window = F.call_function("shiftright", mask, place).bitwiseAND(F.lit((1 << days) - 1))
    return F.coalesce(window, F.lit(0).cast("bigint"))


def set_bits(mask: Column, bits: int) -> Column:
    """Array of the places of ``mask``'s bits below ``bits``."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)),
                    lambda i: F.getbit(mask, i) == F.lit(1))
