"""Exact distinct counts from mergeable sets of numbered ids.

Ids get dense numbers once; a set of ids is then rows of (word, bits), 64 numbers a word. Words of many
rows fold into one by "or" in a hash aggregate, also on the map side, so a set is shuffled once per task
and word however often its ids occur, and sets of days, stages or sources combine again by "or": the
distinct count of any range comes from the stored sets without another look at the events.

(Spark's bitmap aggregates keep 4 KB per bucket of 32,768 numbers and run as sort aggregates; words suit
groups that hold few ids and stay in generated hash aggregates.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmarts.operators.reports import in_range
from sparkmarts.session import durable

GROWTH_KEYS = ("event_date", "source", "funnel_stage", "event_name")
WORD_BITS = 64
#: Bytes of a numbering up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def number_ids(ids: DataFrame, id_col: str) -> DataFrame:
    """(id_col, number): every distinct non-NULL id with a number from 0, without gaps.

    The distinct ids are written down before they are numbered (a retried task would deal them otherwise);
    a number is the id's place in its partition plus the sizes of the partitions before, of which there is
    one row per partition.
    """
    distinct = ids.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    placed = durable(distinct.select(id_col, F.monotonically_increasing_id().alias("_at")))
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["count"]) for r in
                   placed.groupBy(part.alias("part")).count().collect())
    starts, start = [], 0
    for number, size in sizes:
        starts.append((number, start))
        start += size
    offsets = ids.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    own = placed.select(id_col, part.alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_in"))
    return own.join(F.broadcast(offsets), "_part").select(
        id_col, (F.col("_start") + F.col("_in")).alias("number"))


def _fits(numbers: DataFrame, id_col: str) -> bool:
    """Whether a numbering is small enough to broadcast."""
    return (numbers.agg(F.sum(F.octet_length(id_col) + 32)).first()[0] or 0) <= BROADCAST_BYTES


def _word(kind: str, number: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(number, F.lit(WORD_BITS)).cast("int"))
    return F.when(number.isNotNull(), F.struct(
        F.lit(kind).alias("kind"), F.floor(number / WORD_BITS).cast("bigint").alias("word"), bit.alias("bits")))


def growth_id_sets(stg_events: DataFrame, admins: DataFrame, organizations: DataFrame) -> DataFrame:
    """Per day, source, stage and event name: kind, word, bits, events.

    Kinds ``admin`` and ``organization`` are the words of the ids seen; one row of kind ``events`` counts
    the events. ``admins`` and ``organizations`` are numberings (``number_ids``). Events meet broadcast
    numberings as they are read; if one is too large for that, events of equal key and ids fold first, so
    that a hot id is a few rows of the join.
    """
    numberings = {"admin_id": admins, "organization_id": organizations}
    fits = {c: _fits(numbers, c) for c, numbers in numberings.items()}
    rows = stg_events.select(*GROWTH_KEYS, *numberings, F.lit(1).cast("bigint").alias("events"))
    if not all(fits.values()):
        rows = rows.groupBy(*GROWTH_KEYS, *numberings).agg(F.sum("events").alias("events"))
    for c, numbers in numberings.items():
        named = numbers.select(F.col(c), F.col("number").alias(f"_{c}"))
        rows = rows.join(F.broadcast(named) if fits[c] else named, c, "left")
    none = F.lit(0).cast("bigint")
    tagged = F.array(
        F.struct(F.lit("events").alias("kind"), none.alias("word"), none.alias("bits")),
        _word("admin", F.col("_admin_id")), _word("organization", F.col("_organization_id")))
    rows = rows.select(*GROWTH_KEYS, "events", F.inline(tagged)).where(F.col("kind").isNotNull())
    return rows.groupBy(*GROWTH_KEYS, "kind", "word").agg(
        F.bit_or("bits").alias("bits"),
        F.sum(F.when(F.col("kind") == "events", F.col("events")).otherwise(none)).alias("events"))


def merged_sets(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sets by fewer keys."""
    return sets.groupBy(*keys, "kind", "word").agg(F.bit_or("bits").alias("bits"),
                                                   F.sum("events").alias("events"))


def counts_of(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per ``keys``, which must be those of the sets: events and exact distinct admins, organizations."""
    size = F.bit_count("bits").cast("bigint")
    of_kind = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, size)),
                                      F.lit(0).cast("bigint"))
    events = F.coalesce(F.sum("events"), F.lit(0).cast("bigint"))
    return sets.groupBy(*keys).agg(events.alias("events"), of_kind("admin").alias("admins"),
                                   of_kind("organization").alias("organizations"))


def growth_daily_from_sets(sets: DataFrame) -> DataFrame:
    """The growth mart from its stored sets."""
    return counts_of(sets, GROWTH_KEYS)


def active_ids(sets: DataFrame, start, end, by: Sequence[str] = ()) -> DataFrame:
    """Events and distinct ids of the days [start, end], per ``by`` (a choice of the mart's keys)."""
    some = in_range(sets, "event_date", start, end)
    return counts_of(merged_sets(some, by), by)


def rolling_ids(sets: DataFrame, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Per day with events (and ``by``): events and distinct ids of that day and the ``days`` - 1 before.

    A day's words are lent to the days that look back on it; days without events of their own have no
    row.
    """
    daily = merged_sets(sets.where(F.col("event_date").isNotNull()), ["event_date", *by])
    seen = daily.select("event_date", *by).distinct().withColumn("_seen", F.lit(True))
    ahead = F.sequence(F.col("event_date"), F.date_add(F.col("event_date"), days - 1))
    lent = daily.withColumn("event_date", F.explode(ahead))
    rolled = counts_of(merged_sets(lent, ["event_date", *by]), ["event_date", *by])
    same = F.lit(True)
    there = seen.select(*[F.col(c).alias(f"_{c}") for c in ("event_date", *by)])
    for c in ("event_date", *by):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rolled.join(there, same, "left_semi")
