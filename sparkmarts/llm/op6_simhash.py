"""SimHash near-duplicate groups by bit-sliced comparison.

Method: equal fingerprints are one class. A pair within ``radius`` differing bits agrees on all but
``radius`` of the fingerprint's blocks, so each choice of the other blocks is a bucket key; more
blocks make longer keys, and their number follows the count of classes so that chance buckets stay
small. Inside buckets fingerprints are stored as vertical bit planes; shifting the planes compares
every row with the one s places further at once, carry-save counters add up the differing bits, and
words of 64 pairs are dropped as soon as all exceed the radius. Buckets of many classes are split
into pairs of blocks. A bucket sends out a forest, not its pairs; components follow.

Defined cases: texts without words (null or empty too) have fingerprint zero and link like others;
rows with equal doc_id are rows of their own; a null doc_id never names a component unless it has no
other row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.common import cut, parts, slices, text_rows
from sparkmarts.llm.graph import Unions, components, in_blocks, whole_groups

BITS = 64


def fingerprint(text: str, shingle: int, seed: int) -> int:
    """A-Z in lower case, words between ASCII white space, majority of each bit over shingles."""
    words = text.encode().lower().split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(data, seed)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k:k + (1 << 16)]
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """id, fp (the fingerprint's bits as a signed long)."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()],
                             np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row k: bit k of all fingerprints, 64 a word, with a word of padding at the end."""
    n = len(fps)
    bits = np.zeros((BITS, (n + 127) // 64 * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1,
                                bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int, check_every: int = 8
                ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group (groups in order of falling size) within ``radius`` bits."""
    sizes = np.bincount(group)
    ends = np.cumsum(sizes)
    planes = bit_planes(fps)
    width = radius.bit_length()
    for s in range(1, int(sizes.max(initial=0))):
        active = int(ends[np.searchsorted(-sizes, -s, "left") - 1])  # rows of groups above s rows
        words, q, r = (active + 63) // 64, s // 64, np.uint64(s % 64)
        same = np.zeros(words * 64, bool)
        stop = max(0, min(active, len(group) - s))
        same[:stop] = group[:stop] == group[s:s + stop]
        over = ~np.packbits(same, bitorder="little").view("<u8")
        at = np.flatnonzero(~over)
        over = over[at]
        counters = [np.zeros(len(at), np.uint64) for _ in range(width)]
        for k in range(BITS):
            plane = planes[k]
            low = plane[np.minimum(at + q, len(plane) - 1)]
            if r:
                high = plane[np.minimum(at + q + 1, len(plane) - 1)]
                low = low >> r | high << (np.uint64(64) - r)
            carry = plane[at] ^ low
            for i in range(width):
                carry, counters[i] = counters[i] & carry, counters[i] ^ carry
            over |= carry
            if k % check_every == check_every - 1:
                alive = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
                if len(alive) < len(at):
                    at, over = at[alive], over[alive]
                    counters = [c[alive] for c in counters]
                if not len(at):
                    break
        if len(at):
            left = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(left)
            i = at[word] * 64 + bit
            if radius != (1 << width) - 1:
                apart = (fps[i] ^ fps[i + s]).astype("<u8").view(np.uint8).reshape(-1, 8)
                i = i[np.unpackbits(apart, axis=1).sum(axis=1) <= radius]
            if len(i):
                yield i, i + s


def key_masks(radius: int, blocks: int) -> list[int]:
    """The bits of each key: every choice of ``blocks`` - ``radius`` of equal blocks of 64 bits."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(masks, blocks - radius)]


def links(classes: DataFrame, radius: int = 3, small_bucket: int = 64, block_rows: int = 2048
          ) -> DataFrame:
    """(a, b): forests of the reps of ``classes`` (fp, rep) that are within ``radius`` bits."""
    n = classes.count()
    blocks = radius + 1
    while n > small_bucket * 2 ** (BITS * (blocks - radius) // blocks) and blocks < radius + 5:
        blocks += 1
    signed = lambda mask: mask - (1 << BITS) if mask >> (BITS - 1) else mask
    keyed = classes.select("fp", "rep", F.posexplode(F.array(*(
        F.col("fp").bitwiseAND(F.lit(signed(m))) for m in key_masks(radius, blocks)))).alias("t", "key"))
    dealt = in_blocks(keyed, ["t", "key"], F.xxhash64("fp"), block_rows)
    group = ["t", "key", "block_a", "block_b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, group, 1 << 18):
            fps = table.column("fp").to_numpy().view(np.uint64)
            sets = Unions(len(fps))
            for i, j in close_pairs(fps, number, radius):
                sets.join(i, j)
            a, b = sets.forest(table.column("rep").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.repartition(parts(classes), *group).sortWithinPartitions(*group).mapInArrow(
        compare, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", small_bucket: int = 64,
                    block_rows: int = 2048) -> DataFrame:
    """<id_col>, fingerprint (hex), component_id, group_id of each row; ids are longs.

    ``group_id`` names the component also where its rows have no id.
    """
    own = cut(fingerprints(docs, shingle, seed, id_col, text_col))
    classes = cut(own.groupBy("fp").agg(F.min("id").alias("least")).withColumn("rep", F.col("fp")))
    found = components(links(classes, radius, small_bucket, block_rows))
    rooted = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "fp", "least", F.coalesce("root", "rep").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(least, "root")
    return own.join(of, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id", F.col("root").alias("group_id"))


def first_of_groups(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of smallest id (rows without id last).

    Rows that share an id, or have none, are told apart by their fingerprint; of rows equal in both one
    stays.
    """
    groups = cut(near_duplicates(docs, shingle, radius, seed, id_col, text_col))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"),
                     F.col("fingerprint").alias("fingerprint"))
    first = cut(groups.groupBy("group_id").agg(F.min(order).alias("first")).select("first.*"))
    again = cut(groups.groupBy(id_col).count().filter((F.col("count") > 1) | F.col(id_col).isNull())
                .select(F.col(id_col).alias("id")))
    sure = first.join(again, "id", "left_anti").filter(~F.col("none")).select("id")
    # columns by place, so that none can clash with those of the groups
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    key, text = (own.columns[docs.columns.index(c)] for c in (id_col, text_col))
    kept = own.join(sure, own[key] == sure["id"], "left_semi")
    # rows in doubt get a number, so that their fingerprints find them again
    doubt = cut(own.join(again, own[key].eqNullSafe(again["id"]), "left_semi")
                .withColumn("number", F.monotonically_increasing_id()))
    marked = fingerprints(doubt, shingle, seed, "number", text).select(
        F.col("id").alias("number"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("print"))
    found = doubt.join(marked, "number")
    found = found.join(first, found[key].eqNullSafe(first["id"]) & (found["print"] == first["fingerprint"]),
                       "left_semi").dropDuplicates([key, "print"]).select(*own.columns)
    return kept.unionByName(found).toDF(*docs.columns)
