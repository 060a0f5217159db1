"""Hard negatives by vertical scans over vector components (BOND).

Method: a shard of rows is stored by dimension. An anchor reads the dimensions in descending order
of its own magnitudes and keeps a partial score of each row still in its candidate bitmap. The
smallest and largest contributions that the unread dimensions can make bound every row's score, and
rows that can no longer matter leave the bitmap: first those that can't be among the anchor's best
rows of its label (its positives), then, per positive, those whose score must miss the window of
allowed scores or can't be among the window's first. What is left when all dimensions are read has
its exact score. Shards and blocks of anchors are of bounded size and meet as groups (the stated
anchors against all rows); each shard's first go on to a ranking per anchor or window.

Defined cases: rows with a null label, a null vector or null or non-finite components take no part;
missing trailing components count as zero (an empty vector scores 0); repeated rows each count, also
as other rows of themselves; a null id is never an anchor, ranks behind others of its score and
comes out null; scores are exact, and those beyond a long are given as its nearest end; windows of
negative positives are empty, a positive of score 0 allows score 0; an empty table, or one without
anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmarts.llm.common import cut
from sparkmarts.llm.vectors import exact, integer_rows, kth, longs, matrix, widest

FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("row", pa.int64()),
                   ("id", pa.int64()), ("no_id", pa.bool_()), ("score", pa.int64())])


class Columns:
    """A shard by dimension, with what one anchor may still gain or lose in the unread ones."""

    def __init__(self, x: np.ndarray):
        self.by_dim = np.ascontiguousarray(x.T)
        self.low = self.by_dim.min(axis=1) if len(x) else np.zeros(x.shape[1])
        self.high = self.by_dim.max(axis=1) if len(x) else np.zeros(x.shape[1])

    def scan(self, anchor: np.ndarray, rows: np.ndarray, step: int = 4
             ) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(rows, partial scores, least rest, most rest); the caller sends back a mask of rows to keep.

        The last time both rests are 0, so the scores are whole.
        """
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, other = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least = np.append(np.cumsum(np.minimum(one, other)[::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(one, other)[::-1])[::-1], 0)
        part = np.zeros(len(rows), self.by_dim.dtype)
        at, d = 0, len(order)
        while True:
            stop = min(d, at + step)
            read = order[at:stop]
            if len(rows) == self.by_dim.shape[1]:
                part = part + anchor[read] @ self.by_dim[read]
            else:
                part = part + anchor[read] @ self.by_dim[np.ix_(read, rows)]
            keep = yield rows, part, least[stop], most[stop]
            if stop == d:
                return
            rows, part = rows[keep], part[keep]
            at, step = stop, step * 2


def first(rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(rows) > k:
        some = np.flatnonzero(scores >= kth(scores, k))
    else:
        some = np.arange(len(rows))
    return some[np.lexsort((rows[some], ids[rows[some]], -scores[some]))[:k]]


def best_rows(shard: Columns, anchor: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
              ) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best of ``rows``."""
    scan, keep = shard.scan(anchor, rows), None
    while True:
        try:
            rows, part, least, most = scan.send(keep)
        except StopIteration:
            break
        keep = part + most >= kth(part + least, k) if len(rows) > k else np.ones(len(rows), bool)
    top = first(rows, part, ids, k)
    return rows[top], part[top]


def window_rows(shard: Columns, anchor: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int,
                windows: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window, rows, scores): each window's k best of ``rows``."""
    scan, keep = shard.scan(anchor, rows), None
    while True:
        try:
            rows, part, least, most = scan.send(keep)
        except StopIteration:
            break
        low, high = part + least, part + most
        keep = np.zeros(len(rows), bool)
        for floor, ceiling in windows:
            may = (high >= floor) & (low <= ceiling)
            sure = low[(low >= floor) & (high <= ceiling)]
            if len(sure) >= k:
                may &= high >= kth(sure, k)
            keep |= may
    for number, (floor, ceiling) in enumerate(windows):
        inside = np.flatnonzero((part >= floor) & (part <= ceiling))
        if len(inside):
            top = inside[first(rows[inside], part[inside], ids, k)]
            yield number, rows[top], part[top]


def _meet(rows: DataFrame, anchors: DataFrame, shard_rows: int, block_rows: int, search) -> DataFrame:
    """``search(some, asked)`` over every shard of ``rows`` and block of ``anchors``, as Arrow tables."""
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(anchors.count() / block_rows))
    spread = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("*", spread(shards, 1).alias("shard")).select("*", every(blocks).alias("block"))
    # new names for the columns of the same table, else the two sides can't be told apart
    own = [F.col(c).alias(c) for c in anchors.columns]
    right = anchors.select(*own, spread(blocks, 2).alias("block")).select("*", every(shards).alias("shard"))

    def task(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return FOUND.empty_table()
        width = widest(some["vec"], asked["vec"])
        x, q = exact(matrix(some["vec"], width), matrix(asked["vec"], width))
        got = list(search(some, asked, Columns(x), q))
        return pa.Table.from_batches(got, FOUND)

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        task, "anchor long, slot int, row long, id long, no_id boolean, score long")


def _found(some: pa.Table, anchor: int, slot: int, rows: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    take = some.select(["row", "id", "no_id"]).take(pa.array(rows)).combine_chunks()
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([anchor] * n, pa.int64()), pa.array([slot] * n, pa.int32()),
         *[c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in take.columns],
         longs(scores)], schema=FOUND)


def _ranked(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "no_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, scale: float = 256.0, positives: int = 5,
                   negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id",
                   vec_col: str = "embedding", label_col: str = "label", shard_rows: int = 8192,
                   block_rows: int = 1024) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (percent windows).

    ``is_anchor`` tests ``id``, the row's id.
    """
    label = F.col(label_col)
    vectors = integer_rows(rows.filter(label.isNotNull()), scale, id_col, vec_col, label=label.cast("string"))
    anchors = vectors.filter(~F.col("no_id") & F.coalesce(is_anchor, F.lit(False)))

    def near(some: pa.Table, asked: pa.Table, shard: Columns, q: np.ndarray):
        labels, numbers, ids = some["label"].to_numpy(), some["row"].to_numpy(), some["id"].to_numpy()
        of = {value: np.flatnonzero(labels == value) for value in set(asked["label"].to_pylist())}
        for anchor, own, value in zip(q, asked["row"].to_pylist(), asked["label"].to_pylist()):
            mine = of[value][numbers[of[value]] != own]
            if len(mine):
                yield _found(some, own, 0, *best_rows(shard, anchor, mine, ids, positives))

    near_rows = _meet(vectors, anchors, shard_rows, block_rows, near)
    best = _ranked(near_rows, positives, "anchor").select(
        F.col("anchor").alias("row"), F.struct(
            "rank", F.when(~F.col("no_id"), F.col("id")).alias("id"), F.col("score")).alias("positive"))
    asked = cut(anchors.withColumnRenamed("id", "anchor_id").join(
        best.groupBy("row").agg(F.sort_array(F.collect_list("positive")).alias("positives")), "row"))

    def in_windows(some: pa.Table, asked: pa.Table, shard: Columns, q: np.ndarray):
        labels, ids = some["label"].to_numpy(), some["id"].to_numpy()
        of = {value: np.flatnonzero(labels != value) for value in set(asked["label"].to_pylist())}
        for anchor, own, value, best_of in zip(q, asked["row"].to_pylist(), asked["label"].to_pylist(),
                                               asked["positives"].to_pylist()):
            windows = [(-(-low * p["score"] // 100), high * p["score"] // 100) for p in best_of]
            for number, found, scores in window_rows(shard, anchor, of[value], ids, negatives, windows):
                yield _found(some, own, number, found, scores)

    held = _ranked(_meet(vectors, asked, shard_rows, block_rows, in_windows), negatives, "anchor", "slot")
    named = asked.select(F.col("row").alias("anchor"), "anchor_id",
                         F.posexplode("positives").alias("slot", "positive"))
    return held.join(named, ["anchor", "slot"]).select(
        "anchor_id", F.col("positive.id").alias("positive_id"), "rank",
        F.when(~F.col("no_id"), F.col("id")).alias("negative_id"),
        F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
