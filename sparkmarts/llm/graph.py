"""Links between rows: buckets of bounded size, forests and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmarts.llm.common import cut

FEW_KEYS = 10_000  # hot keys that are broadcast at most


def in_blocks(rows: DataFrame, keys: list[str], spread: Column, limit: int) -> DataFrame:
    """``rows`` with block_a, block_b and own (block), so that no (keys, block_a, block_b) is large.

    Rows of a key with more than ``limit`` rows are dealt by ``spread`` over blocks of about that
    size, and each pair of blocks is a group: any two rows of a key meet in at least one group.
    """
    heavy = rows.groupBy(*keys).count().filter(F.col("count") > limit).select(
        *keys, F.ceil(F.col("count") / limit).cast("int").alias("blocks"))
    heavy = cut(heavy)
    n = heavy.count()
    if not n:
        return rows.withColumns({c: F.lit(0) for c in ("block_a", "block_b", "own")})
    dealt = rows.join(F.broadcast(heavy) if n <= FEW_KEYS else heavy, keys, "left")
    own = F.pmod(spread, F.coalesce("blocks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1), lambda other: F.struct(
        F.least(other, F.col("own")).alias("block_a"), F.greatest(other, F.col("own")).alias("block_b")))
    out = dealt.withColumn("own", own).withColumn("pair", F.explode(pairs))
    return out.select(*rows.columns, "pair.block_a", "pair.block_b", "own")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int
                 ) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (about ``rows`` rows) of a stream sorted by ``keys``, largest first.

    Comes with the number of each row's group, counted from 0.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for key in keys:
            values = table.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def by_size(table: pa.Table, first: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        sizes = np.diff(np.r_[first, table.num_rows])
        order = np.argsort(-sizes, kind="stable")
        group = np.repeat(np.arange(len(order)), sizes[order])
        ends = np.cumsum(sizes[order])
        take = np.repeat(first[order] - ends + sizes[order], sizes[order]) + np.arange(len(group))
        return table.take(pa.array(take)), group

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            first = starts(table)
            if len(first) > 1:
                yield by_size(table.slice(0, first[-1]), first[:-1])
                held = table.slice(first[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield by_size(table, starts(table))


class Unions:
    """Sets of row numbers, joined by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        differ = x != y
        if not differ.any():
            return
        up: dict[int, int] = {}
        for u, v in set(zip(x[differ].tolist(), y[differ].tolist())):
            while u in up:
                u = up[u]
            while v in up:
                v = up[v]
            if u != v:
                up[max(u, v)] = min(u, v)
        old = np.fromiter(up, np.int64, len(up))
        self.root[old] = np.fromiter(up.values(), np.int64, len(up))
        while True:
            to = self.root[self.root]
            if (to == self.root).all():
                return
            self.root = to

    def forest(self, ids: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of ids that connect each set, no id in more than ``width`` + 1 of them."""
        order = np.lexsort((ids, self.root))
        roots = self.root[order]
        first = np.flatnonzero(np.r_[True, roots[1:] != roots[:-1]]) if len(roots) else roots
        place = np.arange(len(roots)) - np.repeat(first, np.diff(np.r_[first, len(roots)]))
        child = np.flatnonzero(place > 0)
        parent = child - place[child] + (place[child] - 1) // width
        return ids[order][child], ids[order][parent]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): the smallest id that links reach, for every id of ``edges`` (longs, not null).

    Each round every id moves to its smallest neighbour in an order by hash, and links between moved
    ids go on. That order breaks up chains, so a constant share of the ids goes each round. Ids
    never leave Spark, minima combine before the shuffle, and each round is cut.
    """
    named = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    links = cut(pairs.select(named("a").alias("a"), named("b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near"))
                   .select("v", F.least("v", "near").alias("to")))
        moves.append(move)
        to_a = move.select(F.col("v").alias("a"), F.col("to").alias("x"))
        to_b = move.select(F.col("v").alias("b"), F.col("to").alias("y"))
        links = cut(links.join(to_a, "a").join(to_b, "b").filter("x <> y").select(
            F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    if not moves:
        return links.select(F.col("a.id").alias("id"), F.col("b.id").alias("root"))
    out = moves[0]
    for move in moves[1:]:
        step = move.select(F.col("v").alias("to"), F.col("to").alias("next"))
        out = out.join(step, "to", "left").select("v", F.coalesce("next", "to").alias("to"))
    out = cut(out)
    least = out.groupBy("to").agg(F.min("v.id").alias("root"))
    return out.join(least, "to").select(F.col("v.id").alias("id"), "root")
