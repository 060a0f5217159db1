"""Exact top-k inner products by the threshold algorithm.

Method: every shard of candidates keeps one sorted list per dimension. A query reads each list from
the end that its weight prefers, looks up the full score of every id it meets, and stops when the
bound, the score that the values last read would give together, can't beat its k-th score. Shards
and blocks of queries are of bounded size and meet as groups; each shard's k best go on to a ranking
per query. The stated queries meet all rows, block by block.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; missing
trailing components count as zero; every row counts, also rows that share an id: a query leaves out
its own row only; ties go to the smaller id; a row with a null id is a candidate that comes after
others of its score; scores are exact, and those beyond a long are given as its nearest end; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmarts.llm.vectors import exact, kth, longs, matrix, widest

FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("row", pa.int64()),
                   ("id", pa.int64()), ("no_id", pa.bool_()), ("score", pa.int64())])


def threshold_search(x: np.ndarray, ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray,
                     own_numbers: np.ndarray, k: int, step: int = 16
                     ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's number, rows of ``x``, scores) of each query's k best rows, ties to smaller ids.

    A query leaves out the row that has its own number.
    """
    n = len(x)
    rising = np.argsort(x, axis=0, kind="stable")
    low = np.take_along_axis(x, rising, axis=0)
    falling, high = rising[::-1], low[::-1]
    for query, own in zip(queries, own_numbers):
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, x.dtype)
        depth, more = 0, step
        while depth < n:
            stop = min(n, depth + more)
            met = np.zeros(n, bool)
            met[falling[depth:stop][:, up].ravel()] = True
            met[rising[depth:stop][:, down].ravel()] = True
            if not len(up) and not len(down):
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            new = new[numbers[new] != own]
            # many look-ups are cheaper over all rows at once
            got = (x @ query)[new] if 8 * len(new) > n else x[new] @ query
            rows, scores = np.concatenate([rows, new]), np.concatenate([scores, got])
            if len(rows) > k:
                least = kth(scores, k)
                rows, scores = rows[scores >= least], scores[scores >= least]
                best = np.lexsort((rows, ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            bound = high[stop - 1, up] @ query[up] + low[stop - 1, down] @ query[down]
            depth, more = stop, 2 * more
            if len(rows) == k and scores.min() > bound or seen.all():
                break
        best = np.lexsort((rows, ids[rows], -scores))[:k]
        yield int(own), rows[best], scores[best]


def top_k(candidates: DataFrame, queries: DataFrame, k: int, shard_rows: int = 4096,
          query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other candidates.

    Both are rows of ``vectors.integer_rows``; the queries have ids.
    """
    shards = max(1, math.ceil(candidates.count() / shard_rows))
    blocks = max(1, math.ceil(queries.count() / query_rows))
    spread = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.select("row", "id", "no_id", "vec", spread(shards, 1).alias("shard"),
                             every(blocks).alias("block"))
    # new names for the columns of the same table, else the two sides can't be told apart
    right = queries.select(*[F.col(c).alias(c) for c in ("row", "id", "vec")],
                           every(shards).alias("shard"), spread(blocks, 2).alias("block"))

    def search(some: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if some.num_rows and asked.num_rows:
            width = widest(some["vec"], asked["vec"])
            x, q = exact(matrix(some["vec"], width), matrix(asked["vec"], width))
            ids, numbers, names = (some[c].to_numpy() for c in ("id", "row", "no_id"))
            query_ids = asked["id"].to_numpy()
            every_query = threshold_search(x, ids, numbers, q, asked["row"].to_numpy(), k)
            for query_id, (own, rows, scores) in zip(query_ids, every_query):
                n = len(rows)
                found.append(pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, own)), pa.array(np.full(n, query_id)), pa.array(numbers[rows]),
                     pa.array(ids[rows]), pa.array(names[rows]), longs(scores)], schema=FOUND))
        return pa.Table.from_batches(found, FOUND)

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        search, "query long, query_id long, row long, id long, no_id boolean, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id", "no_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("vec_id"), "score")
