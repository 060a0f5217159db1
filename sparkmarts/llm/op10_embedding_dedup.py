"""Near-duplicate embeddings by Euclidean p-stable hashing.

Method: vectors are normalised; each table quantises ``hashes`` random projections, floor((a.x + b)
/ width), and rows of a label with equal values meet in a bucket, where the exact cosine (double
precision) decides. The number of projections follows the count of vectors, so that chance buckets
stay small, and the number of tables follows from it, so that a pair at the threshold meets in at
least one table with probability ``recall``; closer pairs meet more surely. Equal vectors are one
class with a weight. Large buckets are split into pairs of blocks. Links are counted where a pair
meets first (in the first table they share, in their own blocks), so no pair leaves its task: out go
counts per class and forests, whose components follow.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite components, and rows
without label link with nothing; vectors of different lengths too; rows that are repeated or have no id
link as other vectors do (a component without any id has a null component_id); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.common import cut, parts
from sparkmarts.llm.graph import Unions, components, in_blocks, whole_groups


def meeting(distance: float, width: float) -> float:
    """Probability that one projection quantises two vectors at a distance alike."""
    t = width / distance
    tail = 0.5 * math.erfc(t / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def sizes(n: int, threshold: float, recall: float, width: float, chance_rows: int) -> tuple[int, int]:
    """(hashes, tables) for n vectors."""
    near, far = meeting(math.sqrt(max(2 - 2 * threshold, 1e-9)), width), meeting(math.sqrt(2), width)
    hashes = max(4, math.ceil(math.log(max(n / chance_rows, 1)) / -math.log(far)))
    return hashes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**hashes)))


class Hashing:
    """Table keys of unit vectors; the same for every worker."""

    def __init__(self, hashes: int, tables: int, width: float, seed: int):
        self.shape, self.width, self.seed = (tables, hashes), width, seed
        self.drawn: dict[int, tuple] = {}

    def keys(self, x: np.ndarray) -> np.ndarray:
        tables, hashes = self.shape
        if x.shape[1] not in self.drawn:
            draw = np.random.default_rng([self.seed, x.shape[1]])
            self.drawn[x.shape[1]] = (draw.normal(size=(x.shape[1], tables * hashes)),
                                      draw.uniform(0, self.width, tables * hashes),
                                      draw.integers(-2**62, 2**62, hashes) * 2 + 1)
        a, b, mix = self.drawn[x.shape[1]]
        q = np.floor((x @ a + b) / self.width).astype(np.int64).reshape(-1, tables, hashes)
        mixed = (q * mix).sum(axis=2)  # wraps; equal values give equal keys
        return ((mixed ^ mixed >> 29) * 0x5851F42D4C957F2D >> 32).astype(np.int32)


def unit(vectors: pa.ListArray, n: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def near_duplicates(rows: DataFrame, threshold: float = 0.93, recall: float = 0.995,
                    width: float = 2.0, chance_rows: int = 32, seed: int = 7,
                    block_rows: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """<id_col>, n_links, component_id, kept of each row; ids are longs."""
    own = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"),
                      F.col(label_col).alias("label"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("label").isNotNull() & ~bad
                       & F.exists("vec", lambda x: x != 0), F.lit(False))
    classes = cut(own.filter(sound).groupBy("label", "vec").agg(
        F.min("id").alias("least"), F.count("*").alias("weight"))
        .withColumn("rep", F.monotonically_increasing_id()))
    hashes, tables = sizes(classes.count(), threshold, recall, width, chance_rows)
    hashing = Hashing(hashes, tables, width, seed)
    schema = T.StructType([*classes.withColumn("dim", F.size("vec")).schema.fields,
                           T.StructField("keys", T.ArrayType(T.IntegerType()))])

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                keys = hashing.keys(unit(some.column("vec"), some.num_rows))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(some.num_rows + 1) * tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*some.columns, lists], names=schema.names)

    keyed = cut(classes.withColumn("dim", F.size("vec")).mapInArrow(hash_rows, schema))
    met = keyed.select("*", F.posexplode("keys").alias("t", "key"))
    dealt = in_blocks(met, ["label", "dim", "t", "key"], F.xxhash64("rep"), block_rows)
    group = ["t", "key", "dim", "label", "block_a", "block_b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, group, 1 << 14):
            # a group's vectors have one length, a table's may differ
            dims = table.column("dim").to_numpy()
            for dim in np.unique(dims):
                keep = dims == dim
                some, of = table.filter(pa.array(keep)).combine_chunks(), number[keep]
                yield bucket_links(some, np.unique(of, return_inverse=True)[1], threshold)

    found = cut(dealt.repartition(parts(rows), *group).sortWithinPartitions(*group).mapInArrow(
        compare, "a long, b long, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null")).withColumnRenamed("id", "rep")
    rooted = classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(counts, "rep", "left").join(least, "root").select(
        "label", "vec", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    linked = own.filter(sound).join(of, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = own.filter(~sound).select("id", F.lit(0).cast("long").alias("n_links"),
                                      F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def bucket_links(table: pa.Table, group: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(a, null, n): links counted here of rep a; (a, b, 0): forest of the buckets' links."""
    n = table.num_rows
    column = lambda c: table.column(c).to_numpy()
    x = unit(table.column("vec").chunk(0), n)
    keys = table.column("keys").chunk(0).flatten().to_numpy().reshape(n, -1)
    t, own, block_a, block_b = (column(c) for c in ("t", "own", "block_a", "block_b"))
    rep, weight = column("rep"), column("weight")
    counts, sets = np.zeros(n, np.int64), Unions(n)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        sets.join(i, j)
        here = (np.minimum(own[i], own[j]) == block_a[i]) & (np.maximum(own[i], own[j]) == block_b[i])
        i, j = i[here], j[here]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at:at + (1 << 16)], j[at:at + (1 << 16)]
            before = (keys[a] == keys[b]) & (np.arange(keys.shape[1]) < t[a][:, None])
            first = ~before.any(axis=1)
            np.add.at(counts, a[first], weight[b[first]])
            np.add.at(counts, b[first], weight[a[first]])

    size = np.bincount(group)
    ends = np.cumsum(size)
    large = int(np.searchsorted(-size, -64, "left"))  # groups of more than 64 rows, one by one
    for start, stop in zip((ends - size)[:large].tolist(), ends[:large].tolist()):
        for a in range(start, stop, 512):
            i, j = np.nonzero(x[a:min(a + 512, stop)] @ x[a:stop].T >= threshold)
            i, j = i + a, j + a
            take(i[i < j], j[i < j])
    begin = int(ends[large - 1]) if large else 0
    for s in range(1, int(size[large:].max(initial=0))):
        active = int(ends[np.searchsorted(-size, -s, "left") - 1])  # rows of groups above s rows
        i = np.arange(begin, min(active, n - s))
        i = i[group[i] == group[i + s]]
        i = i[np.einsum("ij,ij->i", x[i], x[i + s]) >= threshold]
        if len(i):
            take(i, i + s)
    a, b = sets.forest(rep)
    some = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([
        pa.array(np.r_[rep[some], a]), pa.array([None] * len(some) + b.tolist(), pa.int64()),
        pa.array(np.r_[counts[some], np.zeros(len(a), np.int64)])], names=["a", "b", "n"])
