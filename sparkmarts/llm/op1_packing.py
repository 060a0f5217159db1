"""Best-fit packing of tokenised documents into fixed-length training sequences.

Method: hierarchical residual packing. Documents become pieces of at most ``max_len`` tokens; full
pieces are sequences of their own. The other pieces are packed best-fit inside each partition. Bins
that are nearly full are emitted; underfull bins go on as items of the next round, where fewer
partitions pack them again, until one partition holds the rest or a round merges nothing more.
Rows that move are a few numbers a piece, never token ids; a task packs ``task_items`` items at most.

Defined cases: a null or empty text is one piece that holds the end id alone; a very long text is many
full pieces; the literal of a special token is that token, as the library has it; ties and repeated rows
are packed as separate items; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.bpe_text import file_encoder
from sparkmarts.llm.common import cut, slices, text_rows

def pieces(docs: DataFrame, tokenizer: str, max_len: int, end_id: int, id_col: str,
           text_col: str) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("id", rows.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = file_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, 8 << 20):
            out: list[list] = [[], [], [], [], []]
            for key, own in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                ids = own.tobytes() + end
                n = len(ids) // 4
                at, stop, k = 0, (n - 1) % max_len + 1, 0
                while at < n:
                    for column, value in zip(out, (key, k, at, stop - at,
                                                   zlib.crc32(ids[4 * at:4 * stop]))):
                        column.append(value)
                    at, stop, k = stop, stop + max_len, k + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], pa.int32()),
                 *(pa.array(c, pa.int64()) for c in out[2:])], names=schema.names)

    return rows.mapInArrow(tokenise, schema)


def best_fit(loads: list[int], capacity: int) -> list[list[int]]:
    """Items (by index) of each bin, packed best-fit in order of decreasing load.

    Open bins are kept in stacks by free space; a bit mask of the non-empty stacks gives the
    tightest one that fits.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    mask = 0
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        load = loads[i]
        fits = mask >> load
        if fits:
            free = load + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask ^= 1 << free
            bins[b].append(i)
            free -= load
        else:
            b, free = len(bins), capacity - load
            bins.append([i])
        if free:
            stacks[free].append(b)
            mask |= 1 << free
    return bins


def pack(items: DataFrame, capacity: int, length_col: str = "length", full: float = 0.99,
         fan_in: int = 8, task_items: int = 50_000) -> DataFrame:
    """Bins of the rows of ``items`` (each of 1 to ``capacity`` long): load, members (array).

    ``full``: bins filled to this share are emitted; the others are items of the next round.
    """
    member = T.ArrayType(items.schema)
    schema = T.StructType([T.StructField("load", T.LongType()), T.StructField("members", member)])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        loads = table.column("load").to_pylist()
        bins = best_fit(loads, capacity)
        members = table.column("members").combine_chunks()
        members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
        order = np.fromiter((i for b in bins for i in b), np.int64, len(loads))
        counts = np.diff(members.offsets.to_numpy())[order]
        ends = np.cumsum(counts)
        starts = members.offsets.to_numpy()[:-1][order]
        take = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        per_bin = np.add.reduceat(counts, np.cumsum([0, *map(len, bins[:-1])]))
        flat = members.values.take(pa.array(take))
        for at in range(0, len(bins), 10_000):
            some = per_bin[at:at + 10_000]
            skip = int(per_bin[:at].sum())
            lists = pa.ListArray.from_arrays(
                pa.array(np.r_[0, np.cumsum(some)], pa.int32()),
                flat.slice(skip, int(some.sum())))
            total = pa.array([sum(loads[i] for i in b) for b in bins[at:at + 10_000]], pa.int64())
            yield pa.RecordBatch.from_arrays([total, lists], names=["load", "members"])

    rest = items.select(F.col(length_col).cast("long").alias("load"),
                        F.array(F.struct(*items.columns)).alias("members"))
    left = rest.count()
    n = max(1, math.ceil(left / task_items))
    done: list[DataFrame] = []
    while True:
        merged = cut(rest.repartition(n).mapInArrow(merge, schema))
        under, before = merged.filter(F.col("load") < full * capacity), left
        left = under.count()
        stalled = left > 0.95 * before and left > task_items  # one task can't hold the rest
        if n == 1 or left < 2 or stalled:
            done.append(merged)
            break
        done.append(merged.filter(F.col("load") >= full * capacity))
        rest, n = under, max(math.ceil(n / fan_in), math.ceil(left / task_items))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, max_len: int = 2048, end_id: int = 0,
                   id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8,
                   task_items: int = 50_000) -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer``: path of a byte-level tokenizers file that every executor can read.
    """
    rows = cut(pieces(docs, tokenizer, max_len, end_id, id_col, text_col))
    whole = rows.filter(F.col("length") == max_len)
    alone = whole.select("*", (F.monotonically_increasing_id() * 2).alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))
    bins = pack(rows.filter(F.col("length") < max_len), max_len, fan_in=fan_in,
                task_items=task_items)
    bins = bins.select("members", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"))

    schema = alone.schema

    def unroll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(0)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            fields = {f.name: flat.field(i) for i, f in enumerate(flat.type)}
            lengths = fields["length"].to_numpy()
            before = np.cumsum(lengths) - lengths
            heads = np.cumsum(sizes) - sizes
            offset = before - np.repeat(before[heads], sizes)
            sequence = np.repeat(batch.column(1).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays(
                [*(fields[c] for c in schema.names[:5]), pa.array(sequence, pa.int64()),
                 pa.array(offset, pa.int64())], names=schema.names)

    packed = bins.mapInArrow(unroll, schema)
    return alone.unionByName(packed).withColumnRenamed("id", id_col)
