"""Token-id files compressed by Re-Pair grammars, with random-access decoding.

Method: documents are encoded, each followed by an end id, and laid out in ascending id order in
shards. Each shard is compressed by Re-Pair: pairs of neighbouring symbols that are frequent are
replaced by new symbols, round after round until no pair occurs ``min_count`` times; the file holds the
rules, the number of ids each rule expands to, and the remaining symbols. The stored lengths give the
place of any id, so that a document or any range is decoded from the symbols that cover it alone. A
round replaces many pairs at once, and an occurrence that overlaps another one in a run stays for the
next round.

File format (Parquet): one row per shard: part (number of the range partition), start (ids of the
partition before the shard), keys and counts of its documents, first_rule, rules (pairs, little-
endian unsigned 32-bit), lengths (ids per rule), symbols. Spark's committer writes the files to
shared storage, so a lost executor or a second attempt leaves no stray shard.

Defined cases: a null or empty text is the end id alone; rows with equal ids are ordered by text,
null ids come first; a very long text is a shard of its own; the literal of a special token is that
token, as the library has it; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from sparkmarts.llm.bpe_text import file_encoder
from sparkmarts.llm.common import cut, parts, slices, text_rows
from sparkmarts.session import checkpoint_dir

BUCKETS = 20  # most bits of the hash table that counts pairs


def compress(ids: np.ndarray, first_rule: int, min_count: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rules[k] is the pair that symbol first_rule + k stands for.

    A round looks at places where a frequent pair may be: all of them at first, then those that the round
    before left and those next to its new symbols (any other pair can only have become rarer). Pairs are
    first counted by a hash; those in buckets of enough places are counted exactly.
    """
    seq, rules, made = ids.astype(np.uint32), [], 0
    may = np.ones(len(seq), bool)
    while True:
        at = np.flatnonzero(may[:-1])
        if len(at) < min_count:
            break
        left, right = (seq[:-1], seq[1:]) if len(at) == len(seq) - 1 else (seq[at], seq[at + 1])
        bits = min(BUCKETS, len(at).bit_length() + 1)
        bucket = left * np.uint32(0x9E3779B1)
        bucket ^= bucket >> np.uint32(15)
        bucket += right
        bucket *= np.uint32(0x85EBCA77)
        bucket >>= np.uint32(32 - bits)
        full = np.bincount(bucket, minlength=1 << bits) >= min_count
        often = np.flatnonzero(full[bucket])
        pair = left[often].astype(np.uint64) << np.uint64(32) | right[often]
        numbered = numbers(pair, (np.cumsum(full) - 1)[bucket[often]], int(full.sum()))
        at, which, used, waiting = frequent(at[often], *numbered, min_count)
        if not len(used):
            break
        rules.append(np.stack([used >> np.uint64(32), used & np.uint64(0xFFFFFFFF)], 1)
                     .astype(np.uint32))
        new = first_rule + made
        made += len(used)
        seq[at] = new + which
        may = np.zeros(len(seq), bool)
        may[waiting] = True
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, may = seq[stay], may[stay]
        fresh = seq >= new
        may |= fresh
        may[:-1] |= fresh[1:]
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)), seq


def numbers(pair: np.ndarray, slot: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, number of each place's pair): a slot's number is one of its pairs, others get new ones."""
    pairs, which = np.zeros(slots, np.uint64), slot.copy()
    pairs[slot] = pair
    other = np.flatnonzero(pairs[slot] != pair)
    if len(other):
        more, which[other] = np.unique(pair[other], return_inverse=True)
        which[other] += slots
        pairs = np.concatenate([pairs, more])
    return pairs, which


def frequent(at: np.ndarray, pairs: np.ndarray, which: np.ndarray, min_count: int
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, number of the pair at each, pairs) to replace at once, none overlapping, and other places
    of frequent pairs. No pairs are returned if none has ``min_count`` places.

    Where places of two pairs overlap, the more frequent pair keeps its place; so the most frequent one
    keeps all, and every round replaces something.
    """
    # a pair of equal symbols overlaps itself in a run: every other place counts
    again = np.r_[False, (np.diff(at) == 1) & (which[1:] == which[:-1])]
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
    even = (np.arange(len(at)) - begin) % 2 == 0
    counts = np.bincount(which[even], minlength=len(pairs))
    often = counts[which] >= min_count
    places = at[often]
    at, which = at[often & even], which[often & even]
    rank = np.empty(len(pairs), np.int64)
    rank[np.lexsort((np.arange(len(pairs)), counts))] = np.arange(len(pairs))
    own, touch = rank[which], np.diff(at) == 1
    keep = np.ones(len(at), bool)
    keep[1:] &= ~touch | (own[1:] > own[:-1])
    keep[:-1] &= ~touch | (own[:-1] > own[1:])
    at, which = at[keep], which[keep]
    good = np.bincount(which, minlength=len(pairs)) >= min_count
    keep = good[which]
    return at[keep], (np.cumsum(good) - 1)[which[keep]], pairs[good], places


def rule_lengths(rules: np.ndarray, first_rule: int) -> np.ndarray:
    """Ids that each rule expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first_rule] if a >= first_rule else 1)
                   + (out[b - first_rule] if b >= first_rule else 1))
    return np.array(out, np.int64)


class Shard:
    """Decodes any range of a compressed shard by the stored lengths of its rules."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, first_rule: int, symbols: np.ndarray):
        self.rules, self.lengths, self.first = rules, lengths.astype(np.int64), first_rule
        self.symbols = symbols
        self.ends = np.cumsum(self.sizes(symbols))
        self.looked_at = 0  # symbols that decoding has met so far

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        sizes = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        sizes[rule] = self.lengths[symbols[rule] - self.first]
        return sizes

    def whole(self) -> np.ndarray:
        """All ids: the rules are expanded once, each from its two parts."""
        flat: list[np.ndarray] = []
        for a, b in self.rules.tolist():
            flat.append(np.concatenate([flat[x - self.first] if x >= self.first else np.array([x], np.uint32)
                                        for x in (a, b)]))
        table = np.concatenate([*flat, np.zeros(0, np.uint32)])
        rule = self.symbols >= self.first
        sizes = self.sizes(self.symbols)
        starts = np.zeros(len(self.symbols), np.int64)
        starts[rule] = (np.cumsum(self.lengths) - self.lengths)[self.symbols[rule] - self.first]
        out = np.repeat(self.symbols, sizes)
        inside = np.repeat(rule, sizes)
        within = np.arange(len(out)) - np.repeat(self.ends - sizes, sizes)
        out[inside] = table[(np.repeat(starts, sizes) + within)[inside]]
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], from the symbols that cover them alone.

        Level by level rules give way to their two parts, and parts outside of the range are dropped.
        """
        if start >= stop:
            return np.zeros(0, np.uint32)
        a = int(np.searchsorted(self.ends, start, "right"))
        b = int(np.searchsorted(self.ends, stop, "left")) + 1
        begin = int(self.ends[a - 1]) if a else 0
        out = self.symbols[a:b]
        while True:
            self.looked_at += len(out)
            rule = out >= self.first
            if not rule.any():
                return out[start - begin:stop - begin]
            places = np.cumsum(1 + rule) - 1 - rule  # of each symbol's first part
            parts = np.empty(len(out) + int(rule.sum()), np.uint32)
            parts[places[~rule]] = out[~rule]
            parts[places[rule]], parts[places[rule] + 1] = self.rules[out[rule] - self.first].T
            ends = begin + np.cumsum(self.sizes(parts))
            a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
            begin = int(ends[a - 1]) if a else begin
            out = parts[a:b]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, first_rule: int = 1 << 16,
          shard_ids: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the shards of ``docs`` to ``path``. ``first_rule``: above all ids."""
    rows = text_rows(docs, id_col, text_col)
    key_type = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("keys", T.ArrayType(key_type)),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("first_rule", T.LongType()), T.StructField("rules", T.BinaryType()),
        T.StructField("lengths", T.BinaryType()), T.StructField("symbols", T.BinaryType())])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = file_encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, start = TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0
        types = [pa.int32(), pa.int64(), None, pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]

        def flush(key_arrow) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            rules, symbols = compress(ids, first_rule)
            counts = [len(x) // 4 for x in held]
            lengths = rule_lengths(rules, first_rule).astype("<u4")
            row = [part, start, list(keys), counts, first_rule, rules.astype("<u4").tobytes(),
                   lengths.tobytes(), symbols.astype("<u4").tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t or pa.list_(key_arrow)) for v, t in zip(row, types)],
                names=schema.names)

        key_arrow = None
        for batch in slices(batches, 16 << 20):
            key_arrow = batch.schema.field(0).type
            for key, ids in zip(batch.column(0).to_pylist(), encoder.ids(batch.column(1))):
                keys.append(key)
                held.append(ids.tobytes() + end)
                size += len(ids) + 1
                if size >= shard_ids:
                    yield flush(key_arrow)
                    start += size
                    keys, held, size = [], [], 0
        if held:
            yield flush(key_arrow)

    tied = rows.withColumn("order", F.xxhash64("text"))
    dealt = tied.repartitionByRange(parts(docs), "id", "order").sortWithinPartitions("id", "order")
    dealt.select("id", "text").mapInArrow(shards, schema).write.parquet(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start`` counted from the first id of all."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.expr(
        "aggregate(counts, 0L, (a, x) -> a + x)")).alias("total"))
    # one row per range partition
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "part").select(
        (F.col("before") + F.col("start")).alias("start"), "keys", "counts", "first_rule", "rules",
        "lengths", "symbols")


def _shard_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, Shard]]:
    """(start, keys, counts, shard) of rows of ``_shards``, one at a time."""
    for batch in slices(batches, 1):
        start, keys, counts, first, rules, lengths, symbols = (c[0].as_py() for c in batch.columns[:7])
        yield start, keys, np.array(counts, np.int64), Shard(
            np.frombuffer(rules, "<u4").reshape(-1, 2), np.frombuffer(lengths, "<u4"), first,
            np.frombuffer(symbols, "<u4"))


def read(spark: SparkSession, path: str, id_col: str = "doc_id", only: list | None = None,
         checksums: bool = False) -> DataFrame:
    """From the files: <id_col>, start (ids of all documents before it), n_tokens, ids (binary).

    ``only``: decode the documents of these ids alone, each from the symbols that cover it.
    ``checksums``: ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit) in place of ids.
    """
    shards = _shards(spark, path)
    key_type = shards.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, key_type), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_crc32", T.LongType()) if checksums
                           else T.StructField("ids", T.BinaryType())])
    if only is not None:
        asked = F.array(*[F.lit(k).cast(key_type) for k in only])
        shards = shards.filter(F.arrays_overlap("keys", asked))
    wanted = None if only is None else set(only)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, keys, counts, shard in _shard_rows(batches):
            ends = np.cumsum(counts)
            begins = ends - counts
            if wanted is None:
                flat = shard.whole().astype("<u4").tobytes()
                ids = [flat[4 * a:4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
            else:
                some = np.array([k in wanted for k in keys])
                keys, counts = [k for k in keys if k in wanted], counts[some]
                begins, ends = begins[some], ends[some]
                ids = [shard.range(a, b).astype("<u4").tobytes() for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_arrow), pa.array(start + begins, pa.int64()),
                 pa.array(counts, pa.int64()), pa.array(list(map(zlib.crc32, ids)), pa.int64())
                 if checksums else pa.array(ids, pa.binary())], names=schema.names)

    key_arrow = to_arrow_type(key_type)
    return shards.mapInArrow(decode, schema)


def read_range(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(start, ids): ids[start:stop] of all documents' ids, a row a shard that holds some of them."""
    size = F.expr("aggregate(counts, 0L, (a, x) -> a + x)")
    shards = _shards(spark, path).filter((F.col("start") < stop) & (F.col("start") + size > start))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, _, counts, shard in _shard_rows(batches):
            a, b = max(0, start - first), min(int(counts.sum()), stop - first)
            ids = shard.range(a, b).astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([first + a], pa.int64()), pa.array([ids], pa.binary())],
                                             names=["start", "ids"])

    return shards.mapInArrow(decode, "start long, ids binary")


def new_path(spark: SparkSession) -> str:
    """A new folder in shared storage."""
    cut(spark.range(0))  # sets a folder for local sessions without one
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
