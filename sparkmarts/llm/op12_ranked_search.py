"""Ranked lexical search with hashed max-sketches.

Method: a document's terms are each hashed to two coordinates of a sketch, and a coordinate keeps the
largest impact (saturated term frequency, an integer) of its terms. The sketch grows with the
document's number of different terms, so that long documents keep tight bounds. A batch of queries
looks its terms up in all sketches of a slice at once: weight times the smaller of a term's two
coordinates, summed, can't be below a document's score. Each query then rescores documents exactly in descending order of that bound, until
the bound falls below its k-th best score. A task keeps its k-th scores from slice to slice, so later
slices are mostly passed over; the tasks' best rows are ranked per query in two steps.

Counts (documents, lengths, document frequencies of the queries' terms) come from all documents. The
queries are dealt into blocks of bounded text; each block is broadcast and read against all documents.

Defined cases: terms are the maximal runs of ASCII letters, digits and characters beyond ASCII, only
A-Z lower-cased; null and empty texts have none, and no result; whole texts count, however long;
repeated rows are ranked each, rows without id after others of their score, and queries that share an
id each get their own ranks; equal scores by ascending doc_id; without documents or queries there are
no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkmarts.llm.common import cut, slices, text_rows
from sparkmarts.llm.vectors import NO_ID, kth

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("no_id", pa.bool_()), ("score", pa.int64())])


def terms(text: str) -> list[bytes]:
    """The terms of a text as UTF-8; ``lower`` of bytes changes A-Z only."""
    return TERM.findall(text.encode("utf-8", "surrogatepass").lower())


def hashed(found: Iterable[bytes]) -> np.ndarray:
    return np.array([zlib.crc32(t) for t in found], np.uint64)


def coordinates(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two coordinates a hash; ``width`` is a power of two."""
    mixed = hashes * np.uint64(0x9E3779B97F4A7C15)
    mask = np.uint64(width - 1)
    return (mixed >> np.uint64(16) & mask).astype(np.int64), (mixed >> np.uint64(40) & mask).astype(np.int64)


def corpus_counts(texts: DataFrame, asked: set[bytes]) -> tuple[int, int, dict[bytes, int]]:
    """Documents with a term, all terms, and how many documents hold each of ``asked``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents, length, holding = 0, 0, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = terms(text)
                documents += bool(found)
                length += len(found)
                holding.update(asked.intersection(found))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, None, *holding], pa.binary()),
             pa.array([documents, length, *holding.values()], pa.int64()),
             pa.array(["documents", "length", *["term"] * len(holding)])], names=["term", "n", "kind"])

    sums = texts.select("text").mapInArrow(count, "term binary, n long, kind string").groupBy(
        "kind", "term").agg(F.sum("n").alias("n"))
    documents = length = 0
    holding = {}
    for kind, term, n in sums.collect():  # one row a term of a block of queries
        if kind == "term":
            holding[bytes(term)] = n
        elif kind == "documents":
            documents = n
        else:
            length = n
    return documents, length, holding


class Block:
    """Queries as weighted terms, with what their scores need of the corpus."""

    def __init__(self, queries: dict[int, Counter], counts: tuple[int, int, dict[bytes, int]]):
        self.documents, self.length, holding = counts
        self.names = list(queries)
        weight = {t: math.floor(1000 * math.log((2 * self.documents + 2) / (2 * n + 1)))
                  for t, n in holding.items()}
        self.queries = [[(t, n * weight[t]) for t, n in q.items() if weight.get(t)] for q in queries.values()]
        self.hashes = hashed(t for q in self.queries for t, _ in q)
        self.weights = np.array([float(w) for q in self.queries for _, w in q])
        sizes = np.array([len(q) for q in self.queries], int)
        self.asked = np.flatnonzero(sizes)  # queries with a term of the corpus
        self.starts = (np.cumsum(sizes) - sizes)[self.asked]

    def look_up(self, sketch: np.ndarray, step: int = 64) -> np.ndarray:
        """(rows, queries): weights times the coordinates of the queries' terms, summed."""
        out = np.zeros((len(sketch), len(self.names)))
        one, two = coordinates(self.hashes, sketch.shape[1])
        if len(one):
            for row in range(0, len(sketch), step):
                some = sketch[row:row + step]
                some = np.minimum(some.take(one, axis=1), some.take(two, axis=1)) * self.weights
                out[row:row + step, self.asked] = np.add.reduceat(some, self.starts, axis=1)
        return out

    def impacts(self, frequency: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Saturated frequencies of terms in documents of ``length`` terms."""
        norm = 75 + 25 * length * self.documents // self.length
        return 1_000_000_000 * frequency // (1000 * frequency + 12 * norm)


class Slice:
    """Some documents: their term counts and sketches by width."""

    def __init__(self, texts: list[str], block: Block):
        self.block = block
        self.counts = [Counter(terms(t)) for t in texts]
        distinct = np.array([len(c) for c in self.counts])
        self.lengths = np.array([sum(c.values()) for c in self.counts], np.int64)
        hashes = hashed(t for c in self.counts for t in c)
        frequency = np.array([n for c in self.counts for n in c.values()], np.int64)
        of = np.repeat(np.arange(len(texts)), distinct)
        impact = block.impacts(frequency, self.lengths[of]) if len(of) else frequency
        # at least eight coordinates a different term; powers of two
        power = np.where(distinct > 0, np.ceil(np.log2(np.maximum(distinct, 4) * 8)).astype(int), 0)
        self.sketches = []
        for width in np.unique(power[power > 0]):
            rows = np.flatnonzero(power == width)
            place = np.full(len(texts), -1)
            place[rows] = np.arange(len(rows))
            mine = power[of] == width
            sketch = np.zeros((len(rows), 1 << width), np.int32)
            for at in coordinates(hashes[mine], 1 << width):
                np.maximum.at(sketch, (place[of[mine]], at), impact[mine].astype(np.int32))
            self.sketches.append((rows, sketch))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents, a row of bounds for each): what no query's score can exceed.

        Sums of products of whole numbers below 2**53 are exact; beyond, a margin covers rounding.
        """
        rows = [r for r, _ in self.sketches]
        found = [self.block.look_up(s) for _, s in self.sketches]
        if not rows:
            return np.zeros(0, int), np.zeros((0, len(self.block.names)))
        best = np.concatenate(found)
        return np.concatenate(rows), np.where(best < 2.0**53, best, best * (1 + 1e-9))

    def score(self, row: int, query: list[tuple[bytes, int]]) -> int:
        counts = self.counts[row]
        norm = 12 * (75 + 25 * int(self.lengths[row]) * self.block.documents // self.block.length)
        total = 0
        for term, weight in query:
            n = counts.get(term)
            if n:
                total += weight * (1_000_000_000 * n // (1000 * n + norm))
        return total


class Best:
    """A query's k best documents so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, []  # (-score, id, no_id)

    @property
    def least(self) -> int:
        """A score that further documents must reach."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def take(self, found: list[tuple[int, int, bool]]) -> None:
        self.rows = sorted(self.rows + found)[:self.k]


def search_slice(part: Slice, ids: np.ndarray, no_id: np.ndarray, best: list[Best], step: int = 32) -> int:
    """Take the slice's documents into ``best``; returns how many were scored."""
    rows, bounds = part.bounds()
    scored = 0
    for column, (query, held) in enumerate(zip(part.block.queries, best)):
        bound = bounds[:, column]
        left = np.flatnonzero(bound >= held.least)
        while len(left):
            # the highest bounds first, a few at a time
            some = left[bound[left] >= kth(bound[left], step)] if len(left) > step else left
            found = []
            for at in some:
                row = rows[at]
                score = part.score(row, query)
                if score >= held.least:
                    found.append((-score, int(ids[row]), bool(no_id[row])))
            scored += len(some)
            held.take(found)
            rest = bound[left] < bound[some].min()
            left = left[rest & (bound[left] >= held.least)]
    return scored


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = 8 << 20,
                  slice_bytes: int = 2 << 20, salts: int = 16, id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
                  ) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0."""
    texts = text_rows(docs, id_col, text_col).select(
        F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"), F.col("id").isNull().alias("no_id"),
        "text")
    asked = cut(items.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item_id"),
                             F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    own_block = F.pmod(F.xxhash64("query"), F.lit(blocks))
    found = None
    for number in range(blocks):
        rows = asked.filter(own_block == number).select("query", "text").collect()  # about block_bytes
        queries = {r["query"]: Counter(terms(r["text"])) for r in rows}
        part = _search_block(texts, queries, k, slice_bytes)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), "id", "no_id"]
    for by in (["query", F.pmod(F.xxhash64("id"), F.lit(salts))], ["query"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        found = found.filter(F.col("rank") <= k)
    return found.join(asked.select("query", "item_id"), "query").select(
        "item_id", "rank", F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "score")


def _search_block(texts: DataFrame, queries: dict[int, Counter], k: int, slice_bytes: int) -> DataFrame:
    counts = corpus_counts(texts, set().union(*queries.values()))
    shared = texts.sparkSession.sparkContext.broadcast((queries, counts))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(*shared.value)
        if not block.length:
            return
        best = [Best(k) for _ in block.names]
        for batch in slices(batches, slice_bytes):
            part = Slice(batch.column(2).to_pylist(), block)
            search_slice(part, batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False),
                         best)
        for name, held in zip(block.names, best):
            if held.rows:
                score, ids, no_id = zip(*held.rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(no_id),
                     pa.array([-s for s in score], pa.int64())], schema=FOUND)

    return texts.mapInArrow(search, "query long, id long, no_id boolean, score long")
