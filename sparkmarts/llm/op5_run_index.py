"""Removal of repeated substrings with a run-compressed Burrows-Wheeler index.

Method: a byte goes if a ``width``-byte window that covers it also starts earlier. Every window is
assigned to the k-gram of least hash in it (an anchor), which depends on the window's bytes alone, so
equal windows share their anchor's hash. The windows of one anchor form a span; equal spans are one
class. All windows of a class's later members are repeats. Where an anchor has several classes, the
spans of their first members differ but may share windows: those spans are indexed together. The
index is the Burrows-Wheeler transform of the spans in runs, with the suffix positions at run ends;
the match of a suffix with its predecessor in suffix order is compared at run heads only and follows
in text order for the others (one less a byte); matching statistics of ``width`` and more chain
suffixes to sets of equal windows, of which only the first in document order stays.

Spans meet by hash, so nothing is compared that shares no anchor. Repeats inside a batch are settled
there, before the shuffle; anchors of many classes are split into pairs of blocks. Span equality is by
64-bit hash under a 64-bit anchor hash; windows in the index are compared byte by byte.

Defined cases: null texts are empty; shorter texts have no window; ids are longs, a null one comes
first; rows of one id and one text are copies of one document (equal places in them are one occurrence);
rows of one id and different texts are documents of their own, in order of the texts' hashes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkmarts.llm.common import cut, parts, slices, text_rows
from sparkmarts.llm.graph import FEW_KEYS, in_blocks

GRAM = 32
CHUNK = 1 << 20  # bytes of text hashed at once
SHARD = 400_000  # bytes of spans indexed at once, besides one group
GROUP_SPANS = 1200  # classes of an anchor in a block at most, on average
PLACE_BITS = 20
NO_ID = -(1 << 63)


class Rolling:
    """Hashes of byte ranges from prefix sums, modulo 2**64 with random byte values."""

    def __init__(self, n: int):
        draw = np.random.default_rng(11)
        self.value = draw.integers(0, 2**64, 256, np.uint64)
        base = int(draw.integers(1, 2**62)) * 4 + 1
        inverse = pow(base, -1, 2**64)
        self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n, b, np.uint64)])
                                    for b in (base, inverse))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[:len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.inverse[start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (the first, if several) of each window of ``width`` values."""
    place, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        later = values[step:] < values[:-step]
        values = np.where(later, values[step:], values[:-step])
        place = np.where(later, place[step:], place[:-step])
        size += step
    return place


def spans_of(data: np.ndarray, ends: np.ndarray, rolling: Rolling, width: int
             ) -> tuple[np.ndarray, ...]:
    """(anchor hash, span hash, first window, last window) of all spans of texts ending at ``ends``."""
    none = np.zeros(0, np.uint64)
    if len(data) < width:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    sums = rolling.sums(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = rolling.ranges(sums, at, at + GRAM)
    place = least(grams, width - GRAM + 1)
    sound = np.ones(len(place) + 1, bool)  # windows that cross no end of a text
    for end in ends[:-1].tolist():
        sound[max(0, end - width + 1):end] = False
    window = np.flatnonzero(sound[:len(place)])
    if not len(window):
        return none, none, none.astype(np.int64), none.astype(np.int64)
    anchor = place[window]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (np.diff(window) != 1)]
    first = window[new]
    last = window[np.r_[np.flatnonzero(new)[1:] - 1, len(window) - 1]]
    anchor = anchor[new]
    span = rolling.ranges(sums, first, last + width) ^ mixed(
        ((last - first) << 8 | (anchor - first)).astype(np.uint64))
    return grams[anchor], span, first, last


def repeats(cells: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Rows that equal an earlier one (by ``order``) in all ``cells``, without copies of the first."""
    rank = np.lexsort((*order[::-1], *cells[::-1]))
    later = np.ones(len(rank), bool)
    later[:1] = False
    for c in cells:
        later[1:] &= c[rank[1:]] == c[rank[:-1]]
    head = rank[np.maximum.accumulate(np.where(later, 0, np.arange(len(rank))))]
    copy = np.ones(len(rank), bool)
    for c in order:
        copy &= c[rank] == c[head]
    out = np.zeros(len(rank), bool)
    out[rank[later & ~copy]] = True
    return out


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, doc, variant, text): variant is 0, or a hash of the text where an id has several texts."""
    rows = text_rows(docs, id_col, text_col).withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)))
    own = F.xxhash64("text")
    several = cut(rows.groupBy("doc").agg(F.min(own).alias("low"), F.max(own).alias("high")).filter(
        "low <> high").select("doc", F.lit(True).alias("several")))
    n = several.count()
    if not n:
        return rows.select("id", "doc", F.lit(0).cast("long").alias("variant"), "text")
    joined = rows.join(F.broadcast(several) if n <= FEW_KEYS else several, "doc", "left")
    return joined.select("id", "doc", F.when(F.col("several"), own).otherwise(0).alias("variant"), "text")


def span_rows(rows: DataFrame, width: int) -> DataFrame:
    """(k, span, doc, variant, place): k the anchor's hash, place = first window, count - 1 and a flag.

    Flagged rows repeat a row of their batch; they are dealt by place and only pass through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(4 * CHUNK)
        for batch in slices(batches, CHUNK):
            found, held, size = [], [], 0

            def settle(texts: list[tuple[int, int, int, bytes]]) -> None:
                data = np.frombuffer(b"".join(t for *_, t in texts), np.uint8)
                ends = np.cumsum([len(t) for *_, t in texts])
                k, span, first, last = spans_of(data, ends, rolling, width)
                which = np.searchsorted(ends, first, "right")
                doc, variant = (np.array([t[c] for t in texts], np.int64)[which] for c in (0, 1))
                shift = np.array([s - e + len(t) for (*_, s, t), e in zip(texts, ends.tolist())], np.int64)
                found.append((k, span, doc, variant, first + shift[which], last - first))

            for doc, variant, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for at in range(0, max(len(data) - width + 1, 1), 2 * CHUNK):  # windows from here on
                    piece = data[at:at + 2 * CHUNK + width - 1]
                    if held and size + len(piece) > 2 * CHUNK:
                        settle(held)
                        held, size = [], 0
                    held.append((doc, variant, at, piece))
                    size += len(piece)
            if held:
                settle(held)
            k, span, doc, variant, first, more = (np.concatenate(c) for c in zip(*found))
            again = repeats((k, span), (doc, variant, first))
            place = first << 8 | more << 1 | again
            k = np.where(again, mixed((doc ^ first << 32).astype(np.uint64)), k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.view(np.int64)), pa.array(span.view(np.int64)), pa.array(doc), pa.array(variant),
                 pa.array(place.astype(np.int64))], names=["k", "span", "doc", "variant", "place"])

    return rows.select("doc", "variant", "text").mapInArrow(
        run, "k long, span long, doc long, variant long, place long")


def settled(rows: DataFrame) -> DataFrame:
    """(doc, variant, first, more, k): repeated windows (k null), first members of an anchor's classes."""
    schema = "doc long, variant long, first long, more long, k long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def batch_of(cells: list[np.ndarray], null: bool) -> pa.RecordBatch:
            k, _, doc, variant, place = cells
            return pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(variant), pa.array(place >> 8), pa.array(place >> 1 & 127),
                 pa.array(k, mask=np.full(len(k), null))], names=["doc", "variant", "first", "more", "k"])

        def firsts(cells: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
            """First members of classes, and the others at other places."""
            k, span, doc, variant, place = cells
            same = (k[1:] == k[:-1]) & (span[1:] == span[:-1])
            later = np.r_[False, same]
            head = np.maximum.accumulate(np.where(later, 0, np.arange(len(k))))
            copy = later & (doc == doc[head]) & (variant == variant[head]) & (place == place[head])
            return [c[~later] for c in cells], [c[later & ~copy] for c in cells]

        def several(cells: list[np.ndarray]) -> list[np.ndarray]:
            k = cells[0]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            many = np.repeat(np.diff(np.r_[first, len(k)]) > 1, np.diff(np.r_[first, len(k)]))
            return [c[many] for c in cells]

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = [c.to_numpy() for c in batch.columns]
            flag = cells[4] & 1 == 1
            if flag.any():
                yield batch_of([c[flag] for c in cells], True)
                cells = [c[~flag] for c in cells]
            if held is not None:
                cells = [np.concatenate(c) for c in zip(held, cells)]
            if not len(cells[0]):
                continue
            own, gone = firsts(cells)
            if len(gone[0]):
                yield batch_of(gone, True)
            last = int(np.searchsorted(own[0], own[0][-1]))
            ready = several([c[:last] for c in own])
            if len(ready[0]):
                yield batch_of(ready, False)
            held = [c[last:] for c in own]  # first members only
        if held is not None and len(held[0]) > 1:
            yield batch_of(held, False)

    n = parts(rows)
    return rows.repartition(n, "k").sortWithinPartitions(
        "k", "span", "doc", "variant", "place").mapInArrow(run, schema)


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, each with an end of its own.

    rows are suffixes in order; suffixes equal up to their ends are in order of place.
    """

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n, lengths = len(self.data), np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        self.end = np.repeat(ends, lengths)
        starts = np.zeros(n, bool)
        starts[(ends - lengths)[lengths > 0]] = True
        self.places = self._sort(int(lengths.max(initial=1)))
        before = self.data[self.places - 1]
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | starts[self.places[1:]] | starts[self.places[:-1]]
        #: of each run: its row, its symbol, and the places at its first row and the run end before it
        self.heads = np.flatnonzero(head)
        self.symbols = before[self.heads]
        self.first_places = self.places[self.heads]
        self.end_places = self.places[self.heads - 1]

    def _sort(self, longest: int) -> np.ndarray:
        n = len(self.data)
        if n >= (1 << PLACE_BITS) - 1:
            raise ValueError("too many bytes for one index")
        at, mask = np.arange(n), (1 << PLACE_BITS) - 1
        left = self.end - at
        symbol = np.r_[self.data.astype(np.int64) + 1, np.zeros(4, np.int64)]
        key = np.zeros(n, np.int64)
        for i in range(4):
            key = key << 9 | np.where(left > i, symbol[i:n + i], 0)
        rank, size = np.zeros(n, np.int64), 4
        while True:
            rows = np.sort(key << PLACE_BITS | at)
            order = rows & mask
            new = np.r_[False, np.diff(rows >> PLACE_BITS) != 0]
            number = np.cumsum(new)
            if size >= longest or number[-1] == n - 1:
                return order
            rank[order] = number
            after = np.where(left > size, rank[np.minimum(at + size, n - 1)] + 1, 0)
            key = rank << PLACE_BITS | after
            size *= 2

    def statistics(self) -> np.ndarray:
        """Of the suffix at each place: how long its match with the row before is."""
        n = len(self.data)
        a, b = self.first_places, self.end_places
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        if len(most):
            most[0] = 0  # the first row has none before it
        match, live, columns = np.zeros(len(a), np.int64), np.arange(len(a)), np.arange(16)
        while len(live):
            x, y = a[live] + match[live], b[live] + match[live]
            same = (self.data[np.minimum(x[:, None] + columns, n - 1)]
                    == self.data[np.minimum(y[:, None] + columns, n - 1)])
            step = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            match[live] = np.minimum(match[live] + step, most[live])
            live = live[(step == 16) & (match[live] < most[live])]
        known = np.full(n, -1, np.int64)
        known[a] = a
        source = np.maximum.accumulate(known)
        value = np.zeros(n, np.int64)
        value[a] = match
        return value[source] + source - np.arange(n)  # one less with each byte from a run head

    def repeated(self, width: int) -> np.ndarray:
        """Places where a window of ``width`` bytes starts that starts at a smaller place too."""
        n = len(self.data)
        out = np.zeros(n, bool)
        if not n:
            return out
        chained = self.statistics()[self.places] >= width
        first = np.flatnonzero(~chained)
        smallest = np.repeat(np.minimum.reduceat(self.places, first), np.diff(np.r_[first, n]))
        out[self.places] = (self.places != smallest) & (self.end[self.places] - self.places >= width)
        return out


def shared_windows(firsts: DataFrame, rows: DataFrame, width: int, group_spans: int) -> DataFrame:
    """(doc, variant, first, more): windows of the spans of ``firsts`` that an earlier span of the anchor has."""
    dealt = in_blocks(firsts, ["k"], F.xxhash64("doc", "variant", "first"), group_spans).drop("own")
    group = ["k", "block_a", "block_b"]
    wanted = firsts.groupBy("doc", "variant").agg(F.collect_list(F.struct("first", "more")).alias("spans"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            doc, variants, first, held = [], [], [], []
            for key, variant, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode()
                for s in spans:
                    doc.append(key)
                    variants.append(variant)
                    first.append(s["first"])
                    held.append(data[s["first"]:s["first"] + s["more"] + width])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in (doc, variants, first)), pa.array(held, pa.binary())],
                names=["doc", "variant", "first", "held"])

    place = ["doc", "variant", "first"]
    texts = rows.join(wanted, ["doc", "variant"]).select("doc", "variant", "text", "spans").mapInArrow(
        extract, "doc long, variant long, first long, held binary").dropDuplicates(place)
    full = dealt.join(texts, place).select(*group, *place, "held")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, variant, first, held, size, current = [], [], [], [], 0, None

        def settle() -> pa.RecordBatch:
            lengths = np.array([len(h) for h in held], np.int64)
            starts = np.cumsum(lengths) - lengths
            hit = np.flatnonzero(RunIndex(held).repeated(width))
            which = np.searchsorted(starts, hit, "right") - 1
            new = np.r_[True, (np.diff(hit) != 1) | (np.diff(which) != 0)][:len(hit)]
            head = np.flatnonzero(new)
            more = np.diff(np.r_[head, len(hit)]) - 1
            at = which[head]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(doc, np.int64)[at]), pa.array(np.array(variant, np.int64)[at]),
                 pa.array(np.array(first, np.int64)[at] + hit[head] - starts[at]), pa.array(more)],
                names=["doc", "variant", "first", "more"])

        for batch in batches:
            for *key, d, v, f, h in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    # block pairs of one anchor hold the same spans, so they get indexes of their own
                    if held and (size >= SHARD or key[0] == current[0]):
                        yield settle()
                        doc, variant, first, held, size = [], [], [], [], 0
                    current = key
                doc.append(d), variant.append(v), first.append(f), held.append(h)
                size += len(h)
        if held:
            yield settle()

    return full.repartition(parts(rows), *group).sortWithinPartitions(*group, *place).mapInArrow(
        index, "doc long, variant long, first long, more long")


def remove_repeats(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text",
                   group_spans: int = GROUP_SPANS) -> DataFrame:
    """<id_col>, n_bytes, n_removed, n_spans, kept (binary: the bytes left) of each text."""
    if not GRAM < width < GRAM + 128:
        raise ValueError(f"width must be above {GRAM} and below {GRAM + 128}")
    rows = numbered(docs, id_col, text_col)
    found = cut(settled(span_rows(rows, width)))
    later = shared_windows(found.filter("k is not null"), rows, width, group_spans)
    gone = found.filter("k is null").select("doc", "variant", "first", "more").unionByName(later)
    per_doc = gone.groupBy("doc", "variant").agg(F.collect_list(F.struct("first", "more")).alias("runs"))
    joined = rows.join(per_doc, ["doc", "variant"], "left")
    schema = T.StructType([
        T.StructField(id_col, rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType())])

    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16 << 20):
            counts, kept = [], []
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data, out, spans, removed, done = text.encode(), [], 0, 0, 0
                for r in sorted((r["first"], r["first"] + r["more"] + width) for r in runs or ()):
                    start, stop = r[0], min(r[1], len(data))
                    if start > done or not spans:
                        out.append(data[done:start])
                        removed += max(stop - start, 0)
                        spans += 1
                    else:
                        removed += max(stop - done, 0)
                    done = max(done, stop)
                counts.append((len(data), removed, spans))
                kept.append(b"".join([*out, data[done:]]))
            numbers = list(zip(*counts)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in numbers), pa.array(kept, pa.binary())],
                names=schema.names)

    return joined.select("id", "text", "runs").mapInArrow(strike, schema)


def digest(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """<id_col>, n_bytes, n_removed, n_spans, kept_sha256 of ``remove_repeats``' result."""
    return kept.select(id_col, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
