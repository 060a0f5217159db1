"""Line dedup: exact classes of lines, then a segment-partition edit join between classes.

Method: a line (between newlines, without outer white space) is removed if an earlier line, by
(doc id, line number), equals it or is within ``max_edits`` edits of it. Equal lines are one class by
a 128-bit hash. A line of ``min_chars`` characters or more is split into max_edits + 1 segments; if
another line is within that many edits, one segment stands in it unchanged, near its old place. So
each line is indexed under (length, segment number, segment) and probes the substrings that segments
of lines of its length, or up to max_edits shorter, can have moved to. Lines that meet under a key
are verified by a banded bit-parallel edit distance: bit x of word d tells whether diagonal x of the
band is reached with d errors. Keys of many lines are split into pairs of blocks.

Defined cases: lines of white space are no lines: they never match and stay; shorter lines match
exactly only; null texts stay null and have no lines; rows that share a doc id count as one document
(repeated rows keep the same lines), and a null id counts as the first document; an empty table
gives no rows; extra columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmarts.llm.common import cut, parts, slices
from sparkmarts.llm.graph import in_blocks

BLANK = " \t\r\x0b\x0c"
SEED = 42  # of Spark's xxhash64
FEW_LINES = 500_000  # candidate lines that are broadcast at most (16 bytes each)
INDEX, PROBE = 1, 2
BLANK_LINE, KEPT, REMOVED = 0, 1, 2


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of ``count`` even segments; the last ones take what is left over."""
    size, longer = divmod(length, count)
    out, at = [], 0
    for k in range(count):
        n = size + (k >= count - longer)
        out.append((at, n))
        at += n
    return out


def keys_of(line: str, max_edits: int, min_chars: int) -> dict[int, int]:
    """Keys of a line with their roles (index, probe or both)."""
    n, out = len(line), {}
    for length in range(max(min_chars, n - max_edits), n + 1):
        moved = n - length
        for k, (start, size) in enumerate(segments(length, max_edits + 1)):
            # errors before the segment: k at most if it is the first unchanged one; after it: the rest
            low = max(start - k, start + moved - (max_edits - k), 0)
            high = min(start + k, start + moved + (max_edits - k), n - size)
            for at in range(low, high + 1):
                key = xxhash.xxh64_intdigest(line[at:at + size].encode(), length * (max_edits + 1) + k)
                role = INDEX | PROBE if not moved and at == start else PROBE
                out[key] = out.get(key, 0) | role
    return out


def within(a: str, b: str, max_edits: int) -> bool:
    """Whether the edit distance is at most ``max_edits``."""
    m, n = len(a), len(b)
    if abs(m - n) > max_edits:
        return False
    if a == b:
        return True
    start, step = 0, 64  # common beginning
    while a[start:start + step] == b[start:start + step] and start + step <= min(m, n):
        start += step
    while start < min(m, n) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    m, n = len(a), len(b)
    band = (1 << 2 * max_edits + 1) - 1
    # bit x of reached[d]: a[:j + x - max_edits] becomes b[:j] with d errors
    reached = [((1 << d + 1) - 1) << max_edits for d in range(max_edits + 1)]
    for j, char in enumerate(b):
        same = 0
        for x in range(2 * max_edits + 1):
            i = j + x - max_edits
            if 0 <= i < m and a[i] == char:
                same |= 1 << x
        before = reached[0]
        reached[0] = before & same
        for d in range(1, max_edits + 1):
            now = reached[d]
            reached[d] = (now & same | before | before >> 1 | reached[d - 1] << 1) & band
            before = now
        if not reached[max_edits]:
            return False
    return bool(reached[max_edits] >> (m - n + max_edits) & 1)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, content, h1, h2 of each line that isn't blank."""
    split = docs.select(F.col(id_col).alias("id"), F.posexplode(
        F.split(F.col(text_col), "\n", -1)).alias("line_no", "line"))
    trimmed = split.select("id", "line_no", F.btrim("line", F.lit(BLANK)).alias("content"))
    return trimmed.filter("content <> ''").select(
        "*", F.xxhash64("content").alias("h1"), F.xxhash64(F.lit(7), "content").alias("h2"))


def key_rows(docs: DataFrame, text_col: str, max_edits: int, min_chars: int) -> DataFrame:
    """(key, line, role) of all lines long enough; line is h1. Repeats in a batch come once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            columns: tuple[list, list, list] = ([], [], [])
            lines = {c for t in batch.column(0).to_pylist() if t for x in t.split("\n")
                     if len(c := x.strip(BLANK)) >= min_chars}
            for line in lines:
                found = keys_of(line, max_edits, min_chars)
                columns[0].extend(found)
                columns[1].extend([xxhash.xxh64_intdigest(line.encode(), SEED)] * len(found))
                columns[2].extend(found.values())
            key, own = (np.array(c, np.uint64).view(np.int64) for c in columns[:2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(own), pa.array(columns[2], pa.int8())],
                names=["key", "line", "role"])

    return docs.select(text_col).mapInArrow(run, "key long, line long, role byte")


def meeting(rows: DataFrame) -> DataFrame:
    """The distinct rows of keys under which different lines meet, one of them indexed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            key = table.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            yield from filtered(table.slice(0, last))
            held = table.slice(last)
            if held.num_rows > 1 << 16:  # a frequent key: its repeats are dropped on the way
                held = distinct(held)
        if held is not None:
            yield from filtered(held)

    def distinct(table: pa.Table) -> pa.Table:
        cells = [table.column(c).to_numpy() for c in ("key", "line", "role")]
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in cells:
            new[1:] |= c[1:] != c[:-1]
        return table.filter(pa.array(new))

    def filtered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if table.num_rows < 2:
            return
        table = distinct(table)
        key, line, role = (table.column(c).to_numpy() for c in ("key", "line", "role"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.maximum.reduceat(line, first) != np.minimum.reduceat(line, first)
        roles = np.bitwise_or.reduceat(role, first)
        keep = np.repeat(several & (roles == INDEX | PROBE), np.diff(np.r_[first, len(key)]))
        if keep.any():
            yield from table.filter(pa.array(keep)).combine_chunks().to_batches()

    n = parts(rows)
    return rows.repartition(n, "key").sortWithinPartitions("key", "line", "role").mapInArrow(
        run, rows.schema)


def near_links(docs: DataFrame, max_edits: int, min_chars: int, id_col: str,
               text_col: str, block_rows: int = 512) -> DataFrame:
    """(h1, h2, near_h1, near_h2): a class and an earlier one within ``max_edits``.

    Of the earlier classes that meet a class under a key, the first in order that is within reach.
    """
    found = cut(meeting(key_rows(docs, text_col, max_edits, min_chars)))
    wanted = cut(found.select(F.col("line").alias("h1")).distinct())
    few = wanted.count() <= FEW_LINES
    texts = line_rows(docs, id_col, text_col).join(F.broadcast(wanted) if few else wanted, "h1")
    texts = cut(texts.groupBy("h1", "h2").agg(F.first("content").alias("content"),
                                              F.min(F.struct("id", "line_no")).alias("place")))
    dealt = in_blocks(found, ["key"], F.xxhash64("line"), block_rows)
    group = ["key", "block_a", "block_b"]
    full = dealt.join(texts.withColumnRenamed("h1", "line"), "line").select(
        *group, "role", "line", "h2", "place.id", "place.line_no", "content")
    schema = "h1 long, h2 long, near_h1 long, near_h2 long"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            rows = sorted(set(held), key=lambda r: (r[2] is not None, r[2] or 0, r[3], r[0], r[1]))
            by_length: dict[int, list[tuple]] = {}
            for row in rows:  # in order of place: the earlier rows are there already
                line, h2, _, _, role, content = row
                for other in (o for n in range(len(content) - max_edits, len(content) + max_edits + 1)
                              for o in by_length.get(n, ())):
                    longer, shorter = (row, other) if len(content) >= len(other[5]) else (other, row)
                    if len(content) == len(other[5]):
                        met = role & INDEX or other[4] & INDEX
                    else:
                        met = shorter[4] & INDEX and longer[4] & PROBE
                    if met and (line, h2) != other[:2] and within(other[5], content, max_edits):
                        out.append((line, h2, *other[:2]))
                        break
                by_length.setdefault(len(content), []).append(row)

        current = None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (
                *group, "line", "h2", "id", "line_no", "role", "content")))
            for *key, line, h2, doc, number, role, content in rows:
                if key != current:
                    close()
                    held, current = [], key
                held.append((line, h2, doc, number, role, content))
            if len(out) > 50_000:
                yield as_batch(out)
                out = []
        close()
        yield as_batch(out)

    def as_batch(out: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells],
                                          names=["h1", "h2", "near_h1", "near_h2"])

    links = full.repartition(parts(docs), *group).sortWithinPartitions(*group).mapInArrow(verify, schema)
    return cut(links.distinct())


def dedup_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 24, id_col: str = "doc_id",
                text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` without the removed lines, and with ``counts`` n_lines, n_removed (longs) at the end."""
    lines = line_rows(docs, id_col, text_col)
    classes = cut(lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("place")))
    links = near_links(docs, max_edits, min_chars, id_col, text_col)
    near = links.select("h1", "h2").distinct()
    kept = classes.join(near, ["h1", "h2"], "left_anti").groupBy(
        F.col("place.id").alias("kept_id")).agg(F.sort_array(F.collect_set("place.line_no")).alias("kept"))
    # a byte a line up to the last one kept: 1 for those kept, so that a line's is found by its number
    marks = F.transform("kept", lambda number, i: F.concat(
        F.repeat(F.lit("0"), number - F.coalesce(F.get("kept", i - 1), F.lit(-1)) - 1), F.lit("1")))
    kept = kept.select("kept_id", F.array_join(marks, "").cast("binary").alias("marks"))
    names = docs.columns
    # columns by place: theirs and the new ones may have any names
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    joined = own.join(kept, own[f"c{names.index(id_col)}"].eqNullSafe(kept["kept_id"]), "left")
    text = f"c{names.index(text_col)}"
    lines_of = joined.withColumn("lines", F.split(text, "\n", -1))
    states = lines_of.withColumn("states", F.transform("lines", lambda line, i: F.when(
        F.btrim(line, F.lit(BLANK)) == "", BLANK_LINE).when(
        F.substring("marks", i + 1, F.lit(1)) == F.lit(b"1"), KEPT).otherwise(REMOVED)))
    counted = states.select(
        *own.columns, "lines", "states",
        F.coalesce(F.size(F.filter("states", lambda s: s != BLANK_LINE)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.filter("states", lambda s: s == REMOVED)), F.lit(0)).cast("long").alias("n_removed"))
    rest = F.array_join(F.filter("lines", lambda _, i: F.get("states", i) != REMOVED), "\n")
    left = F.when((F.col("n_lines") > F.col("n_removed")) | (F.col("n_lines") == 0), rest).otherwise("")
    rebuilt = counted.withColumn(text, F.when(F.col(text).isNotNull(), left))
    if not counts:
        return rebuilt.select(*own.columns).toDF(*names)
    return rebuilt.select(*own.columns, "n_lines", "n_removed").toDF(*names, "n_lines", "n_removed")


def digest(kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """<id_col>, n_lines, n_removed, kept_chars, kept_sha256 of ``dedup_lines``' result."""
    text = F.coalesce(text_col, F.lit(""))
    return kept.select(id_col, "n_lines", "n_removed", F.length(text).cast("long").alias("kept_chars"),
                       F.sha2(text, 256).alias("kept_sha256"))
