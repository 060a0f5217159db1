"""Secret scan: fixed patterns, and guess costs of values in credential contexts.

Method: base patterns find assignments, access keys and hex strings. Values that stand in a
credential context (a key word, a separator, a value) are also segmented at least cost into
dictionary words, dates, repeats, keyboard walks and brute-force spans; a value that would take
``min_bits`` bits of guesses or more is a span of kind ``guess``.

Dictionary words and their ranks come from a public vocabulary file (a parameter): the letters of
its tokens, in order of id. Costs are in bits: log2 of the number of guesses a segment takes, plus
one bit a segment.

Defined cases: null and empty texts have no spans; each row is scanned alone and whole, so long
texts, ties, repeated rows and empty tables need no rule; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmarts.llm.common import Memo, slices, text_rows

#: The base patterns, in the order of their kinds, and the least lengths.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|"""
    r"""private[_-]?key|credentials?|bearer|auth(?:orization)?)["']?[\x20\t]*(?::=|=>|[:=])"""
    r"""[\x20\t]*(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;<>]+))""")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])(?!\d)"
                  r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
PLACE = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}
NEAR = {(a, b) for a, (r, k) in PLACE.items() for b, (s, m) in PLACE.items()
        if a != b and abs(r - s) <= 1 and abs(k - m) <= 1}
DATE_BITS, YEAR_BITS, WALK_BITS, TURN_BITS = math.log2(365 * 200), math.log2(200), 6.0, 3.0
LONGEST_WORD = 20


class GuessCost:
    """Least bits of guesses over all segmentations of a value."""

    def __init__(self, words: dict[str, int]):
        self.words = words
        self.bits = Memo(self._bits, 50_000)

    @classmethod
    def load(cls, path: str) -> GuessCost:
        """Words of a rank file: tokens of three letters and more, the earliest rank of each."""
        words: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore").strip().lower()
                    if len(word) >= 3 and word.isalpha():
                        words.setdefault(word, len(words) + 1)
        return cls(words)

    @staticmethod
    def brute(char: str) -> float:
        """Bits of a character on its own, by its class."""
        if char.isdigit():
            return math.log2(10)
        if char.isascii() and char.isalpha():
            return math.log2(52)
        return math.log2(95) if char.isascii() else 16.0

    def _bits(self, value: str) -> float:
        n, low = len(value), value.lower()
        best = [0.0] + [math.inf] * n  # least cost of each prefix
        brute = [0.0] + [math.inf] * n  # of those that end in a brute-force span
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: (start, bits)
        for m in DATE.finditer(value):
            ends[m.end()].append((m.start(), YEAR_BITS if len(m[0]) == 4 else DATE_BITS))
        at = 0
        while at < n - 1:  # keyboard walks, each as long as it goes
            stop, turns, way = at + 1, 0, None
            while stop < n and (low[stop - 1], low[stop]) in NEAR:
                (r, k), (s, m) = PLACE[low[stop - 1]], PLACE[low[stop]]
                turns, way, stop = turns + ((s - r, m - k) != way), (s - r, m - k), stop + 1
            if stop - at >= 3:
                ends[stop].append((at, WALK_BITS + TURN_BITS * turns + math.log2(stop - at)))
            at = max(stop - 1, at + 1)
        for period in range(1, min(16, n // 2) + 1):  # repeats, each as long as it goes
            at = 0
            while at + period < n:
                stop = at + period
                while stop < n and value[stop] == value[stop - period]:
                    stop += 1
                count = (stop - at) // period
                if count >= 2 and stop - at >= 3:
                    unit = sum(map(self.brute, value[at:at + period]))
                    ends[at + count * period].append((at, unit + math.log2(count)))
                at = max(at + 1, stop - period + 1)
        for end in range(1, n + 1):
            step = self.brute(value[end - 1])
            brute[end] = min(brute[end - 1] if end > 1 else math.inf, best[end - 1] + 1) + step
            best[end] = brute[end]
            for start in range(max(0, end - LONGEST_WORD), end - 2):
                rank = self.words.get(low[start:end])
                if rank:
                    upper = sum(c.isupper() for c in value[start:end])
                    bits = math.log2(rank + 1) + 1 + (
                        0 if not upper else 1 if upper == end - start or (
                            upper == 1 and value[start].isupper()) else end - start)
                    best[end] = min(best[end], best[start] + bits)
            for start, bits in ends[end]:
                best[end] = min(best[end], best[start] + bits + 1)
        return best[n]

    def __call__(self, value: str) -> float:
        return self.bits[value]


def spans(text: str, cost: GuessCost, min_bits: float) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans in code points, by start, then kind."""
    out = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_ASSIGN:
            out.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CONTEXT.finditer(text):
        if cost(m[m.lastindex]) >= min_bits:
            out.append((m.start(m.lastindex), 3, m.end(m.lastindex)))
    return sorted(out)


_COSTS: dict[str, GuessCost] = {}


def scan(docs: DataFrame, words_path: str, min_bits: float = 40.0, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """<id_col>, spans array<struct<kind, start, end>> of each whole text, by start, then kind."""
    rows = text_rows(docs, id_col, text_col)
    span = T.StructType([T.StructField("kind", T.StringType()),
                         T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType),
                           T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if words_path not in _COSTS:
            _COSTS[words_path] = GuessCost.load(words_path)
        cost = _COSTS[words_path]
        for batch in slices(batches, 16 << 20):
            found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in
                      spans(t, cost, min_bits)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """<id_col>, n_assign, n_access, n_hex, base_sha256, spans (text) of ``scan``'s result."""
    rows = found.select(id_col, "spans")
    schema = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType),
        *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for some in batch.column(1).to_pylist():
                shown = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in some]
                for column, kind in zip(out, KINDS[:3]):
                    column.append(sum(k == kind for k, _ in shown))
                base = ",".join(x for k, x in shown if k != KINDS[3])
                out[3].append(hashlib.sha256(base.encode()).hexdigest())
                out[4].append(",".join(x for _, x in shown))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]),
                 *(pa.array(c, pa.string()) for c in out[3:])], names=schema.names)

    return rows.mapInArrow(run, schema)


def redact(docs: DataFrame, words_path: str, min_bits: float = 40.0, mark: str = "[SECRET]",
           text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` (overlapping ones as one) replaced by ``mark``.

    Rows, other columns and null texts stay as they are.
    """
    names = docs.columns
    at = names.index(text_col)

    def clean(text: str | None, cost: GuessCost) -> str | None:
        found = spans(text, cost, min_bits) if text else []
        out, done = [], 0
        for a, _, b in found:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]]) if found else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if words_path not in _COSTS:
            _COSTS[words_path] = GuessCost.load(words_path)
        for batch in slices(batches, 16 << 20):
            texts = [clean(t, _COSTS[words_path]) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
