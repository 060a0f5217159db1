"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Method: for every byte prefix of a word, exactly one vocabulary token can end the prefix's BPE
encoding. ``PrefixTable`` stores that last token per prefix; following it backwards gives the ids.
A token may follow a prefix if the prefix's last token and it form a stable pair: BPE of their bytes
makes no merge across their border. The table makes appends exact (old entries stay) and lets an
edit re-encode only from the edit until entries agree with the old ones again. Each different word of
a slice of texts is encoded once, in sorted order: one table serves all, of which the prefix shared with
the word before stays and the rest is appended.

Defined cases: a null or empty text has no ids and decodes to nothing; other columns are not read;
each row is encoded alone, so ties, repeated rows and an empty table need no rule.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from os.path import commonprefix
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkmarts.llm.bpe_text import BEFORE, PART, UNSAFE, encode_parts
from sparkmarts.llm.common import Memo, no_collection, slices, text_rows

NEVER = 1 << 62
# bytes of texts and of ids; a task that encodes and decodes has two Python workers, each of which does both in turn
ENCODED_AT_ONCE, DECODED_AT_ONCE = 4 << 20, 1 << 20


class Vocabulary:
    """Ranks of byte strings (also their ids), with each token's last merge and border checks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # longest token by its last three bytes (fewer: the token itself)
        self.longest: dict[bytes, int] = {}
        for token in ranks:
            end = token[-3:]
            self.longest[end] = max(self.longest.get(end, 0), len(token))
        self.reach = max(self.longest.values(), default=0)
        self.spines = Memo(self._spine, 100_000)
        self.stable = Memo(self._stable, 250_000)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The parts of ``token`` after all merges of a rank less than ``below``."""
        got = [token[i:i + 1] for i in range(len(token))]
        while len(got) > 1:
            rank, at = min((self.ranks.get(got[i] + got[i + 1], NEVER), i)
                           for i in range(len(got) - 1))
            if rank >= below:
                break
            got[at:at + 2] = [got[at] + got[at + 1]]
        return got

    def _spine(self, key: tuple[bytes, int]) -> tuple[tuple[bytes, int], ...] | None:
        """Parts on one border of a token (side 0: left, -1: right) from the token down to a byte.

        Each with the rank of the merge that ends it. None if BPE never makes the token.
        """
        token, side = key
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if len(token) == 1:
                return tuple(out)
            until = self.ranks[token]
            halves = self._merged(token, until)
            if len(halves) != 2:
                return None
            token = halves[side]

    def _stable(self, pair: int) -> bool:
        """Whether BPE of both tokens' bytes leaves the two apart; the pair is left rank << 32 | right.

        Ranks grow along a derivation, so merges happen in order of rank, equal ranks from the left.
        A merge across the border needs its two parts to exist at its rank: the left one must not
        have been used at the same rank already, as that merge comes first.
        """
        left = self.spines[self.bytes_of[pair >> 32], -1]
        right = self.spines[self.bytes_of[pair & 0xFFFFFFFF], 0]
        if left is None or right is None:
            return False
        for x, x_until in left:
            for y, y_until in right:
                rank = self.ranks.get(x + y)
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True


class PrefixTable:
    """The last token (by rank) of each byte prefix's encoding; data[:i + 1] ends with token last[i]."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _token(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        rank_of, stable = v.ranks.get, v.stable
        # tokens that end here: up to the longest with these last bytes, or of one or two bytes
        reach = v.longest.get(data[end - 3:end], 2) if end > 2 else 2
        for start in range(end - reach if reach < end else 0, end):
            rank = rank_of(data[start:end])
            if rank is not None and (stable[last[start - 1] << 32 | rank] if start else
                                     v.spines[data[:end], 0] is not None):
                return rank
        raise ValueError("a byte is missing in the vocabulary")

    def append(self, more: bytes) -> None:
        at = len(self.data)
        self.data += more
        for end in range(at + 1, len(self.data) + 1):
            self.last.append(self._token(end))

    def cut(self, size: int) -> None:
        """Keeps the first ``size`` bytes."""
        self.data = self.data[:size]
        del self.last[size:]

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Puts ``new`` in place of data[start:stop]; returns how many entries were computed."""
        tail, old = self.data[stop:], self.last[stop:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(new)
        self.data += tail
        same, need = 0, self.vocabulary.reach
        for k in range(len(tail)):
            if same >= need:  # every later entry depends on agreeing entries and equal bytes only
                self.last += old[k:]
                return len(new) + k
            token = self._token(len(self.last) + 1)
            self.last.append(token)
            # an entry that reaches back to or before the edit is not known to agree
            same = same + 1 if token == old[k] and k >= len(self.vocabulary.bytes_of[token]) else 0
        return len(new) + len(tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.last)
        while end:
            rank = self.last[end - 1]
            out.append(rank)
            end -= len(self.vocabulary.bytes_of[rank])
        return out[::-1]


class Codec:
    """Encodes and decodes texts: each match of ``pattern`` on its own, no special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, kept: int = 300_000):
        self.vocabulary, self.kept = vocabulary, kept
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}  # ids of parts of the slices before

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece, by one table that goes from piece to piece in order of bytes."""
        out, ranks = {}, self.vocabulary.ranks
        table, before = PrefixTable(self.vocabulary), b""
        for data, piece in sorted((p.encode(), p) for p in pieces):
            whole = ranks.get(data)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
                continue
            same = len(commonprefix((before, data)))
            table.cut(same)
            table.append(data[same:])
            ids = table.ids()
            out[piece], before = pack(f"<{len(ids)}I", *ids), data
        return out

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        new = [p for p in parts if p not in known]
        found = list(map(self.pattern.findall, new))
        ids_of = self._pieces({piece for some in found for piece in some})
        if len(known) + len(new) > self.kept:
            # those of this slice stay
            known = self.known = {p: known[p] for p in parts if p in known}
        for part, some in zip(new, found):
            known[part] = ids_of[some[0]] if len(some) == 1 else b"".join([ids_of[x] for x in some])
        ids = [known[p] for p in parts]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        return np.frombuffer(b"".join(ids), "<u4"), ends

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        own = texts.to_pylist()
        safe = np.array([not (UNSAFE.search(t) or PART in t or BEFORE in t) for t in own], bool)
        with no_collection():
            by_parts = iter(encode_parts(texts.filter(pa.array(safe)), self._parts) if safe.any() else ())
            return [(next(by_parts) if cut else self._parts([text])[0]).tobytes()
                    for text, cut in zip(own, safe)]

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec a Python worker, so that its memos last."""
    if (ranks_path, pattern) not in _CODECS:
        _CODECS[ranks_path, pattern] = Codec(Vocabulary.load(ranks_path), pattern)
    return _CODECS[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """<id_col>, ids (binary, little-endian unsigned 32-bit) of each whole text."""
    rows = text_rows(docs, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType),
                           T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in slices(batches, ENCODED_AT_ONCE):
            ids = own.encode_all(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())],
                                             names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
                     ids_col: str = "ids", texts: bool = True) -> DataFrame:
    """<id_col>, n_tokens, ids_sha256, decoded_sha256 and decoded (binary) of each row's ids.

    Without ``texts`` the decoded bytes stay in their task.
    """
    rows = encoded.select(id_col, ids_col)
    schema = T.StructType([
        T.StructField(id_col, rows.schema[id_col].dataType),
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("decoded", T.BinaryType())] if texts else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in slices(batches, DECODED_AT_ONCE):
            ids = [x or b"" for x in batch.column(1).to_pylist()]
            decoded = [own.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                *([pa.array(decoded, pa.binary())] if texts else []),
            ], names=schema.names)

    return rows.mapInArrow(run, schema)
