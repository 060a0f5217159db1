"""Byte-level BPE of whole texts, each different part of a slice of texts once.

The pre-tokeniser pattern never matches across a space that follows a non-space character: a match
takes at most one leading space, and runs of white space hold nothing else. A text may therefore be
cut before each such space and the parts encoded apart (``encode_parts``). Texts in which white space
precedes a space are encoded whole.

``FileEncoder`` gives the ids that a tokenizers file gives. BPE by a list of merges equals BPE by the rank
of the joined bytes, as long as a token's two parts come before it: within a span that no merge crosses,
merges up to a rank act as on the span alone, so the pair that meets there is the token's own. Tokens that
BPE never makes of their own bytes are left out, which changes nothing for the same reason. So texts of
characters whose class has been the same in all versions of Unicode go to a rank encoder; any other text,
and any that holds a special token's literal, goes whole to the library that the file is for.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UNSAFE = re.compile(r"[\s\x85] ")
PART, BEFORE = "\x01", "\x02"  # the end of a part; the place before a space


def encode_parts(texts: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]],
                 spaces: bool = True) -> list[np.ndarray]:
    """The ids of each text by its parts; the texts hold neither UNSAFE places nor PART nor BEFORE.

    ``encode``: of a list of different parts, the ids of all of them and the place of each one's end.
    Without ``spaces`` white space only ends parts and is no part of the one after it.
    """
    texts = texts.cast(pa.large_string())
    if spaces:
        split = pc.split_pattern(pc.replace_substring(texts, " ", BEFORE + " "), BEFORE)
    else:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    coded = split.flatten().dictionary_encode()
    flat, ends = encode(coded.dictionary.to_pylist())
    starts, codes = np.r_[0, ends[:-1]], coded.indices.to_numpy()
    sizes = (ends - starts)[codes]
    upto = np.cumsum(sizes)
    source = np.repeat(starts[codes] - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)
    out = flat[source]
    cuts = np.r_[0, upto][split.offsets.to_numpy()].tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:])]


def byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves; the others take the code points from 256 on.
    """
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in own else spare))
        spare += b not in own
    return out


# --- fixed values: how the two kinds of files cut a text into the pieces that BPE sees ---
# --- (the first as its library has it, but that \x01 is a piece of its own and ends a text)
BYTE_LEVEL = r"\x01|'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x01]+|\s+(?![^\s\x01])|\s+"
BYTE_LEVEL_STEPS = (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                           "use_regex": True})
WORD_STEPS = (
    {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {
            "Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
#: Characters of stable classes: ASCII, Latin, general punctuation, basic Cyrillic, Han and Hangul. Each is
#: its own NFC form.
STABLE = "\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u203a\u20ac\u0410-\u044f\u4e00-\u9fa5\uac00-\ud7a3"
OTHER = re.compile(f"[^{STABLE}]")
END = b"\x00"  # stands for the end of a word; texts with it are not of STABLE


def _class(kind: str) -> str:
    """The characters of STABLE whose category begins with ``kind``, for a character class."""
    stable = re.compile(f"[{STABLE}]")
    found = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and stable.match(chr(c))
             and unicodedata.category(chr(c)).startswith(kind)]
    first = [c for i, c in enumerate(found) if not i or found[i - 1] != c - 1]
    last = [c for i, c in enumerate(found) if i + 1 == len(found) or found[i + 1] != c + 1]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(first, last))


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The parts of ``data`` after all merges, lowest rank first, leftmost of equal ones."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], sys.maxsize), i) for i in range(len(parts) - 1))
        if rank == sys.maxsize:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def file_ranks(spec: dict) -> tuple[dict[bytes, int], list[int]] | None:
    """(ranks of byte strings, id by rank) of a tokenizers file; None if its merges aren't in order."""
    model = spec["model"]
    byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
    suffix = model.get("end_of_word_suffix") or ""

    def data(token: str) -> bytes:
        ends = bool(suffix) and token.endswith(suffix)
        return b"".join(map(byte_of.__getitem__, token[:len(token) - len(suffix)] if ends else token)) + (
            END if ends else b"")

    ranks = {bytes([b]): b for b in range(256)}
    ids = [model["vocab"][c] for c in byte_letters()]
    if suffix:  # first of all, a word's last byte takes the end
        for b, c in enumerate(byte_letters()):
            ranks[bytes([b]) + END] = len(ids)
            ids.append(model["vocab"][c + suffix])
    for pair in model["merges"]:
        one, other = pair.split(" ") if isinstance(pair, str) else pair
        token = data(one) + data(other)
        if token in ranks or data(one) not in ranks or data(other) not in ranks:
            return None
        ranks[token] = len(ids)
        ids.append(model["vocab"][one + other])
    reached = {t: r for t, r in ranks.items() if len(t) < 2 or merged(t, ranks) == [t]}
    return reached, ids


class FileEncoder:
    """Ids of whole texts by a tokenizers file, as its library gives them without special tokens added.

    A special token's literal in a text is that token, which is the library's default.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.literals = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        steps = (spec["normalizer"], spec["pre_tokenizer"])
        plain = {k: v for k, v in spec["model"].items() if v and k not in ("type", "vocab", "merges")}
        self.words = steps == WORD_STEPS and list(plain) == ["end_of_word_suffix"]
        known = self.words or steps == BYTE_LEVEL_STEPS and not plain
        found = file_ranks(spec) if known else None
        self.ranked = None
        if found:
            import tiktoken

            self.id_of = np.array(found[1], "<u4")
            self.ranked = tiktoken.Encoding(
                "file", pat_str=r"[^\x00]+\x00" if self.words else BYTE_LEVEL, mergeable_ranks=found[0],
                special_tokens={})
        if self.words:
            letter, number = _class("L"), _class("N")
            self.split = re.compile(
                f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|\x01|[^\\s{letter}{number}\x01]+")

    def _plain(self, text: str) -> bool:
        """Whether the text may be cut before its spaces and encoded by ranks."""
        return not (OTHER.search(text) or self.literals.search(text)
                    or not self.words and UNSAFE.search(text))

    def _parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = PART.join([*parts, ""])
        if self.words:
            found = self.split.findall(text.lower())
            text = "\0".join(found) + "\0" if found else ""
        ranks = np.array(self.ranked.encode_ordinary(text), np.int64)
        marks = ranks == (256 + 1 if self.words else 1)  # the rank of PART
        ends = np.flatnonzero(marks)
        return self.id_of[ranks[~marks]], ends - np.arange(len(ends))

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        own = texts.to_pylist()
        plain = np.array([self.ranked is not None and self._plain(t) for t in own], bool)
        by_parts = iter(encode_parts(texts.filter(pa.array(plain)), self._parts, not self.words)
                        if plain.any() else ())
        return [next(by_parts) if safe
                else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
                for text, safe in zip(own, plain)]


_ENCODERS: dict[str, FileEncoder] = {}


def file_encoder(path: str) -> FileEncoder:
    """One encoder a file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FileEncoder(path)
    return _ENCODERS[path]
