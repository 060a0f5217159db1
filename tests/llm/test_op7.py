import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from sparkmarts.llm.bpe_text import FileEncoder, file_ranks
from sparkmarts.llm.op7_token_files import (Shard, compress, new_path, read, read_range, rule_lengths,
                                            write)
from sparkmarts.llm.queries import op7_token_files
from tests.llm.helpers import ODD_ROWS, docs_frame

PATH = P.path("word_bpe_49k.json")


def brute(rows):
    tokenizer = Tokenizer.from_file(PATH)
    start, out = 0, set()
    for key, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.add((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def shard_of(ids, **options):
    rules, symbols = compress(ids, 1 << 16, **options)
    return rules, Shard(rules, rule_lengths(rules, 1 << 16), 1 << 16, symbols)


def test_grammar_round_trip_and_ranges():
    draw = np.random.default_rng(3)
    phrases = [draw.integers(0, 500, draw.integers(3, 30)) for _ in range(40)]
    ids = np.concatenate([phrases[k] for k in draw.integers(0, 40, 3000)]).astype(np.uint32)
    for options in ({}, {"min_count": 4}):
        rules, shard = shard_of(ids, **options)
        assert len(shard.symbols) + 2 * len(rules) < len(ids) / 4
        assert (shard.range(0, len(ids)) == ids).all() and (shard.whole() == ids).all()
        for a in draw.integers(0, len(ids), 200).tolist():
            b = min(len(ids), a + int(draw.integers(0, 50)))
            assert (shard.range(a, b) == ids[a:b]).all()


def test_compression_goes_on_until_no_pair_is_frequent():
    draw = np.random.default_rng(4)
    one = draw.integers(0, 40_000, 8000).astype(np.uint32)
    rules, shard = shard_of(np.tile(one, 250))
    assert (shard.range(0, 8000 * 250) == np.tile(one, 250)).all()
    assert len(shard.symbols) < 250 * 32  # a copy is a few symbols
    for ids in (np.tile(one, 40), np.repeat(one[:50], 300), draw.integers(0, 30, 20_000).astype(np.uint32)):
        rules, shard = shard_of(ids)
        assert (shard.range(0, len(ids)) == ids).all() and (shard.whole() == ids).all()
        pairs = {}
        at = 0
        while at + 1 < len(shard.symbols):  # occurrences that don't overlap
            pair = tuple(shard.symbols[at:at + 2].tolist())
            if pairs.get(pair, (0, -2))[1] != at - 1 or pair[0] != pair[1]:
                pairs[pair] = (pairs.get(pair, (0, 0))[0] + 1, at)
            at += 1
        assert max(n for n, _ in pairs.values()) < 16


def test_a_document_is_decoded_without_its_shard():
    draw = np.random.default_rng(5)
    one = draw.integers(0, 40_000, 5000).astype(np.uint32)
    ids = np.concatenate([np.tile(one, 30), draw.integers(0, 40_000, 300_000).astype(np.uint32)])
    _, shard = shard_of(ids)
    assert (shard.range(12_345, 12_445) == ids[12_345:12_445]).all()
    assert shard.looked_at < 100 * 40  # the symbols of that range and their parts, level by level


def test_grammar_of_degenerate_sequences():
    for ids in (np.zeros(0, np.uint32), np.ones(1, np.uint32), np.full(1001, 7, np.uint32)):
        _, shard = shard_of(ids)
        assert (shard.range(0, len(ids)) == ids).all() and (shard.whole() == ids).all()


TEXTS = ("It's DON'T  a\n\nb.\nC, d'll ÉCOLE İI Σας ß é é x1y2 !!,. ", "a\x1cb\x85c d",
         "<|endoftext|> <|startoftext|>x", "漢字 😀 don't. we'RE", "\n", " ", "", "\n\n. ,a",
         "naïve. NAÏVE, É. x.. x.", "e\u0301. \u0301 .", "x <|endoftext|> y <|start", "a\0b \0", "ªº µ²½ 3⁄4 —“q” …",
         "Привет, мир 12", "한국어 漢字文", "soft\u00adhyphen\u00a0no-break \u200bzero",
         "ends in spaces  ", "\n \n", "a \n b", "tab\t \tx", "word\n\n", " lead", "\x01 a\x02 b", "'s's 'll 'LL d'D")


def test_encoders_equal_the_library():
    draw = np.random.default_rng(6)
    letters = list("abcdefghijklmnopqrstuvwxyzäößéÉàçñ ABC  ..,'s0123-\n\t!&")
    drawn = ["".join(draw.choice(letters, 300)) for _ in range(200)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        tokenizer, own = Tokenizer.from_file(P.path(name)), FileEncoder(P.path(name))
        assert own.ranked is not None
        for some in ([*TEXTS, *drawn], *([text] for text in TEXTS)):
            want = [tokenizer.encode(text, add_special_tokens=False).ids for text in some]
            assert [ids.tolist() for ids in own.ids(pa.array(some))] == want, some
        assert own.ids(pa.array([], pa.string())) == []


def test_merges_out_of_order_go_to_the_library():
    letters = {c: i for i, c in enumerate(__import__("sparkmarts.llm.bpe_text", fromlist=["x"]).byte_letters())}
    vocab = {**letters, "ab": 256, "abc": 257}
    spec = {"model": {"vocab": vocab, "merges": ["ab c", "a b"]}}
    assert file_ranks(spec) is None
    ranks, ids = file_ranks({"model": {"vocab": vocab, "merges": ["a b", "ab c"]}})
    assert ids[ranks[b"abc"]] == 257


def test_odd_rows(spark):
    path = new_path(spark)
    write(docs_frame(spark, ODD_ROWS).repartition(3), path, PATH, shard_ids=50)
    got = {tuple(r) for r in read(spark, path, checksums=True).collect()}
    ordered = sorted(ODD_ROWS, key=lambda r: -1 if r[0] is None else r[0])
    assert got == brute(ordered)
    rows = {r.doc_id: r for r in read(spark, path).collect()}
    some = {r.doc_id: r for r in read(spark, path, only=[7, 5, 999]).collect()}
    assert some == {k: rows[k] for k in (5, 7)}
    flat = b"".join(bytes(r.ids) for r in sorted(rows.values(), key=lambda r: r.start))
    parts = sorted((r.start, bytes(r.ids)) for r in read_range(spark, path, 40, 900).collect())
    assert parts[0][0] == 40 and b"".join(x for _, x in parts) == flat[160:3600]
    path = new_path(spark)
    write(docs_frame(spark, ODD_ROWS).limit(0), path, PATH)
    assert read(spark, path).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in op7_token_files(spark, sf).collect()}
    assert got == brute(sorted(map(tuple, rows)))
