import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkmarts.llm.op1_packing import best_fit, pack, pack_documents
from sparkmarts.llm.queries import op1_packing
from tests.llm.helpers import ODD_ROWS, docs_frame

PATH = P.path("byte_bpe_50k.json")


def check(rows, texts, max_len):
    """Pieces and places are right; returns the number of sequences."""
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % max_len + 1
        ends = list(range(first, len(ids) + 1, max_len))
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            want.append((key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    order = lambda x: tuple((v is None, v or 0) for v in x)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=order) == sorted(want, key=order)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= max_len
    return len(places), math.ceil(sum(r.length for r in rows) / max_len)


def test_best_fit_takes_the_tightest_bin():
    assert best_fit([6, 5, 4, 3], 10) == [[0, 2], [1, 3]]
    assert best_fit([], 10) == []
    assert best_fit([10, 10, 1], 10) == [[0], [1], [2]]


def test_odd_rows_long_texts_and_ties(spark):
    odd = [*ODD_ROWS, (20, "x <|endoftext|> y<|endoftext|>"), (21, "tab\there  and \x1c \u0130 \u2028 \u05d0")]
    rows = pack_documents(docs_frame(spark, odd), PATH, max_len=64).collect()
    n, least = check(rows, odd, 64)
    assert n <= least + 1
    assert pack_documents(docs_frame(spark, ODD_ROWS).limit(0), PATH).count() == 0


def test_rounds_merge_underfull_bins(spark):
    items = spark.range(4000).select((F.pmod(F.xxhash64("id"), F.lit(700)) + 1).alias("length"), "id")
    bins = pack(items, 1000, task_items=300, fan_in=4).collect()
    assert sum(len(b.members) for b in bins) == 4000
    assert all(b.load == sum(m.length for m in b.members) <= 1000 for b in bins)
    total = items.agg(F.sum("length")).first()[0]
    assert len(bins) <= 1.02 * total / 1000 + 1


def test_large_items_that_never_pair_end(spark):
    items = spark.range(500).select(F.lit(600).alias("length"), "id")
    assert pack(items, 1000, task_items=50).count() == 500


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, least = check(op1_packing(spark, sf).collect(), texts, 2048)
    assert n <= 1.02 * least + 1
