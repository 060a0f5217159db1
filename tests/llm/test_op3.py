import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import types as T

import sparkmarts.llm.op3_prefix_bpe as op3
from sparkmarts.llm.op3_prefix_bpe import (Codec, PrefixTable, Vocabulary, decode_documents,
                                           encode_documents)
from sparkmarts.llm.queries import op3_prefix_bpe
from tests.llm.helpers import ODD_ROWS, docs_frame

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(PATH)


def test_random_texts_equal_the_library(tik, vocabulary):
    own, draw = Codec(vocabulary, P.PATTERN), random.Random(5)
    letters = " \n\t\x0b\x1c\x85\xa0abcdeth'sreINGé漢字😀.,!?-=1234 aaaaa<|endoftext|>"
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        ids = own.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == tik.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_appends_and_edits_equal_new_tables(vocabulary):
    draw = random.Random(7)
    some = lambda n: bytes(draw.choice(b"theingaer  -=") for _ in range(n))
    saved = 0
    for _ in range(300):
        data = some(draw.randint(0, 400))
        table = PrefixTable(vocabulary, data)
        a = draw.randint(0, len(data))
        b, new = draw.randint(a, min(len(data), a + 5)), some(draw.randint(0, 6))
        done = table.replace(a, b, new)
        whole = PrefixTable(vocabulary, data[:a] + new + data[b:])
        saved += len(whole.data) - a - done
        assert (table.data, table.last) == (whole.data, whole.last)
        table.append(b"inger")
        assert table.last == PrefixTable(vocabulary, whole.data + b"inger").last
    assert saved > 0


def test_odd_rows_and_empty_table(spark, tik):
    df = docs_frame(spark, ODD_ROWS)
    got = decode_documents(encode_documents(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert len(got) == len(ODD_ROWS)
    want = {(i, len(tik.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in ODD_ROWS}
    assert {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in got} == want
    empty = encode_documents(df.limit(0), PATH, P.PATTERN)
    assert decode_documents(empty, PATH, P.PATTERN).count() == 0


def test_query_equals_the_library(spark, tik):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op3_prefix_bpe(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        ids = np.array(tik.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_batches_are_taken_in_small_slices(monkeypatch, vocabulary):
    # both of a task's Python workers held the lists of 8 MB at a time
    texts = [f"text {i} " * 60 for i in range(20_000)]
    codec, taken = Codec(vocabulary, P.PATTERN), []

    class Frame:
        def __init__(self, schema):
            self.schema = schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    def encode_all(some):
        taken.append(some.nbytes)
        return [b"\0\0\0\0" * 500] * len(some)

    monkeypatch.setattr(codec, "encode_all", encode_all)
    monkeypatch.setattr(op3, "codec", lambda *_: codec)
    rows = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    monkeypatch.setattr(op3, "text_rows", lambda *_: Frame(rows))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = [*op3.encode_documents(None, PATH, P.PATTERN)(iter([batch]))]
    assert sum(b.num_rows for b in out) == len(texts) and sum(taken) >= 9 << 20
    assert max(taken) <= 5 << 20
    ids = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])
    whole = pa.Table.from_batches(out).combine_chunks().to_batches()
    got = [*op3.decode_documents(Frame(ids), PATH, P.PATTERN, texts=False)(iter(whole))]
    assert sum(b.num_rows for b in got) == len(texts)
    assert max(b.num_rows for b in got) * 2000 <= 2 << 20
