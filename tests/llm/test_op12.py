"""Ranked search against plain scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sparkmarts.llm.op12_ranked_search import (Best, Block, Slice, coordinates, hashed, ranked_search,
                                               search_slice, terms)
from sparkmarts.llm.queries import op12_ranked_search
from tests.conftest import SF_SMALL
from tests.llm.helpers import ODD_ROWS, docs_frame

PATTERN = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, k=20):
    found = [(d, Counter(plain_terms(t))) for d, t in docs]
    n = sum(bool(c) for _, c in found)
    length = sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in found:
            score = 0
            for t in plain_terms(text):
                if t in c:
                    m = 100 - 25 + (25 * sum(c.values()) * n) // length
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d if d is not None else 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def items_frame(spark, rows):
    df = spark.createDataFrame(rows, "item_id long, text string")
    return df.withColumns({c: F.lit(None).cast("string") for c in ("query", "id", "score", "doc_id")})


def test_terms_equal_the_pattern():
    for text in ["Ärger, ÄRGER! x_y-z 3.14 É é b", "A" * 9, "", "日本 語\x00t\x7fu", "[Z]`{|}~@a"]:
        assert [t.decode() for t in terms(text)] == plain_terms(text)


def test_bounds_hold_and_most_documents_are_not_scored():
    draw = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    share = 1 / np.arange(1, 4001)
    share /= share.sum()
    texts = [" ".join(draw.choice(words, size, p=share)) for size in draw.integers(1, 400, 1500)]
    queries = {i: Counter(terms(" ".join(draw.choice(words, 25, p=share)))) for i in range(20)}
    counted = [Counter(terms(t)) for t in texts]
    asked = set().union(*queries.values())
    block = Block(queries, (1500, sum(sum(c.values()) for c in counted),
                            {t: sum(t in c for c in counted) for t in asked}))
    part = Slice(texts, block)
    rows, bounds = part.bounds()
    exact = np.array([[part.score(r, q) for q in block.queries] for r in rows])
    assert (bounds >= exact).all()
    best = [Best(10) for _ in block.names]
    scored = search_slice(part, np.arange(1500), np.zeros(1500, bool), best)
    assert scored < 0.5 * 1500 * 20
    one, two = coordinates(hashed(asked), 1 << 12)
    assert 0 <= one.min() and two.max() < 1 << 12 and (one != two).mean() > 0.9
    for column, held in enumerate(best):
        order = sorted((-int(s), int(r)) for r, s in zip(rows, exact[:, column]) if s > 0)[:10]
        assert [(s, i) for s, i, _ in held.rows] == order


def test_odd_documents_and_items(spark):
    docs = ODD_ROWS + [(11, "Zürich zürich ZÜRICH cat"), (11, "cat cat"), (12, "the CAT sat"), (None, "cat x")]
    items = [(1, "the cat"), (2, None), (3, ""), (1, "ZÜRICH, né cat cat"), (None, "x"), (5, "unseen words"),
             (6, "lorem dolor")]
    for k in (2, 20):
        out = ranked_search(docs_frame(spark, docs), items_frame(spark, items), k=k, block_bytes=12, slice_bytes=64)
        assert got(out) == plain(docs, items, k)
    assert ranked_search(docs_frame(spark, []), items_frame(spark, items)).collect() == []
    assert ranked_search(docs_frame(spark, docs), items_frame(spark, [])).collect() == []
    assert ranked_search(docs_frame(spark, [(1, "...")]), items_frame(spark, items)).collect() == []


def test_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(60, 0, -1)] + [(99, "same")]
    items = [(1, "same words")]
    assert got(ranked_search(docs_frame(spark, docs), items_frame(spark, items))) == plain(docs, items)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert got(op12_ranked_search(spark, SF_SMALL)) == plain(docs, items)
