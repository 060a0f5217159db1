"""Hard negatives against brute force, on rows."""

import numpy as np
from pyspark.sql import functions as F

from sparkmarts.llm.op11_hard_negatives import Columns, best_rows, hard_negatives, window_rows
from sparkmarts.llm.queries import op11_hard_negatives
from tests.conftest import SF_SMALL

INF, NAN = float("inf"), float("nan")
SCHEMA = ("vec_id long, embedding array<float>, label int, row string, shard string, block int, "
          "score long, rank int, slot int, anchor long, id string")
LAST = 2**70


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], SCHEMA)


def plain(rows, scale=256, positives=5, negatives=10, anchor=lambda i: i % 100 == 0):
    """The contract on a list of (id, vector, label), row by row."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v], c) for i, v, c in rows
            if v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    clip = lambda s: min(max(s, -2**63), 2**63 - 1)
    out = []
    for n, (i, v, c) in enumerate(kept):
        if i is None or not anchor(i):
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(v, w))), LAST if j is None else j, j, d)
                        for m, (j, w, d) in enumerate([(LAST if x[0] is None else x[0], *x[1:]) for x in kept])
                        if m != n)
        for p, _, pid, _ in [s for s in scored if s[3] == c][:positives]:
            allowed = [s for s in scored if s[3] != c and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, pid, r, s[2], -p, -s[0]) for r, s in enumerate(allowed, 1)]
    name = lambda x: None if x == LAST else x
    return sorted(((a, name(b), r, name(d), p, s) for a, b, r, d, p, s in out), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def mined(df, **options):
    return hard_negatives(df, F.expr("id % 100 = 0"), **options)


def test_scan_drops_rows_and_keeps_results():
    draw = np.random.default_rng(1)
    x = np.floor(draw.normal(size=(3000, 24)) * np.r_[np.full(4, 900), np.full(20, 9)])
    x[50:60] = x[50]  # ties
    ids = draw.permutation(3000)
    shard = Columns(x)
    read = []
    scan = shard.scan

    def counting(anchor, rows, step=4):
        inner, keep = scan(anchor, rows, step), None
        while True:
            try:
                step_rows = inner.send(keep)
            except StopIteration:
                return
            read.append(len(step_rows[0]))
            keep = yield step_rows

    shard.scan = counting
    for anchor in x[:40]:
        scores = x @ anchor
        order = np.lexsort((ids, -scores))[:7]
        rows, values = best_rows(shard, anchor, np.arange(3000), ids, 7)
        assert rows.tolist() == order.tolist() and values.tolist() == scores[order].tolist()
        top = int(scores.max())
        windows = [(top // 4, top // 2), (top // 3, top // 3), (1, 0)]
        found = {n: (r.tolist(), s.tolist()) for n, r, s in
                 window_rows(shard, anchor, np.arange(3000), ids, 7, windows)}
        for n, (low, high) in enumerate(windows):
            inside = [i for i in np.lexsort((ids, -scores)) if low <= scores[i] <= high][:7]
            assert found.get(n, ([], []))[0] == inside
    assert sum(read) < 0.6 * 3000 * len(read)  # the bitmap shrinks as dimensions are read


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (1, None, 1), (2, [None, 1.0], 2),
            (3, [NAN, 1.0], 2), (4, [INF, 1.0], 2), (5, [], 2), (6, [0.0, 0.0], 2), (7, [2.0, 1.0], None),
            (8, [0.5, 0.25], 2), (9, [0.4, 0.3], 3), (None, [0.4, 0.3], 3), (None, [0.9, 0.5], 1),
            (10, [0.4, 0.3, 0.0], 3), (9, [0.4, 0.3], 3), (200, [-1.0, 0.5], 4), (11, [1.0, -0.5], 4),
            (300, [0.0, 0.0], 5), (12, [0.0, 0.0], 5), (400, [1.0, 1.0], 6)]
    assert got(mined(frame(spark, rows))) == plain(rows)
    assert mined(frame(spark, [])).collect() == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])).collect() == []


def test_shards_blocks_and_ties(spark):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) / 256 for x in draw.integers(-4, 9, 6)], int(draw.integers(0, 3)))
            for i in range(420)]
    assert got(mined(frame(spark, rows), shard_rows=60, block_rows=2)) == plain(rows)


def test_huge_components_are_exact_and_clipped(spark):
    rows = [(0, [1e14, 3.0], 1), (1, [1e14, 2.0], 1), (2, [5e13, 3.0], 2), (3, [5e13, 4.0], 2),
            (100, [1e30, 1.0], 3), (4, [1e30, 2.0], 3), (5, [1.0, 1.0], 4)]
    assert got(mined(frame(spark, rows), scale=1.0)) == plain(rows, scale=1)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select(
        "vec_id", "embedding", "label").collect()]
    rows = [(i, v, (c + 1) % 10 if c is not None and i % 7 == 0 else c) for i, v, c in rows]
    assert got(op11_hard_negatives(spark, SF_SMALL)) == plain(rows)
