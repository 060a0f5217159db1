import hashlib
import random

import numpy as np

from sparkmarts.llm.op5_run_index import RunIndex, digest, least, remove_repeats
from sparkmarts.llm.queries import op5_run_index
from tests.llm.helpers import ODD_ROWS, docs_frame


def brute(rows, width=100):
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - width + 1):
            window = data[i:i + width]
            if window in seen:
                gone[i:i + width] = True
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_least_places():
    values = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 69):
        want = [i + int(np.argmin(values[i:i + width])) for i in range(301 - width)]
        assert least(values, width).tolist() == want


def test_index_statistics_and_repeats_equal_brute_force():
    draw = random.Random(3)
    for case in range(30):
        base = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 60))) for _ in range(3)]
        texts = [b"".join(draw.choice(base) for _ in range(draw.randint(1, 3))) for _ in range(6)]
        if not any(texts):
            continue
        index, at, suffixes = RunIndex(texts), 0, []
        for t in texts:
            suffixes += [(t[i:], at + i) for i in range(len(t))]
            at += len(t)
        order = sorted(suffixes)
        assert index.places.tolist() == [p for _, p in order]
        want = np.zeros(at, int)
        for (x, _), (y, p) in zip(order, order[1:]):
            while want[p] < min(len(x), len(y)) and x[want[p]] == y[want[p]]:
                want[p] += 1
        assert index.statistics().tolist() == want.tolist()
        seen, again = set(), []
        for s, p in sorted(suffixes, key=lambda r: r[1]):
            again.append(len(s) >= 10 and s[:10] in seen)
            seen.add(s[:10])
        assert index.repeated(10).tolist() == again
        assert len(index.heads) < at or at < 200


def test_repeats_of_planted_passages(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choice("abcdefgé ") for _ in range(n))
    passages = [text(n) for n in (60, 99, 100, 130, 400, 900)]
    rows = []
    for i in range(80):
        parts = []
        for _ in range(draw.randint(0, 5)):
            p = draw.choice(passages)
            if draw.random() < 0.4:
                a = draw.randint(0, len(p))
                p = p[:a] + draw.choice(("", "X", "yy")) + p[a:]
            if draw.random() < 0.3:
                p = p[draw.randint(0, 50):]
            parts.append(draw.choice((text(draw.randint(0, 150)), p, p)))
        rows.append((i, "".join(parts)))
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, "a" * 130 + "b" + "a" * 120)]
    want = brute(rows)
    assert sum(r[2] > 0 for r in want) > 40
    assert result(digest(remove_repeats(docs_frame(spark, rows).repartition(5)))) == want
    assert result(digest(remove_repeats(docs_frame(spark, rows).repartition(2), group_spans=4))) == want


def test_odd_rows(spark):
    df = docs_frame(spark, ODD_ROWS)
    assert result(digest(remove_repeats(df))) == brute(ODD_ROWS)
    assert remove_repeats(df.limit(0)).count() == 0
    twice = docs_frame(spark, [(1, "x" * 40 + "abcdefghij" * 3 + "0123456789" * 5)] * 2)
    assert [r.n_removed for r in remove_repeats(twice).collect()] == [0, 0]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = list(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    assert result(op5_run_index(spark, sf)) == brute(rows)


def test_rows_that_share_an_id(spark):
    draw = random.Random(5)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    shared, first, second, other = text(150), text(400), text(300), text(200)
    copies = docs_frame(spark, [(1, first), (2, second), (1, first)]).coalesce(1)
    assert [r.n_removed for r in remove_repeats(copies).collect()] == [0, 0, 0]
    rows = [(None, first + shared), (None, second), (3, other + shared), (3, text(220)), (None, first + shared)]
    for df in (docs_frame(spark, rows).coalesce(1), docs_frame(spark, rows).repartition(4)):
        got = {r.kept.decode(): (r.doc_id, r.n_removed) for r in remove_repeats(df).collect()}
        assert got == {first + shared: (None, 0), second: (None, 0), other: (3, 150), rows[3][1]: (3, 0)}
    rows = [(None, shared + first), (None, shared + second)]
    got = remove_repeats(docs_frame(spark, rows).coalesce(1)).collect()
    assert sorted(r.n_removed for r in got) == [0, 150]
