import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import sparkmarts.llm.op2_toxicity as op2
from sparkmarts.llm.op2_toxicity import Index, fit, held_out, score
from sparkmarts.llm.queries import op2_toxicity
from tests.llm.helpers import ODD_ROWS, docs_frame


def test_block_max_search_equals_all_cosines():
    draw = np.random.default_rng(0)
    dense = draw.random((700, 40)) * (draw.random((700, 40)) < 0.1)
    dense[100:140] = dense[100]  # ties
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    vectors = [(np.flatnonzero(v), v[v > 0]) for v in dense]
    index = Index.build(vectors, 40)
    for i in range(0, 700, 7):
        found, weights = vectors[i]
        if not len(found):
            continue
        for skip in (-1, i):
            rows, cosines = index.search(found, weights, 25, skip)
            want = dense @ dense[i]
            if skip >= 0:
                want[skip] = 0
            order = [r for r in np.lexsort((np.arange(700), -np.round(want, 12)))[:25] if want[r] > 0]
            assert np.allclose(cosines, want[order])
            assert np.allclose(want[rows], cosines)


def test_odd_rows_and_missing_labels(spark):
    df = docs_frame(spark, ODD_ROWS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = score(df, fit(df, none)).collect()
    assert len(got) == len(ODD_ROWS) and all(r.score == 0.0 and r.predicted == 0 for r in got)
    rows = [(i, f"word{chr(97 + i % 7)}{'x' * (i % 5)} plain text " + ("vilething " if i % 2 else ""))
            for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 1)],
                                   "doc_id long, toxic int")
    model = fit(docs_frame(spark, rows), labels)
    got = score(docs_frame(spark, rows + ODD_ROWS[1:]), model).collect()
    assert len(got) == 60 + len(ODD_ROWS) - 1
    for r in got:
        assert 0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5)
    assert {r.doc_id for r in got if r.predicted} >= {i for i in range(11, 60, 2)}
    assert not any(r.predicted for r in got if r.doc_id in (2, 3) and not r.evidence)
    assert score(df.limit(0), model).count() == 0


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op2_toxicity(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.7 * sum(r.toxic for r in rows)  # a fifth of these labels has no trace in the text
    assert hit >= 0.88 * sum(r.predicted for r in rows)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    share = got.select(F.avg(held_out().cast("int"))).first()[0]
    assert 0.15 < share < 0.25


def test_no_feature_of_the_examples_is_dropped(spark):
    """Toxic words that are each rare, and clean examples, are neighbours too."""
    rows = [(i, f"blume{'abcdefgh'[i % 8]} kraut" if i % 10 else f"vile{chr(97 + i // 10)}{'xyz'[i % 3]} kraut")
            for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = fit(docs_frame(spark, rows), labels)
    assert set(model.number) >= {f for _, t in rows for f in (w + " " for w in t.split())}
    assert (model.worth > 0).all()
    got = {r.doc_id: r for r in score(docs_frame(spark, rows), model).collect()}
    assert all(r.evidence for r in got.values())
    assert all(got[i].evidence[0].toxic == int(i % 10 == 0) for i in got)


def test_features_are_looked_up_by_different_words(monkeypatch):
    texts = ["Plain words, plain WORDS; foo-foo_bar4baz", "", "İstanbul ẞ ½Ⅷx étude wordy\x1cwords",
             "abcd abcde abcdef abcdefg \U00010400\U00010401\U00010402\U00010403\U00010404 unknownword", None]
    counts = [Counter(f for part in (t or "").lower().split() for f in op2.features_of(part)) for t in texts]
    names = sorted({f for c in counts for f in c if "unk" not in f}, key=str.encode)
    model = op2.Model(pa.array(names, pa.string()), np.ones(len(names)), None, [], np.zeros(0, int),
                      (1.0, 1.0), 0.1, 25)
    monkeypatch.setattr(op2, "features_of", None)  # no text is taken apart feature by feature
    for own in (model, pickle.loads(pickle.dumps(model))):
        got = [{}, {}, {}, {}, {}]
        for text, feature, count in zip(*(x.tolist() for x in own.features(pa.array(texts)))):
            got[text][names[feature]] = count
        assert got == [{f: n for f, n in c.items() if f in names} for c in counts]
    none = op2.Model(pa.array([], pa.string()), np.zeros(0), None, [], np.zeros(0, int), (1.0, 1.0), 0.1, 25)
    assert all(len(x) == 0 for x in none.features(pa.array(texts)))
    assert all(len(x) == 0 for x in model.features(pa.array([], pa.string())))
