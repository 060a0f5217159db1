import corpus_pipeline
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sparkmarts.llm.op8_secrets import GuessCost, spans
from sparkmarts.llm.queries import op2_toxicity

from tests.llm.helpers import ODD_ROWS, docs_frame
from tests.llm.test_op1 import check
from tests.llm.test_op6 import brute as groups_of
from tests.llm.test_op9 import brute as lines_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_keep_columns_and_rows(results):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "secrets", "packing"]
    for name in names[:4]:
        assert results[name].columns == results["documents"].columns
        assert all(r.n_chars == len(r.text) for r in results[name].filter("n_chars is not null").collect())


def test_each_stage_equals_a_plain_version(spark, results):
    before, clean = texts(results["documents"]), texts(results["toxicity"])
    scores = {r.doc_id: r.score for r in op2_toxicity(spark, SF).collect()}
    assert clean == {k: t for k, t in before.items() if scores[k] < 0.5} and len(clean) < len(before)
    lines = texts(results["line_dedup"])
    exact = lines_of(sorted(clean.items()), max_edits=2, min_chars=24)
    assert lines == {k: text for k, text, _, _ in exact} and sum(gone for *_, gone in exact) > 0
    kept = texts(results["simhash"])
    want = {k for k, _, c in groups_of(sorted(lines.items())) if k == c}
    assert set(kept) == want and all(kept[k] == lines[k] for k in kept)
    safe = texts(results["secrets"])
    cost = GuessCost.load(P.path("byte_bpe_50k.tiktoken"))
    for key, text in kept.items():
        out, done = "", 0
        for a, _, b in sorted(spans(text, cost, 40.0)):
            if a >= done:
                out += text[done:a] + "[SECRET]"
            done = max(done, b)
        assert safe[key] == out + text[done:]
    assert any(safe[k] != kept[k] for k in kept)
    n, least = check(results["packing"].collect(), sorted(safe.items()), 2048)
    assert n <= 1.02 * least + 1


def test_columns_of_any_name_pass_every_stage(spark):
    names = ["predicted", "score", "evidence", "kept", "kept_id", "n_lines", "n_removed", "number", "print",
             "id", "fp", "c0", "c1", "count", "none", "first", "fingerprint", "group_id"]
    docs = docs_frame(spark, ODD_ROWS, extra=False).withColumns({c: F.lit(c) for c in names})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == c for r in rows for c in names), name
    assert {r.doc_id for r in corpus_pipeline.packing(spark, docs, SF).collect()} == {k for k, _ in ODD_ROWS}


def test_simhash_tells_rows_of_one_id_apart(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (2, text), (2, "another text with quite different words in it"), (3, ""), (None, ""),
            (None, "no id and a text of its own"), (None, "no id and a text of its own"), (2, text), (4, text)]
    kept = corpus_pipeline.simhash(spark, docs_frame(spark, rows, extra=False), SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([
        (1, text), (2, "another text with quite different words in it"), (3, ""),
        (None, "no id and a text of its own")], key=repr)


def test_odd_rows_pass_every_stage(spark):
    docs = docs_frame(spark, ODD_ROWS, extra=False)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        assert stage(spark, docs, SF).count() > 0, name
    assert corpus_pipeline.simhash(spark, docs, SF).count() == 6
