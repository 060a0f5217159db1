"""The corpus pipeline: toxicity, line dedup, SimHash near-dedup, secret scans, best-fit packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each stage's result as
Parquet to the shared folder of spark.checkpoint.dir and reads it back as the next one's documents.
All but the last return the columns of documents, whatever further columns are called:

* toxicity drops documents that score 0.5 or more; labels are learnt as in the operator's query;
* line_dedup drops repeated lines, ``n_chars`` follows the text, documents without a line left stay
  with an empty text;
* simhash keeps the document of smallest id of each group (a row without id only where no row of its
  group has one; of rows equal in id and fingerprint one);
* secrets replaces secrets in texts by a mark, ``n_chars`` follows;
* packing returns one row per piece of a document and its place in a sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmarts.llm import (op1_packing, op2_toxicity, op6_simhash, op7_token_files, op8_secrets,
                            op9_line_dedup)


def with_length(df: DataFrame) -> DataFrame:
    """``df`` with n_chars (if there) of its new texts."""
    if "n_chars" not in df.columns:
        return df
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = op2_toxicity.fit(docs, labels.filter(~op2_toxicity.held_out()))
    # columns by place, so that none can clash with those of the score
    own = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = own.mapInArrow(*op2_toxicity.scorer(own, model, own.columns[docs.columns.index("text")]))
    return scored.filter("predicted = 0").select(*own.columns).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_length(op9_line_dedup.dedup_lines(docs, max_edits=2, min_chars=24, counts=False))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_simhash.first_of_groups(docs, shingle=3, radius=3)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    words = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return with_length(op8_secrets.redact(docs, words))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash", simhash),
          ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = op7_token_files.new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: Toxicity scores and token ids are beyond SQL; tests compare with plain versions of the stages.
ORACLE_SQL = None
