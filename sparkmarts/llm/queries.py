"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op1_packing import pack_documents

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op2_toxicity import fit, held_out, score

    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted",
                                     "evidence")


def op3_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op3_prefix_bpe import decode_documents, encode_documents

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = encode_documents(documents(spark, sf_dir), path, pattern)
    return decode_documents(encoded, path, pattern, texts=False)


def op4_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op4_threshold_search import top_k
    from sparkmarts.llm.vectors import integer_rows

    vectors = integer_rows(embeddings(spark, sf_dir), scale=64.0)
    return top_k(vectors, vectors.filter("not no_id and id % 20 = 0"), k=20)


def op5_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op5_run_index import digest, remove_repeats

    return digest(remove_repeats(documents(spark, sf_dir), width=100))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op6_simhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), shingle=3, radius=3).drop("group_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op7_token_files import new_path, read, write

    path = new_path(spark)
    write(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path, checksums=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op8_secrets import digest, scan

    words = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digest(scan(documents(spark, sf_dir), words))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op9_line_dedup import dedup_lines, digest

    return digest(dedup_lines(documents(spark, sf_dir), max_edits=2, min_chars=24))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op10_embedding_dedup import near_duplicates

    return near_duplicates(embeddings(spark, sf_dir), threshold=0.93)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op11_hard_negatives import hard_negatives

    rows = embeddings(spark, sf_dir).withColumn(
        "label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives(rows, F.expr("id % 100 = 0"), scale=256.0, positives=5, negatives=10)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op12_ranked_search import ranked_search

    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return ranked_search(documents(spark, sf_dir), items, k=20)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sparkmarts.llm.op13_html_extraction import extract

    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_toxicity": op2_toxicity, "op3_prefix_bpe": op3_prefix_bpe,
            "op5_run_index": op5_run_index, "op4_threshold_search": op4_threshold_search,
            "op10_embedding_dedup": op10_embedding_dedup,
            "op6_simhash": op6_simhash, "op7_token_files": op7_token_files, "op8_secrets": op8_secrets,
            "op9_line_dedup": op9_line_dedup, "op11_hard_negatives": op11_hard_negatives,
            "op12_ranked_search": op12_ranked_search, "op13_html_extraction": op13_html_extraction}


_WHOLE = """whole as (
  select vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) as vec
  from {table} where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)"""

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_threshold_search": "with " + _WHOLE.format(scale=64, table="embeddings") + """,
rows_ as (select *, row_number() over () as n from whole),
scored as (
  select q.vec_id as query_id, q.n as qn, c.vec_id, c.n,
         list_inner_product(q.vec, c.vec)::bigint as score
  from rows_ q join rows_ c on q.n <> c.n where q.vec_id % 20 = 0),
ranked as (
  select query_id, vec_id, score, row_number() over (
    partition by qn order by score desc, vec_id nulls last, n)::integer as rank
  from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op11_hard_negatives": """with relabelled as (
  select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings where label is not null),
""" + _WHOLE.format(scale=256, table="relabelled") + """,
rows_ as (select *, row_number() over () as n from whole),
scored as (
  select a.vec_id as anchor_id, a.n as an, c.vec_id, c.n, a.label = c.label as same,
         list_inner_product(a.vec, c.vec)::bigint as score
  from rows_ a join rows_ c on a.n <> c.n where a.vec_id % 100 = 0),
positives as (
  select * from (
    select anchor_id, an, vec_id as positive_id, n as pn, score as positive_score,
           row_number() over (partition by an order by score desc, vec_id nulls last, n) as place
    from scored where same)
  where place <= 5),
held as (
  select p.anchor_id, p.positive_id, p.positive_score, s.vec_id as negative_id,
         s.score as negative_score, row_number() over (
           partition by p.an, p.pn order by s.score desc, s.vec_id nulls last, s.n)::integer as rank
  from positives p join scored s on s.an = p.an and not s.same
  where 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
from held where rank <= 10""",
    "op12_ranked_search": r"""with doc_terms as (
  select row_number() over () as d, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
item_terms as (
  select row_number() over () as i, item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from benchmark where text is not null),
docs as (
  select d, doc_id, terms, len(terms)::bigint as n from doc_terms where len(terms) > 0),
corpus as (
  select count(*)::bigint as big_n, sum(n)::bigint as big_l from docs),
lengths as (
  select d, doc_id, 100 - 25 + ((25 * n * big_n) // big_l) as m from docs, corpus),
held as (
  select d, term, count(*)::bigint as tf from (select d, unnest(terms) as term from docs)
  group by d, term),
weights as (
  select term, floor(1000 * ln((2.0::double * any_value(big_n) + 2) / (2.0::double * count(*) + 1)))::bigint as w
  from held, corpus group by term),
scores as (
  select i.i, i.item_id, h.d,
         sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from (select i, item_id, unnest(terms) as term from item_terms) i
  join held h on h.term = i.term
  join weights g on g.term = i.term
  join lengths l on l.d = h.d
  group by i.i, i.item_id, h.d),
ranked as (
  select item_id, doc_id, score, row_number() over (
    partition by i order by score desc, doc_id nulls last)::integer as rank
  from scores join lengths using (d) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20""",
}
