"""Small tables for the operators' tests."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = "lorem ipsum " * 4000


def docs_frame(spark, rows, extra=True):
    """(doc_id, text) rows with the columns of documents and some with clashing names."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df = df.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")})
    if extra:
        df = df.withColumns({c: F.lit(None).cast("string") for c in
                             ("id", "ids", "piece", "start", "length", "key", "label", "load")})
    return df


ODD_ROWS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "the cat sat on the mat"),
            (5, LONG), (6, " \n\t "), (7, "né à Zürich — 漢字 😀"), (8, "x"), (None, "no id"), (9, "x")]
