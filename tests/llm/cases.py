"""Rows that every operator must take: nulls, empty and long texts, repeats, ties, clashing columns."""

import re

LONG = "word " * 200_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    passage = " ".join(f"shared{i}" for i in range(60))
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "   \n", None, None, 4), (None, "no id here at all", "en", "a", 5),
        (None, None, None, None, None), (4, "one", "en", "b", 3), (5, "!!! ???", "en", "b", 7), (6, LONG, "en", "b", len(LONG)),
        (7, "twice the very same row of text", "en", "b", 1), (7, "twice the very same row of text", "en", "b", 1),
        (8, "twice the very same row of text", "de", "c", 1), (9, "x" * 300_000, "en", "c", 1),
        (10, f"before one {passage} after", "en", "c", 1), (11, f"other words precede {passage}", "en", "c", 1), (12, f"日本語の文章 {passage} é", "ja", "c", 1),
        (13, "same id, one text", "en", "a", 1), (13, "same id, and quite another text", "en", "a", 1),
    ]
    return rows


def odd(spark):
    """The odd rows, with further columns that have the names operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), DOCS)
    for name in ("key", "score", "copies", "rate", "count", "hub", "sig", "bands", "u", "v", "node", "root", "unit", "terms", "start", "stop", "tokens"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())
