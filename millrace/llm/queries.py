"""Queries of the driver contract, one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.llm import audio, leaks, licences, mixing, near, quotes, repeats, suffix, tokens, toxicity
from millrace.llm.words import sql_words


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark, sf_dir):
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_licences(spark, sf_dir):
    return licences.licences(_table(spark, sf_dir, "documents"))


def op3_suffix_array(spark, sf_dir):
    return suffix.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_quotation_linking(spark, sf_dir):
    """The conversations as mail, since they hold no quotes themselves: each message quotes what it
    answers, and linking has to find that out and to take the quotes away again."""
    return quotes.linked(quotes.as_mail(_table(spark, sf_dir, "conversations")))


def op5_mpeg_audio(spark, sf_dir):
    """A media column for every page, since no table has one: streams that carry the page's bytes."""
    media = audio.with_audio(_table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html"), F.col("url"))
    return audio.audio_index(media)


def op6_token_ids(spark, sf_dir):
    return tokens.packed(_table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.copies(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return leaks.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_seed_and_extend(spark, sf_dir):
    return repeats.repeats(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_licences, op3_suffix_array, op4_quotation_linking, op5_mpeg_audio, op6_token_ids, op7_mixing, op8_decontamination, op9_toxicity, op10_seed_and_extend)}

_WORDS = sql_words()

ORACLES = {
    "op2_licences": licences.oracle(),
    "op3_suffix_array": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
        r AS (SELECT DISTINCT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
        n AS (SELECT *, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS new FROM r),
        s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM n)
        SELECT doc_id, min(i) - 1 AS start_word, max(i) + 49 AS end_word, max(i) - min(i) + 50 AS n_words
        FROM s GROUP BY doc_id, island""",
    "op10_seed_and_extend": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
        g AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
        c AS (SELECT h, min({{'d': doc_id, 'i': i}}) AS hub, max({{'d': doc_id, 'i': i}}) AS far FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
        l AS (SELECT doc_id, i, CASE WHEN hub.d <> doc_id THEN hub.d ELSE far.d END AS t, CASE WHEN hub.d <> doc_id THEN hub.i ELSE far.i END - i AS diagonal FROM g JOIN c USING (h)),
        k AS (SELECT DISTINCT doc_id, t, diagonal FROM l),
        e AS (SELECT k.doc_id, k.t, k.diagonal, a.i, l.i IS NOT NULL AS linked FROM k JOIN g a ON a.doc_id = k.doc_id JOIN g b ON b.doc_id = k.t AND b.i = a.i + k.diagonal AND b.h = a.h
            LEFT JOIN l ON l.doc_id = k.doc_id AND l.t = k.t AND l.diagonal = k.diagonal AND l.i = a.i),
        s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, t, diagonal ORDER BY i) AS island FROM e)
        SELECT doc_id, min(i) - 1 AS start_word, count(*) + 49 AS n_words, t AS match_doc_id, min(i) + diagonal - 1 AS match_start
        FROM s GROUP BY doc_id, t, diagonal, island HAVING bool_or(linked)""",
    "op8_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        dp AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
        bp AS (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS j FROM b WHERE len(w) >= 13),
        dg AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS g FROM dp),
        bg AS (SELECT item_id, j, array_to_string(list_slice(w, j, j + 12), ' ') AS g FROM bp),
        m AS (SELECT doc_id, item_id, i, j, j - i AS diagonal FROM dg JOIN bg USING (g)),
        s AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island FROM m)
        SELECT doc_id, item_id, min(i) - 1 AS doc_start, min(j) - 1 AS item_start, count(*) + 12 AS n_words
        FROM s GROUP BY doc_id, item_id, diagonal, island""",
}
