"""Queries over files: documents are written as lines of the shared folder and read by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.operators import audit, ranking
from millrace.operators.holdout import candidates
from millrace.operators.rules import document_of, rules_of
from millrace.plans.recipes import _limited, cleaning
from millrace.plans.registry import _NORMAL, _table, _values, query
from millrace.operators.recipe import Rulebook
from millrace.functions.text import kept_lines
from millrace.session import scratch
from millrace.sources import lines as sources, sinks
from millrace.sources.files import joined

#: One line for each document: most are objects, some are blank, no JSON, or no object.
_SAID = (("doc_id % 10 = 3", "''"), ("doc_id % 10 = 4", "'  '"), ("doc_id % 10 = 5", "'{'"), ("doc_id % 10 = 6", "'[1]'"))
_CASE = "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in _SAID) + """ ELSE '{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}' END"""
_LINED = f"WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line, {_CASE} AS value FROM documents), t AS (SELECT *, row_number() OVER (ORDER BY line) AS ordinal FROM l WHERE trim(value) <> '')"


def _file(spark, sf_dir, name: str = "lines.jsonl") -> str:
    """One file, so that its lines have the order of the ids."""
    path = scratch(spark, name.replace(".", "-")) + name[name.index(".") :]
    one = _table(spark, sf_dir, "documents").orderBy("doc_id").select(F.expr(_CASE).alias("value")).coalesce(1)
    sinks.write_lines(one, path)
    return path


@query(_LINED + " SELECT line, ordinal, value FROM t")
def scan_lines(spark, sf_dir):
    """Line numbers, and ordinals without the blank lines."""
    return sources.Input(spark, _file(spark, sf_dir)).text().select("line", "ordinal", "value")


@query(_LINED + " SELECT line, ordinal, value FROM t")
def scan_gzip(spark, sf_dir):
    return sources.Input(spark, _file(spark, sf_dir, "lines.jsonl.gz")).text().select("line", "ordinal", "value")


@query(_LINED + " SELECT line, value FROM t WHERE ordinal <= 25")
def scan_limit(spark, sf_dir):
    """The limit counts lines with text."""
    return _limited(sources.Input(spark, _file(spark, sf_dir)).text(), 25).select("line", "value")


@query(_LINED + " SELECT line, row_number() OVER (ORDER BY line) AS ordinal FROM t WHERE value LIKE '{_%'")
def scan_objects(spark, sf_dir):
    return sources.Input(spark, _file(spark, sf_dir), parsed=True).objects().select("line", "ordinal")


@query(_LINED + """ SELECT count(*) AS lines, count(*) FILTER (trim(value) = '') AS blank, count(*) FILTER (trim(value) <> '') AS text,
    count(*) FILTER (trim(value) NOT IN ('', '{')) AS valid, count(*) FILTER (value LIKE '{_%') AS object FROM l""")
def scan_counts(spark, sf_dir):
    counts = sources.Input(spark, _file(spark, sf_dir), parsed=True).counts
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts))


@query(_LINED + " SELECT n, (SELECT min(ordinal) FROM t WHERE ordinal >= n AND value <> '{') AS stop FROM (SELECT unnest(range(1, 21)) AS n)")
def audit_limits(spark, sf_dir):
    """Where an audit of n rows ends: a line that is no JSON is never the last."""
    text = sources.Input(spark, _file(spark, sf_dir)).text().select("ordinal", (F.col("value") != "{").alias("valid"))
    return spark.createDataFrame([(n, audit.audit_stop(text, n)) for n in range(1, 21)], "n long, stop long")


@query(_LINED + """ SELECT code, n AS records, n AS occurrences FROM (
    SELECT unnest(['invalid_json', 'not_object', 'missing_name', 'missing_ingredients', 'missing_instructions', 'low_information']) AS code,
        unnest([count(*) FILTER (value = '{'), count(*) FILTER (value = '[1]'), o, o, o, o]) AS n FROM t, (SELECT count(*) AS o FROM t WHERE value LIKE '{_%') GROUP BY o) WHERE n > 0""")
def line_issues(spark, sf_dir):
    """Issues of whole lines: what is no JSON counts as a record and as an occurrence."""
    text = sources.Input(spark, _file(spark, sf_dir)).text().drop("ordinal")
    return audit.issue_counts(cleaning(text, Rulebook()))


@query(f"SELECT sha256(string_agg(replace({_NORMAL}, chr(10), ' ') || chr(10), '' ORDER BY doc_id)) AS digest, count(*) AS n FROM documents")
def content_digest(spark, sf_dir):
    """The hash of all lines in their order. Null texts count as rows; without any text there is no hash."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.translate(kept_lines(F.col("text")), "\n", " ").alias("value"))
    digest, lines, n = sinks.hashed(rows, "doc_id")
    return spark.createDataFrame([(digest if lines else None, n)], "digest string, n long")


#: Training rows from documents; some are invalid, and spaces around the fields don't count.
_SHOWN = f"CASE WHEN doc_id % 17 = 0 THEN '' ELSE {_NORMAL} END"
_UNIQUE = f"""WITH d AS (SELECT doc_id, source, {_SHOWN} AS output FROM documents), v AS (SELECT * FROM d WHERE output <> '' AND doc_id % 19 <> 0),
    r AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v t WHERE t.doc_id < 60 AND t.source = v.source AND t.output = v.output)),
    u AS (SELECT min(doc_id) AS line FROM r GROUP BY source, output)"""


def _training(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    d = _table(spark, sf_dir, "documents")
    output = F.when(F.expr("doc_id % 17 = 0"), "").otherwise(kept_lines(F.col("text")))
    row = F.to_json(F.struct(F.concat(F.lit("  "), "source").alias("instruction"), F.lit("").alias("input"), F.concat(output, F.lit("\n ")).alias("output")))
    lines = d.select(F.lit("documents").alias("path"), F.col("doc_id").alias("line"), F.when(F.expr("doc_id % 19 = 0"), '{"instruction": 1}').otherwise(row).alias("value"))
    return lines, lines.where("line < 60 AND line % 17 <> 0 AND line % 19 <> 0")


@query(_UNIQUE + " SELECT line, row_number() OVER (ORDER BY line) AS ordinal FROM u")
def holdout_candidates(spark, sf_dir):
    """What a training set doesn't have, each row once, the first of equal ones."""
    return candidates(*_training(spark, sf_dir))[0].select("line", "ordinal")


@query(_UNIQUE + """ SELECT (SELECT count(*) FROM v WHERE doc_id < 60) AS train_rows, (SELECT count(*) FROM (SELECT DISTINCT source, output FROM v WHERE doc_id < 60)) AS train_unique_records,
    (SELECT count(*) FROM d) AS source_rows, (SELECT count(*) FROM d) - (SELECT count(*) FROM v) AS malformed_or_invalid_rows, (SELECT count(*) FROM v) - (SELECT count(*) FROM r) AS excluded_train_overlap_rows,
    (SELECT count(*) FROM r) - (SELECT count(*) FROM u) AS excluded_duplicate_source_rows, (SELECT count(*) FROM u) AS eligible_unique_rows""")
def holdout_counts(spark, sf_dir):
    report = candidates(*_training(spark, sf_dir))[1]
    return spark.createDataFrame([tuple(report.values())], ", ".join(f"{n} long" for n in report))


#: Predictions with and without the marks that are looked for, by turn.
_PREDICTED = """CASE turn % 5 WHEN 0 THEN '食材：' || chr(10) || '- ' || text || chr(10) || '步骤:' || chr(10) || '1. ' || role WHEN 1 THEN '  ' WHEN 2 THEN '<THINK>' || text || '</think>' WHEN 3 THEN '第三步 ' || text ELSE text END"""


@query(f"""
    WITH p AS (SELECT role AS run, turn % 5 AS kind, length({_PREDICTED}) / greatest(length(role), 1) AS ratio FROM conversations)
    SELECT run, count(*) AS samples, count(*) FILTER (kind = 1) AS empty, count(*) FILTER (kind = 0) AS formatted, count(*) FILTER (kind IN (0, 3)) AS numbered, count(*) FILTER (kind = 2) AS thinking,
        avg(ratio)::DECIMAL(18,4) AS mean, median(ratio)::DECIMAL(18,4) AS median FROM p GROUP BY run""")
def structure_rates(spark, sf_dir):
    c = _table(spark, sf_dir, "conversations").select(F.col("role").alias("run"), F.expr(_PREDICTED.replace("chr(10)", "char(10)")).alias("predict"), F.col("role").alias("label"))
    return ranking.structure(c).withColumns({n: F.col(n).cast("decimal(18,4)") for n in ("mean", "median")})


@query("""
    WITH s AS (SELECT d.source, d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
    m AS (SELECT CASE WHEN source = 'src0' THEN 'final_model' WHEN source = 'src1' THEN 'base' ELSE 'checkpoint-' || substr(source, 4) END AS name,
        sum(quality)::DOUBLE AS rouge_l, CASE WHEN source = 'src2' THEN 0.0 ELSE sum(toxic)::DOUBLE END AS rouge_2, count(*) AS samples,
        round(count(*) FILTER (doc_id % 7 = 0) * 100 / count(*), 4) AS empty_rate FROM s GROUP BY source),
    r AS (SELECT *, name <> 'base' AS candidate FROM m)
    SELECT name, rouge_l::DECIMAL(18,4) AS rouge_l, rouge_2::DECIMAL(18,4) AS rouge_2, samples, empty_rate::DECIMAL(18,4) AS empty_rate, CASE WHEN candidate THEN row_number() OVER (PARTITION BY candidate ORDER BY rouge_l DESC, rouge_2 DESC, name) END AS rank,
        CASE WHEN name LIKE 'checkpoint-%' THEN substr(name, 12)::BIGINT ELSE -1 END AS step FROM r""")
def rank_runs(spark, sf_dir):
    """Sources ranked as runs: metrics as JSON documents, predictions as lines. A metric that is no number is 0."""
    run = F.when(F.col("source") == "src0", "final_model").when(F.col("source") == "src1", "base").otherwise(F.concat(F.lit("checkpoint-"), F.substring("source", 4, 9)))
    s = _table(spark, sf_dir, "documents").select("doc_id", "source", run.alias("run")).join(_table(spark, sf_dir, "labels"), "doc_id")
    second = F.when(F.first("source") == "src2", "n/a").otherwise(F.sum("toxic").cast("string"))
    documents = s.groupBy("run").agg(F.to_json(F.create_map(F.lit("predict_rouge-l"), F.sum("quality").cast("string"), F.lit("predict_rouge-2"), second)).alias("document"))
    said = F.to_json(F.struct(F.when(F.expr("doc_id % 7 = 0"), " ").otherwise("x").alias("predict"), F.lit("y").alias("label")))
    rows = ranking.ranked(ranking.collected(documents, s.select("run", F.col("doc_id").alias("line"), said.alias("value"))))
    out = [(r["name"], r["rouge_l"], r["rouge_2"], r["samples"], r["empty_rate"], i if ranking.is_candidate(r) else None, r["step"]) for i, r in enumerate(rows, 1)]
    df = spark.createDataFrame(out, "name string, rouge_l double, rouge_2 double, samples long, empty_rate double, rank long, step long")
    return df.withColumns({n: F.col(n).cast("decimal(18,4)") for n in ("rouge_l", "rouge_2", "empty_rate")})


_DOCUMENT = {"version": 1, "rules": [{"id": i, "enabled": e, "fields": ["description"], "regex": False, "pattern": p, "replacement": "", "reason": ""} for i, e, p in (("a", True, "xx"), ("b", False, "xxxxx"), ("c", True, "yyyy"), ("d", True, "zz"))]}


@query(_values([(1, "c", "yyyy"), (2, "a", "xx"), (3, "d", "zz")], "place, id, pattern"))
def rule_files(spark, sf_dir):
    """Rules from a file: those that are on, longer patterns first, others in their order; written and read again."""
    path = joined(scratch(spark, "rules"), "rules.json")
    sinks.write_document(_DOCUMENT, path)
    held = rules_of(document_of(sources.load_rules(path)))
    return spark.createDataFrame([(i, r.id, r.pattern) for i, r in enumerate(held, 1)], "place long, id string, pattern string")


@query(_values([(1, "布里欧修"), (2, "中种"), (3, "a b")], "place, word"))
def word_files(spark, sf_dir):
    path = joined(scratch(spark, "words"), "words.txt")
    sinks.write_words(["布里欧修", "", "# no word", " 中种 ", "a b"], path, "a note")
    return spark.createDataFrame(list(enumerate(sources.load_protected_words(path), 1)), "place long, word string")
