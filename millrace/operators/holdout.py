"""Evaluation sets that share no row with the training set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.hashing import fingerprint
from millrace.functions.text import stripped
from millrace.functions.variant import strict_json
from millrace.operators.sampling import LISTED, kept_in_reservoir, taking, with_ordinal
from millrace.session import checkpointed

FIELDS = ("instruction", "input", "output")


def _text(v: Column, name: str) -> Column:
    inner = F.try_variant_get(v, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(inner) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))


def training_rows(lines: DataFrame, strip: bool = True) -> DataFrame:
    """lines with the three fields, which are null together where a line is no training row: not JSON,
    no object, a field that is no string, or, when stripped, an empty instruction or output."""
    df = lines.withColumn("_v", strict_json(F.col("value")))
    raw = {n: _text(F.col("_v"), n) for n in FIELDS}
    df = df.withColumns({n: stripped(c) if strip else c for n, c in raw.items()}).drop("_v")
    fine = F.col("instruction").isNotNull() & F.col("input").isNotNull() & F.col("output").isNotNull()
    if strip:
        fine = fine & (F.col("instruction") != "") & (F.col("output") != "")
    return df.withColumn("_fine", fine).withColumns({n: F.when(F.col("_fine"), F.col(n)) for n in FIELDS}).drop("_fine")


def digest() -> Column:
    return fingerprint(*[F.col(n) for n in FIELDS])


def candidates(source: DataFrame, train: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """(digest, path, line, ordinal) of the rows of source that train doesn't have, of equal ones the first,
    and the counts of the report. Each side is read and hashed once; only fingerprints and places are kept."""
    own = checkpointed(training_rows(train).select(digest().alias("digest"), F.col("instruction").isNotNull().alias("fine")))
    trained = own.agg(F.count("*").alias("rows"), F.count_if(~F.col("fine")).alias("bad"), F.count_distinct("digest").alias("unique")).first()
    if trained.bad:
        raise ValueError(f"{trained.bad} training rows are invalid")
    known = own.select("digest").distinct().withColumn("_known", F.lit(True))
    every = training_rows(source).select("path", "line", digest().alias("digest"), F.col("instruction").isNotNull().alias("fine"))
    every = checkpointed(every.join(known, "digest", "left"))
    left = F.col("fine") & F.col("_known").isNull()
    seen = every.agg(F.count("*").alias("rows"), F.count_if("fine").alias("fine"), F.count_if(left).alias("left")).first()
    unique = every.where(left).groupBy("digest").agg(F.min(F.struct("path", "line")).alias("at")).select("digest", "at.path", "at.line")
    numbered = with_ordinal(unique, ["path", "line"])
    eligible = numbered.count()
    return numbered, {
        "train_rows": trained.rows, "train_unique_records": trained.unique, "source_rows": seen.rows, "malformed_or_invalid_rows": seen.rows - seen.fine,
        "excluded_train_overlap_rows": seen.fine - seen.left, "excluded_duplicate_source_rows": seen.left - eligible, "eligible_unique_rows": eligible,
    }


def holdout(source: DataFrame, train: DataFrame, count: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(rows, report). rows: count rows of source that train doesn't have, each once, drawn by a
    reservoir over their order (path, line) and sorted by fingerprint. Both come as non-blank lines.
    Texts are read again only for the rows that are drawn."""
    numbered, report = candidates(source, train)
    eligible = report["eligible_unique_rows"]
    if eligible < count:
        raise ValueError(f"only {eligible} rows are left, {count} were asked for")
    drawn = taking(numbered, kept_in_reservoir(eligible, count, seed)).select("path", "line", "digest")
    rows = training_rows(source.join(F.broadcast(drawn) if count <= LISTED else drawn, ["path", "line"])).select(*FIELDS, "digest").orderBy("digest")
    return rows, {"seed": seed, "requested_count": count, "written_count": count, **report}
