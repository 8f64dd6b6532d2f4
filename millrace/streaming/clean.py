"""Cleaning of a stream of JSONL. Cleaning looks at one record at a time, so it runs unchanged; exact
deduplication keeps the keys of a watermark's length of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.functions.hashing import content_key
from millrace.functions.text import is_blank
from millrace.functions.variant import records
from millrace.operators.anomalies import anomalies
from millrace.operators.recipe import Rulebook, cleaned
from millrace.operators.route import CLEAN, routed
from millrace.session import prepared, sealed


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(path, line, value, at) of the text files that arrive in a folder; `line` is null, as lines are only
    counted in batches."""
    raw = prepared(spark).readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.lit(None).cast("long").alias("line"), "value", F.col("_metadata.file_modification_time").alias("at"))


def cleaned_stream(lines: DataFrame, book: Rulebook | None = None) -> DataFrame:
    """Routed records of a stream of lines, which keep their time `at`."""
    return routed(anomalies(cleaned(records(lines.where(~is_blank(F.col("value")))), book)))


def first_in_time(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The clean records of a stream, each content once within the watermark."""
    key = content_key(F.col("name"), F.col("recipeIngredient"), F.col("recipeInstructions"))
    clean = sealed(stream).where(F.col("route") == CLEAN).withColumn("key", key)
    return clean.withWatermark("at", delay).dropDuplicatesWithinWatermark(["key"])
