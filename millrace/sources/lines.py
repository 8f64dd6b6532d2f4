"""Text and JSONL sources with exact line numbers, and the small files beside them."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from millrace.functions.text import is_blank
from millrace.functions.variant import is_object, strict_json
from millrace.operators.rules import Rule, rules_of
from millrace.session import checkpointed, prepared
from millrace.sources.files import read_text

TAIL_BYTES = 8 << 20
#: Splits whose counts may be broadcast, some 50 bytes each.
SPLITS = 1_000_000


class Input:
    """A text or JSONL input, plain or gzipped, whose splits are counted once.

    Spark reads a file in splits. The counting scan gives each split its first line number and the
    ordinals of its rows; within a split, rows keep their order. So numbering sorts nothing and shuffles
    no text: the counts are joined by a broadcast, as long as there are at most SPLITS of them.
    counts: lines, blank (of white space only), text (the others), and `valid` (JSON) and `object` of
    these if parsed.
    """

    def __init__(self, spark: SparkSession, path: str, parsed: bool = False) -> None:
        self.raw = prepared(spark).read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
        blank = is_blank(F.col("value"))
        seen = self.raw.withColumn("_blank", blank)
        kinds = {"text": ~F.col("_blank")}
        if parsed:
            seen = seen.withColumn("_v", F.when(~F.col("_blank"), strict_json(F.col("value"))))
            kinds |= {"valid": F.col("_v").isNotNull(), "object": is_object(F.col("_v"))}
        splits = seen.groupBy("path", "at").agg(F.count("*").alias("lines"), F.min("id").alias("first"), *[F.count_if(c).alias(n) for n, c in kinds.items()])
        self.splits = checkpointed(splits)
        found = self.splits.agg(F.count("*").alias("splits"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("lines", *kinds)]).first().asDict()
        self._few = found.pop("splits") <= SPLITS
        self.counts = found | {"blank": found["lines"] - found["text"]}

    def _numbered(self, rows: DataFrame, kind: str) -> DataFrame:
        """(path, line, value, ordinal): ordinal counts from 1 over all files in the order of their paths.
        rows: raw, filtered to one kind of row, with own ids."""
        before = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        part = F.shiftright("first", 33)
        places = self.splits.select(
            "path", "at", "first", before("lines", W.partitionBy("path").orderBy("at")).alias("_line"), before(kind, W.orderBy("path", "at")).alias("_ordinal"),
            # rows of a kind get new ids, from the start of their partition on
            (F.shiftleft(part, 33) + before(kind, W.partitionBy(part).orderBy("first"))).alias("_own"),
        )
        joined = rows.join(F.broadcast(places) if self._few else places, ["path", "at"])
        return joined.select("path", (F.col("_line") + F.col("id") - F.col("first") + 1).alias("line"), "value", (F.col("_ordinal") + F.col("_id") - F.col("_own") + 1).alias("ordinal"))

    def text(self) -> DataFrame:
        """The lines that aren't blank, with their ordinals among these."""
        return self._numbered(self.raw.where(~is_blank(F.col("value"))).withColumn("_id", F.monotonically_increasing_id()), "text")

    def objects(self) -> DataFrame:
        """The lines that are JSON objects, with their ordinals among these."""
        fine = ~is_blank(F.col("value")) & is_object(strict_json(F.col("value")))
        return self._numbered(self.raw.where(fine).withColumn("_id", F.monotonically_increasing_id()), "object")

    def _lines(self) -> DataFrame:
        return self._numbered(self.raw.withColumn("_id", F.col("id")), "lines").drop("ordinal")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of plain or gzipped text; `line` counts from 1 in each file."""
    return Input(spark, path)._lines()


def load_rules(path: str | Path) -> list[Rule]:
    return rules_of(load_json(path))


def load_protected_words(path: str | Path) -> list[str]:
    """One word a line; blank lines and comments are skipped."""
    return [w for w in (x.strip() for x in read_text(path).split("\n")) if w and not w.startswith("#")]


def load_json(path: str | Path, default=None):
    """A JSON document. With a default, also where the file is missing or no JSON."""
    try:
        return json.loads(read_text(path))
    except (OSError, ValueError):
        if default is None:
            raise
        return default


def runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, set[str]]:
    """(run, document) of root/*/metrics.json, (run, line, value) of the predictions beside them, and the
    runs that have a file of these, be it empty."""
    run = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    metrics = spark.read.text(f"{root}/*/metrics.json", wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    every = f"{root}/*/generated_predictions.jsonl"
    files = spark.read.format("binaryFile").load(every).select("path") if metrics.count() else metrics.select("path")
    present = {r.run for r in files.select(run.alias("run")).collect()}
    predictions = lines(spark, every)
    return metrics.select(run.alias("run"), F.col("value").alias("document")), predictions.select(run.alias("run"), "line", "value"), present


def tail(path: str | Path, size: int = TAIL_BYTES) -> str:
    """The last bytes of a log; empty where there is none. Invalid bytes are replaced."""
    p = Path(path)
    if not p.is_file():
        return ""
    with p.open("rb") as f:
        f.seek(max(0, p.stat().st_size - size))
        return f.read().decode("utf-8", "replace")


def latest_log(spark: SparkSession, folder: str, glob: str = "train_*.log") -> str | None:
    """The log that was modified last."""
    if not any(Path(folder).glob(glob)):
        return None
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(str(folder))
    return found.agg(F.max_by("path", "modificationTime")).first()[0]


def checkpoint_step(name: str) -> int:
    """The number of checkpoint-N; -1 for any other name."""
    prefix, _, number = name.partition("-")
    return int(number) if prefix == "checkpoint" and re.fullmatch(r"\d+", number) else -1


def checkpoints(folder: str | Path) -> list[Path]:
    """The checkpoint folders, by their numbers."""
    return sorted((p for p in Path(folder).glob("checkpoint-*") if p.is_dir()), key=lambda p: checkpoint_step(p.name))
