"""Sinks: JSONL tables, split routes, and small documents that replace their file at once."""

from __future__ import annotations

import csv
import hashlib
import io
import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.sources.files import joined, write_text

FIELDS = ("name", "dish", "description", "recipeIngredient", "recipeInstructions", "keywords")
RAW_CHARS = 2000


def json_line(*columns: Column, nulls: bool = False) -> Column:
    """A struct of the columns as a line of JSON; null fields are left out unless asked for."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": str(not nulls).lower()}).alias("value")


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Lines of `value` as text, gzipped if the path ends in .gz. An existing output is only replaced
    when asked for."""
    writer = lines.select("value").write.mode("overwrite" if overwrite else "errorifexists")
    if path.lower().endswith(".gz"):
        writer = writer.option("compression", "gzip")
    writer.text(path)


def envelopes(routed: DataFrame) -> DataFrame:
    """(route, value): a line of JSON for each record. Clean ones are training rows. Those for review and
    rejected ones carry line, flags, changes and record, for review also the candidate; a line that is
    no JSON comes with its beginning instead."""
    record = F.struct(*FIELDS)
    head = [F.col("line"), F.col("flags"), F.col("changes")]
    none = F.lit(None).cast("struct<name: string>").alias("record")
    raw = F.regexp_replace(F.substring("value", 1, RAW_CHARS), r"(?U)\s+$", "").alias("raw")
    value = (
        F.when(F.col("route") == "clean", json_line("row.*"))
        .when(~F.col("valid"), json_line(F.col("line"), F.col("flags"), raw))
        .when(~F.col("object"), json_line(*[F.col("line"), F.transform("flags", lambda f: F.struct(f["code"].alias("code"), f["detail"].alias("detail"))).alias("flags"), F.col("changes"), none], nulls=True))
        .when(F.col("route") == "review", json_line(*head, record.alias("record"), F.col("row").alias("candidate")))
        .otherwise(json_line(*head, record.alias("record")))
    )
    return routed.select("route", "path", "line", value.alias("value"))


def write_document(document, path: str | Path) -> None:
    """A JSON document that is whole or not there: it is written beside its place and moved."""
    write_text(json.dumps(document, ensure_ascii=False, indent=2) + "\n", path)


def write_words(words: list[str], path: str | Path, header: str) -> None:
    write_text(f"# {header}\n" + "".join(f"{w}\n" for w in words), path)


def hashed(lines: DataFrame, *order: str) -> tuple[str, int, int]:
    """The SHA-256 of the lines of `value` by `order`, the number of these lines, and that of rows. A null
    is a row without a line. Such a hash has no parts: each line changes the state that the next one
    needs. So one task takes all of them, sorted and streamed, and only the result reaches the driver;
    everything before that is distributed."""

    def one(batches):
        h, n, rows = hashlib.sha256(), 0, 0
        for batch in batches:
            rows += batch.num_rows
            for line in batch.column("_line").to_pylist():
                if line is not None:
                    h.update(line)
                    n += 1
        yield pa.RecordBatch.from_pydict({"digest": [h.hexdigest()], "n": [n], "rows": [rows]})

    line = F.concat(F.rtrim("value", F.lit("\r\n")), F.lit("\n")).cast("binary")
    ordered = lines.select(*order, line.alias("_line")).repartition(1).sortWithinPartitions(*order)
    found = ordered.select("_line").mapInArrow(one, "digest string, n long, rows long").first()
    return tuple(found) if found else (hashlib.sha256().hexdigest(), 0, 0)


def content_sha256(lines: DataFrame, *order: str) -> str:
    """SHA-256 of the lines of `value` by `order`."""
    return hashed(lines, *order)[0]


def write_ranking(rows: list[dict], root: str | Path) -> None:
    """Ranked runs (see ranking.ranked) as JSON, CSV and Markdown, and the path of the best one."""
    from millrace.operators.ranking import is_candidate

    write_document(rows, joined(root, "checkpoint_ranking.json"))
    table = io.StringIO(newline="")
    out = csv.DictWriter(table, list(rows[0]))
    out.writeheader()
    out.writerows(rows)
    write_text(table.getvalue(), joined(root, "checkpoint_ranking.csv"))
    columns = [("ROUGE-L", "rouge_l", ".4f"), ("ROUGE-2", "rouge_2", ".4f"), ("BLEU-4", "bleu_4", ".4f"), ("食谱格式率", "recipe_format_rate", ".2f"), ("编号步骤率", "numbered_steps_rate", ".2f"), ("思考泄漏率", "thinking_leak_rate", ".2f"), ("长度比", "median_length_ratio", ".3f")]
    lines = ["# 评估排名", "", "| 排名 | 名称 | " + " | ".join(c for c, *_ in columns) + " |", "| ---: | --- |" + " ---: |" * len(columns)]
    for i, r in enumerate(rows, 1):
        cells = [f"{r[k]:{f}}" + ("%" if k.endswith("_rate") else "") for _, k, f in columns]
        lines.append(f"| {i if is_candidate(r) else '基线'} | {r['name']} | " + " | ".join(cells) + " |")
    write_text("\n".join(lines) + "\n", joined(root, "evaluation_report.md"))
    if is_candidate(rows[0]):
        write_text(str(rows[0]["checkpoint_path"] or rows[0]["name"]) + "\n", joined(root, "best_checkpoint.txt"))
