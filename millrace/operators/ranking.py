"""Ranking of evaluation runs by their metrics and the structure of their predictions."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions.text import any_of, is_blank
from millrace.functions.variant import strict_json
from millrace.sources.lines import checkpoint_step

_THINKS = r"(?iuU)</?think>|" + any_of("推理过程", "思考过程")
_NUMBERED = r"(?mdU)^\s*" + any_of(r"\d+[、.)]", r"第[一二三四五六七八九十百\d]+步")
_NEEDS = r"(?dU)(?:^|\n)\s*" + any_of("原料", "材料", "食材") + r"\s*[:：]"
_STEPS = r"(?dU)(?:^|\n)\s*" + any_of("做法", "步骤", "制作步骤") + r"\s*[:：]"
METRICS = {"bleu_4": "predict_bleu-4", "rouge_1": "predict_rouge-1", "rouge_2": "predict_rouge-2", "rouge_l": "predict_rouge-l", "samples_per_second": "predict_samples_per_second"}


def thinks(c: Column) -> Column:
    return c.rlike(_THINKS)


def is_numbered(c: Column) -> Column:
    return c.rlike(_NUMBERED)


def is_formatted(c: Column) -> Column:
    return c.rlike(_NEEDS) & c.rlike(_STEPS)


def safe_float(c: Column) -> Column:
    """A number, or 0 for what is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def structure(predictions: DataFrame) -> DataFrame:
    """(run, samples, empty, formatted, numbered, thinking, mean, median) of (run, predict, label)."""
    ratio = F.length("predict") / F.greatest(F.length("label"), F.lit(1))
    yes = lambda c: F.count_if(c)
    p = F.col("predict")
    return predictions.groupBy("run").agg(
        F.count("*").alias("samples"), yes(is_blank(p)).alias("empty"), yes(is_formatted(p)).alias("formatted"), yes(is_numbered(p)).alias("numbered"), yes(thinks(p)).alias("thinking"),
        F.avg(ratio).alias("mean"), F.median(ratio).alias("median"),
    )


def predictions_of(lines: DataFrame) -> DataFrame:
    """(run, predict, label) of the non-blank lines (run, line, value); a value that is no string is
    taken as it is written. A line that is no JSON object is an error."""
    df = lines.where(~is_blank(F.col("value"))).withColumn("v", strict_json(F.col("value")))
    bad = df.where(F.col("v").isNull()).select("run", "line").first()
    if bad:
        raise ValueError(f"line {bad.line} of {bad.run} is no JSON")
    return df.select("run", *[F.coalesce(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")).alias(n) for n in ("predict", "label")])


def collected(documents: DataFrame, lines: DataFrame, present: set[str] = frozenset()) -> list[dict]:
    """A row for each run that has metrics and predictions, in the order of their names. present: runs
    with a file of predictions; if it is empty, that is an error. The rates are rounded here: rounding
    in SQL goes by decimals and differs in the last place."""
    own = {r.run: r.document for r in documents.collect()}
    found = {r.run: r for r in structure(predictions_of(lines)).collect()}
    out = []
    for run in sorted(own):
        if run not in found and run in present:
            raise ValueError(f"the predictions of {run} are empty")
        if run not in found:
            warnings.warn(f"{run} has no predictions and is left out", stacklevel=2)
            continue
        r = found[run]
        m = json.loads(own[r.run])

        def number(x) -> float:
            try:
                return float(x)
            except (TypeError, ValueError):
                return 0.0

        rate = lambda n: round(n * 100 / r.samples, 4)
        out.append({
            "name": r.run, "step": checkpoint_step(r.run), "checkpoint_path": m.get("checkpoint_path") or "", **{k: round(number(m.get(v)), 4) for k, v in METRICS.items()},
            "samples": r.samples, "empty_rate": rate(r.empty), "recipe_format_rate": rate(r.formatted), "numbered_steps_rate": rate(r.numbered), "thinking_leak_rate": rate(r.thinking),
            "mean_length_ratio": round(r.mean, 4), "median_length_ratio": round(r.median, 4),
        })
    return out


def is_candidate(row: dict) -> bool:
    return row["name"] == "final_model" or row["step"] > -1


RANK = ("rouge_l", "rouge_2", "recipe_format_rate", "bleu_4")


def ranked(rows: list[dict]) -> list[dict]:
    """Candidates, the best first, ties by name; then the baselines, which have no rank."""
    best = sorted((r for r in rows if is_candidate(r)), key=lambda r: tuple(-r[k] for k in RANK))
    return best + [r for r in rows if not is_candidate(r)]


def with_rank(runs: DataFrame, by: list[str], name: str) -> DataFrame:
    """runs with their `rank` by columns in descending order, ties by name."""
    return runs.withColumn("rank", F.row_number().over(W.orderBy(*[F.desc(c) for c in by], F.asc(name))))

