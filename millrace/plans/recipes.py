"""The plans behind the commands: clean, audit, bootstrap, sample, convert, holdout, rank, run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace import __version__
from millrace.functions.variant import records, strict_json
from millrace.operators import audit as audits, base_rules, mining, ranking
from millrace.operators.anomalies import LEAST, MOST, anomalies
from millrace.operators.holdout import FIELDS, holdout, training_rows
from millrace.operators.recipe import Rulebook, cleaned, converted, slim, training_row
from millrace.operators.route import CLEAN, REJECTED, REVIEW, deduplicated, routed
from millrace.operators.sampling import kept_in_reservoir, selected, taking, with_ordinal
from millrace.operators.rules import document_of
from millrace.session import checkpointed, prepared, sealed
from millrace.sources import lines as sources, sinks
from millrace.sources.files import joined

ORDER = ["path", "line"]
#: What the cleaning always does, as the report says it.
POLICY = (
    "flagged_records_are_routed_to_review", "animal_age_duration_exemption", "generic_title_checks", "ingredient_media_cleanup", "inline_media_deictic_cleanup",
    "semantic_low_information_checks", "context_aware_duration_checks",
)
BUILT_IN = "built-in"
NOTES = {"occurrence_or_application_counts": "同一食谱内的多次命中分别计数", "record_counts": "每条食谱的同类问题或规则最多计数一次"}


def rulebook(typos: str | None = None, noise: str | None = None, words: str | None = None) -> Rulebook:
    """A rulebook with what the files hold, or else with what comes with the engine."""
    book = Rulebook()
    if typos:
        book.typos = sources.load_rules(typos)
    if noise:
        book.noise = sources.load_rules(noise)
    if words:
        book.protected = sources.load_protected_words(words)
    return book


def _limited(text: DataFrame, limit: int | None) -> DataFrame:
    """The rows with the first `limit` ordinals."""
    return text.where(F.col("ordinal") <= limit) if limit else text


def cleaning(text: DataFrame, book: Rulebook, deduplicate: bool = True) -> DataFrame:
    """Non-blank lines as routed records, with the training row of each. One shuffle, on the dedup key."""
    df = routed(anomalies(cleaned(records(text), book)))
    df = deduplicated(df) if deduplicate else sealed(df)
    return df.withColumn("row", F.when(F.col("route").isin(CLEAN, REVIEW), training_row(F.col("name"), F.col("output"))))


def _counts(df: DataFrame) -> dict:
    issues, rules = audits.issue_counts(df).collect(), audits.rule_counts(df).collect()

    def table(rows, key: str, value: str) -> dict:
        return {r[key]: r[value] for r in sorted(rows, key=lambda r: (-r[value], r[key]))}

    return {
        "issue_counts": table(issues, "code", "records"), "issue_record_counts": table(issues, "code", "records"), "issue_occurrence_counts": table(issues, "code", "occurrences"),
        "rule_record_counts": table(rules, "rule", "records"), "rule_application_counts": table(rules, "rule", "applications"), "counting_notes": NOTES,
    }


def clean(spark: SparkSession, input: str, output: str, review: str, rejected: str, report: str, book: Rulebook | None = None, deduplicate: bool = True, target_count: int | None = None, selection_seed: int = 20260722, scan_limit: int | None = None, overwrite: bool = False, rules: dict[str, str | None] | None = None, source: sources.Input | None = None) -> dict:
    """Cleans a corpus of JSONL into training rows, rows for review and rejected ones, and reports.
    rules: where the rules come from, for the report; source: the input, if it has been counted."""
    if len({output, review, rejected, report, input}) < 5:
        raise ValueError("input, output, review, rejected and report must be five different paths")
    for name, n in (("target_count", target_count), ("scan_limit", scan_limit)):
        if n is not None and n <= 0:
            raise ValueError(f"{name} must be positive")
    source = source or sources.Input(spark, input)
    df = checkpointed(cleaning(_limited(source.text(), scan_limit).drop("ordinal"), book or Rulebook(), deduplicate))
    found = audits.summary(df).first().asDict()
    lines = checkpointed(sinks.envelopes(df))
    kept = lines.where(F.col("route") == CLEAN)
    found["blank_lines"] = source.counts["blank"]
    if target_count is not None:
        kept = taking(with_ordinal(kept, ORDER), selected(found["eligible"], target_count, selection_seed))
        found["clean"] = min(target_count, found["eligible"])
        found["not_selected"] = found["eligible"] - found["clean"]
    else:
        found["clean"] = found["eligible"]
    sinks.write_lines(kept.orderBy(*ORDER), output, overwrite)
    for route, path in ((REVIEW, review), (REJECTED, rejected)):
        sinks.write_lines(lines.where(F.col("route") == route).orderBy(*ORDER), path, overwrite)
    document = {
        "pipeline_version": __version__, "input": input, "output": output, "summary": {k: v for k, v in found.items() if v}, **_counts(df),
        "selection": {"requested": target_count, "selected": found["clean"], "seed": selection_seed if target_count is not None else None, "stage": "after_cleaning_validation_and_deduplication"},
        "quality_policy": {"max_output_chars": MOST, "min_output_chars": LEAST, "unicode_normalization": "NFC"} | dict.fromkeys(POLICY, True),
        "rules": {n: (rules or {}).get(n) or BUILT_IN for n in ("protected_words", "noise", "typo")},
    }
    sinks.write_document(document, report)
    return document


def audit(spark: SparkSession, input: str, report: str, book: Rulebook | None = None, examples: int = 5, limit: int | None = None, source: sources.Input | None = None) -> dict:
    """Counts issues and rules without writing records. Duplicates count as clean."""
    source = source or sources.Input(spark, input)
    text = source.text()
    if limit:
        # the first `limit` rows hold the place of the limit, or all valid ones before it
        stop = audits.audit_stop(text.withColumn("valid", strict_json(F.col("value")).isNotNull()), limit)
        text = text.where(F.col("ordinal") <= stop) if stop else text
    text = text.drop("ordinal")
    df = checkpointed(cleaning(text, book or Rulebook(), deduplicate=False))
    found = audits.summary(df).first().asDict()
    found |= {"clean": found.pop("eligible"), "blank_lines": source.counts["blank"]}

    def grouped(rows, key: str) -> dict:
        out: dict = {}
        for r in rows.collect():
            out.setdefault(r[key], []).append({k: v for k, v in r.asDict().items() if k not in (key, "nth")})
        return out

    document = {"pipeline_version": __version__, "input": input, "summary": {k: v for k, v in found.items() if v}, **_counts(df), "rule_examples": grouped(audits.rule_examples(df, examples), "rule"), "examples": grouped(audits.issue_examples(df, examples), "code")}
    sinks.write_document(document, report)
    return document


def bootstrap(spark: SparkSession, input: str, output_dir: str, sample_size: int = 100_000, seed: int = 20260722, min_typo_count: int = 3, min_protected_count: int = 10, min_ingredient_protected_count: int = 30, scan_limit: int | None = None, base_typos: str | None = None, base_words: str | None = None, canonical_terms: str | None = None, confusion_map: str | None = None, source: sources.Input | None = None) -> dict:
    """Mines rules and protected words from a reservoir of the valid records, and writes both."""
    if min(sample_size, min_typo_count, min_protected_count, min_ingredient_protected_count) <= 0:
        raise ValueError("sizes and thresholds must be positive")
    source = source or sources.Input(spark, input, parsed=True)
    if scan_limit:  # what is scanned is bounded, so it can be numbered by itself
        raw = checkpointed(records(_limited(source.text(), scan_limit).drop("ordinal")))
        scan = raw.agg(F.count("*").alias("scanned"), F.count_if(~F.col("valid")).alias("invalid"), F.count_if("object").alias("valid")).first().asDict()
        numbered = with_ordinal(slim(raw).drop("value"), ORDER)
    else:
        n = source.counts
        scan = {"scanned": n["text"], "invalid": n["text"] - n["valid"], "valid": n["object"]}
        numbered = source.objects()
    taken = taking(numbered, kept_in_reservoir(scan["valid"], sample_size, seed))
    sample = checkpointed(taken if scan_limit else slim(records(taken)).drop("value"))
    scan |= {"blank": source.counts["blank"], "sampled": min(sample_size, scan["valid"])}
    base = sources.load_rules(base_typos) if base_typos else list(base_rules.TYPOS)
    terms = {t["term"]: t["fields"] for t in sources.load_json(canonical_terms)["terms"]} if canonical_terms else None
    confused = sources.load_json(confusion_map)["characters"] if confusion_map else None
    rules, typos, variants = mining.mined_rules(sample, base, terms, confused, min_typo_count)
    words, protected = mining.mined_words(sample, sources.load_protected_words(base_words) if base_words else None, variants, min_protected_count, min_ingredient_protected_count)
    paths = {"typo_rules": joined(output_dir, "typo_rules.generated.json"), "protected_words": joined(output_dir, "protected_words.generated.txt")}
    sinks.write_document(document_of(rules), paths["typo_rules"])
    sinks.write_words(words, paths["protected_words"], "基础保护词与随机样本高频词的合并结果。")
    document = {
        "pipeline_version": __version__, "input": input, "scan": {k: v for k, v in scan.items() if v},
        "parameters": {"sample_size": sample_size, "seed": seed, "min_typo_count": min_typo_count, "min_protected_count": min_protected_count, "min_ingredient_protected_count": min_ingredient_protected_count},
        "typo_candidates": typos, "generated_typo_rules": sum(t["promoted"] for t in typos), "generated_protected_words": len(protected), "protected_word_candidates": protected, "outputs": paths,
    }
    sinks.write_document(document, joined(output_dir, "bootstrap_report.json"))
    return document


def sample(spark: SparkSession, input: str, output: str, report: str, size: int = 100_000, seed: int = 20260810, overwrite: bool = False) -> dict:
    """Exactly `size` lines in uniform selection and source order, or all if there are fewer."""
    source = sources.Input(spark, input)
    n, blank = source.counts["text"], source.counts["blank"]
    if not n:
        raise ValueError("the input is empty")
    taken = checkpointed(taking(source.text(), selected(n, size, seed)).drop("slot"))
    bad = training_rows(taken, strip=False).where(F.col("instruction").isNull()).orderBy(*ORDER).select("line").first()
    if bad:
        raise ValueError(f"line {bad.line} is no training row")
    ordered = taken.orderBy(*ORDER)
    sinks.write_lines(ordered, output, overwrite)
    document = {
        "pipeline_version": __version__, "source": input, "output": output, "source_total_lines": n + blank, "source_nonempty_records": n, "source_blank_lines": blank,
        "requested_sample_size": size, "selected_records": min(size, n), "seed": seed, "algorithm": "two_pass_sequential_uniform_selection", "content_sha256": sinks.content_sha256(taken, *ORDER),
    }
    sinks.write_document(document, report)
    return document


def convert(spark: SparkSession, input: str, output: str, errors: str | None = None, limit: int | None = None, overwrite: bool = False) -> dict:
    """Converts records that have all parts, without rules; at most `limit` rows are written."""
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    if input == output:
        raise ValueError("the output must not be the input")
    raw = records(sources.Input(spark, input).text().drop("ordinal"))
    rows = converted(raw)
    last = None
    if limit:
        rows = checkpointed(rows.orderBy(*ORDER).limit(limit))
        if rows.count() == limit:
            last = rows.orderBy(F.desc("path"), F.desc("line")).first()
    seen = raw.where((F.col("path") < last.path) | ((F.col("path") == last.path) & (F.col("line") <= last.line))) if last else raw
    found = seen.agg(F.count("*").alias("read"), F.count_if(~F.col("valid")).alias("invalid")).first().asDict()
    sinks.write_lines(rows.orderBy(*ORDER).select(sinks.json_line(*FIELDS)), output, overwrite)
    if errors:
        sinks.write_lines(seen.where(~F.col("valid")).orderBy(*ORDER), errors, overwrite)
    return found | {"written": rows.count()}


def prepare_holdout(spark: SparkSession, source: str, train: str, output: str, report: str, count: int = 1000, seed: int = 20260811, overwrite: bool = True) -> dict:
    """An evaluation set of `count` rows of source that train doesn't have."""
    if count <= 0:
        raise ValueError("count must be positive")
    rows, document = holdout(sources.Input(spark, source).text(), sources.Input(spark, train).text(), count, seed)
    lines = checkpointed(rows.select("digest", sinks.json_line(*FIELDS))).orderBy("digest")
    sinks.write_lines(lines, output, overwrite)
    document = {"source_file": source, "train_file": train, "output_file": output, **document, "output_sha256": sinks.content_sha256(lines, "digest"), "disjoint_rule": "no two rows share a BLAKE2b-128 of their three stripped fields"}
    sinks.write_document(document, report)
    return document


def rank(spark: SparkSession, root: str) -> list[dict]:
    """Ranks the runs below root and writes the ranking beside them."""
    rows = ranking.ranked(ranking.collected(*sources.runs(prepared(spark), root)))
    if not rows:
        raise ValueError(f"no run with metrics and predictions below {root}")
    sinks.write_ranking(rows, root)
    return rows


def run(spark: SparkSession, input: str, output_dir: str = "pipeline_output", sample_size: int = 100_000, seed: int = 20260722, min_typo_count: int = 3, min_protected_count: int = 10, min_ingredient_protected_count: int = 30, with_audit: bool = False, target_count: int | None = None, selection_seed: int = 20260722, scan_limit: int | None = None, overwrite: bool = False) -> dict:
    """Bootstrap, the optional audit, and cleaning with what was mined."""
    source = sources.Input(spark, input, parsed=True)  # counted once, then read to mine and to clean
    at = lambda name: joined(output_dir, name)
    config = at("generated_config")
    mined = bootstrap(spark, input, config, sample_size, seed, min_typo_count, min_protected_count, min_ingredient_protected_count, scan_limit, source=source)
    generated = {"typo": mined["outputs"]["typo_rules"], "protected_words": mined["outputs"]["protected_words"]}
    book = rulebook(typos=generated["typo"], words=generated["protected_words"])
    if with_audit:
        audit(spark, input, at("audit_report.json"), book, limit=scan_limit, source=source)
    paths = {"train": at("recipe_train_clean.jsonl"), "review": at("recipe_review.jsonl"), "rejected": at("recipe_rejected.jsonl"), "report": at("clean_report.json")}
    document = clean(spark, input, paths["train"], paths["review"], paths["rejected"], paths["report"], book, True, target_count, selection_seed, scan_limit, overwrite, generated, source)
    manifest = {"pipeline_version": __version__, "input": input, "output_dir": output_dir, "generated_config": {**mined["outputs"], "bootstrap_report": joined(config, "bootstrap_report.json")}, "outputs": paths, "requested_target_count": target_count, "selection_seed": selection_seed if target_count is not None else None}
    sinks.write_document(manifest, at("manifest.json"))
    return manifest | {"summary": document["summary"]}
