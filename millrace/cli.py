"""Command line: python -m millrace.cli COMMAND ..."""

from __future__ import annotations

import os
import sys
from argparse import ArgumentParser, ArgumentTypeError
from datetime import datetime
from json import dumps
from pathlib import Path

from millrace.operators import diagnosis
from millrace.plans import recipes
from millrace.session import session
from millrace.sources import lines, sinks
from millrace.sources.files import joined


def _positive(text: str) -> int:
    n = int(text)
    if n <= 0:
        raise ArgumentTypeError("must be greater than 0")
    return n


def _numbers(parser: ArgumentParser, kind=int, **defaults: int) -> None:
    for name, value in defaults.items():
        parser.add_argument("--" + name.replace("_", "-"), type=kind, default=value)


def _switches(parser: ArgumentParser, *names: str) -> None:
    for name in names:
        parser.add_argument("--" + name, action="store_true")


def _beside(path: str, suffix: str, ending: str) -> str:
    folder, slash, name = path.rpartition("/")
    return folder + slash + Path(name.removesuffix(".gz")).stem + suffix + ending


def parser() -> ArgumentParser:
    top = ArgumentParser(prog="millrace")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str):
        p = sub.add_parser(name)
        for x in positional:
            p.add_argument(x)
        _numbers(p, progress_every=100_000)  # accepted; Spark reports progress itself
        return p

    def mining(p) -> None:
        p.add_argument("--sample-size", type=_positive, default=100_000)
        _numbers(p, seed=20260722)
        _numbers(p, _positive, min_typo_count=3, min_protected_count=10, min_ingredient_protected_count=30)
        p.add_argument("--scan-limit", type=_positive)

    def rules(p) -> None:
        for x in ("--typo-rules", "--noise-rules", "--protected-words"):
            p.add_argument(x)

    p = command("run", "input")
    p.add_argument("--output-dir", default="pipeline_output")
    mining(p)
    _switches(p, "with-audit")
    p.add_argument("--target-count", type=_positive)
    _numbers(p, selection_seed=20260722)
    _switches(p, "overwrite")
    p = command("bootstrap", "input", "output_dir")
    mining(p)
    for x in ("--base-typo-rules", "--base-protected-words", "--canonical-terms", "--confusion-map"):
        p.add_argument(x)
    p = command("audit", "input", "report")
    rules(p)
    _numbers(p, examples=5)
    p.add_argument("--limit", type=_positive)
    p = command("clean", "input", "output")
    rules(p)
    for x in ("--review", "--rejected", "--report"):
        p.add_argument(x)
    _switches(p, "no-deduplicate")
    p.add_argument("--target-count", type=_positive)
    _numbers(p, selection_seed=20260722)
    p.add_argument("--scan-limit", type=_positive)
    _switches(p, "overwrite")
    p = command("sample")
    p.add_argument("input", nargs="?", default="pipeline_output/recipe_train_clean.jsonl")
    p.add_argument("--output-dir", default="training_sample")
    p.add_argument("--output-name", default="recipe_train_sample.jsonl")
    p.add_argument("--sample-size", type=_positive, default=100_000)
    _numbers(p, seed=20260810)
    _switches(p, "overwrite")
    p = command("convert", "input", "output")
    p.add_argument("--errors")
    p.add_argument("--limit", type=_positive)
    _switches(p, "overwrite")
    p = command("holdout")
    for x, usual in (("source", "pipeline_output/recipe_train_clean.jsonl"), ("train", "training_sample/recipe_train_sample.jsonl"), ("output", "evaluation/recipe_eval_holdout.jsonl"), ("report", "evaluation/eval_holdout_report.json")):
        p.add_argument(f"--{x}", default=usual)
    p.add_argument("--count", type=_positive, default=1000)
    _numbers(p, seed=20260811)
    p = command("rank", "root")
    p = command("status")
    for x in ("--status-file", "--pid-file", "--output-dir", "--log-file"):
        p.add_argument(x)
    p.add_argument("--update-state", choices=("RUNNING", "COMPLETED", "FAILED"), help="write the status file instead of reporting")
    for x in ("--pid", "--exit-code"):
        p.add_argument(x, type=int)
    p.add_argument("--alive", action="store_true", help="the training process is known to run")
    _switches(p, "json")
    return top


def _number(path: str | None) -> int | None:
    """The number in a small file, if there is one."""
    try:
        return int(Path(path).read_text().strip()) if path else None
    except (OSError, ValueError):
        return None


def _alive(pid: int | None) -> bool:
    """Whether a process of this machine runs."""
    try:
        os.kill(int(pid), 0)
    except PermissionError:
        return True
    except (OSError, TypeError, ValueError, OverflowError):
        return False
    return int(pid) > 0


def _record(a) -> int:
    """Writes the state of a run into its status file; what isn't named stays as it was."""
    if not a.status_file:
        raise ValueError("--update-state needs --status-file")
    now = datetime.now().astimezone().isoformat(timespec="seconds")
    begun = a.update_state == "RUNNING"
    old = lines.load_json(a.status_file, {})
    if begun:
        old = {k: v for k, v in old.items() if k not in ("ended_at", "exit_code")}
    fields = {"state": a.update_state, "pid": a.pid, "exit_code": a.exit_code, "log_file": a.log_file, "output_dir": a.output_dir, "updated_at": now, "started_at": now if begun else None, "ended_at": None if begun else now}
    sinks.write_document(diagnosis.updated_status(old, **fields), a.status_file)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "status" and a.update_state:
            return _record(a)
        spark = session()
        if a.command == "run":
            out = recipes.run(spark, a.input, a.output_dir, a.sample_size, a.seed, a.min_typo_count, a.min_protected_count, a.min_ingredient_protected_count, a.with_audit, a.target_count, a.selection_seed, a.scan_limit, a.overwrite)
        elif a.command == "bootstrap":
            out = recipes.bootstrap(spark, a.input, a.output_dir, a.sample_size, a.seed, a.min_typo_count, a.min_protected_count, a.min_ingredient_protected_count, a.scan_limit, a.base_typo_rules, a.base_protected_words, a.canonical_terms, a.confusion_map)
        elif a.command == "audit":
            out = recipes.audit(spark, a.input, a.report, recipes.rulebook(a.typo_rules, a.noise_rules, a.protected_words), a.examples, a.limit)
        elif a.command == "clean":
            out = recipes.clean(
                spark, a.input, a.output, a.review or _beside(a.output, "_review", ".jsonl"), a.rejected or _beside(a.output, "_rejected", ".jsonl"), a.report or _beside(a.output, "_report", ".json"),
                recipes.rulebook(a.typo_rules, a.noise_rules, a.protected_words), not a.no_deduplicate, a.target_count, a.selection_seed, a.scan_limit, a.overwrite,
                {"typo": a.typo_rules, "noise": a.noise_rules, "protected_words": a.protected_words},
            )
        elif a.command == "sample":
            out = recipes.sample(spark, a.input, joined(a.output_dir, a.output_name), joined(a.output_dir, "sample_report.json"), a.sample_size, a.seed, a.overwrite)
        elif a.command == "convert":
            out = recipes.convert(spark, a.input, a.output, a.errors, a.limit, a.overwrite)
        elif a.command == "holdout":
            out = recipes.prepare_holdout(spark, a.source, a.train, a.output, a.report, a.count, a.seed)
        elif a.command == "rank":
            out = recipes.rank(spark, a.root)
        else:
            status = lines.load_json(a.status_file, {}) if a.status_file else {}
            log = a.log_file or status.get("log_file") or (lines.latest_log(spark, str(Path(a.status_file).parent)) if a.status_file else None)
            log = str(log).removeprefix("file:") if log else None
            folder = a.output_dir or status.get("output_dir")
            pid = a.pid or status.get("pid") or _number(a.pid_file)
            found = [str(p) for p in lines.checkpoints(folder)] if folder else []
            out = diagnosis.report(spark, lines.tail(log) if log else "", status | {"pid": pid}, a.alive or _alive(pid), found, status_file=a.status_file, log_file=log, output_dir=folder)
            print(dumps(out, ensure_ascii=False, indent=2) if a.json else diagnosis.readable(out))
            return diagnosis.EXIT.get(out["state"], 3)
    except (OSError, ValueError) as error:
        print(f"错误：{error}", file=sys.stderr)
        return 2 if a.command == "sample" else 1
    print(dumps(out, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
