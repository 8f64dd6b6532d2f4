"""The commands from end to end, over files."""

import gzip
import hashlib
import json
import os

import pytest

from millrace import cli
from millrace.functions.variant import records
from millrace.operators import mining, sampling
from millrace.operators.recipe import slim
from millrace.operators.rules import rules_of
from millrace.plans import recipes, registry
from millrace.sources import files, lines as sources

LINES = [v for v, *_ in registry.CASES]


@pytest.fixture
def corpus(tmp_path):
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join([LINES[0], "", *LINES[1:], "  ", "{"]) + "\n", encoding="utf-8")
    return path


def read(path):
    return [json.loads(x) for p in sorted(path.glob("part-*")) for x in (gzip.open(p, "rt", encoding="utf-8") if p.suffix == ".gz" else p.open(encoding="utf-8"))]


def paths(tmp_path, **more):
    return {k: str(tmp_path / v) for k, v in {"output": "clean", "review": "review", "rejected": "rejected", "report": "report.json"}.items()} | more


def test_line_numbers_across_files_and_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"a{i}\r\n" for i in range(1, 2001)))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write("b1\n\nb3")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sources.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 2003
    assert all(r.value in ("", f"{'ab'['b.jsonl' in r.path]}{r.line}") for r in got)
    source = sources.Input(spark, str(tmp_path))
    assert source.counts == {"lines": 2003, "text": 2002, "blank": 1} and source.text().count() == 2002


def test_clean_routes_reports_and_refuses_to_overwrite(spark, corpus, tmp_path):
    report = recipes.clean(spark, str(corpus), **paths(tmp_path))
    want = {r: sum(x == r for _, x, *_ in registry.CASES) for r in ("clean", "duplicate", "review", "rejected")}
    s = report["summary"]
    assert (s["read"], s["blank_lines"], s["clean"], s["duplicates"], s["review"], s["rejected"]) == (31, 2, want["clean"], want["duplicate"], want["review"], want["rejected"] + 1)
    assert s["read"] == s["eligible"] + s["duplicates"] + s["review"] + s["rejected"]
    clean, review, rejected = (read(tmp_path / n) for n in ("clean", "review", "rejected"))
    assert len(clean) == s["clean"] and set(clean[0]) == {"instruction", "input", "output"} and clean[0]["input"] == ""
    assert clean[0]["output"].startswith("简介：家常菜\n\n食材：\n- 500克五花肉\n") and "1. 把五花肉洗净切块焯水" in clean[0]["output"]
    assert all({"line", "flags", "changes", "record", "candidate"} == set(r) for r in review)
    kinds = {r["flags"][0]["code"]: r for r in rejected}
    assert set(kinds["invalid_json"]) == {"line", "flags", "raw"} and kinds["not_object"]["record"] is None and "candidate" not in kinds["missing_name"]
    assert kinds["invalid_json"]["line"] in (30, 33) and report["issue_record_counts"]["invalid_json"] == 2
    assert report["issue_occurrence_counts"]["temperature"] == 2 and report["issue_record_counts"]["temperature"] == 1
    assert report["rule_application_counts"]["repair_ingredient_order"] == 2 and report["rule_record_counts"]["repair_ingredient_order"] == 1
    with pytest.raises(Exception, match="(?i)already exists"):
        recipes.clean(spark, str(corpus), **paths(tmp_path))
    with pytest.raises(ValueError):
        recipes.clean(spark, str(corpus), **paths(tmp_path, review=str(tmp_path / "clean")))


def test_target_counts_limits_and_gzip(spark, corpus, tmp_path):
    a = recipes.clean(spark, str(corpus), **paths(tmp_path, output=str(tmp_path / "c.jsonl.gz")), target_count=3, selection_seed=5)
    assert a["summary"]["clean"] == 3 == len(read(tmp_path / "c.jsonl.gz")) and a["selection"]["seed"] == 5
    b = recipes.clean(spark, str(corpus), **paths(tmp_path), scan_limit=2, deduplicate=False, overwrite=True)
    assert (b["summary"]["read"], b["summary"]["clean"], "duplicates" in b["summary"]) == (2, 2, False)


def test_audit_counts_examples_and_its_odd_limit(spark, corpus, tmp_path):
    a = recipes.audit(spark, str(corpus), str(tmp_path / "a.json"), examples=1)
    assert a["summary"]["clean"] == sum(r in ("clean", "duplicate") for _, r, *_ in registry.CASES)
    assert all(len(v) == 1 for v in a["examples"].values()) and a["examples"]["invalid_json"][0]["line"] == 30
    assert a["rule_examples"]["repair_ingredient_order"][0] == {"line": 4, "name": "红烧肉", "field": "recipeIngredient", "count": 1}
    bad = tmp_path / "bad.jsonl"
    bad.write_text("\n".join([LINES[0], "{", LINES[2], LINES[3]]), encoding="utf-8")
    assert recipes.audit(spark, str(bad), str(tmp_path / "b.json"), limit=2)["summary"]["read"] == 3
    assert recipes.audit(spark, str(bad), str(tmp_path / "b.json"), limit=1)["summary"]["read"] == 1


def test_bootstrap_mines_rules_and_words(spark, tmp_path):
    rows = [json.dumps({"name": f"菜{i}", "dish": "糖醋排骨", "recipeIngredient": ["五花肉500克", "耗油一勺", "少许绰水盐"], "recipeInstructions": ["绰水后绰水再切快", "腌制"]}, ensure_ascii=False) for i in range(4)]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join([*rows, "[1]", "{", ""]), encoding="utf-8")
    got = recipes.bootstrap(spark, str(path), str(tmp_path / "config"), min_protected_count=4, min_ingredient_protected_count=3)
    assert got["scan"] == {"scanned": 6, "invalid": 1, "valid": 4, "sampled": 4} | ({"blank": got["scan"]["blank"]} if "blank" in got["scan"] else {})
    found = {c["variant"]: (c["sample_count"], c["promoted"]) for c in got["typo_candidates"]}
    assert found == {"绰水": (8, True), "耗油": (4, True), "切快": (4, True)}
    rules = rules_of(json.loads((tmp_path / "config/typo_rules.generated.json").read_text(encoding="utf-8")))
    assert {"绰水", "耗油", "切快", "抄水"} <= {r.pattern for r in rules} and all(r.id.startswith(("typo_", "auto_")) for r in rules)
    words = sources.load_protected_words(tmp_path / "config/protected_words.generated.txt")
    assert words[:6] == list(registry.base_rules.PROTECTED) and "糖醋排骨" in words and "五花肉" in words and not any("绰水" in w for w in words)


def test_mining_excludes_words_with_any_variant_found(spark):
    df = spark.createDataFrame([("p", 1, json.dumps({"name": "a", "dish": "耗油生菜", "recipeIngredient": ["耗油"], "recipeInstructions": []}, ensure_ascii=False))], "path string, line long, value string")
    sample = slim(records(df))
    _, found, variants = mining.mined_rules(sample, least=3)
    assert [c["promoted"] for c in found] == [False] and variants == {"耗油"}
    assert mining.mined_words(sample, [], variants, 1, 1)[0] == []
    assert set(mining.mined_words(sample, [], set(), 1, 1)[0]) == {"耗油生菜", "耗油"}


def row(i):
    return json.dumps({"instruction": f"q{i}", "input": "", "output": f"a{i}"}, ensure_ascii=False)


def test_sample_is_exact_ordered_and_hashed(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join([row(i) for i in range(50)] + ["", row(50)]), encoding="utf-8")
    got = recipes.sample(spark, str(path), str(tmp_path / "s"), str(tmp_path / "r.json"), 20, 11)
    kept = [r["instruction"] for r in read(tmp_path / "s")]
    want = [f"q{o - 1}" for o in sampling.selection(51, 20, 11)]
    assert kept == want and got["source_blank_lines"] == 1 and got["selected_records"] == 20
    assert got["content_sha256"] == hashlib.sha256("".join(row(int(k[1:])) + "\n" for k in want).encode()).hexdigest()
    (tmp_path / "bad.jsonl").write_text('{"instruction": 1}\n')
    with pytest.raises(ValueError, match="no training row"):
        recipes.sample(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "s2"), str(tmp_path / "r2.json"))


def test_holdout_shares_nothing_with_training(spark, tmp_path):
    source, train = tmp_path / "source.jsonl", tmp_path / "train.jsonl"
    source.write_text("\n".join([*(row(i) for i in range(40)), row(3), row(30), '{"instruction": " q39 ", "input": "", "output": "a39"}', "{", '{"instruction": "x", "input": "", "output": " "}']), encoding="utf-8")
    train.write_text("\n".join(row(i) for i in range(10)), encoding="utf-8")
    got = recipes.prepare_holdout(spark, str(source), str(train), str(tmp_path / "h"), str(tmp_path / "r.json"), 12, 4)
    counts = [got[k] for k in ("source_rows", "malformed_or_invalid_rows", "excluded_train_overlap_rows", "excluded_duplicate_source_rows", "eligible_unique_rows", "train_rows")]
    assert counts == [45, 2, 11, 2, 30, 10]
    kept = [r["instruction"] for r in read(tmp_path / "h")]
    assert sorted(kept) == sorted(f"q{o + 9}" for o in sampling.reservoir(30, 12, 4))
    order = [hashlib.blake2b(json.dumps({"input": "", "instruction": k, "output": "a" + k[1:]}, separators=[",", ":"], ensure_ascii=False).encode(), digest_size=16).hexdigest() for k in kept]
    assert order == sorted(order)
    with pytest.raises(ValueError, match="only 30 rows"):
        recipes.prepare_holdout(spark, str(source), str(train), str(tmp_path / "h2"), str(tmp_path / "r.json"), 31, 4)


def test_convert_writes_up_to_its_limit(spark, corpus, tmp_path):
    got = recipes.convert(spark, str(corpus), str(tmp_path / "out"), str(tmp_path / "bad"), limit=3)
    assert got == {"read": 3, "invalid": 0, "written": 3} and len(read(tmp_path / "out")) == 3
    got = recipes.convert(spark, str(corpus), str(tmp_path / "out2"), str(tmp_path / "bad2"))
    assert (got["read"], got["invalid"]) == (31, 2)
    assert sum(1 for p in (tmp_path / "bad2").glob("part-*") for _ in p.open()) == 2


def test_ranking(spark, tmp_path, capsys):
    good = "食材：\n- 肉\n\n制作步骤：\n1. 切"
    for run, rouge, said in (("checkpoint-10", 0.5, [good, ""]), ("checkpoint-9", 0.5, [good, good]), ("base", 0.9, ["<think>x"]), ("final_model", "n/a", [good]), ("checkpoint-1", 0.1, None)):
        (tmp_path / run).mkdir()
        (tmp_path / run / "metrics.json").write_text(json.dumps({"predict_rouge-l": rouge, "checkpoint_path": f"/c/{run}"}))
        if said is not None:
            (tmp_path / run / "generated_predictions.jsonl").write_text("\n".join(json.dumps({"predict": p, "label": "xx"}) for p in said) + "\n\n")
    assert cli.main(["rank", str(tmp_path)]) == 0
    rows = json.loads((tmp_path / "checkpoint_ranking.json").read_text())
    assert [r["name"] for r in rows] == ["checkpoint-9", "checkpoint-10", "final_model", "base"]
    assert (rows[1]["empty_rate"], rows[1]["recipe_format_rate"], rows[1]["step"], rows[1]["median_length_ratio"]) == (50.0, 50.0, 10, round(len(good) / 4, 4))
    assert rows[3]["thinking_leak_rate"] == 100.0 and rows[2]["rouge_l"] == 0.0
    assert (tmp_path / "best_checkpoint.txt").read_text() == "/c/checkpoint-9\n"
    (tmp_path / "base" / "generated_predictions.jsonl").write_text("\n")
    assert cli.main(["rank", str(tmp_path)]) == 1
    assert "| 基线 | base |" in (tmp_path / "evaluation_report.md").read_text(encoding="utf-8") and (tmp_path / "checkpoint_ranking.csv").read_text().count("\n") == 5


def test_status_of_a_run(spark, tmp_path, capsys):
    (tmp_path / "s.json").write_text(json.dumps({"state": "RUNNING", "pid": 2**22 + 5}))
    (tmp_path / "train_1.log").write_text(" 50%|#  | 2/4 [\nTraceback (most recent call last)\nKeyError: 'x'\n")
    for n in (20, 3):
        (tmp_path / f"checkpoint-{n}").mkdir()
    assert cli.main(["status", "--status-file", str(tmp_path / "s.json"), "--output-dir", str(tmp_path), "--json"]) == 2
    got = json.loads(capsys.readouterr().out)
    assert (got["state"], got["progress"], got["checkpoint_count"], got["latest_checkpoint"], got["error_category"], got["error_detail"]) == ("UNEXPECTED_STOP", {"percent": 50, "step": 2, "total_steps": 4}, 2, str(tmp_path / "checkpoint-20"), "Python 运行异常", "KeyError: 'x'")
    assert cli.main(["status", "--status-file", str(tmp_path / "s.json"), "--alive"]) == 0
    assert cli.main(["status"]) == 3
    assert "状态：没有状态" in capsys.readouterr().out
    at = str(tmp_path / "t.json")
    assert cli.main(["status", "--update-state", "RUNNING", "--status-file", at, "--pid", str(os.getpid())]) == 0
    assert cli.main(["status", "--status-file", at, "--json"]) == 0 and json.loads(capsys.readouterr().out)["pid_alive"]
    assert cli.main(["status", "--update-state", "FAILED", "--status-file", at, "--exit-code", "137"]) == 0
    assert cli.main(["status", "--status-file", at]) == 2
    held = json.loads((tmp_path / "t.json").read_text())
    assert (held["state"], held["exit_code"], held["pid"]) == ("FAILED", 137, os.getpid()) and held["started_at"] <= held["ended_at"]


def test_whole_pipeline_by_the_command(spark, corpus, tmp_path, capsys):
    out = tmp_path / "out"
    assert cli.main(["run", str(corpus), "--output-dir", str(out), "--sample-size", "10", "--with-audit", "--target-count", "4"]) == 0
    manifest = json.loads((out / "manifest.json").read_text(encoding="utf-8"))
    assert manifest["requested_target_count"] == 4 and len(read(out / "recipe_train_clean.jsonl")) == 4
    assert (out / "audit_report.json").exists() and (out / "generated_config/bootstrap_report.json").exists()
    with pytest.raises(Exception, match="(?i)already exists"):
        cli.main(["run", str(corpus), "--output-dir", str(out)])


def test_stream_cleans_what_arrives(spark, tmp_path):
    from millrace.streaming.clean import arriving, cleaned_stream, first_in_time

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(LINES[:8]), encoding="utf-8")
    stream = first_in_time(cleaned_stream(arriving(spark, str(folder)))).select("name", "route", "output")
    run = stream.writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("arrived").collect()
    assert len(got) == sum(r == "clean" for _, r, *_ in registry.CASES[:8]) and {r.route for r in got} == {"clean"}


def scanned(spark) -> int:
    """Rows that scans of text have given so far."""
    store, total = spark._jsparkSession.sharedState().statusStore(), 0
    every = store.executionsList()
    for i in range(every.size()):
        at = every.apply(i).executionId()
        nodes, values = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for k in range(nodes.size()):
            if nodes.apply(k).name().startswith("Scan text"):
                metrics = nodes.apply(k).metrics()
                for m in range(metrics.size()):
                    if metrics.apply(m).name() == "number of output rows":
                        got = values.get(metrics.apply(m).accumulatorId())
                        total += int(got.get().replace(",", "")) if got.isDefined() else 0
    return total


def test_a_run_reads_its_input_three_times(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("\n".join([LINES[i % len(LINES)] for i in range(300)] + ["", "{"]) + "\n", encoding="utf-8")
    before = scanned(spark)
    recipes.run(spark, str(path), str(tmp_path / "out"), sample_size=10, target_count=5)
    assert 2 * 302 <= scanned(spark) - before <= 3 * 302


def test_the_text_is_not_shuffled(spark, corpus, tmp_path, monkeypatch):
    text = sources.Input(spark, str(corpus)).text()
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan.split("Scan text")[-1]
    monkeypatch.setattr(sources, "SPLITS", 0)
    few = sources.Input(spark, str(corpus)).text()
    assert sorted(few.collect()) == sorted(text.collect())


def test_outputs_at_uris(spark, corpus, tmp_path):
    """Reports, rules and manifests go where the tables go, by the file system of the URI."""
    out = f"file://{tmp_path}/far"
    recipes.run(spark, f"file://{corpus}", out, sample_size=10)
    manifest = json.loads((tmp_path / "far" / "manifest.json").read_text(encoding="utf-8"))
    assert manifest["outputs"]["train"] == f"{out}/recipe_train_clean.jsonl" and read(tmp_path / "far" / "recipe_train_clean.jsonl")
    report = json.loads((tmp_path / "far" / "clean_report.json").read_text(encoding="utf-8"))
    assert report["rules"]["typo"] == f"{out}/generated_config/typo_rules.generated.json" and report["quality_policy"]["generic_title_checks"] is True
    assert files.joined("s3a://bucket/out/", "x") == "s3a://bucket/out/x" and not [p for p in (tmp_path / "far").iterdir() if p.name.endswith(".tmp")]


def test_large_populations_are_drawn_directly():
    a = sampling.selected(10**12, 1000, 5)
    assert len(set(a)) == 1000 and a == sorted(a) and 1 <= a[0] and a[-1] <= 10**12 and a == sampling.selected(10**12, 1000, 5)
    b = sampling.kept_in_reservoir(10**12, 1000, 5)
    assert len(set(b)) == 1000 and sampling.kept_in_reservoir(50, 80, 1) == list(range(1, 51))
    assert sampling.selected(1000, 30, 5) == sampling.selection(1000, 30, 5) and sampling.selected(7, 9, 1) == list(range(1, 8))
    counts = [0] * 20
    for seed in range(4000):
        for o in sampling.selected(20, 5, seed, exact=0):
            counts[o - 1] += 1
    assert all(abs(c - 1000) < 130 for c in counts)
