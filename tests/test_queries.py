"""Every query with SQL against DuckDB, as the driver compares them, on the smallest tables."""

import collections
import math

import duckdb
import pytest

from millrace.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Their SQL lists the ordinals of 1,000 documents.
AT_SF_001 = {"seq_sample_exact", "reservoir_sample"}


@pytest.fixture(scope="module")
def duck():
    out = {}
    for size in ("sf0.001", "sf0.01"):
        con = out[size] = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{size}/{t}.parquet'")
    return out


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    size = "sf0.01" if name in AT_SF_001 else "sf0.001"
    df = registry.QUERIES[name](spark, f"/root/testdata/{size}")
    cols = sorted(df.columns)
    got = collections.Counter(repr([plain(r[c]) for c in cols]) for r in df.collect())
    rel = duck[size].sql(registry.ORACLES[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == collections.Counter(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert got or name == "term_mining"  # its thresholds are for more rows


def test_all_queries_have_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["doc_id", "h", "n_chars"]
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_engine_stands_without_the_training_data_folders():
    """Nothing outside them imports them, and the entry points work when they are gone."""
    import os
    import pathlib
    import shutil
    import subprocess
    import sys
    import tempfile

    root = pathlib.Path(__file__).parent.parent
    with tempfile.TemporaryDirectory() as there:
        shutil.copytree(root / "millrace", f"{there}/millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(root / "__spark_entry__.py", there)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'exact_dedup_first' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=there, env=os.environ | {"PYTHONPATH": there}, check=True)
    for path in (root / "millrace").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "millrace.llm" not in path.read_text(encoding="utf-8"), path
