"""Queries against their SQL over documents that the driver's small tables lack: blank, null and repeated ones."""

import collections

import duckdb
import pytest

from millrace.plans import registry

_FINE = "plain text that is long enough to stay clean, surely"
TEXTS = ["", "  \n\t \n", " " * 50, None, "\n" * 60, _FINE, _FINE + " ", None, "a@b\n" * 3 + "x", "   \n" * 20, "short"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, None if t is None else len(t)) for i, t in enumerate(TEXTS, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


@pytest.mark.parametrize("name", ["examples_per_issue", "route_counts", "routes", "content_digest"])
def test_same_rows_as_sql(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    rel = con.sql(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, odd).select(*rel.columns)
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(rel.fetchall())
