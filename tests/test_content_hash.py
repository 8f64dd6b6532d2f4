import hashlib
import random

import pytest

from millrace.sources import sinks


@pytest.mark.parametrize("parts", [1, 7])
def test_lines_are_hashed_in_order_and_stay_off_the_driver(spark, monkeypatch, parts):
    rnd = random.Random(1)
    rows = [(f"p{i % 3}", i, None if i % 9 == 0 else rnd.choice(["", "é", "x" * 3000, "\r"]) + str(i) + rnd.choice(["", "\r\n", "\n\n", " "])) for i in range(900)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "path string, line long, value string").repartition(parts)
    lines = [v.rstrip("\r\n") + "\n" for *_, v in sorted(rows, key=lambda r: r[:2]) if v is not None]

    def forbidden(*_, **__):
        raise AssertionError("rows go to the driver")

    for name in ("toLocalIterator", "toPandas", "toArrow"):
        monkeypatch.setattr(type(df), name, forbidden)
    kept = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: rows if len(rows := kept(self)) <= 1 else forbidden())
    assert sinks.hashed(df, "path", "line") == (hashlib.sha256("".join(lines).encode()).hexdigest(), 800, 900)


def test_nothing_has_the_hash_of_nothing(spark):
    none = spark.createDataFrame([], "line long, value string")
    assert sinks.hashed(none, "line") == (hashlib.sha256().hexdigest(), 0, 0)
    assert sinks.hashed(none.union(spark.sql("SELECT 1L, CAST(NULL AS STRING)")), "line") == (hashlib.sha256().hexdigest(), 0, 1)
