import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import mixing, queries
from tests.llm import cases


def test_pivot_keeps_sums_and_means():
    rnd = random.Random(1)
    for p, q in ((0.3, 0.5), (0.7, 0.6), (0.5, 0.5), (0.1, 0.9), (0.99, 0.99)):
        out = [mixing.pivot(p, q, rnd.random()) for _ in range(20000)]
        assert all(abs(a + b - p - q) < 1e-9 for a, b in out)
        assert all(min(abs(x) for x in (a, b, 1 - a, 1 - b)) < 1e-9 for a, b in out)
        assert abs(np.mean([a for a, _ in out]) - p) < 0.015 and abs(np.mean([b for _, b in out]) - q) < 0.015


def rows(n):
    rnd = random.Random(3)
    return [(i, f"text {i}", "en", f"s{min(int(rnd.expovariate(0.7)), 6)}" if i % 50 else None, 1) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 70])
def test_copies_meet_their_targets(spark, parts):
    data = rows(3000)
    docs = spark.createDataFrame(data, cases.DOCS).repartition(parts)
    per = collections.Counter(r[3] for r in data)
    mass = sum(n**mixing.ALPHA for n in per.values())
    got = mixing.copies(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    total = collections.Counter()
    for r in got:
        rate = per[r.source] ** mixing.ALPHA / mass * 3000 / per[r.source]
        assert int(rate) <= r.copies <= int(rate) + 1
        total[r.source] += r.copies
    for s, n in per.items():
        assert abs(total[s] - n**mixing.ALPHA / mass * 3000) < 1 + 1e-6


def test_every_row_keeps_its_probability():
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([0.0] * 9)], ["doc_id", "rate"])
    rate, source = np.array([0.2, 0.5, 0.9, 1.3, 0.0, 2.0, 0.4, 0.4, 0.3]), list("aabaaabba")
    total, n = np.zeros(9), 4000
    for seed in range(n):
        state = mixing._Rounding(seed, 0)
        seen = np.zeros(9)
        for part in (batch.slice(0, 5), batch.slice(5)):
            at = int(part.column(0)[0].as_py())
            for out in state.batch(part, source[at : at + part.num_rows], rate[at : at + part.num_rows]):
                seen[out.column("doc_id").to_numpy()] += out.column(mixing._COPIES).to_numpy()
        for out in state.rest():
            seen[out.column("doc_id").to_numpy()] += out.column(mixing._COPIES).to_numpy() + out.column(mixing._REST).to_numpy()
        assert all(abs(seen[[s == k for s in source]].sum() - rate[[s == k for s in source]].sum()) < 1e-9 for k in "ab")
        total += seen
    assert np.abs(total / n - rate).max() < 0.04


def test_mixed_keeps_columns_and_weights_can_leave_out(spark):
    docs = cases.odd(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and abs(out.count() - docs.count()) <= 4
    only = mixing.mixed(docs, weights={"a": 1.0}).collect()
    assert {r.source for r in only} == {"a"} and abs(len(only) - docs.count()) <= 1
    assert mixing.mixed(cases.empty(spark)).count() == 0 and mixing.copies(cases.empty(spark)).count() == 0


def test_weights_without_mass(spark):
    docs = cases.odd(spark)
    for weights in ({"nowhere": 1.0}, {"a": 0.0}, {}):
        got = mixing.copies(docs, weights=weights).collect()
        assert len(got) == docs.count() and {r.copies for r in got} == {0} and mixing.mixed(docs, weights=weights).count() == 0
    with pytest.raises(ValueError):
        mixing.copies(docs, weights={"a": -1.0})


def test_the_query_meets_its_targets_and_every_row(spark, medium):
    """By plain arithmetic over the table: floor or ceiling for every row, the total of each source, and
    that of all. The draw itself is held against its probabilities above."""
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "source").collect()
    per = collections.Counter(r.source for r in docs)
    mass = sum(n**0.7 for n in per.values())
    rate = {s: n**0.7 / mass * len(docs) / n for s, n in per.items()}
    got = queries.op7_mixing(spark, medium).collect()
    assert sorted((r.doc_id, r.source) for r in got) == sorted((r.doc_id, r.source) for r in docs)
    assert all(r.copies in (int(rate[r.source]), int(rate[r.source]) + 1) for r in got)
    total = collections.Counter()
    for r in got:
        total[r.source] += r.copies
    assert all(abs(total[s] - rate[s] * n) < 1 for s, n in per.items()) and abs(sum(total.values()) - len(docs)) < len(per)
    assert got == queries.op7_mixing(spark, medium).collect()
