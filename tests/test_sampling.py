import random

import pytest

from millrace.operators import sampling


def sequential(population, size, seed):
    """Selection sampling as one pass over a file does it."""
    rng, need, left, out = random.Random(seed), min(size, population), population, []
    for i in range(1, population + 1):
        if need and rng.randrange(left) < need:
            out.append(i)
            need -= 1
        left -= 1
    return out


def by_reservoir(population, size, seed):
    rng, held = random.Random(seed), []
    for i in range(1, population + 1):
        if len(held) < size:
            held.append(i)
        elif (slot := rng.randrange(i)) < size:
            held[slot] = i
    return held


@pytest.mark.parametrize("population, size", [(0, 5), (3, 5), (5, 5), (1000, 1), (1000, 137)])
def test_drawn_ordinals_are_those_of_a_pass(population, size):
    assert sampling.selection(population, size, 7) == sequential(population, size, 7)
    assert sampling.reservoir(population, size, 7) == by_reservoir(population, size, 7)


@pytest.mark.parametrize("parts", [1, 3, 11])
def test_samples_do_not_depend_on_partitions(spark, parts):
    df = spark.range(500).selectExpr("id", "id * 7 % 500 AS at").repartition(parts)
    got = sampling.sequential_sample(df, ["at"], 40, 3).collect()
    assert sorted(r.at + 1 for r in got) == sampling.selection(500, 40, 3) and all(r.ordinal == r.at + 1 for r in got)
    got = sampling.reservoir_sample(df, ["at"], 40, 3).collect()
    assert [r.at + 1 for r in sorted(got, key=lambda r: r.slot)] == sampling.reservoir(500, 40, 3)


def test_the_query_samples_the_whole_table(spark, small):
    """Its SQL lists the ordinals of 1,000 documents; the table has 200."""
    from millrace.plans import registry

    ids = sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect())
    got = registry.QUERIES["seq_sample_exact"](spark, small).collect()
    assert sorted((r.ordinal, r.doc_id) for r in got) == [(i, ids[i - 1]) for i in sequential(len(ids), registry.SIZE, registry.SEED)]
