"""Exact-size seeded samples.

Which ordinals a sequential sampler takes depends only on the population, the size and the seed. They
are drawn on the driver and joined to the rows' ordinals, so that a cluster takes the very rows that a
pass over one file would. That needs a random number for each row of the population; beyond EXACT rows
the ordinals are drawn directly instead, uniformly, exactly as many and by the seed, in steps that grow
with the sample alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import checkpointed


#: Populations of which a sample is the one of a sequential pass.
EXACT = 20_000_000
#: Ordinals that may be broadcast.
LISTED = 1_000_000


def selected(population: int, size: int, seed: int, exact: int = EXACT) -> list[int]:
    """Ordinals of a sample in source order: those of selection(), or drawn directly."""
    if population <= exact or size >= population:
        return selection(population, size, seed) if size < population else list(range(1, population + 1))
    return sorted(random.Random(seed).sample(range(1, population + 1), size))


def kept_in_reservoir(population: int, size: int, seed: int, exact: int = EXACT) -> list[int]:
    """Ordinals of a sample by slot: those of reservoir(), or drawn directly."""
    if population <= exact or size >= population:
        return reservoir(population, size, seed)
    return random.Random(seed).sample(range(1, population + 1), size)


def selection(population: int, size: int, seed: int) -> list[int]:
    """Ordinals from 1 on that selection sampling takes: exactly size of them, or all."""
    rng, need, taken = random.Random(seed), min(size, population), []
    for ordinal in range(1, population + 1):
        if not need:
            break
        if rng.randrange(population - ordinal + 1) < need:
            taken.append(ordinal)
            need -= 1
    return taken


def reservoir(population: int, size: int, seed: int) -> list[int]:
    """Ordinals from 1 on that a reservoir holds at the end, by slot."""
    rng, slots = random.Random(seed), list(range(1, min(size, population) + 1))
    for ordinal in range(len(slots) + 1, population + 1):
        slot = rng.randrange(ordinal)
        if slot < size:
            slots[slot] = ordinal
    return slots


def with_ordinal(df: DataFrame, order: list, name: str = "ordinal") -> DataFrame:
    """df with the dense ordinal of each row in the order given, from 1 on. Rows are range-partitioned
    and numbered in each partition behind the counts of those before: no partition takes all."""
    return_columns = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    counts = counts.select("_part", "_first", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(counts), "_part").select(*return_columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias(name))


def taking(df: DataFrame, ordinals: Iterable[int], name: str = "ordinal") -> DataFrame:
    """The rows of df with these ordinals, and their place in the list as `slot`, from 0 on."""
    ordinals = list(ordinals)
    listed = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(ordinals)], f"{name} long, slot long")
    return df.join(F.broadcast(listed) if len(ordinals) <= LISTED else listed, name)


def sequential_sample(df: DataFrame, order: list, size: int, seed: int) -> DataFrame:
    """Exactly size rows, in uniform selection, with their ordinals."""
    numbered = with_ordinal(df, order)
    return taking(numbered, selected(numbered.count(), size, seed)).drop("slot")


def reservoir_sample(df: DataFrame, order: list, size: int, seed: int) -> DataFrame:
    """What a reservoir of size holds after all rows, with their ordinals and slots."""
    numbered = with_ordinal(df, order)
    return taking(numbered, kept_in_reservoir(numbered.count(), size, seed))


def hash_sample(df: DataFrame, key: Column, size: int, seed: int) -> DataFrame:
    """Exactly size rows by the least hashes of seed and key: no ordinals, and only a top-N."""
    return df.withColumn("_h", F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string")))).orderBy("_h").limit(size).drop("_h")
