"""Where a record goes, and exact deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.functions.hashing import content_key
from millrace.operators.recipe import STRUCTURAL

CLEAN, REVIEW, REJECTED, DUPLICATE = "clean", "review", "rejected", "duplicate"


def codes(flags: Column) -> Column:
    return F.transform(flags, lambda f: f["code"])


def structural_failure(flags: Column) -> Column:
    return F.arrays_overlap(codes(flags), F.array(*[F.lit(c) for c in STRUCTURAL]))


def routed(df: DataFrame) -> DataFrame:
    """df with `route`: invalid and structurally failed records are rejected, other flagged ones are for
    review, the rest is clean."""
    route = F.when(~F.col("valid") | ~F.col("object") | structural_failure(F.col("flags")), REJECTED).when(F.size("flags") > 0, REVIEW).otherwise(CLEAN)
    return df.withColumn("route", route)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `nth`, the place of a row among those with the same keys. Where it is 1 the row stays;
    a later one never takes the place of the first, as dropDuplicates() might let it."""
    return df.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def deduplicated(df: DataFrame) -> DataFrame:
    """Clean records that repeat an earlier one's name, ingredients and steps become duplicates; flagged
    ones are left alone."""
    keyed = df.withColumn("_key", F.when(F.col("route") == CLEAN, content_key(F.col("name"), F.col("recipeIngredient"), F.col("recipeInstructions"))).otherwise(F.concat_ws(":", F.lit("-"), "path", "line")))
    again = first_of(keyed, ["_key"], ["path", "line"])
    return again.withColumn("route", F.when((F.col("route") == CLEAN) & (F.col("nth") > 1), DUPLICATE).otherwise(F.col("route"))).drop("_key", "nth")
