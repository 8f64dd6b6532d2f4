"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import checkpointed


def _least(df: DataFrame, by: str, of: str) -> DataFrame:
    """m, the least of `by` and all `of` beside it. Minima are combined before they are shuffled, and
    the join splits what is skewed, so no node is one task however many edges it has."""
    return df.join(df.groupBy(by).agg(F.min(of).alias("m")), by).withColumn("m", F.least(by, "m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node but the roots, which are the least nodes of their components.

    edges: (u, v), two longs, in any direction. Loops and nulls are left out. The number of rounds
    grows with the logarithm of the longest path; each keeps its state in the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    e = checkpointed(e)
    last = None
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        e = _least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _least(e, "a", "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("s"))
        e = checkpointed(small.select("s.*").where("a <> b").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now
