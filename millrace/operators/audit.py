"""Counts and examples of what cleaning has found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.operators.route import CLEAN, DUPLICATE, REJECTED, REVIEW, codes


def summary(routed: DataFrame) -> DataFrame:
    """One row: read, rejected, review, duplicates, eligible."""
    is_ = lambda r: F.count_if(F.col("route") == r)
    return routed.agg(F.count("*").alias("read"), is_(REJECTED).alias("rejected"), is_(REVIEW).alias("review"), is_(DUPLICATE).alias("duplicates"), is_(CLEAN).alias("eligible"))


def issue_counts(flagged: DataFrame) -> DataFrame:
    """(code, records, occurrences), the most frequent first; in a record each code counts once for
    records and as often as it occurs for occurrences."""
    per = flagged.select(F.explode(F.array_distinct(codes(F.col("flags")))).alias("code"), codes(F.col("flags")).alias("all"))
    per = per.select("code", F.size(F.filter("all", lambda c: c == F.col("code"))).cast("long").alias("n"))
    return per.groupBy("code").agg(F.count("*").alias("records"), F.sum("n").alias("occurrences")).orderBy(F.desc("records"), "code")


def rule_counts(changed: DataFrame) -> DataFrame:
    """(rule, records, applications), the most frequent first."""
    rules = F.transform("changes", lambda c: c["rule"])
    per = changed.select("changes", F.explode(F.array_distinct(rules)).alias("rule"))
    n = F.aggregate(F.filter("changes", lambda c: c["rule"] == F.col("rule")), F.lit(0).cast("long"), lambda a, c: a + c["count"])
    return per.select("rule", n.alias("n")).groupBy("rule").agg(F.count("*").alias("records"), F.sum("n").alias("applications")).orderBy(F.desc("records"), "rule")


def first_examples(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of each value of a column."""
    nth = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= k)


def issue_examples(flagged: DataFrame, k: int = 5) -> DataFrame:
    """(code, nth, line, name, detail): the first k flags of each code, in the order of lines."""
    rows = flagged.select("path", "line", "name", F.posexplode("flags").alias("pos", "flag")).select("path", "line", "pos", "name", "flag.code", "flag.detail")
    return first_examples(rows, "code", ["path", "line", "pos"], k).select("code", "nth", "line", "name", "detail").orderBy("code", "nth")


def rule_examples(changed: DataFrame, k: int = 5) -> DataFrame:
    """(rule, nth, line, name, field, count): the first k changes by each rule."""
    rows = changed.select("path", "line", "name", F.posexplode("changes").alias("pos", "c")).select("path", "line", "pos", "name", "c.rule", "c.field", "c.count")
    return first_examples(rows, "rule", ["path", "line", "pos"], k).select("rule", "nth", "line", "name", "field", "count").orderBy("rule", "nth")


def audit_stop(ordinals: DataFrame, limit: int) -> int | None:
    """The ordinal at which an audit of `limit` rows ends: the first valid one from there on, as an
    invalid line is never the last. None: it ends with the input. ordinals: (ordinal, valid)."""
    return ordinals.where(F.col("valid") & (F.col("ordinal") >= limit)).agg(F.min("ordinal")).first()[0]


def length_profile(lengths: DataFrame, column: str, over: int = 2048) -> DataFrame:
    """(p50, p90, p95, p99, p999, over_share) of a length, as decimals: exact percentiles, interpolated."""
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99, 0.999)]))
    got = lengths.agg(p.alias("p"), F.avg((F.col(column) > over).cast("int")).alias("over_share"))
    names = ("p50", "p90", "p95", "p99", "p999")
    return got.select(*[F.element_at("p", i + 1).cast("decimal(18,3)").alias(n) for i, n in enumerate(names)], F.col("over_share").cast("decimal(9,6)").alias("over_share"))
