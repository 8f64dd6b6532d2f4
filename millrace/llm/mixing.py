"""Mixing sources to target weights by pivotal (dependent) rounding.

A document of source s is wanted f_s times on average. The whole part of f_s is certain; the rest is a
probability. Pivotal rounding takes two open units, moves mass between them at random until one is 0
or 1, and goes on with the other, so that every unit keeps its probability and the sum stays as it
is. Each partition rounds its rows as they stream by and is left with at most one open unit for a
source; those few are rounded in a tree, FAN partitions to a node, until one is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from millrace.llm.shared import checkpointed, written

#: Target weight of a source with n documents: n ** ALPHA, as a share of the sum.
ALPHA = 0.7
SEED = 20240229
FAN = 64
BROADCAST_ROWS = 100_000
EPS = 1e-9

_RATE, _COPIES, _REST, _UNIT, _UP, _SOURCE = (f"__millrace_{x}" for x in ("rate", "copies", "rest", "unit", "up", "source"))


def rates(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """(source, documents, weight, rate): rate is the mean number of copies that gives each source its
    weight while the total stays the number of documents. weights: target weights by source instead
    of documents ** alpha; sources without one get 0. Where no source that is there has a weight, all
    rates are 0. A weight that is negative or no number: ValueError."""
    if any(not 0 <= float(v) < float("inf") for v in (weights or {}).values()):
        raise ValueError(f"weights must be numbers of 0 and more: {weights}")
    n = docs.groupBy("source").agg(F.count("*").alias("documents"))
    if weights is None:
        n = n.withColumn("weight", F.pow(F.col("documents").cast("double"), F.lit(float(alpha))))
    else:
        table = F.broadcast(docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "k string, weight double"))
        n = n.join(table, F.col("source").eqNullSafe(F.col("k")), "left").select("source", "documents", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    whole = n.agg(F.sum("documents").alias("all"), F.sum("weight").alias("mass"))
    share = F.when(F.col("mass") > 0, F.col("weight") / F.col("mass")).otherwise(0.0)
    return n.crossJoin(F.broadcast(whole)).select("source", "documents", share.alias("weight"), (share * F.col("all") / F.col("documents")).alias("rate"))


def pivot(p: float, q: float, u: float) -> tuple[float, float]:
    """One step: mass of p and q after it; at least one of them is 0 or 1."""
    total = p + q
    if total < 1:
        return (total, 0.0) if u * total < p else (0.0, total)
    if total >= 2 - EPS:
        return 1.0, 1.0
    return (1.0, total - 1) if u * (2 - total) < 1 - q else (total - 1, 1.0)


def _is_open(p: float) -> bool:
    return EPS < p < 1 - EPS


class _Rounding:
    """Pivotal rounding of the rows of one partition, batch by batch."""

    def __init__(self, seed: int, part: int) -> None:
        self.rng, self.part, self.held, self.count = np.random.default_rng([seed, part]), part, {}, 0

    def batch(self, batch: pa.RecordBatch, source: list, rate: np.ndarray):
        n = batch.num_rows
        whole = np.floor(rate + EPS).astype(np.int64)
        rest = rate - whole
        copies = whole.copy()
        draw = self.rng.random(n)
        now: dict = {}
        late = []
        for i in np.flatnonzero(rest > EPS).tolist():
            s, q = source[i], float(rest[i])
            before = now.get(s) or self.held.pop(s, None)
            if before is None:
                now[s] = (i, q)
                continue
            ref, p = before
            p, q = pivot(p, q, draw[i])
            now.pop(s, None)
            if not _is_open(p):
                if isinstance(ref, int):
                    copies[ref] += round(p)
                else:
                    late.append((ref[0], ref[1] + round(p)))
            elif isinstance(ref, int):
                now[s] = (ref, p)
            else:
                self.held[s] = (ref, p)
            if _is_open(q):
                now[s] = (i, q)
            else:
                copies[i] += round(q)
        done = np.ones(n, bool)
        for s, (i, p) in now.items():
            done[i] = False
            self.held[s] = ((batch.take(pa.array([i])), int(copies[i])), p)
        yield from self._rows(batch.filter(pa.array(done)), copies[done])
        if late:
            yield from self._rows(pa.Table.from_batches([b for b, _ in late]).combine_chunks().to_batches()[0], np.array([c for _, c in late]))

    def _rows(self, batch: pa.RecordBatch, copies: np.ndarray):
        if batch.num_rows:
            none = pa.nulls(batch.num_rows)
            yield self._with(batch, pa.array(copies, pa.int64()), none.cast(pa.float64()), none.cast(pa.int64()))

    @staticmethod
    def _with(batch: pa.RecordBatch, *columns: pa.Array) -> pa.RecordBatch:
        names = [*batch.schema.names[:-1], _COPIES, _REST, _UNIT]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names)

    def rest(self):
        for (batch, copies), p in self.held.values():
            unit = (self.part << 32) | self.count
            self.count += 1
            yield self._with(batch, pa.array([copies], pa.int64()), pa.array([p]), pa.array([unit], pa.int64()))


def _tree(open_units: DataFrame, seed: int) -> DataFrame:
    """(unit, up) for the open units (unit, source, rest), one up for each unit that is rounded up."""
    spark = open_units.sparkSession
    state = "unit long, source string, node long, rest double, up int"

    def node(pdf):
        pdf = pdf.sort_values("unit", kind="stable").reset_index(drop=True)
        rng = np.random.default_rng([seed, 1, int(pdf.node[0])])
        p, at = pdf.rest.to_numpy(copy=True), None
        for i in range(len(p)):
            if at is not None:
                p[at], p[i] = pivot(p[at], p[i], rng.random())
            if at is None or not _is_open(p[at]):
                at = i if _is_open(p[i]) else None
        shut = np.array([not _is_open(x) for x in p])
        pdf["up"] = np.where(shut, np.round(p), -1).astype(int)
        pdf["rest"] = p
        return pdf

    level = checkpointed(open_units.select("unit", "source", F.shiftright("unit", 32).alias("node"), "rest", F.lit(-1).alias("up")))
    done = []
    while True:
        top = level.agg(F.max("node")).first()[0]
        if top is None:
            break
        level = level.withColumn("node", F.expr(f"node div {FAN}"))
        level = checkpointed(level.groupBy("source", "node").applyInPandas(node, state))
        done.append(level.where("up >= 0").select("unit", "up"))
        level = level.where("up < 0")
        if top < FAN:  # one node: what is open now is the whole remainder of a source
            last = F.when((F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("rest"), 1).otherwise(0)
            done.append(level.select("unit", last.cast("int").alias("up")))
            break
    out = spark.createDataFrame([], "unit long, up int")
    for d in done:
        out = out.unionAll(d)
    return out


def with_copies(docs: DataFrame, weights: dict[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """docs and how often each row is to be taken, in a last column __millrace_copies.

    The copies of a source sum to its target but for less than 1. A null source is a source like
    another. Every row is a unit of its own, repeated rows and rows with null ids or texts too, and
    other columns go along unread. The table is streamed once and never shuffled. Which rows of a source
    are taken follows the seed and the partitions; rows are never compared, so there are no ties.
    weights without mass: no copies of any row. Empty tables: no rows.
    """
    table = checkpointed(rates(docs, weights, alpha).select(F.col("source").alias(_SOURCE), F.col("rate").alias(_RATE)))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    rated = docs.join(table, F.col("source").eqNullSafe(F.col(_SOURCE)), "left").drop(_SOURCE)
    at = docs.columns.index("source")

    def stream(batches):
        state = _Rounding(seed, TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                rate = batch.column(batch.num_columns - 1).fill_null(0).to_numpy(zero_copy_only=False)
                yield from state.batch(batch, batch.column(at).to_pylist(), rate)
        yield from state.rest()

    extra = [T.StructField(_COPIES, T.LongType()), T.StructField(_REST, T.DoubleType()), T.StructField(_UNIT, T.LongType())]
    first = written(rated.mapInArrow(stream, T.StructType([*docs.schema.fields, *extra])), "mixing")
    names = [f"`{c}`" for c in docs.columns]
    open_rows = first.where(F.col(_REST).isNotNull())
    ups = _tree(open_rows.select(F.col(_UNIT).alias("unit"), F.col("source").cast("string").alias("source"), F.col(_REST).alias("rest")), seed)
    ups = ups.select(F.col("unit").alias(_UNIT), F.col("up").alias(_UP))
    closed = open_rows.join(ups, _UNIT).select(*names, (F.col(_COPIES) + F.col(_UP)).alias(_COPIES))
    return first.where(F.col(_REST).isNull()).select(*names, _COPIES).unionAll(closed)


def copies(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, source, copies) for every row of docs; 0 copies where a row is left out."""
    return with_copies(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source"), **how).withColumnRenamed(_COPIES, "copies")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """docs with every row as often as with_copies() says, all columns kept."""
    return with_copies(docs, **how).where(F.col(_COPIES) > 0).withColumn(_COPIES, F.explode(F.sequence(F.lit(1), F.col(_COPIES)))).select(*[f"`{c}`" for c in docs.columns])
