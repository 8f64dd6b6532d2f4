"""Substring duplicates by seed and extend.

Documents are joined on winnowed anchors. Around an anchor a match of MIN_WORDS words is some number
of words to the left and the rest to the right; for each of those splits the occurrences are grouped
by a hash of the words, which costs n rather than n * n comparisons however many documents share the
passage, and each is linked to the first of another document.

So each document becomes a list of runs of windows with, for each run, the first place that has the same
words. That place is a name for the words: two documents agree in a window where both name one place.
Links that continue each other on one diagonal are joined, and then extended both ways, run by run, as
far as the lists of the two documents agree. The list of the other document is fetched only where the
next window could be in it, which the places it lies between tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.llm.anchors import HOT_SEGMENTS, MIN_WORDS, by_anchor, lots, shared_segments, shared_windows
from millrace.llm.shared import written
from millrace.llm.words import mix, span_hash

_NAMES = ["anchor", "segment", "role", "key", "first", "skip", "windows", "hub_key", "hub_at", "far_key", "far_at"]
#: A run of windows of a document: the first, their number, and where the least and the greatest document
#: that have them have the first of them.
_RUN = ["start", "windows", "hub_key", "hub_at", "far_key", "far_at"]
#: Documents are extended in lots of about so many runs.
LOT_RUNS = 500_000
#: More than a document has words.
_FAR = np.int64(1 << 40)


def matches(lot: pa.Table, least: int) -> list[np.ndarray]:
    """Runs of matching windows in the segments of a lot, as columns of _NAMES: `windows` windows after
    `skip`, and where the first of them is in the least document that has them and in the greatest."""
    body = np.frombuffer(b"".join(lot.column("words").to_pylist()), np.int32)
    h = mix(body.astype(np.uint64))
    key, first, last = (lot.column(n).to_numpy() for n in ("key", "first", "last"))
    n = last - first + 1
    begin = np.concatenate([[0], np.cumsum(n + least - 1)])[:-1]
    seg = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    s = begin[seg] + inner
    code = span_hash(h, s, s + least)
    owner, at = key[seg], first[seg] + inner
    order = np.lexsort((at, owner, code))
    head = np.concatenate([[True], code[order][1:] != code[order][:-1]])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    lo = np.flatnonzero(head)
    hub, far = order[lo][group], order[np.append(lo[1:], len(order)) - 1][group]
    mine = np.flatnonzero(owner[hub] != owner[far])
    if not len(mine):
        return [np.empty(0, np.int64) for _ in _NAMES]
    hub, far, own = hub[mine], far[mine], seg[mine]
    signs = (own, owner[hub], at[hub] - inner[mine], owner[far], at[far] - inner[mine], mine - np.arange(len(mine)))
    new = np.ones(len(mine), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in signs], axis=0)
    a = np.flatnonzero(new)
    own = own[a]
    taken = [lot.column(c).to_numpy()[own] for c in ("anchor", "segment", "role", "key", "first")]
    return [*taken, inner[mine[a]], np.diff(np.append(a, len(mine))), owner[hub[a]], at[hub[a]], owner[far[a]], at[far[a]]]


def joined(spans: DataFrame, *by: str) -> DataFrame:
    """(by, start, stop): the spans of each `by`, those joined that overlap or touch."""
    before = W.partitionBy(*by).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1)
    island = spans.withColumn("gap", F.coalesce(F.col("start") > F.max("stop").over(before), F.lit(True)).cast("int"))
    island = island.withColumn("island", F.sum("gap").over(W.partitionBy(*by).orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def _spans(doc: np.ndarray, match: np.ndarray, diagonal: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of one document, match and diagonal that overlap or touch, joined."""
    order = np.lexsort((start, diagonal, match, doc))
    doc, match, diagonal, start, stop = (x[order] for x in (doc, match, diagonal, start, stop))
    same = np.zeros(len(order), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (match[1:] == match[:-1]) & (diagonal[1:] == diagonal[:-1])
    # stops only grow within one diagonal, so that it is enough to look at the span before
    head = np.flatnonzero(~(same & np.concatenate([[False], start[1:] <= stop[:-1]])))
    return doc[head], match[head], diagonal[head], start[head], np.maximum.reduceat(stop, head) if len(head) else stop


def lists(table: pa.Table) -> pa.RecordBatch:
    """(key, runs, asks): the runs of each document of a table of (key, *_RUN) that is sorted by key and
    start, as int64, and the documents whose lists its links are to be extended with."""
    key = table.column("key").to_numpy()
    run = np.stack([table.column(c).to_numpy() for c in _RUN], axis=1)
    start, n, hub, hub_at, far, far_at = run.T
    follows = np.zeros(len(key), bool)
    follows[1:] = (key[1:] == key[:-1]) & (start[1:] == start[:-1] + n[:-1])
    alike = follows.copy()
    alike[1:] &= (hub[1:] == hub[:-1]) & (hub_at[1:] - start[1:] == hub_at[:-1] - start[:-1]) & (far[1:] == far[:-1]) & (far_at[1:] - start[1:] == far_at[:-1] - start[:-1])
    head = np.flatnonzero(~alike)
    size = np.add.reduceat(n, head)
    key, run, follows = key[head], run[head], follows[head]
    run[:, 1] = size
    start, n, hub, hub_at, far, far_at = run.T
    to, to_at = np.where(hub != key, hub, far), np.where(hub != key, hub_at, far_at)

    def may_hold(i, at, j, off):
        """Whether to[i] may have, at `at`, the window of run j that is `off` after its first."""
        more = (to[i] > hub[j]) | ((to[i] == hub[j]) & (at >= hub_at[j] + off))
        less = (to[i] < far[j]) | ((to[i] == far[j]) & (at <= far_at[j] + off))
        known = (to[j] == to[i]) & (to_at[j] + off == at)
        return more & less & ~known & (at >= 0)

    b = np.flatnonzero(follows)
    a = b - 1
    on = a[may_hold(a, to_at[a] + n[a], b, 0)]
    back = b[may_hold(b, to_at[b] - 1, a, n[a] - 1)]
    asking = np.unique(np.concatenate([on, back]))
    pairs = np.unique(np.stack([key[asking], to[asking]], axis=1), axis=0)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    edge = np.append(first[1:], len(key))
    names = key[first]
    lo, hi = np.searchsorted(pairs[:, 0], names, "left"), np.searchsorted(pairs[:, 0], names, "right")
    offsets = np.append(lo, hi[-1:]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array([np.ascontiguousarray(run[x:y]).tobytes() for x, y in zip(first.tolist(), edge.tolist())], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(pairs[:, 1]))],
        ["key", "runs", "asks"],
    )


def _flat(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Runs of several lists one after another, and the list that each is of."""
    size = np.array([len(b) // (8 * len(_RUN)) for b in blobs], np.int64)
    return np.frombuffer(b"".join(blobs), np.int64).reshape(-1, len(_RUN)), np.repeat(np.arange(len(blobs)), size)


def maximal(keys: list[int], own: list[bytes], asked: list[tuple[int, int, bytes]], least: int) -> tuple[np.ndarray, ...]:
    """(document, start, words, match, its start): the links of the lists `own` of the documents `keys`,
    as far as they go. asked: (index of a document, match, list of the match)."""
    run, doc = _flat(own)
    start, n, hub, hub_at, far, far_at = run.T
    key = np.array(keys, np.int64)
    mine = hub != key[doc]
    to, at = np.where(mine, hub, far), np.where(mine, hub_at, far_at)
    doc_, match, diagonal, a, z = _spans(doc, to, at - start, start, start + n - 1 + least)
    if asked and len(doc_):
        other, pair = _flat([b for _, _, b in asked])
        names = np.array([(i, h) for i, h, _ in asked], np.int64)
        place = {(int(i), int(h)): k for k, (i, h) in enumerate(names)}
        of = np.array([place.get(x, -1) for x in zip(doc_.tolist(), match.tolist())])
        mine_at, its_at = doc * _FAR + start, pair * _FAR + other[:, 0]

        def step(live, p):
            """For spans and windows of their documents: which agree, and the two runs."""
            q = p + diagonal[live]
            i = np.searchsorted(mine_at, doc_[live] * _FAR + p, "right") - 1
            j = np.searchsorted(its_at, of[live] * _FAR + np.maximum(q, 0), "right") - 1
            fine = (p >= 0) & (q >= 0) & (i >= 0) & (j >= 0)
            i, j = np.maximum(i, 0), np.maximum(j, 0)
            fine &= (doc[i] == doc_[live]) & (pair[j] == of[live]) & (p < start[i] + n[i]) & (q < other[j, 0] + other[j, 1])
            fine &= (hub[i] == other[j, 2]) & (hub_at[i] - start[i] + p == other[j, 3] - other[j, 0] + q)
            return fine, i, j, q

        live = np.flatnonzero(of >= 0)
        while len(live):
            p = z[live] - least + 1
            fine, i, j, q = step(live, p)
            z[live[fine]] += np.minimum(start[i] + n[i] - p, other[j, 0] + other[j, 1] - q)[fine]
            live = live[fine]
        live = np.flatnonzero(of >= 0)
        while len(live):
            p = a[live] - 1
            fine, i, j, q = step(live, p)
            a[live[fine]] -= np.minimum(p - start[i], q - other[j, 0])[fine] + 1
            live = live[fine]
        doc_, match, diagonal, a, z = np.unique(np.stack([doc_, match, diagonal, a, z], axis=1), axis=0).T
    return key[doc_], a, z - a, match, a + diagonal


def extended(found: DataFrame, least: int) -> DataFrame:
    """found: (key, *_RUN), each window of a document that another one has in one run. The maximal matches
    that hold the links of the runs, as (doc_id, start_word, n_words, match_doc_id, match_start)."""
    names = ["doc_id", "start_word", "n_words", "match_doc_id", "match_start"]
    schema = ", ".join(f"{x} long" for x in names)

    def listing(batches):
        for table in lots(batches, LOT_RUNS, "key", None):
            yield lists(table)

    every = found.select("key", *_RUN).repartition("key").sortWithinPartitions("key", "start", "windows", "hub_key", "hub_at")
    every = written(every.mapInArrow(listing, "key long, runs binary, asks array<long>"), "lists")

    def alone(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in maximal(batch.column("key").to_pylist(), batch.column("runs").to_pylist(), [], least)], names)

    def together(batches):
        for table in lots(batches, LOT_RUNS * len(_RUN) * 2, "key", "runs"):
            keys, own, asked = [], [], []
            for key, match, runs in zip(*(table.column(c).to_pylist() for c in ("key", "match", "runs"))):
                if match is None:
                    keys.append(key)
                    own.append(runs)
                else:
                    asked.append((len(keys) - 1, match, runs))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in maximal(keys, own, asked, least)], names)

    asking = every.where("size(asks) > 0")
    pairs = asking.select(F.col("key").alias("asker"), F.explode("asks").alias("key"))
    fetched = pairs.join(every.select("key", "runs"), "key").select(F.col("asker").alias("key"), F.col("key").alias("match"), "runs")
    both = asking.select("key", F.lit(None).cast("long").alias("match"), "runs").unionAll(fetched)
    both = both.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("match"))
    return every.where("size(asks) = 0").mapInArrow(alone, schema).unionAll(both.mapInArrow(together, schema))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, start_word, n_words, match_doc_id, match_start): maximal passages of at least
    min_words words that a document shares with another one, in words (see words) of the texts: no row
    could be longer at either end. Wherever a shared window of min_words words occurs, a row of that
    document holds it and names the least document that has it (that one itself: the greatest). So the
    rows connect all places of a passage, by which any two of its documents are found, and their
    number grows with the places, not with the pairs. Pairs that only meet in a third document have
    no row of their own.

    Null, empty and shorter texts share nothing. Rows without doc_id cannot be named and are left
    out; rows with the same id are one document (with several texts under one id, a match may stop
    short), and what repeats only within a document is not reported. Empty tables: no rows. Other
    columns are not looked at. min_words below the 8 words of a seed: ValueError.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("key"), "text")
    shared = shared_segments(keyed, "seeds", least=min_words, hot=hot)

    def compare(batches):
        for lot in lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in matches(lot, min_words)], _NAMES)

    runs = by_anchor(shared.segments).mapInArrow(compare, ", ".join(f"{n} long" for n in _NAMES))
    single = shared_windows(shared.windows).select(
        "anchor", "segment", "role", "key", "first", "skip", F.lit(1).cast("long").alias("windows"), F.col("hub.key").alias("hub_key"), F.col("hub.at").alias("hub_at"), F.col("far.key").alias("far_key"), F.col("far.at").alias("far_at")
    )
    runs = written(runs.unionAll(single), "runs")
    same = runs.where("role = 1").select("anchor", "segment", "skip", "windows", "hub_key", "hub_at", "far_key", "far_at")
    varied = shared.alike.where("varied").select("anchor", "segment", "key", "first").join(same, ["anchor", "segment"])
    plain = shared.alike.where("not varied").select(
        "key", "first", F.lit(0).alias("skip"), (F.col("last") - F.col("first") + 1).alias("windows"),
        F.col("hub.key").alias("hub_key"), (F.col("hub.pos") - F.col("pos") + F.col("first")).alias("hub_at"),
        F.col("other.key").alias("far_key"), (F.col("other.pos") - F.col("pos") + F.col("first")).alias("far_at"),
    )
    found = [x.select("key", (F.col("first") + F.col("skip")).alias("start"), "windows", "hub_key", "hub_at", "far_key", "far_at") for x in (runs.where("role = 0"), varied, plain)]
    return extended(found[0].unionAll(found[1]).unionAll(found[2]), min_words)
