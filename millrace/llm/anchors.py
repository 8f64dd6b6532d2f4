"""Winnowed anchors of passages that documents share, and the words around them.

Every window of MIN_WORDS words chooses the least of its k-grams as its anchor (see words.winnow), so
equal windows, wherever they are, choose the same anchor at the same place. The consecutive windows
of a document that choose one anchor make a segment. Windows need comparing only within an anchor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.llm.shared import BROADCAST_ROWS, checkpointed, slices, written
from millrace.llm.words import span_hash, winnow, words

K = 8
MIN_WORDS = 50
#: Segments are compared in lots of whole anchors with about so many words.
LOT_WORDS = 1_000_000
#: An anchor with more segments than that is no lot: its windows are compared each by itself, in a shuffle.
HOT_SEGMENTS = 20_000

_NUMBERS = ["anchor", "segment", "key", "first", "last", "role"]
_WINDOW = ["anchor", "segment", "first", "role", "key", "skip", "code"]
_PLACE = ["anchor", "segment", "key", "pos", "first", "last"]


def _found(part: pa.RecordBatch, k: int, least: int):
    w = words(part.column("text"))
    a, first, last, anchor = winnow(w, k, least - k + 1)
    doc = w.doc_of(a)
    return w, doc, a - w.ptr[doc], first - w.ptr[doc], last - w.ptr[doc], anchor, first, last + least


@dataclass
class Shared:
    """alike: (anchor, segment, key, first, last, pos, hub, other, varied): segments that another
    document has word for word, with the least and the greatest (key, pos) that has them, and whether
    the anchor has other segments too. segments: those others, and hub and other of each alike segment
    at such anchors, with their words: (anchor, segment, key, first, last, role, words); role is 0, or
    1 for a hub and 2 for an other. windows: of the same kind, but for the anchors with very many
    segments: (anchor, segment, key, first, role, skip, code), a hash of each window."""

    alike: DataFrame
    segments: DataFrame
    windows: DataFrame


def shared_segments(docs: DataFrame, tag: str, k: int = K, least: int = MIN_WORDS, hot: int = HOT_SEGMENTS) -> Shared:
    """Segments at anchors that at least two documents of (key, text) have."""
    if least < k:
        raise ValueError(f"min_words {least} must be {k} at least")

    def places(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w, doc, pos, first, last, anchor, s, e = _found(part, k, least)
                whole = span_hash(w.h, s, e).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(whole), part.column("key").take(pa.array(doc)), *map(pa.array, (pos, first, last))], _PLACE)

    found = docs.mapInArrow(places, ", ".join(f"{n} long" for n in _PLACE))
    same, every, place = W.partitionBy("anchor", "segment"), W.partitionBy("anchor"), F.struct("key", "pos")
    found = (
        found.withColumns({"hub": F.min(place).over(same), "other": F.max(place).over(same)})
        .withColumns({"lo": F.min("key").over(every), "hi": F.max("key").over(every), "varied": F.min("segment").over(every) != F.max("segment").over(every)})
        .where("lo <> hi").drop("lo", "hi")
    )
    found = written(found, tag)
    alike = F.col("hub.key") != F.col("other.key")
    role = F.when(~alike, 0).when(place == F.col("hub"), 1).when(place == F.col("other"), 2)
    compared = found.where("varied").withColumn("role", role).where("role is not null")
    crowded = checkpointed(compared.groupBy("anchor").count().where(F.col("count") > hot).select("anchor", F.lit(True).alias("hot")))
    if crowded.count() <= BROADCAST_ROWS:
        crowded = F.broadcast(crowded)
    compared = compared.join(crowded, "anchor", "left")
    one = F.struct("anchor", "segment", "first", "last", "role", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = compared.groupBy("key").agg(F.collect_set(one).alias("wanted"))
    asked = docs.join(wanted, "key").select("key", "text", "wanted")

    def cut(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                small = (w.h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                out = {n: [] for n in (*_NUMBERS, "words")}
                keys = part.column("key").to_pylist()
                for i, rows in enumerate(part.column("wanted").to_pylist()):
                    end = int(w.ptr[i + 1] - w.ptr[i])
                    for r in rows:
                        if not r["hot"] and r["last"] + least <= end:  # past the end only if two texts go by one id
                            own = small[w.ptr[i] + r["first"] : w.ptr[i] + r["last"] + least]
                            for n, v in zip(out, (r["anchor"], r["segment"], keys[i], r["first"], r["last"], r["role"], own.tobytes())):
                                out[n].append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(out[n], pa.int64()) for n in _NUMBERS), pa.array(out["words"], pa.binary())], list(out))

    def single(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                w = words(part.column("text"))
                keys = part.column("key").to_pylist()
                for i, rows in enumerate(part.column("wanted").to_pylist()):
                    own = [r for r in rows if r["hot"] and r["last"] + least <= w.ptr[i + 1] - w.ptr[i]]
                    if own:
                        size = np.array([r["last"] - r["first"] + 1 for r in own])
                        skip = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        s = w.ptr[i] + np.repeat([r["first"] for r in own], size) + skip
                        columns = [np.repeat(np.array([r[n] for r in own], np.int64), size) for n in ("anchor", "segment", "first", "role")]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.full(len(s), keys[i])), pa.array(skip), pa.array(span_hash(w.h, s, s + least).view(np.int64))], _WINDOW)

    segments = asked.mapInArrow(cut, ", ".join(f"{n} long" for n in _NUMBERS) + ", words binary")
    windows = asked.where(F.exists("wanted", lambda r: r["hot"])).mapInArrow(single, ", ".join(f"{n} long" for n in _WINDOW))
    return Shared(found.where(alike), segments, windows)


def shared_windows(windows: DataFrame) -> DataFrame:
    """The rows of Shared.windows that another document has, with hub and far, the least and the greatest
    (key, at) that have them. Minima are combined before the shuffle."""
    place = F.struct("key", (F.col("first") + F.col("skip")).alias("at"))
    ends = windows.groupBy("code").agg(F.min(place).alias("hub"), F.max(place).alias("far")).where("hub.key <> far.key")
    return windows.join(ends, "code")


def lots(batches, most: int = LOT_WORDS, by: str = "anchor", weight: str | None = "words"):
    """Rows that come sorted by `by`, as tables of whole groups of about `most` words, or bytes of `weight`
    by 4, or, without it, rows."""
    held, size, edge = [], 0, None
    for batch in batches:
        at = 0
        group = batch.column(by).to_numpy()
        if not len(group):
            continue
        own = pc.binary_length(batch.column(weight)).to_numpy(zero_copy_only=False) // 4 if weight else np.ones(len(group), np.int64)
        total = np.cumsum(own)
        starts = np.flatnonzero(np.concatenate([[edge is None or group[0] != edge], group[1:] != group[:-1]]))
        for s in starts.tolist():
            if size + int(total[s - 1] if s else 0) - int(total[at - 1] if at else 0) >= most:
                held.append(batch.slice(at, s - at))
                yield pa.Table.from_batches([h for h in held if h.num_rows]).combine_chunks()
                held, size, at = [], 0, s
        held.append(batch.slice(at))
        size += int(total[-1]) - int(total[at - 1] if at else 0)
        edge = group[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_anchor(segments: DataFrame) -> DataFrame:
    return segments.repartition("anchor").sortWithinPartitions("anchor", "key", "first", "last")
