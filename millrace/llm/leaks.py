"""Benchmark decontamination by winnowing.

Both sides keep, of every window of k-grams, the least one. A span of k + window - 1 words that a
document and a benchmark item share makes both keep the same k-gram in it, so joining the
fingerprints finds every such span. Hits are then extended both ways, word by word.

A benchmark of up to PART_BYTES is indexed once and sent to the executors; a larger one is joined by
its fingerprints in a shuffle, and only the documents that meet an item there are looked at with it.
Both ways find the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices, written
from millrace.llm.words import Words, mix, span_hash, winnow, words

K = 5
MIN_WORDS = 13
#: Text of a benchmark that may be broadcast.
PART_BYTES = 32 << 20
#: Hits that are extended at once.
LOT_HITS = 1 << 20


def _runs(pos: np.ndarray, key: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Anchors in rows of equal key at equal distances of at most k words: first place, distance, number.
    In such a row the words repeat themselves."""
    n = len(pos)
    gap = np.zeros(n, np.int64)
    if n > 1:
        d = pos[1:] - pos[:-1]
        gap[1:] = np.where((key[1:] == key[:-1]) & (doc[1:] == doc[:-1]) & (d <= k), d, 0)
    new = np.ones(n, bool)
    new[1:] = gap[1:] == 0
    # a row goes on only at the distance it began with
    new[2:] |= ~new[1:-1] & (gap[2:] != gap[1:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    step = np.where(count > 1, gap[np.minimum(first + 1, n - 1)] if n else 0, 0)
    return first, step, count


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, 0), (i, 1), ... (i, sizes[i] - 1) for every i."""
    i = np.repeat(np.arange(len(sizes)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Index:
    """Rows of fingerprints of benchmark items, sorted by hash: first place, distance, number. codes:
    sorted hashes of all windows of `least` words."""

    w: Words
    ids: list
    key: np.ndarray
    place: np.ndarray
    step: np.ndarray
    count: np.ndarray
    codes: np.ndarray
    k: int
    least: int
    paired: bool = False

    @classmethod
    def of(cls, ids: list, texts: list, k: int, least: int, paired: bool = False) -> Index:
        """paired: the i-th item is looked for in the i-th document alone."""
        w = words(pa.array(texts, pa.large_string()))
        a, first_window, last_window, key = winnow(w, k, least - k + 1)
        if paired:
            key = mix(key + mix(w.doc_of(a).astype(np.uint64)))
        first, step, count = _runs(a, key, w.doc_of(a), k)
        order = np.argsort(key[first], kind="stable")
        i, inner = _ranges(last_window - first_window + 1)
        s = first_window[i] + inner
        return cls(w, ids, key[first][order], a[first][order], step[order], count[order], np.unique(span_hash(w.h, s, s + least)), k, least, paired)

    def held(self, texts: pa.Array) -> np.ndarray:
        """Which of the texts share a span of `least` words with an item."""
        d = words(texts)
        a, lo, hi, key = winnow(d, self.k, self.least - self.k + 1)
        out = np.zeros(len(texts), bool)
        near = np.flatnonzero(_among(self.key, key))
        if len(near):
            i, inner = _ranges(hi[near] - lo[near] + 1)
            s = lo[near][i] + inner
            hit = _among(self.codes, span_hash(d.h, s, s + self.least))
            out[d.doc_of(s[hit])] = True
        return out

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        """Maximal shared spans of at least `least` words: document, item, first word in each, length."""
        d = words(texts)
        a, _, _, key = winnow(d, self.k, self.least - self.k + 1)
        if self.paired:
            key = mix(key + mix(d.doc_of(a).astype(np.uint64)))
        first, step, count = _runs(a, key, d.doc_of(a), self.k)
        a, key = a[first], key[first]
        lo, hi = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        i, inner = _ranges(hi - lo)
        j = lo[i] + inner
        alike = step[i] == self.step[j]
        # of two rows with one distance, each diagonal once; of others, all places with all
        n, m = count[i], self.count[j]
        size = np.where(alike, n + m - 1, n * m)
        found, at = [], 0
        while at < len(size):
            to = max(at + 1, int(np.searchsorted(np.cumsum(size[at:]), LOT_HITS, "right")) + at)
            r, c = _ranges(size[at:to])
            r += at
            same = alike[r]
            x = np.where(same, np.where(c < n[r], c, 0), c // m[r])
            y = np.where(same, np.maximum(c - n[r] + 1, 0), c % m[r])
            found.append(self._extended(d, a[i[r]] + x * step[i[r]], self.place[j[r]] + y * self.step[j[r]]))
            at = to
        return tuple(np.unique(np.concatenate(found), axis=0).T) if found else tuple(np.empty(0, np.int64) for _ in range(5))

    def _extended(self, d: Words, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        doc, item = d.doc_of(p), self.w.doc_of(q)
        left = _extend(d.h, self.w.h, p, q, d.ptr[doc], self.w.ptr[item], -1)
        _, once = np.unique(np.stack([p - left, q - left], axis=1), axis=0, return_index=True)
        p, q, doc, item, left = p[once], q[once], doc[once], item[once], left[once]
        right = _extend(d.h, self.w.h, p, q, d.ptr[doc + 1], self.w.ptr[item + 1], 1)
        s, t, length = p - left, q - left, left + right
        return np.unique(np.stack([doc, item, s - d.ptr[doc], t - self.w.ptr[item], length], axis=1)[length >= self.least], axis=0)


def _among(held: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(held):
        return np.zeros(len(asked), bool)
    return held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked


def _extend(x, y, p, q, p_end, q_end, step) -> np.ndarray:
    """Number of equal words from p and q on (step 1), or before them (step -1)."""
    out = np.zeros(len(p), np.int64)
    most = np.minimum(p_end - p, q_end - q) if step > 0 else np.minimum(p - p_end, q - q_end)
    live = np.flatnonzero(most > 0)
    k = 0
    while len(live):
        same = x[p[live] + k] == y[q[live] + k] if step > 0 else x[p[live] - k - 1] == y[q[live] - k - 1]
        live = live[same]
        out[live] += 1
        k += 1
        live = live[most[live] > k]
    return out


def _checked(k: int, least: int) -> None:
    if not 1 <= k <= least:
        raise ValueError(f"min_words {least} must be k {k} at least, and k 1")


def _rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")


def _fits(benchmark: DataFrame, part_bytes: int) -> bool:
    return (_rows(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= part_bytes


def index(benchmark: DataFrame, k: int, least: int):
    """A broadcast variable with the index of a benchmark whose size has been looked at."""
    own = sorted((r[0] is None, r[0] or 0, r[1]) for r in _rows(benchmark).distinct().collect())
    return benchmark.sparkSession.sparkContext.broadcast(Index.of([None if null else x for null, x, _ in own], [t for *_, t in own], k, least))


_NAMES = ["doc_id", "item_id", "doc_start", "item_start", "n_words"]
_SCHEMA = ", ".join(f"{n} long" for n in _NAMES)


def _met(rows: DataFrame, benchmark: DataFrame, k: int, least: int) -> DataFrame:
    """(row, item_id, item) for the rows (row, text) and the items that have a fingerprint in common,
    by a shuffle of the fingerprints."""

    def marks(name: str):
        def found(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    w = words(part.column("text"))
                    a, _, _, key = winnow(w, k, least - k + 1)
                    pair = np.unique(np.stack([w.doc_of(a), key.view(np.int64)], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([part.column(name).take(pa.array(pair[:, 0])), pa.array(pair[:, 1])], [name, "mark"])

        return found

    items = written(_rows(benchmark).distinct().withColumn("item", F.xxhash64("item_id", "text")), "items")
    own = items.select("item", "text").mapInArrow(marks("item"), "item long, mark long")
    met = rows.mapInArrow(marks("row"), "row long, mark long").join(own, "mark").select("row", "item").distinct()
    return met.join(items.withColumnRenamed("text", "item_text"), "item")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, min_words: int = MIN_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every maximal span of at least min_words words that a document shares with a benchmark item:
    (doc_id, item_id, doc_start, item_start, n_words), in words (see words) of both texts.

    Null, empty and shorter texts hold no such span, on either side; benchmark items of fewer than
    min_words words are never found. Null ids stay null. Repeated benchmark rows count once, a
    repeated document row is reported each time. Words that repeat themselves match at every shift,
    and each shift is a span. Empty tables: no rows. A benchmark of up to part_bytes is broadcast, and
    the documents are read once and never shuffled; of a larger one the fingerprints are shuffled.
    min_words below k: ValueError.
    """
    _checked(k, min_words)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if _fits(benchmark, part_bytes):
        held = index(benchmark, k, min_words)

        def find(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    doc, item, s, t, n = held.value.hits(part.column("text"))
                    if len(doc):
                        ids = pa.array([held.value.ids[i] for i in item], pa.int64())
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), ids, pa.array(s), pa.array(t), pa.array(n)], _NAMES)

        return narrow.mapInArrow(find, _SCHEMA)

    rows = narrow.withColumn("row", F.xxhash64("doc_id", "text"))
    met = _met(rows.select("row", "text").distinct(), benchmark, k, min_words)

    def pairs(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own, n = part.column("item_text").to_pylist(), part.num_rows
                one = Index.of(list(range(n)), own, k, min_words)
                doc, _, s, t, size = one.hits(part.column("text"), np.arange(n))
                if len(doc):
                    at = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("item_id").take(at), pa.array(s), pa.array(t), pa.array(size)], _NAMES)

    return rows.join(met, "row").select("doc_id", "item_id", "text", "item_text").mapInArrow(pairs, _SCHEMA)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, min_words: int = MIN_WORDS, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs in which contaminated() finds nothing, unchanged and with all their columns."""
    _checked(k, min_words)
    if _fits(benchmark, part_bytes):
        held = index(benchmark, k, min_words)

        def keep(batches):
            for batch in batches:
                for part in slices(batch, "text"):
                    yield part.filter(pa.array(~held.value.held(part.column("text"))))

        return docs.mapInArrow(keep, docs.schema)
    row = "__millrace_row"
    found = contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text").distinct(), benchmark, k, min_words, part_bytes).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, F.coalesce(F.xxhash64("text"), F.lit(0))).join(found, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
