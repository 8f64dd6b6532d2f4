"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star
edges, and connected components.

One hash function parts the shingles of a document among BINS bins and keeps the least hash of each;
an empty bin takes the value of a bin that a second, universal hash chooses, again and again until
that one is not empty. Rows of the signature are folded into bands; documents with an equal band
share a bucket. In a bucket each document is compared with one of them, the hub of the star, and with
its neighbour in the order of the following band, so that a bucket of n has less than 2 n candidate
pairs. Every candidate pair is verified by all its shingles.

Documents with the same set of shingles are one node from the start, however many they are; buckets,
pairs and components hold nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.llm.graph import components
from millrace.llm.shared import BROADCAST_ROWS, checkpointed, row_key, slices, written
from millrace.llm.words import ends, grams, mix, span_hash, words

SHINGLE = 3
BINS = 128
#: Rows to a band. With 42 bands of 3 a pair of Jaccard 0.5 has an equal band in 99.6 % of cases.
ROWS = 3
#: Least Jaccard similarity of the shingle sets of copies.
THRESHOLD = 0.5

_U = np.uint64
_MASK = _U((1 << 57) - 1)
_EMPTY = _U(2**64 - 1)


def signatures(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """For each text a row of BINS minima, all empty where there is nothing to compare; its distinct
    shingles in order; and a hash of their set."""
    w = words(texts)
    n = len(texts)
    lens = np.diff(w.ptr)
    g, doc = np.empty(0, _U), np.empty(0, np.int64)
    if len(w.h) >= shingle:
        g = grams(w.h, shingle)
        at = np.flatnonzero(np.arange(len(g)) + shingle <= ends(w)[: len(g)])
        g, doc = g[at], np.repeat(np.arange(n), np.maximum(lens - shingle + 1, 0))
    short = np.flatnonzero((lens > 0) & (lens < shingle))
    if len(short):
        g, doc = np.concatenate([g, span_hash(w.h, w.ptr[short], w.ptr[short + 1])]), np.concatenate([doc, short])
    for i in np.flatnonzero(lens == 0).tolist():
        text = texts[i].as_py()
        if text and text.strip():  # no word: only the very same text is alike
            own = int.from_bytes(hashlib.md5(text.encode("utf-8", "replace")).digest()[:8], "big")
            g, doc = np.append(g, _U(own)), np.append(doc, i)
    out = np.full(n * BINS, _EMPTY)
    np.minimum.at(out, doc * BINS + (g >> _U(57)).astype(np.int64), g & _MASK)
    key = np.unique((doc.astype(_U) << _U(32)) | (g & _U(0xFFFFFFFF)))
    ptr = np.searchsorted(key >> _U(32), np.arange(n + 1, dtype=_U))
    low = key.astype(np.uint32)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(mix(mix(low.astype(_U)) + _U(0x9E3779B97F4A7C15)), dtype=_U)])
    return _densified(out.reshape(n, BINS)), [low[ptr[i] : ptr[i + 1]].tobytes() for i in range(n)], mix(total[ptr[1:]] - total[ptr[:-1]] + np.diff(ptr).astype(_U))


def _densified(m: np.ndarray) -> np.ndarray:
    doc, slot = np.nonzero((m == _EMPTY) & ~(m == _EMPTY).all(axis=1)[:, None])
    src = m.copy()
    attempt = 1
    while len(doc):
        choice = (mix(slot.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(attempt)) >> _U(57)).astype(np.int64)
        value = src[doc, choice]
        found = value != _EMPTY
        m[doc[found], slot[found]] = value[found]
        doc, slot = doc[~found], slot[~found]
        attempt += 1
    return m


def bands(m: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n = BINS // rows
    parts = m[:, : n * rows].reshape(len(m), n, rows)
    acc = np.broadcast_to(np.arange(n, dtype=_U), parts.shape[:2]).copy()
    for r in range(rows):
        acc = mix(acc * _U(0xD6E8FEB86659FD93) + parts[:, :, r])
    return acc.view(np.int64)


def _signed(keyed: DataFrame) -> DataFrame:
    names = ["key", "hash", "node", "bands", "shingles"]

    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                m, shingles, node = signatures(part.column("text"))
                some = np.flatnonzero(m[:, 0] != _EMPTY)
                b = bands(m[some])
                offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * b.shape[1])
                at = pa.array(some)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(at), part.column("hash").take(at), pa.array(node[some].view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(b.ravel())), pa.array([shingles[i] for i in some], pa.binary())], names
                )

    return keyed.mapInArrow(sign, "key long, hash long, node long, bands array<long>, shingles binary")


def jaccard(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of sets that signatures() has given, as binary arrays, pair by pair."""

    def keyed(sets):
        size = pc.binary_length(sets).to_numpy(zero_copy_only=False).astype(np.int64) // 4
        first = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset] // 4 if len(sets) else 0
        flat = np.frombuffer(sets.buffers()[2] or b"", np.uint32)[first : first + size.sum()]
        return size, (np.repeat(np.arange(len(sets), dtype=_U), size) << _U(32)) | flat

    (n, x), (m, y) = keyed(a), keyed(b)
    if not len(x) or not len(y):
        return np.zeros(len(a))
    common = x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x]
    both = np.bincount((common >> _U(32)).astype(np.int64), minlength=len(a))
    return both / np.maximum(n + m - both, 1)


#: Shingles that are compared at once, in bytes; a longer pair is taken whole.
COMPARED_BYTES = 4 << 20


def _alike(pairs: DataFrame, threshold: float) -> DataFrame:
    def verify(batches):
        for batch in batches:
            at = 0
            size = np.cumsum(sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in "xy"))
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + COMPARED_BYTES, "right")))
                part = batch.slice(at, to - at)
                yield part.select(["u", "v"]).filter(pa.array(jaccard(part.column("x"), part.column("y")) >= threshold))
                at = to

    return pairs.mapInArrow(verify, "u long, v long")


def _listed(df: DataFrame) -> DataFrame:
    """df, computed, and marked for a broadcast if it has few rows."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def groups(keyed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, hash, group) of all rows (key, hash, text) that have something to compare."""
    signed = written(_signed(keyed), "minhash")
    n = BINS // ROWS
    following = F.concat(F.slice("bands", 2, n - 1), F.slice("bands", 1, 1))
    nodes = signed.groupBy("node").agg(F.first("bands").alias("bands"))
    rows = nodes.select("node", F.explode(F.arrays_zip("bands", following.alias("following"))).alias("z")).select("node", F.col("z.bands").alias("band"), F.col("z.following").alias("following"))
    bucket = W.partitionBy("band")
    stars = rows.select("node", F.min("node").over(bucket).alias("hub"), F.lag("node").over(bucket.orderBy("following", "node")).alias("near"))
    pairs = stars.select("node", F.explode(F.array("hub", "near")).alias("other")).where("node <> other").select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v")).distinct()
    pairs = checkpointed(pairs)
    wanted = _listed(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    sets = signed.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    side = lambda k, x: sets.select(F.col("node").alias(k), F.col("shingles").alias(x))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").select("u", "v", "x", "y")
    linked = components(_alike(both, threshold))
    return signed.select("key", "hash", "node").join(linked, "node", "left").select("key", "hash", F.coalesce("root", "node").alias("group"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of) for every document that is a near or exact copy, directly or by way of
    others, of one with a lesser id; duplicate_of is the least id of its group, which stays.

    Null and empty texts are no one's copy; a text without words only of the very same text; one of
    fewer than 3 words of a text with the same words. Rows without doc_id cannot be named and are
    left out. Of rows with the same id each goes by its own text; a pair of ids is named once. Empty
    tables: no rows. Other columns are not looked at. Texts are hashed whole.
    """
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("key"), F.lit(0).cast("long").alias("hash"), "text")
    members = groups(keyed, threshold).select("group", "key")
    least = members.groupBy("group").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("group", "least")
    return members.join(least, "group").where("key > least").select(F.col("key").alias("doc_id"), F.col("least").alias("duplicate_of")).distinct()


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns kept.

    The row with the least id of a group stays; of several texts with that id the one with the least
    hash. A row without an id goes by a hash of its text. Of rows with the same id and text one stays,
    whatever their other columns hold; rows with the same id and texts that are no copies all stay.
    """
    mine, text = "__millrace_key", "__millrace_text"
    key, hashed = row_key(), F.xxhash64("text")
    members = groups(docs.select(key.alias("key"), hashed.alias("hash"), "text"), threshold).distinct()
    least = members.groupBy("group").agg(F.min(F.struct("key", "hash")).alias("least"), F.max(F.struct("key", "hash")).alias("most")).where("least <> most").select("group", "least")
    drop = members.join(least, "group").where("struct(key, hash) <> least").select(F.col("key").alias(mine), F.col("hash").alias(text))
    kept = docs.withColumns({mine: key, text: hashed}).join(_listed(drop), [mine, text], "left_anti")
    again = checkpointed(docs.groupBy(key.alias(mine), hashed.alias(text)).count().where("count > 1").select(mine))
    if not again.isEmpty():
        each = W.partitionBy(mine, text).orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]))
        kept = kept.withColumn("__millrace_nth", F.row_number().over(each)).where("__millrace_nth = 1")
    return kept.select(*[f"`{c}`" for c in docs.columns])
