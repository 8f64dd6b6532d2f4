"""Toxicity: a factorization machine over hashed terms.

score(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, where x_i is 1 if a term that hashes to i
is in the document. The pairwise part is what additive weights miss: two terms that are harmless
alone and toxic together. Terms are the distinct words of the whole text. They are capped in no way.

Before the machine is fitted, terms without evidence are left out: a term stays if its class differs by
itself, or if a pair that it belongs to says what its two terms don't say each by itself. With all terms
in, the machine learns its few labelled rows by heart.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices
from millrace.llm.words import mix, words

#: At most so many labelled documents are used to fit the model.
TRAIN_ROWS = 20_000
BITS = 20
FACTORS = 4
THRESHOLD = 0.5
#: Standard errors that the evidence of a pair of terms must have, and the least share of the rows that
#: hold a term whose pairs are looked at.
PAIR_LEAST = 9.0
PAIR_SHARE = 0.03


@dataclass
class Model:
    """Weights of the terms that have any: known, a sorted array of hashed terms, and theirs."""

    bits: int
    bias: float
    known: np.ndarray
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities. A text without a single known term, a null or empty one too, has 0."""
        slot, among, near = self._slots()
        t, ptr = terms(texts, self.bits, among, near)
        at = slot[t]
        margin = self.bias + _sums(self.linear[at], ptr) + _pairs(self.factors[at], ptr)
        return np.where(ptr[1:] > ptr[:-1], 1 / (1 + np.exp(-np.clip(margin, -30, 30))), 0.0)

    def _slots(self) -> tuple[np.ndarray, ...]:
        """The place of each term in the weights or -1, whether it has one, and whether it or the term
        for its repetition has one."""
        if not hasattr(self, "_slot"):
            slot = np.full(1 << self.bits, -1, np.int32)
            slot[self.known] = np.arange(len(self.known), dtype=np.int32)
            among = slot >= 0
            self._slot = slot, among, among | among[_again(np.arange(1 << self.bits), self.bits)]
        return self._slot

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_slot"}


def _sums(x: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of x over ptr[i]:ptr[i + 1], 0 for an empty range."""
    out = np.zeros((len(ptr) - 1, *x.shape[1:]), x.dtype)
    some = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, ptr[some], axis=0)
    return out


def _pairs(v: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    return 0.5 * (_sums(v, ptr) ** 2 - _sums(v * v, ptr)).sum(axis=1)


def _again(t: np.ndarray, bits: int) -> np.ndarray:
    """The term that says that t occurs more than once."""
    return (mix(t.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int64)


def terms(texts: pa.Array, bits: int = BITS, among: np.ndarray | None = None, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed terms of each text, and where each text's terms begin. Terms are words and
    their beginnings of 4 and 5 bytes, by which an inflected form is known that was never labelled,
    and for each of these that occurs again, one that says so. among: a mask of the terms to keep; near:
    of those that are kept or whose repetition is.
    """
    w = words(texts, prefixes=(4, 5))
    doc = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(w.ptr))
    keys = []
    for h in (w.h, *w.prefixes):
        t = h >> np.uint64(64 - bits)
        own = doc
        if near is not None:
            hit = near[t]
            t, own = t[hit], doc[hit]
        keys.append(np.stack([own, t]))
    # a word of 4 or 5 bytes and its beginning are two terms, each counted by itself
    found = []
    for own, t in keys:
        key, times = np.unique((own << np.uint64(bits)) | t, return_counts=True)
        more = key[times > 1]
        twice = (more >> np.uint64(bits) << np.uint64(bits)) | _again(more & np.uint64((1 << bits) - 1), bits).astype(np.uint64)
        found += [key, twice]
    key = np.unique(np.concatenate(found))
    if among is not None:
        key = key[among[key & np.uint64((1 << bits) - 1)]]
    ptr = np.searchsorted(key >> np.uint64(bits), np.arange(len(texts) + 1, dtype=np.uint64))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int32), ptr


def _sign(terms: np.ndarray) -> bytes:
    return hashlib.blake2b(terms.tobytes(), digest_size=16).digest()


def evidence(rows: list[np.ndarray], labels: np.ndarray, bits: int, prior: float = 10.0) -> np.ndarray:
    """Z scores of the smoothed log odds of each term between the classes; 0 for unseen terms."""
    df = [_held(rows, labels, y, bits) for y in (0, 1)]
    share = float(np.mean(labels))
    a1, a0 = prior * share, prior * (1 - share)
    odds = np.log((df[1] + a1) / a1) - np.log((df[0] + a0) / a0)
    odds -= np.log((labels.sum() + a1) / a1) - np.log((len(labels) - labels.sum() + a0) / a0)
    return np.where(df[0] + df[1] > 0, odds / np.sqrt(1 / (df[1] + a1) + 1 / (df[0] + a0)), 0)


def _held(rows: list[np.ndarray], labels: np.ndarray, y: int, bits: int) -> np.ndarray:
    """In how many rows of a class each term is."""
    out = np.zeros(1 << bits)
    own = [r for r, l in zip(rows, labels) if l == y]
    for at in range(0, len(own), 1000):
        out += np.bincount(np.concatenate(own[at : at + 1000]), minlength=1 << bits)
    return out


def _together(rows: list[np.ndarray], n: int, lo: int, hi: int) -> np.ndarray:
    """In how many rows the terms lo..hi-1 are with each of the terms lo..n-1."""
    out = np.zeros((hi - lo, n - lo), np.float32)
    for at in range(0, len(rows), 1000):
        x = np.zeros((min(1000, len(rows) - at), n - lo), np.float32)
        for i, r in enumerate(rows[at : at + 1000]):
            x[i, r[r >= lo] - lo] = 1
        out += x[:, : hi - lo].T @ x
    return out


def interacting(rows: list[np.ndarray], labels: np.ndarray, bits: int, least: float = PAIR_LEAST, share: float = PAIR_SHARE, prior: float = 10.0) -> np.ndarray:
    """Terms that say something about the class together with another term which the two don't say
    each by itself: the log odds of the documents that hold both are beyond those of either, their sum
    and none by at least `least` standard errors. All pairs are looked at of terms in at least `share`
    of the rows."""
    df = [_held(rows, labels, y, bits) for y in (0, 1)]
    common = np.flatnonzero(df[0] + df[1] >= max(10, share * len(rows)))
    slot = np.full(1 << bits, -1, np.int32)
    slot[common] = np.arange(len(common))
    own = [[x[x >= 0] for x in (slot[r] for r, l in zip(rows, labels) if l == y)] for y in (0, 1)]
    one = [d[common].astype(np.float32) for d in df]
    mass = [prior * (1 - float(labels.mean())), prior * float(labels.mean())]
    odds = lambda n1, n0: np.log(n1 / np.float32(mass[1]) + 1) - np.log(n0 / np.float32(mass[0]) + 1)
    base = odds(labels.sum(), len(labels) - labels.sum())
    alone = (odds(one[1], one[0]) - base).astype(np.float32)
    out = np.zeros(len(common), bool)
    step = 256
    for at in range(0, len(common), step):  # some terms at a time with those that follow
        to = min(at + step, len(common))
        n0, n1 = (_together(own[y], len(common), at, to) for y in (0, 1))
        l, i, j = odds(n1, n0) - np.float32(base), alone[at:to, None], alone[at:]
        # what the terms say by themselves, one of them, both or none, is no evidence of the pair
        l = np.maximum(l - np.maximum(np.maximum(i, j), np.maximum(i + j, 0)), np.minimum(np.minimum(i, j), np.minimum(i + j, 0)) - l)
        l /= np.sqrt(1 / (n1 + np.float32(mass[1])) + 1 / (n0 + np.float32(mass[0])))
        n0 += n1
        # too few to say, or one of the two always with the other: then they are one
        hit = (l >= least) & (n0 >= 10) & (n0 < np.float32(0.9) * np.minimum((one[1] + one[0])[at:to, None], (one[1] + one[0])[at:]))
        out[at:to] |= hit.any(axis=1)
        out[at:] |= hit.any(axis=0)
    return common[out]


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 6, rate: float = 0.1, batch: int = 256, l2: float = 1e-4, seed: int = 7, least: float = 3.0, balance: float = 0.5, pairs: float = PAIR_LEAST) -> Model:
    """Logistic loss, AdaGrad, over the terms whose class differs by at least `least` standard errors, by
    themselves or (`pairs`, see interacting) together with another term.
    balance: how far the rarer class is weighted up, 1 so that both count alike. Without both classes:
    a model that calls nothing toxic."""
    labels = np.asarray(labels, np.float64)
    rng = np.random.default_rng(seed)
    if len(rows):  # copies of one document are one piece of evidence
        kept = list({(_sign(r), y): i for i, (r, y) in enumerate(zip(rows, labels))}.values())
        rows, labels = [rows[i] for i in kept], labels[kept]
    positive = labels.sum()
    if not 0 < positive < len(labels):
        return Model(bits, -20.0, np.empty(0, np.int64), np.empty(0, np.float32), np.empty((0, factors), np.float32))
    known = np.union1d(np.flatnonzero(np.abs(evidence(rows, labels, bits)) >= least), interacting(rows, labels, bits, pairs))
    slot = np.full(1 << bits, -1, np.int32)
    slot[known] = np.arange(len(known))
    rows = [x[x >= 0] for x in (slot[r] for r in rows)]
    size = len(known)
    m = Model(bits, 0.0, known, np.zeros(size, np.float32), (rng.standard_normal((size, factors)) * 0.01).astype(np.float32))
    weight = np.where(labels > 0, (len(labels) / (2 * positive)) ** balance, (len(labels) / (2 * (len(labels) - positive))) ** balance)
    seen_w, seen_v, seen_b = np.full(size, 1e-6, np.float32), np.full((size, factors), 1e-6, np.float32), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            lens = np.array([len(rows[i]) for i in ids])
            ptr = np.concatenate([[0], np.cumsum(lens)])
            t = np.concatenate([rows[i] for i in ids]) if ptr[-1] else np.empty(0, np.int32)
            gb, used, gw, gv = gradients(m.bias, m.linear, m.factors, t, ptr, labels[ids], weight[ids], l2)
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            seen_b += gb**2
            m.linear[used] -= rate * gw / np.sqrt(seen_w[used])
            m.factors[used] -= 0.2 * rate * gv / np.sqrt(seen_v[used])
            m.bias -= rate * gb / np.sqrt(seen_b)
    return m


def gradients(bias: float, linear: np.ndarray, factors: np.ndarray, t: np.ndarray, ptr: np.ndarray, labels: np.ndarray, weight: np.ndarray, l2: float) -> tuple:
    """Of the mean loss of the rows t[ptr[i]:ptr[i + 1]]: by the bias; the terms of the rows, and by their
    linear weights and factors, with l2 times the weight added."""
    v = factors[t]
    total = _sums(v, ptr)
    margin = bias + _sums(linear[t], ptr) + 0.5 * (total**2 - _sums(v * v, ptr)).sum(axis=1)
    grad = (weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)).astype(linear.dtype)
    lens = np.diff(ptr)
    g = np.repeat(grad, lens)
    used, back = np.unique(t, return_inverse=True)
    gw = np.bincount(back, g, len(used)).astype(linear.dtype) + l2 * linear[used]
    per = g[:, None] * (np.repeat(total, lens, axis=0) - v)
    gv = np.stack([np.bincount(back, per[:, f], len(used)) for f in range(factors.shape[1])], axis=1).astype(linear.dtype) + l2 * factors[used]
    return float(grad.sum()), used, gw, gv


def sampled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms and labels of at most `rows` labelled documents, chosen by a hash of their ids. The ids
    go to the executors, which is why their number has a bound; only hashed terms come back."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    )

    def featurise(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                t, ptr = terms(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("toxic"), pa.array([t[ptr[i] : ptr[i + 1]].tobytes() for i in range(part.num_rows)], pa.binary())],
                    ["doc_id", "toxic", "terms"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull())
    got = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text").mapInArrow(featurise, "doc_id long, toxic int, terms binary").toArrow()
    ids, toxic, held = got.column("doc_id").to_numpy(), got.column("toxic").to_numpy(), got.column("terms").combine_chunks()
    del got
    flat, ptr = np.frombuffer(held.buffers()[2] or b"", np.int32), np.frombuffer(held.buffers()[1], np.int32)[held.offset :] // 4
    rows_ = [flat[ptr[i] : ptr[i + 1]] for i in range(len(ids))]  # views of one buffer
    order = sorted(range(len(ids)), key=lambda i: (ids[i], toxic[i], _sign(rows_[i])))
    return [rows_[i] for i in order], toxic[order].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return fit(*sampled(docs, labels, rows))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score) of every document that is toxic: score >= threshold.

    Every document is scored, over its whole text; the model is trained on the labelled ones. Null
    or empty text: not toxic. A toxic row without doc_id has a null there. Repeated rows are each
    judged, alike. Empty tables: no rows. Without labels of both classes nothing is toxic. Other
    columns are not looked at.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def score(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                p = model.value.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.round(p, 6))], ["doc_id", "score"]).filter(pa.array(p >= threshold))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that toxic_documents() doesn't find, unchanged and with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def keep(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.value.scores(part.column("text")) < threshold))

    return docs.mapInArrow(keep, docs.schema)
