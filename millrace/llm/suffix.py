"""Substring duplicates by a suffix array that is built column by column.

The collection is a lot of word sequences. Round j takes the j-th word from the end of every sequence
and inserts the suffixes that begin there, all at once, into the suffix array of the collection and its
array of common prefixes. A new suffix's slot follows from the slot of the suffix one word shorter:
within the suffixes with the same first word the order is that of the rest. The arrays of a round are
read from the file of the round before and written to the next one, front to back, a block at a time:
first the keys, which say where the new suffixes go, then the common prefixes, whose minima between two
slots are those of the suffixes one word longer, then both, merged with what is new. In memory are the
first HELD bytes of both files, a block, a table of bounded size and a few numbers for each sequence,
however long they are; the rest of the files is in the shared folder. The keys lead from each suffix to
the one a word shorter, so that which suffix is where, and with it the Burrows-Wheeler transform, is
read off at the end.

Long documents would need as many rounds as words. They enter as the segments around anchors that
another document has as well (see anchors), whose lengths are bounded by twice the threshold. Since
every window of the threshold's length lies whole in such a segment, nothing is lost.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from millrace.llm.anchors import HOT_SEGMENTS, MIN_WORDS, by_anchor, lots, shared_segments, shared_windows
from millrace.llm.repeats import joined
from millrace.llm.shared import scratch_root

#: Suffixes of a block of the files, which may have up to twice as many.
BLOCK = 1 << 17
#: Bytes of a file that stay in memory.
HELD = 1 << 25
#: Entries of the table that says how far slots move in a round.
TABLE = 1 << 21
_PSI = np.int64((1 << 32) - 1)
#: What a file holds for each suffix: first word and the slot of the rest, and the common prefix with
#: the suffix before.
_COLUMNS = (("key", np.int64), ("lcp", np.int16))


class _Files:
    """The two files of a lot, that of the last round and that of the next. Each is a row of blocks, and a
    block has its columns one after another. Blocks beyond the first `held` bytes are in the shared folder."""

    def __init__(self, root: str, block: int = BLOCK, held: int = 0) -> None:
        self.fs, path = fs.FileSystem.from_uri(root.replace("s3a://", "s3://"))
        self.dir = f"{path.rstrip('/')}/millrace-suffixes/{uuid.uuid4().hex}"
        self.turn, self.blocks, self.block, self.held, self.made = 0, [], block, held, False

    @property
    def total(self) -> int:
        return sum(n for n, _ in self.blocks)

    def write(self, tables) -> None:
        """The next file, of tables of any size."""
        blocks, room, out = [], self.held, None
        try:
            for table in tables:
                n = len(table[0])
                parts = max(1, n // self.block)
                edges = [n * i // parts for i in range(parts + 1)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    part = [np.ascontiguousarray(c[a:b]) for c in table]
                    room -= sum(c.nbytes for c in part)
                    if room >= 0:
                        blocks.append((b - a, part))
                        continue
                    out = out or self._opened()
                    for c in part:
                        out.write(memoryview(c).cast("B"))
                    blocks.append((b - a, None))
        finally:
            if out:
                out.close()
        self.turn ^= 1
        self.blocks = blocks

    def _opened(self):
        if not self.made:
            self.fs.create_dir(self.dir)
            self.made = True
        return self.fs.open_output_stream(f"{self.dir}/{self.turn ^ 1}")

    def read(self, *columns: int):
        """(first slot, columns) of the blocks of the last file, from the first to the last."""
        at = slot = 0
        data = None
        try:
            for n, part in self.blocks:
                if part is None:
                    data = data or self.fs.open_input_file(f"{self.dir}/{self.turn}")
                    out = []
                    for i, (_, kind) in enumerate(_COLUMNS):
                        size = n * np.dtype(kind).itemsize
                        if i in columns:
                            data.seek(at)
                            out.append(np.frombuffer(data.read(size), kind))
                        at += size
                    yield slot, out
                else:
                    yield slot, [part[i] for i in columns]
                slot += n
        finally:
            if data:
                data.close()

    def close(self) -> None:
        self.blocks = []
        if self.made:
            self.fs.delete_dir(self.dir)


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of x[lo..hi], both inclusive, for many ranges: a range is two spans of a power of two."""
    out = np.empty(len(lo), x.dtype)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    edges = np.searchsorted(level[order], np.arange(level.max(initial=-1) + 2))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        own = order[a:b]
        out[own] = np.minimum(x[lo[own]], x[hi[own] - (1 << k) + 1])
        x = np.minimum(x[: -1 << k], x[1 << k :])
    return out


def _moves(at: np.ndarray, total: int, most: int = TABLE):
    """A function of slots: how many of the places `at`, in order and up to total, are not beyond them. What
    a table of at most so many entries leaves open is searched for."""
    by = (total // most).bit_length()
    table = np.repeat(np.arange(len(at) + 1, dtype=np.int32), np.diff(at >> by, prepend=0, append=(total >> by) + 1))
    if not by:
        return table.take

    def moves(slot: np.ndarray) -> np.ndarray:
        cell = slot >> by
        out = table[cell]
        mixed = np.flatnonzero(out != np.where(cell > 0, table[cell - 1], 0))
        out[mixed] = np.searchsorted(at, slot[mixed], "right")
        return out

    return moves


def _places(files: _Files, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For keys in order: before which slot each goes, and the keys of the slots before and there (-1 if none)."""
    at, before, after = (np.full(len(fresh), -1, np.int64) for _ in range(3))
    done, last, n = 0, -1, 0
    for slot, (key,) in files.read(0):
        to = int(np.searchsorted(fresh, key[-1], "right"))
        if to > done:
            own = np.searchsorted(key, fresh[done:to])
            at[done:to] = slot + own
            before[done:to] = np.where(own > 0, key[np.maximum(own - 1, 0)], last)
            after[done:to] = key[own]
        done, last, n = to, key[-1], slot + len(key)
    at[done:], before[done:] = n, last
    return at, before, after


def _prefixes(files: _Files, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes with the keys a and b, a before b. With the same first word it
    is one more than that of their rests, the least of the common prefixes between these."""
    out = np.zeros(len(a), np.int16)
    alike = np.flatnonzero((a >> 32 == b >> 32) & (a >> 32 > 0) & (a >= 0))
    if not len(alike):
        return out
    lo, hi = (a[alike] & _PSI) + 1, b[alike] & _PSI
    least = np.full(len(alike), np.iinfo(np.int16).max, np.int16)
    for slot, (lcp,) in files.read(1):
        own = np.flatnonzero((lo < slot + len(lcp)) & (hi >= slot))
        if len(own):
            x, y = np.maximum(lo[own] - slot, 0), np.minimum(hi[own] - slot, len(lcp) - 1)
            least[own] = np.minimum(least[own], _least(lcp, x, y))
    out[alike] = 1 + least
    return out


def build(symbols: np.ndarray, ptr: np.ndarray, files: _Files) -> tuple[np.ndarray, ...]:
    """(lcp, sequence, length, bwt) of all suffixes of the sequences symbols[ptr[i]:ptr[i + 1]], in
    order. Symbols are 1 and up; each sequence ends in a mark of its own below them."""
    n = np.diff(ptr)
    m = len(n)
    end = ptr[1:]
    files.write([(np.arange(m), np.zeros(m, np.int16))])
    slot = np.arange(m)
    rounds = int(n.max(initial=0))
    for j in range(1, rounds + 1):
        live = np.flatnonzero(n >= j)
        fresh = (symbols[end[live] - j].astype(np.int64) << 32) | slot[live]
        order = np.argsort(fresh)
        live, fresh = live[order], fresh[order]
        at, before, after = _places(files, fresh)
        follows = np.concatenate([[False], at[1:] == at[:-1]])  # the suffix before is new as well
        before[follows] = fresh[:-1][follows[1:]]
        last = np.flatnonzero(np.append(~follows[1:], True) & (after >= 0))  # an old one comes next
        common = _prefixes(files, np.concatenate([before, fresh[last]]), np.concatenate([fresh, after[last]]))
        mine, theirs = common[: len(live)], common[len(live) :]
        total = files.total
        moves = _moves(at, total)
        fresh += moves(fresh & _PSI)

        def merged():
            done = 0
            for first, (key, lcp) in files.read(0, 1):
                stop = first + len(key)
                to = len(at) if stop == total else int(np.searchsorted(at, stop, "left"))
                places = at[done:to] - first + np.arange(to - done)
                old = np.ones(len(key) + to - done, bool)
                old[places] = False
                keys, prefixes = np.empty(len(old), np.int64), np.empty(len(old), np.int16)
                keys[old], keys[places] = key + moves(key & _PSI), fresh[done:to]
                prefixes[old], prefixes[places] = lcp, mine[done:to]
                a, b = np.searchsorted(last, (done, to))
                own = last[a:b]
                prefixes[at[own] - first + own - done + 1] = theirs[a:b]
                yield keys, prefixes
                done = to

        files.write(merged())
        slot[live] = at + np.arange(len(live))
    key, lcp = (np.concatenate(c) for c in zip(*(c for _, c in files.read(0, 1))))
    longer = np.empty(len(key), np.int64)  # the slot of the suffix one word longer
    longer[key[m:] & _PSI] = np.arange(m, len(key))
    seq, length = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    own = here = np.arange(m)
    for j in range(rounds + 1):
        seq[here], length[here] = own, j
        more = n[own] > j
        own, here = own[more], longer[here[more]]
    bwt = np.where(length < n[seq], symbols[np.maximum(end[seq] - length - 1, 0)], 0).astype(np.int32)
    return lcp, seq, length, bwt


def repeated(lot: pa.Table, least: int, root: str, block: int = BLOCK, held: int = HELD) -> tuple[np.ndarray, ...]:
    """(key, start, stop): runs of windows of `least` words that another document of the lot has."""
    body = np.frombuffer(b"".join(lot.column("words").to_pylist()), np.int32)
    key, first, last = (lot.column(c).to_numpy() for c in ("key", "first", "last"))
    size = last - first + least
    ptr = np.concatenate([[0], np.cumsum(size)])
    symbols = np.unique(body, return_inverse=True)[1] + 1
    files = _Files(root, block, held)
    try:
        lcp, seq, length, _ = build(symbols, ptr, files)
    finally:
        files.close()
    head = lcp < least
    head[:1] = True
    starts = np.flatnonzero(head)
    owner = key[seq]
    group = np.cumsum(head) - 1
    several = (np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts))[group]
    hit = np.zeros(len(body) + 1, bool)
    some = several & (length >= least)
    hit[ptr[seq[some] + 1] - length[some]] = True
    at = np.flatnonzero(hit)
    if not len(at):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    own = np.searchsorted(ptr, at, "right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1])])
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(at)) - 1
    inner = at - ptr[own] + first[own]
    return key[own[a]], inner[a], inner[z] + least


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, hot: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the parts of each document that consist of windows of
    min_words words which another document holds too, in words of the lower-cased texts; overlapping
    and touching ones are one part.

    Null, empty and shorter texts have none. Rows without doc_id cannot be named and are left out;
    rows with the same id are one document, and what repeats only within a document is not reported.
    Empty tables: no rows. Other columns are not looked at. min_words below the 8 words of a seed, or
    beyond what the files hold of a common prefix: ValueError.
    """
    if min_words > np.iinfo(np.int16).max // 2:
        raise ValueError(f"min_words {min_words} must be {np.iinfo(np.int16).max // 2} at most")
    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("key"), "text")
    shared = shared_segments(keyed, "suffixes", least=min_words, hot=hot)
    root = scratch_root(docs.sparkSession)

    def compare(batches):
        for lot in lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in repeated(lot, min_words, root)], ["key", "start", "stop"])

    near = by_anchor(shared.segments).mapInArrow(compare, "key long, start long, stop long")
    alike = shared.alike.select("key", F.col("first").alias("start"), (F.col("last") + min_words).alias("stop"))
    at = F.col("first") + F.col("skip")
    single = shared_windows(shared.windows).select("key", at.alias("start"), (at + min_words).alias("stop"))
    spans = joined(alike.unionAll(near).unionAll(single), "key")
    return spans.select(F.col("key").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"))
