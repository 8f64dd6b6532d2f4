"""Numpy kernels over the words of many documents at once.

A text is composed (NFC) and lower-cased. A word is a letter or digit and the letters, digits and
combining marks after it, by their Unicode categories; every character of the Han, Hiragana and
Katakana scripts is a word of its own, with the marks after it. All else parts words. Words are 64-bit
hashes of their bytes, so that n-grams, windows and comparisons are array arithmetic. What a document
is hashed to depends on nothing but its text, whichever others are in the batch.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U)
_P = U(0x9E3779B97F4A7C15)
_GRAM = U(0xD6E8FEB86659FD93)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(65, 91)]] = True
#: Bits of a winnowing key that hold a position; the others order the k-grams.
_POS_BITS = U(30)
_POS_MASK = U((1 << 30) - 1)

#: Characters that are words by themselves: Hiragana, Katakana and Han, first and last of each range.
ALONE = (
    (0x3005, 0x3005), (0x3007, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FD, 0x30FF),
    (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAD9), (0xFF66, 0xFF6F), (0xFF71, 0xFF9D), (0x20000, 0x323AF),
)
_NONE, _LETTER, _ALONE, _COMBINING = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """What each code point is: no part of a word, a letter or digit, a word of its own, or a mark."""
    kinds = {"L": _LETTER, "N": _LETTER, "M": _COMBINING}
    out = np.zeros(0x110000, np.uint8)
    for lo, hi in ((0x80, 0x40000), (0xE0000, 0xE0200)):  # no other plane has letters or marks
        out[lo:hi] = [kinds.get(unicodedata.category(chr(c))[0], _NONE) for c in range(lo, hi)]
    for lo, hi in ALONE:
        out[lo : hi + 1][out[lo : hi + 1] == _LETTER] = _ALONE
    return out


def sql_words(text: str = "text") -> str:
    """DuckDB SQL for the list of the words of a column."""
    alone = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in ALONE)
    return rf"regexp_extract_all(regexp_replace(lower(nfc_normalize({text})), '([{alone}]\p{{M}}*)', ' \1 ', 'g'), '[\p{{L}}\p{{N}}][\p{{L}}\p{{M}}\p{{N}}]*')"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers under which near numbers part."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    """Words of n documents in a row: hashes, and where each document's words begin."""

    h: np.ndarray
    ptr: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ptr, at, "right") - 1


def _lowered(texts: pa.Array) -> pa.Array:
    texts = pc.fill_null(texts, "")
    try:
        return pc.utf8_lower(_composed(texts))
    except pa.ArrowInvalid:  # bytes that are no UTF-8
        raw = texts.cast(pa.large_binary()).to_pylist()
        return pc.utf8_lower(_composed(pa.array([x.decode("utf-8", "replace") for x in raw], pa.large_string())))


def _composed(texts: pa.Array) -> pa.Array:
    """texts in NFC. A text without a character from U+0300 on is in it already."""
    off, data = _flat(texts)
    high = np.flatnonzero(data >= 0xCC)
    if not len(high):
        return texts
    own = np.unique(np.searchsorted(off, high, "right") - 1)
    held = texts.take(pa.array(own)).to_pylist()
    odd = [i for i, x in enumerate(held) if not unicodedata.is_normalized("NFC", x)]
    if not odd:
        return texts
    mask = np.zeros(len(texts), bool)
    mask[own[odd]] = True
    return pc.replace_with_mask(texts, pa.array(mask), pa.array([unicodedata.normalize("NFC", held[i]) for i in odd], texts.type))


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return off - off[0], raw


def words(texts: pa.Array | pa.ChunkedArray, prefixes: tuple[int, ...] = ()) -> Words:
    """The words of texts; a null is an empty text. prefixes: also hashes of the words' first bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return Words(np.empty(0, U), np.zeros(1, np.int64), tuple(np.empty(0, U) for _ in prefixes))
    off, b = _flat(_lowered(texts))
    n = len(b)
    if not n:
        return Words(np.empty(0, U), np.zeros(len(off), np.int64), tuple(np.empty(0, U) for _ in prefixes))
    word = _IS_WORD[b]
    start = word.copy()
    edge = off[:-1][off[:-1] < n]
    if (b >= 0x80).any():
        start = _beyond_ascii(b, word, edge)
    else:
        start[1:] &= ~word[:-1]
        start[edge] = word[edge]
    first = np.flatnonzero(start)
    if not len(first):
        return Words(np.empty(0, U), np.zeros(len(off), np.int64), tuple(np.empty(0, U) for _ in prefixes))
    ptr = np.searchsorted(first, off)
    rank = np.cumsum(word, dtype=np.int32)
    begin = rank[first] - 1
    body = b[word]
    lens = np.diff(np.append(begin, len(body)))
    value = _BYTE[body]
    value *= _powers("bytes", int(lens.max()))[np.arange(len(body), dtype=np.int32) - np.repeat(begin, lens)]
    heads = []
    for k in prefixes:
        head = np.zeros(len(begin), U)
        for j in range(k):
            head += np.where(lens > j, value[np.minimum(begin + j, len(value) - 1)], U(0))
        heads.append(mix(head + np.array([k], U) * _GRAM))
    return Words(mix(np.add.reduceat(value, begin)), ptr, tuple(heads))


def _beyond_ascii(b: np.ndarray, word: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where words begin. word says which bytes are ASCII letters or digits and is extended to all bytes
    of words; edge: where documents begin."""
    lead = np.flatnonzero(b >= 0xC2)
    size = 2 + (b[lead] >= 0xE0) + (b[lead] >= 0xF0).astype(np.int64)
    fits = lead + size <= len(b)
    lead, size = lead[fits], size[fits]
    code = (b[lead].astype(np.int32)) & (0xFF >> (size + 1)).astype(np.int32)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        code[more] = code[more] << 6 | (b[lead[more] + k] & 0x3F)
    kind = _classes()[code]
    letter = kind != _NONE
    for k in range(4):
        own = lead[letter & (size > k)] + k
        word[own] = True
    mark = kind == _COMBINING
    if mark.any():  # a mark belongs to a word only where a letter of the same document is before it
        mine, wide = lead[mark], size[mark]
        place = np.arange(len(b))
        body = np.ones(len(b), bool)
        for k in range(4):
            body[mine[wide > k] + k] = False
        held = np.maximum.accumulate(np.where(body, place, -1))[mine]
        begin = edge[np.searchsorted(edge, mine, "right") - 1]
        loose = (held < begin) | ~word[np.maximum(held, 0)]
        for k in range(4):
            word[mine[loose & (wide > k)] + k] = False
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[edge] = word[edge]
    alone = np.flatnonzero(kind == _ALONE)
    if len(alone):
        start[lead[alone]] = True
        after = lead[alone] + size[alone]
        if mark.any():  # marks stay with the character before them
            goes_on = np.zeros(len(b) + 1, bool)
            for k in range(4):
                goes_on[mine[wide > k] + k] = True
            live = np.flatnonzero(goes_on[after])
            while len(live):
                after[live] += 1
                live = live[goes_on[after[live]]]
        after = after[after < len(b)]
        start[after] |= word[after]
    return start


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (across documents: the caller leaves those out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _GRAM
        g += h[j : j + n]
    return mix(g)


def ends(w: Words) -> np.ndarray:
    """For each word the end of its document."""
    return np.repeat(w.ptr[1:], np.diff(w.ptr))


_POW: dict[str, np.ndarray] = {}
_PINV = U(pow(int(_P), -1, 2**64))


def _powers(which: str, n: int) -> np.ndarray:
    """At least the first n + 1 powers: of _P from the first on (bytes), from the zeroth on (up), or of
    its inverse (down)."""
    if n >= len(_POW.get(which, ())):
        size = max(1 << (12 if which == "bytes" else 18), 1 << int(n).bit_length())
        more = np.cumprod(np.full(size, _PINV if which == "down" else _P, dtype=U))
        _POW[which] = more if which == "bytes" else np.concatenate([np.ones(1, U), more])
    return _POW[which]


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hash of the words s..e-1 for many spans; equal spans have equal hashes wherever they are."""
    n = len(h)
    up, down = _powers("up", n), _powers("down", n)
    total = np.zeros(n + 1, U)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * _GRAM)


def winnow(w: Words, k: int, window: int) -> tuple[np.ndarray, ...]:
    """Winnowing: of every `window` consecutive k-grams of a document the least is chosen, the
    rightmost of equal ones. Returns the chosen positions, the first and the last window start that
    choose each, and the k-gram hashes. Any span of k + window - 1 words that two documents share
    makes both choose the same place in it.
    """
    if k < 1 or window < 1:
        raise ValueError(f"no span of {k + window - 1} words holds a window of {k}-grams")
    n, need = len(w.h), k + window - 1
    none = np.empty(0, np.int64)
    if n < need:
        return none, none, none, np.empty(0, U)
    g = grams(w.h, k)
    m = ((g >> _POS_BITS) << _POS_BITS) | (_POS_MASK - np.arange(len(g), dtype=U))
    span = 1
    while span * 2 <= window:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if rest := window - span:
        m = np.minimum(m[:-rest], m[rest:])
    start = np.flatnonzero(np.arange(len(m)) + need <= ends(w)[: len(m)])
    if not len(start):
        return none, none, none, np.empty(0, U)
    pos = (_POS_MASK - (m[start] & _POS_MASK)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]]))
    last = np.append(new[1:], len(pos)) - 1
    return pos[new], start[new], start[last], g[pos[new]]
