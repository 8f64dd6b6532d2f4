import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import words as kernel

CHARS = [*"abcZ 09,.-", "é", "é", "́", "日", "本", "が", "ガ", "ー", "한", "하", "→", "😀", "“", "，", " ", "ß", "İ", "ſ", "क", "ि", "️", "❤", "٠", "Σ", "𠀀", "　", "ก", "ั"]
HARD = [None, "", "a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, "foo→bar", "안녕，세계", "a😀b", "你好，世界", "x" * 300_000 + "́"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(1)
    return ["".join(rnd.choice(CHARS) for _ in range(rnd.randrange(40))) for _ in range(6000)] + HARD


def test_words_are_those_of_the_sql(texts):
    w = kernel.words(pa.array(texts))
    con = duckdb.connect()
    con.register("t", pa.table({"i": range(len(texts)), "text": texts}))
    seen = {}
    for i, own in con.sql(f"SELECT i, {kernel.sql_words()} FROM t ORDER BY i").fetchall():
        hashes = w.h[w.ptr[i] : w.ptr[i + 1]].tolist()
        assert len(own or []) == len(hashes), texts[i]
        assert all(seen.setdefault(word, h) == h for word, h in zip(own or [], hashes)), texts[i]
    assert len(set(seen.values())) == len(seen) > 5000
    assert np.diff(w.ptr)[-len(HARD) :].tolist() == [0, 0, 1, 1, 2, 2, 2, 4, 1]


@pytest.mark.parametrize("step", [1, 3, 64, 999])
def test_a_document_is_hashed_alike_in_any_slice(texts, step):
    whole = kernel.words(pa.array(texts), prefixes=(4,))
    every = pa.array(texts)
    parts = [kernel.words(every.slice(k, step), prefixes=(4,)) for k in range(0, len(texts), step)]
    assert np.array_equal(np.concatenate([p.h for p in parts]), whole.h)
    assert np.array_equal(np.concatenate([p.prefixes[0] for p in parts]), whole.prefixes[0])
    assert np.array_equal(np.concatenate([np.diff(p.ptr) for p in parts]), np.diff(whole.ptr))


def test_composed_and_decomposed_texts_are_one():
    a, b = "naïve café が 한글", "naïve café が 한글"
    w = kernel.words(pa.array([a, b, "other é"]))
    assert np.array_equal(w.h[w.ptr[0] : w.ptr[1]], w.h[w.ptr[1] : w.ptr[2]])


def test_spans_and_anchors():
    rng = np.random.default_rng(2)
    w = kernel.words(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 3, n)) for n in (0, 4, 300, 40)]))
    for k, window in ((5, 9), (1, 1), (8, 43)):
        pos, first, last, key = kernel.winnow(w, k, window)
        g = kernel.grams(w.h, k)
        want = {}
        for d in range(4):
            for s in range(w.ptr[d], w.ptr[d + 1] - (k + window - 1) + 1):
                own = g[s : s + window] >> np.uint64(30)
                want.setdefault(int(s + window - 1 - np.argmin(own[::-1])), []).append(s)
        assert [(p, f, z) for p, f, z in zip(pos.tolist(), first.tolist(), last.tolist())] == [(p, min(s), max(s)) for p, s in sorted(want.items())]
    with pytest.raises(ValueError):
        kernel.winnow(w, 5, 0)
