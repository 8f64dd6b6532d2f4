import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from millrace.llm import tokens
from tests.llm import cases


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 32), st.integers(0, 400), st.sampled_from([1, 3, 8, 100, 1024]), st.integers(0, 2**32))
def test_round_trip(bits, n, block, seed):
    ids = np.random.default_rng(seed).integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
    data, offsets = tokens.pack(ids, bits, block)
    text = ""
    for at in range(0, n, block):  # as a string of bits, low ones first
        own = "".join(format(int(i), f"0{bits}b")[::-1] for i in ids[at : at + block])
        text += own + "0" * (-len(own) % 8)
    assert data == bytes(int(text[i : i + 8][::-1], 2) for i in range(0, len(text), 8))
    assert np.array_equal(tokens.unpack(data, n, bits, offsets, block), ids)
    for k in range(0, n, 37):
        assert tokens.token_at(data, k, n, bits, offsets, block) == ids[k]


def test_width_and_limits():
    assert [tokens.width(v) for v in (1, 2, 3, 256, 257, 32000, 50257, 65536, 65537)] == [1, 1, 2, 8, 9, 15, 16, 16, 17]
    with pytest.raises(ValueError):
        tokens.pack(np.array([8]), 3)
    with pytest.raises(IndexError):
        tokens.token_at(b"", 0, 0, 4, [])


def test_texts_come_back(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    encoder = tokens.encoding()
    for r in tokens.packed(docs, block=100).collect():
        ids = tokens.unpack(bytes(r.tokens), r.n_tokens, r.bits, r.block_offsets, 100)
        assert encoder.decode(ids.tolist()) == text[r.doc_id] and len(r.block_offsets) == -(-r.n_tokens // 100)


def test_odd_rows(spark):
    docs = cases.odd(spark)
    got = tokens.packed(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_tokens == by[2].n_tokens == 0 and bytes(by[1].tokens) == b"" and by[1].block_offsets == []
    ids = tokens.unpack(bytes(by[6].tokens), by[6].n_tokens, by[6].bits, by[6].block_offsets)
    assert tokens.encoding().decode(ids.tolist()) == cases.LONG
    assert tokens.packed(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("vocabulary, bits", [("/opt/tokenizers/byte_bpe_multi_50k.tiktoken", 16), (None, 13)])
def test_the_query_equals_a_slow_restatement(spark, small, tmp_path, vocabulary, bits):
    if vocabulary is None:  # the first 5,000 ids of the file: a vocabulary that is no power of 256
        vocabulary = str(tmp_path / "small.tiktoken")
        with open(tokens.VOCABULARY) as lines, open(vocabulary, "w") as out:
            out.writelines(line for line in lines if int(line.split()[1]) < 5000)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    encoder = tokens.encoding(vocabulary)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in tokens.packed(docs, vocabulary, block=100).collect():
        ids = encoder.encode_ordinary(text[r.doc_id])
        assert (r.n_tokens, r.bits) == (len(ids), bits)
        stride = -(-100 * bits // 8)
        assert r.block_offsets == [i * stride for i in range(-(-len(ids) // 100))]
        number = int.from_bytes(bytes(r.tokens), "little")
        assert ids == [number >> (8 * stride * (k // 100) + k % 100 * bits) & (1 << bits) - 1 for k in range(len(ids))]


def test_long_runs():
    encoder = tokens.encoding()
    for n in (49_999, 50_000, 50_001, 120_000):
        for text in (" " * n + "x", "a b" + "\n" * n + " y", "\t" * n, "a" + " " * n + "1" + "\n" * n, " " * n + "\nx" + " " * n):
            assert tokens.encoded(encoder, text) == encoder.encode_ordinary(text)
    began = time.time()
    for text in (" " * 1_000_000 + "x", "x" + "\n" * 3_000_000 + "y", "a" * 1_000_000, "!?" * 500_000, "1" * 1_000_000, "日本" * 300_000):
        assert encoder.decode(tokens.encoded(encoder, text)) == text
    assert time.time() - began < 60
