"""Token ids in fixed-width bits.

Each id takes the least number of bits that the vocabulary needs, low bits first. A document's ids
are cut into blocks of BLOCK ids; a block begins on a byte, at its offset in block_offsets, so that any
id is found without the ones before it, and a block is unpacked by a few numpy operations.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from millrace.llm.shared import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 1024
_LONG_SPACE = regex.compile(r"\s{50000,}+")


@lru_cache(maxsize=2)
def encoding(path: str = VOCABULARY):
    """The tokenizer of a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("millrace", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(encoder, text: str) -> list[int]:
    """The ids of a text. The encoder's pattern looks for the end of white space step by step and fails
    on runs of a million; so a long run is encoded by itself but for its last character, which goes
    with what follows. That is where the pattern parts it, so the ids are those of the whole."""
    ids, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        if run.end() < len(text):
            ids += encoder.encode_ordinary(text[at : run.start()])
            ids += encoder.encode_ordinary(text[run.start() : run.end() - 1])
            at = run.end() - 1
    return ids + encoder.encode_ordinary(text[at:])


def width(vocabulary: int) -> int:
    """Bits that an id below `vocabulary` needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """The packed ids and the offset of each block in bytes."""
    ids = np.asarray(ids, np.uint64)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    stride = -(-block * bits // 8)
    offsets = np.arange(-(-len(ids) // block), dtype=np.int64) * stride
    if block * bits % 8 == 0:  # blocks end on a byte by themselves
        return _packed(ids, bits), offsets
    return b"".join(_packed(ids[at : at + block], bits) for at in range(0, len(ids), block)), offsets


def _packed(ids: np.ndarray, bits: int) -> bytes:
    """The low bits of each id one after another."""
    wide = ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : -(-bits // 8)]
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little", count=bits).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int, offsets, block: int = BLOCK) -> np.ndarray:
    """All n ids."""
    if not n:
        return np.empty(0, np.uint32)
    return np.concatenate([unpack_block(data, i, n, bits, offsets, block) for i in range(len(offsets))])


def unpack_block(data: bytes, i: int, n: int, bits: int, offsets, block: int = BLOCK) -> np.ndarray:
    """The ids of the i-th block of n ids."""
    many = min(block, n - i * block)
    raw = np.frombuffer(data, np.uint8, -(-many * bits // 8), int(offsets[i]))
    raised = np.unpackbits(raw, bitorder="little", count=many * bits).reshape(many, bits)
    wide = np.zeros((many, 32), np.uint8)
    wide[:, :bits] = raised
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def token_at(data: bytes, k: int, n: int, bits: int, offsets, block: int = BLOCK) -> int:
    """The k-th id, from its own bytes alone."""
    if not 0 <= k < n:
        raise IndexError(k)
    first = int(offsets[k // block]) * 8 + (k % block) * bits
    held = int.from_bytes(data[first // 8 : (first + bits + 7) // 8], "little")
    return (held >> (first % 8)) & ((1 << bits) - 1)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, bits, block_offsets, tokens) for every row of docs.

    Texts are encoded whole; what looks like a special token is ordinary text. A null or empty text
    has no tokens, no blocks and empty bytes. Rows are packed each for itself, so repeated rows and
    null ids give rows of their own, and other columns are not looked at. Empty tables: no rows.
    vocabulary: a file of ranks at the same path on every executor.
    """
    bits = width(max(encoding(vocabulary)._mergeable_ranks.values()) + 1)

    def encode(batches):
        encoder = encoding(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, offsets, data = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encoded(encoder, text) if text else []
                    body, at = pack(np.array(ids, np.uint32), bits, block)
                    sizes.append(len(ids))
                    offsets.append(at)
                    data.append(body)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([bits] * len(sizes), pa.int32()), pa.array(offsets, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                    ["doc_id", "n_tokens", "bits", "block_offsets", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, n_tokens long, bits int, block_offsets array<long>, tokens binary")
