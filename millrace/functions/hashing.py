"""Hashes. BLAKE2b has no builtin; the others stay in the JVM."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, functions as F

_AROUND = (("", "怎么做"), ("在家怎么做", ""), ("做", "需要哪些食材和步骤"), ("", "的家常做法是什么"), ("能告诉我", "怎么做吗"))
PROMPTS = tuple(f"{before}{{name}}{after}？" for before, after in _AROUND)


def blake2b(c: Column, size: int) -> Column:
    """BLAKE2b with a digest of `size` bytes, in hex. The size goes into the hash: it is no prefix."""

    @F.arrow_udf("string")
    def digest(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else hashlib.blake2b(v.encode(), digest_size=size).hexdigest() for v in x.to_pylist()], pa.string())

    return digest(c)


def prompt(name: Column) -> Column:
    """The question that a recipe answers: one of five, chosen by a hash of the name."""
    which = F.conv(blake2b(name, 2), 16, 10).cast("int") % len(PROMPTS)
    forms = F.array(*[F.lit(p) for p in PROMPTS])
    return F.replace(F.element_at(forms, which + 1), F.lit("{name}"), name)


def json_text(c: Column) -> Column:
    """A string as JSON writes it: quoted and escaped."""
    return F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)


def content_key(name: Column, ingredients: Column, steps: Column) -> Column:
    """SHA-256 of the compact JSON of [name, ingredients, steps]."""
    packed = F.concat(F.lit("["), json_text(name), F.lit(","), F.to_json(ingredients), F.lit(","), F.to_json(steps), F.lit("]"))
    return F.sha2(packed, 256)


def fingerprint(instruction: Column, input_: Column, output: Column) -> Column:
    """BLAKE2b-128 of a training row as compact JSON with sorted keys."""
    body = F.concat(F.lit('{"input":'), json_text(input_), F.lit(',"instruction":'), json_text(instruction), F.lit(',"output":'), json_text(output), F.lit("}"))
    return blake2b(body, 16)
