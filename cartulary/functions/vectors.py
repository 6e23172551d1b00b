"""Tokens, hashed bag-of-words vectors and cosine."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cartulary.functions.text import let

# What counts as a token.
LATIN_TOKEN = "[a-z0-9]+"
CJK_CHARACTER = "[\\u4e00-\\u9fff]"


def embedding_tokens(text: Column) -> Column:
    """Tokens with repeats: Latin words, CJK characters, and bigrams of neighbouring CJK characters.

    Bigrams overlap, so they are read through a lookahead. Without lambdas the array can feed an Arrow UDF
    in the same projection.
    """
    latin = F.regexp_extract_all(F.lower(text), F.lit(LATIN_TOKEN), F.lit(0))
    characters = F.regexp_extract_all(text, F.lit(CJK_CHARACTER), F.lit(0))
    bigrams = F.regexp_extract_all(text, F.lit(f"(?=({CJK_CHARACTER}{{2}}))"), F.lit(1))
    return F.when(text.rlike(CJK_CHARACTER), F.concat(latin, characters, bigrams)).otherwise(latin)


def md5_buckets(tokens: Column, dimensions: int) -> Column:
    """Distinct cells that ``tokens`` hit under the md5 family, also those whose weights cancel."""
    return F.array_distinct(
        F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dimensions)
    )


def model_name(dimensions: int) -> str:
    return f"deterministic-hashing-{dimensions}"


def _digest_function(family: str):
    if family == "blake2b":
        return lambda data: hashlib.blake2b(data, digest_size=8).digest()
    if family == "md5":
        return lambda data: hashlib.md5(data).digest()
    raise ValueError(f"unknown hash family: {family}")


def hash_vector(dimensions: int, family: str = "blake2b"):
    """Arrow UDF: ``array<string>`` of tokens to a unit vector ``array<double>``.

    The built-in functions have no blake2b. The UDF runs inside the scan stage without a shuffle. Tokens are
    dictionary-encoded per batch, so each distinct token is hashed once, and the rest is numpy over the batch.
    """

    @F.arrow_udf(ArrayType(DoubleType()))
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        digest = _digest_function(family)

        @lru_cache(maxsize=1 << 20)
        def place(token: str) -> tuple[int, float]:
            raw = digest(token.encode("utf-8"))
            return int.from_bytes(raw[:4], "big") % dimensions, 1.0 if raw[4] % 2 == 0 else -1.0

        def vectors(lists: pa.Array) -> np.ndarray:
            rows = len(lists)
            sizes = np.nan_to_num(np.asarray(pc.list_value_length(lists), dtype=float)).astype(np.int64)
            words = pc.dictionary_encode(lists.flatten())
            if len(words) == 0:
                return np.zeros((rows, dimensions))
            places = [place(token) for token in words.dictionary.to_pylist()]
            bucket = np.array([p[0] for p in places], dtype=np.int64)
            sign = np.array([p[1] for p in places])
            owner = np.repeat(np.arange(rows, dtype=np.int64), sizes)
            pair, count = np.unique(owner * len(places) + np.asarray(words.indices), return_counts=True)
            row, code = pair // len(places), pair % len(places)
            cells = np.bincount(
                row * dimensions + bucket[code],
                weights=sign[code] * (1.0 + np.log(count)),
                minlength=rows * dimensions,
            ).reshape(rows, dimensions)
            norms = np.sqrt((cells * cells).sum(axis=1, keepdims=True))
            return cells / np.where(norms == 0.0, 1.0, norms)

        for batch in batches:
            # Slices bound the dense buffer, whatever the batch size of the session.
            parts = [vectors(batch.slice(at, 1024)) for at in range(0, len(batch), 1024)]
            dense = np.concatenate(parts) if parts else np.zeros((0, dimensions))
            offsets = pa.array(np.arange(len(dense) + 1, dtype=np.int32) * dimensions)
            yield pa.ListArray.from_arrays(offsets, pa.array(dense.ravel()))

    return embed


def _dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two vectors of equal size; a zero vector scores 0, unequal sizes raise an error."""
    left, right = left.cast("array<double>"), right.cast("array<double>")

    def ratio(parts: Column) -> Column:
        scale = F.sqrt(parts["l"]) * F.sqrt(parts["r"])
        return F.when(scale == 0.0, F.lit(0.0)).otherwise(parts["d"] / scale)

    parts = F.struct(_dot(left, right).alias("d"), _dot(left, left).alias("l"), _dot(right, right).alias("r"))
    return F.when(
        F.size(left) != F.size(right),
        F.raise_error(F.lit("vectors differ in their number of dimensions")).cast("double"),
    ).otherwise(let(parts, ratio))
