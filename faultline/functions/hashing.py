"""Offline hash embedding: map-only, one Arrow batch at a time.

Written with built-in expressions the same vector needs either a shuffle (explode
and group) or a fold that measured ten times slower than this helper, which hashes
each distinct token once and adds up whole batches in numpy.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.text import slices_of_chars

TOKEN = re.compile("[a-z0-9]+")  # fixed value
SPARSE_TYPE = "struct<at:array<int>,w:array<int>>"
BATCH_CHARS = 1 << 18  # whose tokens are held at a time, or those of one text


@lru_cache(maxsize=1 << 16)
def signed_bucket(token: str, dim: int) -> int:
    """Bucket number times two, plus one for a negative sign."""
    digest = int.from_bytes(hashlib.md5(token.encode()).digest(), "big")
    return digest % dim * 2 + (digest >> 8 & 1)


def hash_batch(texts: list[str | None], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row offsets, buckets and signed counts of a batch; buckets ascend and zero counts are left out."""
    found = [TOKEN.findall(t.lower()) if t else [] for t in texts]
    sizes = [len(f) for f in found]
    packed = np.fromiter((signed_bucket(t, dim) for f in found for t in f), np.int64, sum(sizes))
    cells = np.repeat(np.arange(len(texts)), sizes) * dim + packed // 2
    cells, inverse = np.unique(cells, return_inverse=True)
    counts = np.bincount(inverse, weights=1 - 2 * (packed % 2), minlength=len(cells)).astype(np.int32)
    cells, counts = cells[counts != 0], counts[counts != 0]
    offsets = np.searchsorted(cells, np.arange(len(texts) + 1) * dim)
    return offsets.astype(np.int32), (cells % dim).astype(np.int32), counts


def sparse_hash_vector(text: Column, dim: int) -> Column:
    """Signed token counts per bucket as ``struct<at, w>``, NULL text giving an empty vector."""

    @F.arrow_udf(SPARSE_TYPE)
    def hashed(texts: pa.Array) -> pa.Array:
        parts = [hash_batch(part.to_pylist(), dim) for part in slices_of_chars(texts, BATCH_CHARS)]
        sizes, at, w = (np.concatenate([np.zeros(0, np.int32), *found]) for found in zip(*[(np.diff(o), a, w) for o, a, w in parts], strict=True))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(offsets, at), pa.ListArray.from_arrays(offsets, w)], names=["at", "w"]
        )

    return hashed(text)


def dense_rows(texts: list[str | None], dim: int) -> np.ndarray:
    """L2-normalised vectors; a text without tokens gives the zero vector."""
    offsets, at, w = hash_batch(texts, dim)
    out = np.zeros((len(texts), dim))
    out[np.repeat(np.arange(len(texts)), np.diff(offsets)), at] = w
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.where(length == 0.0, 1.0, length)


def hash_embedding(text: Column, dim: int) -> Column:
    """The dense ``array<float>`` form, for tables that store embeddings."""

    @F.arrow_udf("array<float>")
    def embedded(texts: pa.Array) -> pa.Array:
        rows = dense_rows(texts.to_pylist(), dim).astype(np.float32)
        offsets = np.arange(0, rows.size + 1, dim, dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, rows.ravel())

    return embedded(text)
