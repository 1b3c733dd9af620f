"""Paragraph packing: one text in, an array of chunks out, linear in the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK_LINE = "\n\n"  # fixed value
BATCH_CHARS = 1 << 20  # that are Python strings at a time, or those of one text


def slices_of_chars(texts: pa.Array, chars: int) -> Iterator[pa.Array]:
    """A batch of texts in parts of consecutive rows, one at least: a new part begins with every ``chars`` characters passed."""
    passed = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // chars
    edges = [0, *(np.flatnonzero(np.diff(passed)) + 1).tolist(), len(texts)]
    for start, end in zip(edges, edges[1:], strict=False):
        yield texts.slice(start, end - start)


def pack_paragraphs(text: str, max_chars: int) -> list[str]:
    """Chunks of consecutive paragraphs.

    A paragraph joins the open chunk while chunk + paragraph + 2 stays within the
    limit. One that is longer than the limit becomes a chunk of its own, whole.
    """
    chunks: list[list[str]] = []
    used = 0
    for block in filter(None, map(str.strip, text.split(BLANK_LINE))):
        if not chunks or used + len(block) + 2 > max_chars:
            chunks.append([block])
            used = len(block)
        else:
            chunks[-1].append(block)
            used += len(BLANK_LINE) + len(block)
    return [BLANK_LINE.join(chunk) for chunk in chunks]


def packed_chunks(text: Column, max_chars: int) -> Column:
    @F.arrow_udf("array<string>")
    def packed(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.string())
        parts = [
            pa.array([None if t is None else pack_paragraphs(t, max_chars) for t in part.to_pylist()], kind)
            for part in slices_of_chars(texts, BATCH_CHARS)
        ]
        return pa.concat_arrays(parts)

    return packed(text)
