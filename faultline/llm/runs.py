"""Runs of equal keys in sorted partitions, and matrices from columns of lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _turns(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows at which any key differs from the row before."""
    turn = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        held = table.column(key).to_numpy()
        turn |= held[1:] != held[:-1]
    return np.flatnonzero(turn) + 1


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal keys, with the bounds of the runs; the last run of a batch waits for the next."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        turns = _turns(table, keys)
        if len(turns):
            yield table.slice(0, turns[-1]), np.concatenate([[0], turns])
            held = table.slice(turns[-1])
        else:
            held = table if table.num_rows else held
    if held is not None and held.num_rows:
        yield held, np.concatenate([[0], _turns(held, keys), [held.num_rows]])


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix of doubles."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = held.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(held), -1)


def by_length(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the lists of each length."""
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(held.offsets.to_numpy())
    for length in (found := np.unique(lengths)):
        if len(found) == 1:
            yield np.arange(len(held)), matrix(held)
            return
        at = np.flatnonzero(lengths == length)
        yield at, matrix(held.take(pa.array(at)))


def unit_rows(points: np.ndarray) -> np.ndarray:
    """Rows of length one, scaled first so that no square overflows."""
    scaled = points / np.abs(points).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))
