"""Packing of tokenized documents into windows by minimum bin slack.

A document's ids and the end id fill whole windows as far as they go; what remains of each document waits
in the task as a multiset of lengths. A window takes the longest waiting piece and then the set of further
pieces that comes closest to the capacity: a bitset holds every reachable sum, one shift for each length and
power of two of its copies, and the sums are traced back to counts. The same pattern is used as often as the
counts allow. If no set fills the window exactly, one more piece is cut to fill it. Less than a window is left
over by each task; these rests are packed the same way in groups of ``TASKS_PER_GROUP`` tasks, so at most one
window of a group is padded.

Memory: a task holds ``WAITING_PIECES`` rests. Defined results: a null or empty text is one end id; rows with
the same id or a null id are packed as they come, each for itself; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import blocks, worker_encoder
from faultline.llm.frames import stage, whole_text

CAPACITY = 2048
END_ID = 1
WAITING_PIECES = 4096
TASKS_PER_GROUP = 512

Piece = tuple[int | None, int, int, bytes]  # document, start, tokens of the document, ids


def closest_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many pieces of each length to take: the longest one and the set that leaves the least slack beside it."""
    longest = max(counts)
    room = capacity - longest
    mask, reach = (1 << room + 1) - 1, 1
    layers: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        copies = min(counts[length] - (length == longest), room // length)
        take = 1
        while copies > 0 and not reach >> room & 1:
            take = min(take, copies)
            layers.append((length, take, reach))
            reach |= reach << length * take & mask
            copies -= take
            take *= 2
        if reach >> room & 1:
            break
    chosen = {longest: 1}
    at = reach.bit_length() - 1
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


class Packer:
    """Fills windows from waiting pieces and yields rows (piece, window, offset)."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity, self.window, self.tokens, self.pieces = capacity, 0, 0, 0
        self.waiting: dict[int, list[Piece]] = {}

    def add(self, piece: Piece) -> None:
        self.waiting.setdefault(len(piece[3]) // 4, []).append(piece)
        self.tokens += len(piece[3]) // 4
        self.pieces += 1

    def _take(self, length: int) -> Piece:
        held = self.waiting[length]
        piece = held.pop()
        if not held:
            del self.waiting[length]
        self.tokens -= length
        self.pieces -= 1
        return piece

    def _place(self, lengths: list[int]) -> Iterator[tuple[Piece, int, int]]:
        offset = 0
        for length in lengths:
            yield self._take(length), self.window, offset
            offset += length
        if offset < self.capacity and self.waiting and self.tokens >= self.capacity - offset:
            # Every piece still waiting is longer than the slack, or the set above would have taken it.
            document, start, total, ids = self._take(max(self.waiting))
            cut = self.capacity - offset
            self.add((document, start + cut, total, ids[4 * cut :]))
            yield (document, start, total, ids[: 4 * cut]), self.window, offset
        self.window += 1

    def whole(self, piece: Piece) -> tuple[Piece, int, int]:
        self.window += 1
        return piece, self.window - 1, 0

    def fill(self, least: int) -> Iterator[tuple[Piece, int, int]]:
        """Fill windows while at least ``least`` tokens wait."""
        while self.tokens >= max(least, 1):
            counts = {length: len(held) for length, held in self.waiting.items()}
            chosen = closest_fill(counts, self.capacity)
            lengths = [length for length, n in chosen.items() for _ in range(n)]
            full = sum(lengths) == self.capacity
            for _ in range(min(counts[length] // n for length, n in chosen.items()) if full else 1):
                yield from self._place(lengths)


ROW = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _rows(placed: list[tuple[Piece, int | None, int]], base: int, extra: dict, id_type: pa.DataType) -> pa.RecordBatch:
    columns = {
        "doc_id": pa.array([p[0] for p, _, _ in placed], id_type),
        "start": pa.array([p[1] for p, _, _ in placed], pa.int64()),
        "length": pa.array([len(p[3]) // 4 for p, _, _ in placed], pa.int64()),
        "ids": pa.array([p[3] for p, _, _ in placed], pa.binary()),
        "doc_tokens": pa.array([p[2] for p, _, _ in placed], pa.int64()),
        "sequence_id": pa.array([None if w is None else base + w for _, w, _ in placed], pa.int64()),
        "offset": pa.array([o for _, _, o in placed], pa.int64()),
    }
    columns |= {name: pa.array([value] * len(placed), pa.int64()) for name, value in extra.items()}
    return pa.RecordBatch.from_pydict(columns)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are little-endian unsigned 32-bit."""
    chosen = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = Packer(capacity), TaskContext.get().partitionId()
        encoder, id_type = worker_encoder(path), pa.int64()

        def shipped(placed: list) -> pa.RecordBatch:
            return _rows(placed, task << 32, {"task": task}, id_type)

        for batch in batches:
            id_type, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            at = 0
            for block in blocks(batch.column(1).to_pylist()):
                flat, sizes = encoder.encode(block)
                begin = 0
                placed: list[tuple[Piece, int | None, int]] = []
                for document, size in zip(ids[at : at + len(block)], sizes.tolist(), strict=True):
                    tokens = np.append(flat[begin : begin + size], end_id).astype("<u4").tobytes()
                    begin, total = begin + size, size + 1
                    for start in range(0, total, capacity):
                        piece = (document, start, total, tokens[4 * start : 4 * (start + capacity)])
                        if len(piece[3]) == 4 * capacity:
                            placed.append(packer.whole(piece))
                        else:
                            packer.add(piece)
                    if packer.pieces >= WAITING_PIECES:
                        placed += packer.fill(capacity)
                    if len(placed) >= WAITING_PIECES:
                        yield shipped(placed)
                        placed = []
                at += len(block)
                if placed:
                    yield shipped(placed)
        placed = list(packer.fill(capacity))
        rest = [(piece, None, 0) for held in packer.waiting.values() for piece in held]
        yield shipped(placed + rest)

    def in_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group, id_type = Packer(capacity), 0, pa.int64()
        for batch in batches:
            rows = batch.to_pydict()
            id_type = batch.schema.field("doc_id").type
            for n, group in enumerate(rows["group"]):
                packer.add((rows["doc_id"][n], rows["start"][n], rows["doc_tokens"][n], rows["ids"][n]))
        yield _rows(list(packer.fill(1)), 1 << 62 | group << 32, {}, id_type)

    first = stage(chosen.mapInArrow(in_task, f"doc_id {kind}, {ROW}, task long"))
    rest = first.where("sequence_id is null").withColumn("group", F.floor(F.col("task") / TASKS_PER_GROUP))
    packed = rest.groupBy("group").applyInArrow(in_group, f"doc_id {kind}, {ROW}")
    return first.where("sequence_id is not null").drop("task").unionByName(packed)
