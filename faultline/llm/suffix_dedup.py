"""Removal of repeated byte strings by suffix sorting with a difference cover.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller id. Texts
are kept as UTF-8 in blocks of ``BLOCK_BYTES``; the suffixes that can matter are found and sorted in four steps.

1. Each window of ``LENGTH`` bytes is owned by the smallest hash among its ``GRAM``-grams, its anchor. Equal windows
   have equal anchors. Blocks send the hashes of their anchors to ranges, and learn which occur in other blocks.
2. For every shared anchor a block sends the text around it, which holds the windows that it owns, to the bucket of
   the anchor; equal texts of a block go once, with the smallest id (a block knows its own repetitions).
3. A bucket sorts the suffixes of its distinct texts. Ranks of the sample suffixes, those at places in a difference
   cover modulo 7, are computed beforehand; then the suffixes are sorted one part at a time by their first eight
   bytes, and longer ties by the ranks at the shift at which both places fall into the cover. Neighbours that agree
   in ``LENGTH`` bytes are one class, whose smallest id decides.
4. The answers, one bit a window, go back to the blocks, which cut their documents.

A task holds one block, or one range or bucket; these grow in number with the text, not in size, except for a text
in very many blocks, of which a bucket holds one copy a block. Defined results: a null or empty text has no bytes;
a row with a null id keeps its text and gives nothing to others; rows that share an id remove nothing from one
another; an empty table gives no rows; other columns are not read. Cuts are between bytes, so ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import gathered
from faultline.llm.frames import stage, whole_text
from faultline.llm.shingles import _LETTER, _powers, mixed

LENGTH = 50
GRAM = 20
BLOCK_BYTES = 1_000_000
#: Bytes of text for each range of anchors, and of text round shared anchors for each bucket of suffixes. Every block
#: sends a row to every bucket, so that few large ones keep the rows few.
RANGE_BYTES, BUCKET_BYTES = 32_000_000, 32_000_000
#: Usual bytes of the text round an anchor.
AROUND = LENGTH + 12
#: A bucket is sorted in parts, by its anchors, of some so many bytes, at most so many, and a part so many suffixes at a time.
PART_BYTES, PARTS = 250_000, 256
PART = 200_000
HALF = np.uint64(0xFFFFFFFF)

# A difference cover modulo 7: every difference of two residues is one of two of its members.
COVER = (1, 2, 4)
PERIOD = 7
SHIFT = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def spread(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


# --- one block ----------------------------------------------------------------


class Block:
    """The windows of a block of documents, grouped by the anchors that own them."""

    def __init__(self, data: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        self.data, self.ids, self.ends = data, ids, ends
        n, grams = len(data), LENGTH - GRAM + 1
        self.run_doc = np.zeros(0, np.int64)
        self.low = self.high = self.anchor = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        if n < LENGTH:
            return
        power, self.inverse = _powers(max(1 << 20, 1 << int(np.ceil(np.log2(n + 1)))))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data] * power[:n], out=self.sums[1:])
        value = mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.inverse[: n - GRAM + 1])
        # The high bits of a hash with its place below them: the least of a window is its smallest hash, the first of equal ones.
        places = np.uint64((1 << int(n).bit_length()) - 1)
        best, reach = (value & ~places) | np.arange(len(value), dtype=np.uint64), 1
        while reach < grams:
            step = min(reach, grams - reach)
            best = np.minimum(best[step:], best[:-step])
            reach += step
        inside = np.ones(n, bool)
        inside[np.maximum(ends[:, None] - np.arange(1, LENGTH), 0)] = False  # no window begins so near the end of a text
        starts = np.flatnonzero(inside[: len(best)])
        owner = (best & places).astype(np.int64)[starts]
        first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(starts) else np.zeros(0, int)
        last = np.append(first[1:], len(starts)) - 1
        self.low, self.high, self.anchor = starts[first], starts[last], owner[first]
        self.run_doc = np.searchsorted(ends, self.low, "right")
        # The smallest hash of a window is small by its nature; mixed again, anchors are dealt evenly by their high bits.
        self.hash = mixed(value[self.anchor])

    def shared(self, ranges: int, answers: dict[int, bytes]) -> np.ndarray:
        """Which runs have an anchor that occurs elsewhere, in this block or by the answers of the ranges."""
        names, which, count = np.unique(self.hash, return_inverse=True, return_counts=True)
        hit = count > 1
        cuts = np.searchsorted(part_of(names, ranges), np.arange(ranges + 1))
        for k, packed in answers.items():
            at = cuts[k] + np.argsort(names[cuts[k] : cuts[k + 1]] & HALF, kind="stable")
            hit[at] |= np.unpackbits(np.frombuffer(packed, np.uint8), count=len(at)).astype(bool)
        return hit[which] if len(which) else np.zeros(0, bool)

    def texts(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the shared runs: which distinct text each is; and for each text a run of the smallest id, in order of bucket."""
        at = np.flatnonzero(shared)
        if not len(at):
            return at, at, at
        low, high = self.low[at], self.high[at] + LENGTH
        name = mixed((self.sums[high] - self.sums[low]) * self.inverse[low] + (high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.lexsort((self.ids[self.run_doc[at]], name, self.hash[at]))
        new = np.r_[True, (name[order][1:] != name[order][:-1]) | (self.hash[at][order][1:] != self.hash[at][order][:-1])]
        which = np.empty(len(at), np.int64)
        which[order] = np.cumsum(new) - 1
        return at, which, at[order[new]]


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def block_of(row: dict) -> Block:
    return Block(spread(row["data"], "u1"), spread(row["ids"], "i8"), spread(row["ends"], "i8"))


# --- one bucket ---------------------------------------------------------------


def words_at(data: np.ndarray, at: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """The n-th eight bytes from each place as a big-endian number; bytes from ``left`` on count as 0."""
    eight = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
    word = eight[np.minimum(at + 8 * n, len(eight) - 1)].astype(np.uint64)
    keep = np.clip(left - 8 * n, 0, 8)
    mask = np.array([0, *(((1 << 8 * k) - 1) << 64 - 8 * k for k in range(1, 9))], np.uint64)
    return word & mask[keep]


def sorted_suffixes(data: np.ndarray, end: np.ndarray, wanted: np.ndarray) -> Iterator[np.ndarray]:
    """The wanted places in order of their suffixes, which end at ``end``; one part at a time.

    Places of one first word come in one part, so parts can be used by themselves.
    """
    # Ranks of the sample: every place near a wanted one that lies in the cover.
    near = np.zeros(len(data), bool)
    for shift in range(PERIOD):
        near[wanted + shift] = True
    places = np.flatnonzero(near)
    sample = places[np.isin(places % PERIOD, COVER)]
    depth = -(-int((end[sample] - sample).max(initial=0)) // 8)
    behind = np.zeros(len(sample), np.int32)
    for n in reversed(range(depth)):  # ranks of the words from the n-th on, from those of the words behind it
        word = words_at(data, sample, end[sample] - sample, n)
        order = np.lexsort((behind, word))
        new = np.zeros(len(order), bool)
        new[1:] = (word[order][1:] != word[order][:-1]) | (behind[order][1:] != behind[order][:-1])
        behind[order] = np.cumsum(new, dtype=np.int32)
    rank = np.zeros(len(data), np.int32)
    rank[sample] = behind
    first = words_at(data, wanted, end[wanted] - wanted, 0)
    by_first = np.argsort(first, kind="stable")
    edges = np.flatnonzero(np.r_[True, first[by_first][1:] != first[by_first][:-1]])
    cuts = edges[np.unique(np.searchsorted(edges, np.arange(0, len(wanted), PART)).clip(max=len(edges) - 1))] if len(edges) else edges
    for low, high in zip(cuts, [*cuts[1:], len(wanted)], strict=False):
        at = wanted[by_first[low:high]]
        group = np.cumsum(np.r_[0, first[by_first[low:high]][1:] != first[by_first[low:high]][:-1]]).astype(np.int64)
        residue = at % PERIOD
        members = []
        for r in range(PERIOD):
            own = np.flatnonzero(residue == r)
            key = group[own] << 32 | rank[at[own] + SHIFT[r][r]].astype(np.int64)
            members.append(own[np.argsort(key, kind="stable")])
        # A suffix comes after all smaller ones of every residue; pairs of residues compare at their own shift.
        final = np.zeros(len(at), np.int64)
        for r in range(PERIOD):
            own = members[r]
            final[own] += np.arange(len(own))
            for s in range(PERIOD):
                if s != r and len(members[s]) and len(own):
                    mine = group[own] << 32 | rank[at[own] + SHIFT[r][s]].astype(np.int64)
                    theirs = group[members[s]] << 32 | rank[at[members[s]] + SHIFT[r][s]].astype(np.int64)
                    final[own] += np.searchsorted(theirs, mine, "right" if s < r else "left")
        out = np.empty_like(at)
        out[final] = at
        yield out


def _met_again(data: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the windows may equal another one, by a hash of theirs; equal hashes only add candidates."""
    power, inverse = _powers(1 << max(20, int(np.ceil(np.log2(len(data) + 1)))))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    value = (sums[wanted + LENGTH] - sums[wanted]) * inverse[wanted]
    order = np.argsort(value)
    same = value[order][1:] == value[order][:-1]
    again = np.zeros(len(wanted), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again


def decide(whole: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For the windows of all texts, one after another: does the same window stand in a text of a smaller id?"""
    start = np.cumsum(lengths) - lengths
    ids = np.unique(ids, return_inverse=True)[1].reshape(-1).astype(np.int32)  # only their order counts
    # Equal texts are one, with their smallest id.
    rows = np.zeros((len(lengths), int(lengths.max())), np.uint8)
    inside = np.arange(rows.shape[1])[None, :] < lengths[:, None]
    rows[inside] = whole
    names = np.ascontiguousarray(np.concatenate([rows, lengths.astype(np.uint8)[:, None]], axis=1))
    _, one, which = np.unique(names.view(f"V{names.shape[1]}").reshape(-1), return_index=True, return_inverse=True)
    which = which.reshape(-1)
    least = np.full(len(one), np.iinfo(np.int32).max, np.int32)
    np.minimum.at(least, which, ids)
    size = lengths[one]
    padded = size + 8
    base = np.cumsum(padded) - padded
    data = np.zeros(int(padded.sum()) + 16, np.uint8)
    at = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(size.sum())
    data[at] = whole[np.repeat(start[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    del rows, names, at
    text = np.repeat(np.arange(len(one), dtype=np.int32), padded)
    end = np.append(np.repeat((base + size).astype(np.int32), padded), np.zeros(16, np.int32))
    windows = size - LENGTH + 1
    wanted = np.repeat(base - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    smallest = np.append(least[text], np.zeros(16, np.int32))  # of a window that no other equals
    for part in sorted_suffixes(data, end, wanted[_met_again(data, wanted)]):
        same = np.ones(len(part) - 1, bool)
        for n in range(-(-LENGTH // 8)):
            word = words_at(data, part, np.full(len(part), LENGTH), n)
            same &= word[1:] == word[:-1]
        heads = np.flatnonzero(np.r_[True, ~same])
        low = np.minimum.reduceat(least[text[part]], heads)
        smallest[part] = np.repeat(low, np.diff(np.append(heads, len(part))))
    # Back to the texts as they came.
    count = lengths - LENGTH + 1
    spot = np.repeat(base[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return smallest[spot] < np.repeat(ids, count)


# --- Spark --------------------------------------------------------------------


def blocks(docs: DataFrame) -> DataFrame:
    """(block, n_bytes, ids, ends, data, carried): texts in blocks, compressed, and the rows' further columns."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        carried: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for _, t in held]).astype(np.int64)
            ids = np.array([i for i, _ in held], np.int64)
            packed = zstandard.compress(b"".join(t for _, t in held), 3)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, carried[0].schema) as out:
                for part in carried:
                    out.write_batch(part)
            rest = zstandard.compress(sink.getvalue().to_pybytes(), 1)
            return pa.RecordBatch.from_pydict({"block": [task << 32 | n], "n_bytes": [size], "ids": [squeeze(ids)], "ends": [squeeze(ends)], "data": [packed], "carried": [rest]})

        for batch in batches:
            others = pa.RecordBatch.from_arrays(batch.columns[2:], names=batch.schema.names[2:]) if batch.num_columns > 2 else pa.record_batch([pa.nulls(batch.num_rows)], ["none"])
            begin = 0
            for at, (scalar, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                raw = text.as_buffer().to_pybytes()
                if held and size + len(raw) > BLOCK_BYTES:
                    carried.append(others.slice(begin, at - begin))
                    yield row()
                    n, held, size, carried, begin = n + 1, [], 0, [], at
                held.append((scalar, raw))
                size += len(raw)
            carried.append(others.slice(begin))
        if held:
            yield row()

    return stage(docs.mapInArrow(in_task, "block long, n_bytes long, ids binary, ends binary, data binary, carried binary"))


def shared_anchors(held: DataFrame, ranges: int) -> DataFrame:
    """(block, answers, hits): for each range a bit for every anchor of the block, set if another block has it too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = np.unique(block_of(row).hash)
                cuts = np.searchsorted(part_of(names, ranges), np.arange(ranges + 1))
                full = [k for k in range(ranges) if cuts[k] < cuts[k + 1]]
                # Within a range the low half tells anchors apart; a false meeting only adds candidates.
                parts = [squeeze(np.diff(np.sort((names[cuts[k] : cuts[k + 1]] & HALF).astype(np.int64)), prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T) for k in full]
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([row["block"]] * len(full), pa.int64()), pa.array(parts, pa.binary())], ["range", "block", "anchors"])

    def meet(table: pa.Table) -> pa.Table:
        lists = [np.cumsum(np.ascontiguousarray(spread(p, "u1").reshape(4, -1).T).view(np.uint32).reshape(-1).astype(np.int64)) for p in table.column("anchors").to_pylist()]
        names, count = np.unique(np.concatenate([np.unique(x) for x in lists]), return_counts=True)
        several = names[count > 1]
        shared = [_inside(x, several) for x in lists]
        return pa.table({
            "block": table.column("block"), "range": table.column("range"),
            "bits": pa.array([np.packbits(x).tobytes() for x in shared], pa.binary()), "hits": pa.array([int(x.sum()) for x in shared], pa.int64()),
        })

    sent = held.mapInArrow(send, "range int, block long, anchors binary")
    answered = sent.groupBy("range").applyInArrow(meet, "block long, range int, bits binary, hits long")
    return stage(answered.groupBy("block").agg(F.collect_list(F.struct("range", "bits")).alias("answers"), F.sum("hits").alias("hits")))


def _inside(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of slices that begin at ``start`` and have ``size`` entries, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _answers(row: dict, ranges: int) -> dict[int, np.ndarray]:
    return {a["range"]: a["bits"] for a in row["answers"] or []}


def repeated_windows(held: DataFrame, ranges: int, buckets: int) -> DataFrame:
    """(block, flags): for each bucket a bit for every window that the block sent there."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = block_of(row)
                _, _, one = block.texts(block.shared(ranges, _answers(row, ranges)))
                bucket = part_of(block.hash[one], buckets)
                edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(one) else np.zeros(0, int)
                sizes = block.high[one] + LENGTH - block.low[one]
                texts, begin = gathered(block.data, block.low[one], sizes).tobytes(), np.append(0, np.cumsum(sizes))
                out: dict[str, list] = {"bucket": [], "block": [], "ids": [], "lengths": [], "parts": [], "texts": []}
                for a, b in zip(edges, [*edges[1:], len(one)], strict=False):
                    runs = one[a:b]
                    out["bucket"].append(int(bucket[a]))
                    out["block"].append(row["block"])
                    out["ids"].append(squeeze(block.ids[block.run_doc[runs]]))
                    out["lengths"].append(squeeze(sizes[a:b].astype(np.uint8)))
                    out["parts"].append(squeeze((block.hash[runs] >> np.uint64(16)).astype(np.uint8)))
                    out["texts"].append(zstandard.compress(texts[begin[a] : begin[b]], 3))
                yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()), ("parts", pa.binary()), ("texts", pa.binary())]))

    def sort(table: pa.Table) -> pa.Table:
        lengths = [spread(p, "u1").astype(np.int64) for p in table.column("lengths").to_pylist()]
        ids = np.concatenate([spread(p, "i8") for p in table.column("ids").to_pylist()])
        parts = np.concatenate([spread(p, "u1") for p in table.column("parts").to_pylist()])
        texts = np.frombuffer(b"".join(zstandard.decompress(p) for p in table.column("texts").to_pylist()), np.uint8)
        size = np.concatenate(lengths)
        start, first = np.cumsum(size) - size, np.cumsum(size - LENGTH + 1) - (size - LENGTH + 1)
        hit = np.zeros(int((size - LENGTH + 1).sum()), bool)
        some = min(PARTS, -(-len(texts) // PART_BYTES))
        parts = parts.astype(np.int64) * some // PARTS
        order = np.argsort(parts, kind="stable")
        edges = np.searchsorted(parts[order], np.arange(some + 1))
        for a, b in zip(edges, edges[1:], strict=False):  # equal windows have one anchor, so they are in one part
            own = order[a:b]
            if len(own):
                spot = _places(first[own], size[own] - LENGTH + 1)
                hit[spot] = decide(gathered(texts, start[own], size[own]), ids[own], size[own])
        ends = np.cumsum([0, *(int((x - LENGTH + 1).sum()) for x in lengths)])
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    sent = held.mapInArrow(send, "bucket int, block long, ids binary, lengths binary, parts binary, texts binary")
    answered = sent.groupBy("bucket").applyInArrow(sort, "block long, bucket int, bits binary")
    return answered.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("flags"))


def removed(block: Block, shared: np.ndarray, buckets: int, flags: dict[int, bytes]) -> np.ndarray:
    """Which bytes of a block go."""
    at, which, one = block.texts(shared)
    cover = np.zeros(len(block.data) + 1, np.int64)
    if len(at):
        count = block.high[one] - block.low[one] + 1
        hit = np.zeros(int(count.sum()), bool)
        first = np.cumsum(count) - count
        # The texts lie in order of bucket, so the windows of each bucket are one slice.
        cuts = np.append(first, len(hit))[np.searchsorted(part_of(block.hash[one], buckets), np.arange(buckets + 1))]
        for k, packed in flags.items():
            hit[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=int(cuts[k + 1] - cuts[k]))
        size = count[which]
        spot = _places(first[which], size)
        own = block.ids[block.run_doc[at]]
        # A larger id than the smallest of the block with this text loses all its windows.
        gone = hit[spot] | np.repeat(own > block.ids[block.run_doc[one]][which], size)
        start = _places(block.low[at], size)[gone]
        cover += np.bincount(start, minlength=len(cover)) - np.bincount(start + LENGTH, minlength=len(cover))
    return np.cumsum(cover[:-1]) > 0


ROW = "n_bytes long, removed array<struct<start: long, end: long>>, kept binary, kept_text string"


def whole_characters(data: bytes, spans: list[dict]) -> str:
    """What the spans leave of a text, without characters that they cut in two."""
    at, parts = 0, []
    for span in [*spans, {"start": len(data), "end": len(data)}]:
        parts.append(data[at : span["start"]].decode("utf-8", "ignore"))
        at = span["end"]
    return "".join(parts)


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, removed, kept, kept_text) and the carried columns of every document: byte spans that go,
    the bytes that stay, and, if asked for, their text."""
    spark = docs.sparkSession
    further = [F.col(c).alias(f"carried_{c}") for c in carry]
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("text"), *further)
    held = blocks(chosen.where("doc_id is not null"))
    total = held.agg(F.sum("n_bytes")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(least, total // RANGE_BYTES)
    bare = held.drop("carried")
    counted = shared_anchors(bare, ranges)
    found = counted.drop("hits")
    buckets = max(least, AROUND * (counted.agg(F.sum("hits")).first()[0] or 0) // BUCKET_BYTES)
    flagged = repeated_windows(bare.join(found, "block", "left"), ranges, buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = block_of(row)
                gone = removed(block, block.shared(ranges, _answers(row, ranges)), buckets, {f["bucket"]: f["bits"] for f in row["flags"] or []})
                out: dict[str, list] = {"doc_id": [], "n_bytes": [], "removed": [], "kept": [], "kept_text": []}
                for name, a, b in zip(block.ids.tolist(), [0, *block.ends[:-1].tolist()], block.ends.tolist(), strict=True):
                    edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                    out["doc_id"].append(name)
                    out["n_bytes"].append(b - a)
                    out["removed"].append([{"start": x, "end": y} for x, y in edge.reshape(-1, 2).tolist()])
                    out["kept"].append(block.data[a:b][~gone[a:b]].tobytes())
                    out["kept_text"].append(whole_characters(block.data[a:b].tobytes(), out["removed"][-1]) if with_text else None)
                span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
                made = pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("removed", pa.list_(span)), ("kept", pa.binary()), ("kept_text", pa.string())]))
                others = pa.ipc.open_stream(zstandard.decompress(row["carried"])).read_all().combine_chunks()
                columns = [others.column(c).combine_chunks() for c in others.schema.names if c != "none"]
                yield pa.RecordBatch.from_arrays([*made.columns, *columns], [*made.schema.names, *(c for c in others.schema.names if c != "none")])

    kinds = "".join(f", carried_{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    done = held.join(found, "block", "left").join(flagged, "block", "left").mapInArrow(finish, f"doc_id long, {ROW}{kinds}")
    nameless = chosen.where("doc_id is null").select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start: long, end: long>>").alias("removed"),
        F.col("text").alias("kept"),
        (F.col("text").cast("string") if with_text else F.lit(None).cast("string")).alias("kept_text"),
        *(f"carried_{c}" for c in carry),
    )
    return done.unionByName(nameless).withColumnsRenamed({f"carried_{c}": c for c in carry})
