"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

``frequent_words`` counts the pre-tokens of a corpus with Spark, ``compile_lexicon`` turns the most
frequent of them into an automaton that shares prefixes and suffixes and whose arcs carry numbers: the
numbers along a word's path add up to the word's place in a table of token ids. The file is handed to
the executors once and memory-mapped there by every Python worker. A word that the automaton does not
hold is merged exactly, by rank, in numpy over all new words of a block together.

Defined results: a null text encodes as an empty one; an empty id list decodes to the empty string; ids
outside the vocabulary are skipped when decoding; repeated rows give repeated results; columns of the
input other than the one written are kept as they are.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import stage, whole_text

#: Words compiled into the transducer.
LEXICON_WORDS = 1 << 16
#: The longest word, in bytes, that the transducer holds and that numpy merges; longer ones are merged one by one.
SHORT_WORD = 24
#: Characters tokenized together, and longer words remembered by a worker.
BLOCK_CHARS = 900_000
REMEMBERED_WORDS = 50_000
NO_RANK = np.int32(2**31 - 1)


# --- the transducer -----------------------------------------------------------


class Transducer:
    """A minimal acyclic automaton over bytes; ``numbers`` maps words to their place in sorted order."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray, longest: int) -> None:
        self.keys, self.targets, self.adds, self.final, self.longest = keys, targets, adds, final, longest

    @classmethod
    def of(cls, words: list[bytes]) -> Transducer:
        """Compile sorted distinct words, sharing each finished suffix through a register."""
        register: dict[tuple, int] = {}
        arcs_of: list[tuple[tuple[int, int], ...]] = []
        final_of: list[bool] = []
        size_of: list[int] = []

        def settle(node: list) -> int:
            key = (node[0], tuple(node[1]))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs_of)
                arcs_of.append(key[1])
                final_of.append(node[0])
                size_of.append(node[0] + sum(size_of[to] for _, to in key[1]))
            return state

        open_nodes: list[list] = [[False, []]]
        last = b""
        for word in [*words, b""]:
            shared = 0
            while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                shared += 1
            for depth in range(len(last), shared, -1):
                state = settle(open_nodes.pop())
                open_nodes[-1][1].append((last[depth - 1], state))
            open_nodes += [[False, []] for _ in range(len(word) - shared)]
            if word:
                open_nodes[-1][0] = True
            last = word
        root = settle(open_nodes[0])
        # The root becomes state 0, so that a walk needs no starting point from outside.
        place = {root: 0} | {state: n + 1 for n, state in enumerate(s for s in range(len(arcs_of)) if s != root)}
        rows = []
        for state, arcs in enumerate(arcs_of):
            before = int(final_of[state])
            for byte, to in arcs:
                rows.append((place[state] << 8 | byte, place[to], before))
                before += size_of[to]
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        final = np.zeros(len(arcs_of), np.int64)
        for state, ends in enumerate(final_of):
            final[place[state]] = ends
        return cls(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), final, max(map(len, words), default=0))

    def numbers(self, words: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of each word (a row of bytes and its length), or -1; all words walk together, a byte at a time."""
        found = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return found
        at = np.flatnonzero((length > 0) & (length <= self.longest))
        state, number = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        for step in range(self.longest + 1):
            ended = length[at] == step
            good = ended & (self.final[state] == 1)
            found[at[good]] = number[good]
            at, state, number = at[~ended], state[~ended], number[~ended]
            if not len(at):
                break
            key = state << 8 | words[at, step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            alive = self.keys[arc] == key
            at, arc, number = at[alive], arc[alive], number[alive]
            state, number = self.targets[arc], number + self.adds[arc]
        return found


class Lexicon:
    """The transducer and the token ids of its words, as one file that workers memory-map."""

    PARTS = ("keys", "targets", "adds", "final", "starts", "ids")

    def __init__(self, transducer: Transducer, starts: np.ndarray, ids: np.ndarray) -> None:
        self.transducer, self.starts, self.ids = transducer, starts, ids

    def save(self, path: str) -> None:
        walk = self.transducer
        parts = [np.ascontiguousarray(x, np.int64) for x in (walk.keys, walk.targets, walk.adds, walk.final, self.starts, self.ids)]
        with open(path, "wb") as out:
            np.array([walk.longest, *map(len, parts)], np.int64).tofile(out)
            for part in parts:
                part.tofile(out)

    @classmethod
    def open(cls, path: str) -> Lexicon:
        whole = np.memmap(path, np.int64, mode="r")
        longest, *lengths = map(int, whole[: len(cls.PARTS) + 1])
        ends = np.cumsum([len(cls.PARTS) + 1, *lengths])
        keys, targets, adds, final, starts, ids = (whole[a:b] for a, b in zip(ends, ends[1:], strict=False))
        return cls(Transducer(keys, targets, adds, final, longest), starts, ids)


# --- the vocabulary and the exact merge ---------------------------------------


class Vocabulary:
    """Pre-tokens, merges and token strings of a word-level BPE file of the ``tokenizers`` format."""

    #: Text below U+0250 has no combining marks and settled classes, so Python splits it as the library does; capitals
    #: whose lower-case form lies above, such as U+0130, are left to the library.
    RISING = "".join(chr(c) for c in range(0x250) if max(chr(c).lower()) >= "\u0250")
    PLAIN = re.compile(f"[^\\x00-\\u024f]|[{RISING}]")
    SPACE = frozenset("\t\n\v\f\r \x85\xa0")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.tokens: list[str | None] = [None] * size
        for token, n in (self.vocab | self.special).items():
            self.tokens[n] = token
        # Bytes appear in the vocabulary as printable characters: themselves, or moved above U+0100 in order.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in set(kept)]
        self.shown = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(moved)}
        self.hidden = {c: b for b, c in self.shown.items()}
        self.byte_id = np.array([self.vocab[self.shown[b]] for b in range(256)], np.int32)
        self.last_id = np.array([self.vocab[self.shown[b] + self.suffix] for b in range(256)], np.int32)
        pairs = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.append((self.vocab[left] << 20 | self.vocab[right], rank, self.vocab[left + right]))
        self.ranked = {key: (rank, new) for key, rank, new in reversed(pairs)}
        self.pair_keys = np.array(sorted(self.ranked), np.int64)
        self.pair_ranks = np.array([self.ranked[int(k)][0] for k in self.pair_keys], np.int32)
        self.new_id = np.zeros(len(pairs), np.int32)
        for rank, new in self.ranked.values():
            self.new_id[rank] = new
        # The ranks of all pairs of single bytes, plain or last in a word, as one table.
        self.first_id = np.concatenate([self.byte_id, self.last_id])
        self.first_ranks = self.ranks(np.repeat(self.first_id, 512), np.tile(self.first_id, 512))
        kinds = {" ": 0, "L": 1, "N": 2}
        self.kind = np.array([0 if chr(c) in self.SPACE else kinds.get(unicodedata.category(chr(c))[0], 3) for c in range(0x250)], np.uint8)

    def is_plain(self, text: str) -> bool:
        return (text.isascii() or not self.PLAIN.search(text)) and ("<|" not in text or not self.special_split.search(text))

    def odd_words(self, text: str) -> list[str]:
        """The pre-tokens of any text, by the library's own splitting; a special token stands as itself."""
        found, at = [], 0
        for mark in self.special_split.finditer(text):
            found += [*self._library_words(text[at : mark.start()]), mark.group()]
            at = mark.end()
        return found + self._library_words(text[at:])

    def _library_words(self, text: str) -> list[str]:
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.hidden.__getitem__, piece)).decode() for piece, _ in pieces]

    def spans(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of plain texts: their UTF-8 bytes, start and end of every pre-token, and each text's number of pre-tokens."""
        parts = [text.lower().encode() for text in texts]
        data = np.frombuffer(b" ".join([*parts, b" " * 8]), np.uint8)
        kind = self.kind[data & 0x7F]
        lead = np.flatnonzero(data >= 0xC0)
        kind[lead] = kind[lead + 1] = self.kind[(data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F]
        first = np.empty(len(data), bool)
        first[0] = True
        np.not_equal(kind[1:], kind[:-1], out=first[1:])
        first |= (kind == 2) & (data < 0x80)
        first[lead[kind[lead] == 2]] = True
        edge = np.flatnonzero(first)
        start, end = edge, np.append(edge[1:], len(data))
        held = kind[start] != 0
        start, end = start[held], end[held]
        # An apostrophe that stands alone takes 's, 't, 'm, 'd, 're, 've or 'll from the letters after it.
        alone = np.flatnonzero((end[:-1] - start[:-1] == 1) & (data[start[:-1]] == 39) & (start[1:] == end[:-1]))
        alone = alone[kind[start[alone + 1]] == 1]
        if len(alone):
            one, two = data[end[alone]], data[end[alone] + 1]
            takes = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
            takes[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)] = 2
            start, end = start.copy(), end.copy()
            end[alone] += takes
            start[alone + 1] += takes
            left = start < end
            start, end = start[left], end[left]
        bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
        return data, start, end, np.diff(np.searchsorted(start, bounds))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK)

    def merge(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word (a row of bytes and its length): always the pair of lowest rank, the leftmost first.

        Returns all ids one after another and the number of ids of each word.
        """
        rows, width = words.shape
        cols = np.arange(width)[None, :]
        code = words.astype(np.int32)
        code[np.arange(rows), length - 1] += 256
        ranks = np.full((rows, width), NO_RANK, np.int32)
        ranks[:, :-1] = self.first_ranks[code[:, :-1] << 9 | code[:, 1:]]
        ranks[cols >= length[:, None] - 1] = NO_RANK
        ids = np.full((rows, width + 1), -1, np.int32)
        ids[:, :width] = self.first_id[code]
        ids[:, :width][cols >= length[:, None]] = -1
        at = np.arange(rows)
        while len(at):
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(best)), best]
            busy = np.flatnonzero(rank != NO_RANK)
            if not len(busy):
                break
            at, best, rank, ranks = at[busy], best[busy], rank[busy], ranks[busy]
            row = np.arange(len(at))
            now = ids[at]
            now[row, best + 1] = self.new_id[rank]
            # Everything right of the merged pair moves one place to the left.
            shift = cols + (cols >= best[:, None])
            now[:, :width] = np.take_along_axis(now, shift, axis=1)
            now[:, width] = -1
            ids[at] = now
            ranks = np.take_along_axis(ranks, np.minimum(shift, width - 1), axis=1)
            ranks[:, -1] = NO_RANK
            ranks[row, best] = self.ranks(now[row, best], now[row, best + 1])
            before = np.flatnonzero(best > 0)
            ranks[before, best[before] - 1] = self.ranks(now[before, best[before] - 1], now[before, best[before]])
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same merges for one word of any length, from a heap of pairs and a linked list."""
        ids = [*self.byte_id[list(word[:-1])].tolist(), int(self.last_id[word[-1]])]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and (hit := self.ranked.get(ids[left] << 20 | ids[right])):
                heapq.heappush(heap, (hit[0], left, ids[left], ids[right]))

        for left in range(len(ids) - 1):
            offer(left)
        while heap:
            rank, left, a, b = heapq.heappop(heap)
            right = after[left]
            if ids[left] != a or right < 0 or ids[right] != b:
                continue
            ids[left], ids[right] = int(self.new_id[rank]), -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        return np.array([n for n in ids if n >= 0], np.int32)


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct words of up to ``SHORT_WORD`` bytes, by width: rows of bytes, lengths, counts, and where which stands.

    Yields (words, length, count, at, which): word ``which[n]`` stands at place ``at[n]`` of ``start``.
    """
    length = end - start
    eight = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    mix = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    for width in range(8, SHORT_WORD + 1, 8):
        at = np.flatnonzero((length > width - 8) & (length <= width))
        if not len(at):
            continue
        packed = np.empty((len(at), width // 8), np.uint64)
        for n in range(width // 8):
            packed[:, n] = eight[np.minimum(start[at] + 8 * n, len(eight) - 1)] & mask[np.clip(length[at] - 8 * n, 0, 8)]
        key = packed[:, 0] if width == 8 else (packed * mix[: width // 8]).sum(axis=1, dtype=np.uint64)
        _, first, which, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        if width > 8 and not (packed == packed[first][which]).all():  # two words of one key: sort by the bytes themselves
            _, first, which, count = np.unique(packed, axis=0, return_index=True, return_inverse=True, return_counts=True)
        # A zero byte at a word's end looks like padding, so lengths tell words apart too.
        if not (length[at] == length[at[first]][which]).all():
            _, first, which, count = np.unique(np.column_stack([packed, length[at].astype(np.uint64)]), axis=0, return_index=True, return_inverse=True, return_counts=True)
        yield packed[first].view(np.uint8).reshape(len(first), width), length[at[first]], count, at, which.reshape(-1)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` that begin at ``start`` and have ``size`` entries, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


class Encoder:
    """Encodes blocks of texts: each distinct word of a block once, by the transducer or else by the exact merge."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.long_words: dict[bytes, np.ndarray] = {}

    def _long(self, word: bytes) -> np.ndarray:
        if len(word) > 256:
            return self.vocabulary.merge_long(word)
        if word not in self.long_words:
            if len(self.long_words) >= REMEMBERED_WORDS:
                self.long_words.clear()
            self.long_words[word] = self.vocabulary.merge_long(word)
        return self.long_words[word]

    def _ids_of(self, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, start, size) of the token ids of distinct words."""
        place = self.lexicon.transducer.numbers(words, length) if self.lexicon is not None else np.full(len(words), -1, np.int64)
        known, new = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        size = np.zeros(len(words), np.int64)
        parts = [np.zeros(0, np.int32)]
        if len(known):
            begin = self.lexicon.starts[place[known]]
            size[known] = self.lexicon.starts[place[known] + 1] - begin
            parts.append(gathered(self.lexicon.ids, begin, size[known]).astype(np.int32))
        if len(new):
            ids, size[new] = self.vocabulary.merge(words[new], length[new])
            parts.append(ids)
        order = np.concatenate([known, new])
        start = np.zeros(len(words), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate(parts), start, size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        plain = [n for n, text in enumerate(texts) if self.vocabulary.is_plain(text)]
        flat, sizes = self._encode_plain([texts[n] for n in plain])
        if len(plain) == len(texts):
            return flat, sizes
        held = dict(zip(plain, np.split(flat, np.cumsum(sizes)[:-1]), strict=True)) if plain else {}
        pieces = [held[n] if n in held else self._encode_odd(text) for n, text in enumerate(texts)]
        return np.concatenate(pieces), np.array([len(p) for p in pieces], np.int64)

    def _encode_odd(self, text: str) -> np.ndarray:
        special = self.vocabulary.special
        pieces = [np.array([special[w]], np.int32) if w in special else self._long(w.encode()) for w in self.vocabulary.odd_words(text)]
        return np.concatenate([np.zeros(0, np.int32), *pieces])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, start, end, words = self.vocabulary.spans(texts)
        begin, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        parts, base = [np.zeros(0, np.int32)], 0
        for rows, length, _, at, which in distinct_words(data, start, end):
            flat, first, count = self._ids_of(rows, length)
            begin[at], size[at] = base + first[which], count[which]
            parts.append(flat)
            base += len(flat)
        for n in np.flatnonzero(end - start > SHORT_WORD):
            parts.append(self._long(data[start[n] : end[n]].tobytes()))
            begin[n], size[n] = base, len(parts[-1])
            base += len(parts[-1])
        total = np.concatenate([[0], np.cumsum(size)])
        bounds = np.concatenate([[0], np.cumsum(words)])
        return gathered(np.concatenate(parts), begin, size), np.diff(total[bounds])


def blocks(texts: Iterable[str | None], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Consecutive texts in blocks of about ``limit`` characters, so that memory doesn't follow the batch."""
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text or "")
        size += len(block[-1]) + 1
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=4)
def worker_encoder(path: str, lexicon: str | None = None) -> Encoder:
    """One encoder for each worker and lexicon, kept for the worker's later tasks."""
    return Encoder(vocabulary(path), Lexicon.open(SparkFiles.get(lexicon)) if lexicon else None)


# --- Spark --------------------------------------------------------------------


def frequent_words(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text: str = "text") -> DataFrame:
    """The most frequent pre-tokens of all texts as (word, n), at most ``size``; counted in every task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist()):
                data, start, end, _ = held.spans([t for t in block if held.is_plain(t)])
                for rows, length, n, _, _ in distinct_words(data, start, end):
                    letters = rows[np.arange(rows.shape[1])[None, :] < length[:, None]].tobytes()
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    words = pa.Array.from_buffers(pa.string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
                    yield pa.RecordBatch.from_arrays([words, pa.array(n.astype(np.int64))], ["word", "n"])
                odd = Counter(w for t in block if not held.is_plain(t) for w in held.odd_words(t) if len(w.encode()) <= SHORT_WORD)
                yield pa.RecordBatch.from_arrays([pa.array(list(odd), pa.string()), pa.array(list(odd.values()), pa.int64())], ["word", "n"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n long")
    summed = stage(counted.groupBy("word").agg(F.sum("n").alias("n")))
    # The least count that leaves at most ``size`` words, from a histogram of a few hundred steps.
    steps = summed.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, held = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r.step):
        held += row.words
        if held > size:
            break
        least = row.least
    return summed.where(F.col("n") >= F.lit(least))


def compile_lexicon(words: DataFrame, path: str) -> str:
    """Compile (word, n) rows, at most ``LEXICON_WORDS`` of them, and hand the file to all executors; returns its name."""
    held = vocabulary(path)
    known = sorted({w.encode() for (w,) in words.select("word").limit(LEXICON_WORDS).collect()} - {s.encode() for s in held.special})
    known = [w for w in known if 0 < len(w) <= SHORT_WORD and b"\0" not in w]
    rows = np.frombuffer(b"".join(w.ljust(SHORT_WORD, b"\0") for w in known), np.uint8).reshape(-1, SHORT_WORD)
    ids, sizes = held.merge(rows, np.array([len(w) for w in known], np.int64))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = Path(tempfile.mkdtemp(prefix="lexicon-")) / name
    Lexicon(Transducer.of(known), starts, ids).save(str(place))
    words.sparkSession.sparkContext.addFile(str(place))
    return name


def _encoded(texts: pa.Array, path: str, lexicon: str | None) -> pa.ListArray:
    worker = worker_encoder(path, lexicon)
    flats, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for block in blocks(texts.to_pylist()):
        flat, size = worker.encode(block)
        flats.append(flat)
        sizes.append(size)
    offsets = np.cumsum(np.concatenate(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats)))


def _decoded(lists: pa.Array, path: str) -> pa.Array:
    table = pa.array(vocabulary(path).tokens, pa.string())
    flat, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    inside = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(table))), flat, None)
    taken = table.take(inside)
    if taken.null_count:
        there = np.concatenate([[0], np.cumsum(taken.is_valid().to_numpy(zero_copy_only=False))])
        offsets, taken = there[offsets], taken.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), taken), " ")


def encode(docs: DataFrame, path: str, lexicon: str | None = None, text: str = "text", into: str = "ids") -> DataFrame:
    """Add the token ids of each text as ``array<int>``."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return _encoded(texts, path, lexicon)

    return docs.withColumn(into, ids(whole_text(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of each id list: token strings, special tokens included, joined by a space."""

    @F.arrow_udf("string")
    def joined(lists: pa.Array) -> pa.Array:
        return _decoded(lists, path)

    return docs.withColumn(into, joined(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def encode_and_decode(docs: DataFrame, path: str, lexicon: str | None = None, text: str = "text") -> DataFrame:
    """Add ``ids`` and the text ``decoded`` from them in one pass, with one Python worker a task instead of two."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def both(texts: pa.Array) -> pa.Array:
        ids = _encoded(texts, path, lexicon)
        return pa.StructArray.from_arrays([ids, _decoded(ids, path)], ["ids", "decoded"])

    done = docs.withColumn("round_trip", both(whole_text(text)))
    return done.withColumns({"ids": F.col("round_trip.ids"), "decoded": F.col("round_trip.decoded")}).drop("round_trip")


def sha256_of_ids(ids: str | Column) -> Column:
    """Lowercase hex of the decimal ids joined by one space."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"), " "), 256)
