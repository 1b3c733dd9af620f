"""Fill-in-the-middle documents, cut on units of the text by rank queries on a wavelet matrix.

Every character gets one of eight classes: newline, other white space, and letters, digits and signs that open
a word or stand inside one. A wavelet matrix over the classes of a block of texts, three bit vectors with a
count before each 64-bit word, answers how many characters of a class come before a place. The ranks of the
classes that bound a unit add up to boundary counts: newlines end lines, the three opening classes begin words.
Their difference between a text's ends is its number of units, and bisection on them finds both cuts, for all
texts of a block together. Only three numbers a text leave Python; texts are taken apart and put together by
DataFrame functions.

A line is ``[^\\n]*\\n|[^\\n]+``. A word is its characters that aren't white space with the white space after them,
the first one also with the white space before it. Cuts and forms follow from ``seed`` and the id alone, so a
rerun, or a task run again, gives the same output.

Memory: a task holds one block of about ``BLOCK_CHARS`` characters, or one text if that is longer. Defined
results: a null text is empty; empty texts and those that contain a marker stay as they are, with form plain
and null sizes; a null id counts as no digits; rows that repeat an id are cut alike, each for itself; an empty
table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.bpe import blocks
from faultline.llm.frames import whole_text

NEWLINE, SPACE, LETTER, DIGIT, SIGN = 0, 1, 2, 4, 6
LEVELS = 3
BLOCK_CHARS = 1 << 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: For each unit the classes whose ranks add up to its boundaries, and whether a boundary ends a unit or begins one.
UNITS = {"line": ((NEWLINE,), "ends"), "word": ((LETTER, DIGIT, SIGN), "begins")}


def _kinds() -> np.ndarray:
    """The class of every character of the basic plane, as if it opened a word."""

    def kind(c: str) -> int:
        return NEWLINE if c == "\n" else SPACE if c.isspace() else DIGIT if c.isdigit() else LETTER if c.isalpha() else SIGN

    return np.array([kind(chr(c)) for c in range(0x10000)], np.uint8)


_table: list[np.ndarray] = []


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts in a row, and where each text starts and the last one ends."""
    if not _table:
        _table.append(_kinds())
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    held = _table[0][np.minimum(codes, 0xFFFF)]
    held[codes > 0xFFFF] = LETTER
    inside = held >= LETTER
    after = np.zeros(len(held), bool)
    after[1:] = inside[1:] & inside[:-1]
    after[starts[:-1][starts[:-1] < len(held)]] = False
    return held + after.astype(np.uint8), starts


class Bits:
    """A bit vector with the number of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(8 + -len(packed) % 8, np.uint8)]).view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of the classes of a sequence: one bit vector for each bit of a class, highest first."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS) -> None:
        self.size, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            bit = (symbols >> np.uint8(level) & np.uint8(1)).astype(bool)
            self.levels.append(Bits(bit))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many symbols of one class come before each place."""
        first, last = np.zeros(1, np.int64), at
        for level, bits in zip(reversed(range(len(self.levels))), self.levels, strict=True):
            if symbol >> level & 1:
                first, last = bits.zeros + bits.rank(first), bits.zeros + bits.rank(last)
            else:
                first, last = first - bits.rank(first), last - bits.rank(last)
        return last - first

    def boundaries(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        return sum(self.rank(s, at) for s in symbols)

    def reach(self, symbols: tuple[int, ...], count: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first place before which there are ``count`` boundaries, by bisection; ``high`` if there is none."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            enough = self.boundaries(symbols, middle) >= count
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low


def cut_places(texts: list[str], draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Units of each text, and the places (in characters) after draw modulo units + 1 of them, a column for each draw."""
    symbols, side = UNITS[unit]
    held, starts = classes(texts)
    matrix = WaveletMatrix(held)
    first, last = starts[:-1], starts[1:]
    before = matrix.boundaries(symbols, first)
    units = matrix.boundaries(symbols, last) - before
    if side == "ends":
        open_end = (last > first) & (held[np.maximum(last, 1) - 1] != NEWLINE) if len(held) else np.zeros(len(texts), bool)
    else:
        open_end = (last > first) & (units == 0)
    units = units + open_end
    places = np.empty(draws.shape, np.int64)
    for column in range(draws.shape[1]):
        taken = draws[:, column] % (units + 1)
        if side == "ends":
            at = matrix.reach(symbols, before + taken, first, last)
        else:
            at = matrix.reach(symbols, before + taken + 1, first, last + 1) - 1
        places[:, column] = np.where(taken == 0, first, np.where(taken == units, last, at)) - first
    return units, places


def draw(doc_id: str, group: int, seed: int) -> Column:
    """One of the eight 8-digit groups of the hash of seed and id, as a number."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(hashed, 1 + 8 * group, 8), 16, 10).cast("long")


def transform(docs: DataFrame, *, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each text.

    ``rate`` per cent of the texts are cut, ``spm`` per cent of those with the suffix first.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, not {unit!r}")

    @F.arrow_udf("struct<n: long, first: long, second: long>")
    def cut(texts: pa.Array, one: pa.Array, other: pa.Array) -> pa.Array:
        draws = np.stack([a.to_numpy(zero_copy_only=False) for a in (one, other)], axis=1).reshape(-1, 2)
        parts, at = [], 0
        for block in blocks(texts.to_pylist(), BLOCK_CHARS):
            units, places = cut_places(block, draws[at : at + len(block)], unit)
            parts.append(np.column_stack([units, np.sort(places, axis=1)]))
            at += len(block)
        found = np.concatenate(parts) if parts else np.zeros((0, 3), np.int64)
        return pa.StructArray.from_arrays([pa.array(found[:, n]) for n in range(3)], ["n", "first", "second"])

    drawn = docs.select(
        F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"), *[draw(doc_id, n, seed).alias(f"h{n + 1}") for n in range(4)]
    )
    held = drawn.withColumn("cut", cut("text", "h1", "h2"))
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (F.pmod("h3", F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod("h4", F.lit(100)) < spm, "spm").otherwise("psm")
    first, second = F.col("cut.first"), F.col("cut.second")

    def part(begin: Column, size: Column) -> Column:
        return F.substr("text", (begin + 1).cast("int"), size.cast("int"))

    prefix, middle = part(F.lit(0), first), part(first, second - first)
    suffix = part(second, F.length("text") - second)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    formed = held.withColumn("form", form)
    whole = F.col("form") == "plain"
    return formed.select(
        "doc_id",
        F.col("cut.n").alias("n"),
        "form",
        F.when(~whole, first).alias("prefix_chars"),
        F.when(~whole, second - first).alias("middle_chars"),
        F.when(whole, F.col("text")).when(F.col("form") == "spm", spm_).otherwise(psm).alias("output"),
    )


def restore(output: str = "output", form: str = "form") -> Column:
    """The exact text from an output and its form. A text that is cut holds no marker, so each marker's first place is its own."""
    spm = F.col(form) == "spm"
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    left = F.split(body, F.when(spm, PREFIX).otherwise(SUFFIX), 2)
    right = F.split(F.get(left, F.lit(1)), F.lit(MIDDLE), 2)
    middle = F.get(right, F.lit(1))
    psm_text = F.concat(F.get(left, F.lit(0)), middle, F.get(right, F.lit(0)))
    spm_text = F.concat(F.get(right, F.lit(0)), middle, F.get(left, F.lit(0)))
    return F.when(F.col(form) == "plain", F.col(output)).when(spm, spm_text).otherwise(psm_text)
