"""Word shingles of whole texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 to the 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return out[0], out[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A to Z lower-cased and parted by ASCII white space, and each text's number of words."""
    parts = [t.encode().translate(_LOWER) for t in texts]
    data = np.frombuffer(b" " + b"".join(p + b" " for p in parts), np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    bounds = 1 + np.cumsum([0, *(len(p) + 1 for p in parts)])
    power, inverse = _powers(1 << int(np.ceil(np.log2(len(data) + 1))))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    words = mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return words, np.diff(np.searchsorted(start, bounds))


def shingle_sets(texts: list[str], k: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer than k words, one for the whole sequence."""
    words, sizes = word_hashes(texts)
    rolled = words.copy()
    for n in range(1, min(k, len(words))):
        rolled[: len(words) - n] = mixed(rolled[: len(words) - n] * _STEP + words[n:])
    out, at = [], 0
    for size in sizes.tolist():
        if size >= k:
            out.append(np.unique(rolled[at : at + size - k + 1]))
        elif size:
            whole = np.array([size], np.uint64)
            for word in words[at : at + size]:
                whole = mixed(whole * _STEP + word)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out
