from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from faultline.llm import packing, queries

from .conftest import NASTY, table


def check(rows, texts, capacity=2048):
    """Every id in exactly one piece, sequences gapless and within the capacity; returns the padding."""
    library = Tokenizer.from_file(queries.tokenizer_file())
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append((r.offset, r.length))
    assert sorted(pieces) == list(range(len(texts)))
    for doc, held in pieces.items():
        ids = [*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(held, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(windows) * capacity - total, len(windows)


def test_whole_table_is_packed_with_little_padding(spark, sample):
    rows = queries.QUERIES["op10_minimum_bin_slack"](spark, "/root/testdata/sf0.001").collect()
    padding, windows = check(rows, [t for _, t in sorted(sample)])
    assert padding < 2048 and windows > 50


def test_nasty_and_repeated_texts(spark, tmp_path):
    texts = [*NASTY, *["same words here " * 400] * 50]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    padding, _ = check(queries.QUERIES["op10_minimum_bin_slack"](spark, str(tmp_path)).collect(), texts)
    assert padding < 2048


def test_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op10_minimum_bin_slack"](spark, str(tmp_path)).count() == 0


def test_closest_fill_leaves_the_least_slack():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        chosen = packing.closest_fill(counts, 50)
        assert all(chosen[n] <= counts[n] for n in chosen) and max(counts) in chosen
        lengths = [n for n, k in counts.items() for _ in range(k)]
        lengths.remove(max(lengths))
        sums = (sum(c) + max(counts) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k))
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= 50)
