from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pytest

from faultline.llm import queries, suffix_dedup

from .conftest import NASTY, table


def brute(rows):
    """{doc_id: (n_bytes, n_removed, n_spans, digest of the rest)} by a table of all windows."""
    least: dict[bytes, int] = {}
    texts = [(n, (t or "").encode()) for n, t in rows]
    for n, text in texts:
        for at in range(len(text) - 49):
            window = text[at : at + 50]
            least[window] = min(n, least.get(window, n))
    out = {}
    for n, text in texts:
        gone = np.zeros(len(text) + 1, bool)
        for at in range(len(text) - 49):
            if least[text[at : at + 50]] < n:
                gone[at : at + 50] = True
        gone = gone[: len(text)]
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        rest = bytes(b for b, g in zip(text, gone.tolist(), strict=True) if not g)
        out[n] = (len(text), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest())
    return out


def run(spark, path):
    rows = queries.QUERIES["op7_difference_cover_dedup"](spark, str(path)).collect()
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def overlapping(rng, n):
    passages = ["".join(rng.choices("abcdé fgh", k=rng.randrange(30, 140))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages)[rng.randrange(10) :] if rng.random() < 0.6 else "".join(rng.choices("abcdefgh é", k=rng.randrange(120))) for _ in range(rng.randrange(1, 6))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("block", [2_000_000, 3_000])
def test_matches_all_windows(spark, tmp_path, monkeypatch, block):
    rng = random.Random(4)
    texts = [*NASTY, *overlapping(rng, 150), "ab" * 400, "ab" * 300 + "c", "x" * 49, "x" * 49, "y" * 50, "y" * 51]
    rng.shuffle(texts)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    table(spark, texts).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert run(spark, tmp_path) == brute(list(enumerate(texts)))


def test_sample_matches_all_windows(spark, sample):
    assert run(spark, "/root/testdata/sf0.001") == brute(sample)


def test_sorted_suffixes_are_in_order():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.integers(97, 99, 500).astype(np.uint8), np.zeros(24, np.uint8)])
    end = np.full(len(data), 500)
    wanted = np.arange(0, 440)
    got = np.concatenate(list(suffix_dedup.sorted_suffixes(data, end, wanted)))
    raw = data.tobytes()[:500]
    assert got.tolist() == sorted(wanted.tolist(), key=lambda n: raw[n:] + b"\0" * n)


def test_empty_repeated_and_null_ids(spark):
    assert suffix_dedup.cut(table(spark, [])).count() == 0
    text = "".join(random.Random(1).choices("abcdef", k=80))
    docs = spark.createDataFrame([(3, text), (3, text), (5, text), (None, text), (7, None)], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, len(r.kept)) for r in suffix_dedup.cut(docs).collect())
    assert kept == [(0, 80), (3, 80), (3, 80), (5, 0), (7, 0)]


def test_anchors_are_dealt_evenly():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    block = suffix_dedup.Block(data, np.arange(40), np.arange(1, 41) * 10_000)
    held = np.bincount(suffix_dedup.part_of(block.hash, 211), minlength=211)
    assert len(block.hash) > 10_000 and held.max() <= 1.5 * held.mean()


def test_answers_are_read_once_however_many_parts():
    """What comes back from ranges and buckets is laid by slices: a pass over the block for each of them took seconds."""
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 200_000).astype(np.uint8)
    block = suffix_dedup.Block(np.concatenate([passage, passage]), np.arange(40), np.arange(1, 41) * 10_000)
    names, parts = np.unique(block.hash), 20_000
    of = suffix_dedup.part_of(names, parts)
    low = np.lexsort((names & suffix_dedup.HALF, of))
    elsewhere = rng.random(len(names)) < 0.5
    answers = {int(k): np.packbits(elsewhere[low][of[low] == k]).tobytes() for k in np.unique(of)}
    begun = time.process_time()
    shared = block.shared(parts, answers)
    at, which, one = block.texts(shared)
    bucket, count = suffix_dedup.part_of(block.hash[one], parts), block.high[one] - block.low[one] + 1
    hit = rng.random(int(count.sum())) < 0.3
    ends = np.cumsum(count)
    flags = {int(k): np.packbits(np.concatenate([hit[ends[n] - count[n] : ends[n]] for n in np.flatnonzero(bucket == k)])).tobytes() for k in np.unique(bucket)}
    took = time.process_time() - begun
    begun = time.process_time()
    gone = suffix_dedup.removed(block, shared, parts, flags)
    assert time.process_time() - begun < 0.5 and took < 20
    twice = np.unique(block.hash, return_counts=True)[1] > 1
    assert (shared == (elsewhere | twice)[np.searchsorted(names, block.hash)]).all()
    expected = np.zeros(len(block.data), bool)
    for run, text in zip(at, which, strict=True):
        later = block.ids[block.run_doc[run]] > block.ids[block.run_doc[one[text]]]
        for n in range(count[text]):
            if later or hit[ends[text] - count[text] + n]:
                expected[block.low[run] + n : block.low[run] + n + 50] = True
    assert (gone == expected).all()


def test_windows_have_the_anchor_of_their_smallest_hash():
    """Each window of a text is in one run, and equal windows in runs of one hash."""
    rng = np.random.default_rng(6)
    passage = rng.integers(97, 100, 300).astype(np.uint8)
    sizes = [300, 0, 49, 50, 3, 300, 120]
    texts = [passage, passage[:0], passage[:49], passage[:50], passage[:3], passage, passage[100:220]]
    block = suffix_dedup.Block(np.concatenate(texts), np.arange(7), np.cumsum(sizes))
    seen: dict[bytes, int] = {}
    found = []
    for low, high, doc, name in zip(block.low, block.high, block.run_doc, block.hash, strict=True):
        for at in range(low, high + 1):
            found.append((int(doc), int(at)))
            assert seen.setdefault(block.data[at : at + 50].tobytes(), int(name)) == int(name)
    begin = np.cumsum(sizes) - sizes
    assert found == [(doc, int(begin[doc]) + at) for doc, size in enumerate(sizes) for at in range(size - 49)]


def test_only_windows_that_meet_again_are_sorted(monkeypatch):
    asked = []
    plain = suffix_dedup.sorted_suffixes
    monkeypatch.setattr(suffix_dedup, "sorted_suffixes", lambda data, end, wanted: asked.append(len(wanted)) or plain(data, end, wanted))
    rng = np.random.default_rng(7)
    texts = [rng.integers(97, 123, 70).astype(np.uint8) for _ in range(100)]
    texts += [texts[0][5:65], texts[1]]
    ids, lengths = np.arange(102), np.array([len(t) for t in texts])
    hit = suffix_dedup.decide(np.concatenate(texts), ids, lengths)
    expected = np.concatenate([np.full(n - 49, at >= 100) for at, n in enumerate(lengths)])
    assert (hit == expected).all() and asked == [22]  # 11 windows of the first text and as many of its part
