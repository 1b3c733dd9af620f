from __future__ import annotations

import random
import re

import numpy as np

from faultline.llm import components as components_module
from faultline.llm import ngram_join, queries
from faultline.llm.components import components

from .conftest import NASTY, table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[n : n + 5]) for n in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    """{doc_id: (size, smallest reachable id)} from all pairs."""
    sets = {n: shingles(t) for n, t in rows}
    root = {n: n for n in sets}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {n: (len(sets[n]), top(n)) for n in ids}


def run(spark, docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs).collect()}


def near_copies(rng, groups, members):
    words = [f"w{n}" for n in range(3000)]
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randrange(20, 200))
        for _ in range(members):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy[rng.randrange(0, 4) :]))
    return texts


def test_matches_all_pairs(spark, monkeypatch):
    rng = random.Random(1)
    texts = [*NASTY, *near_copies(rng, 12, 14), *near_copies(rng, 1, 120)]
    rng.shuffle(texts)
    want = brute(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) > 20
    assert run(spark, table(spark, texts).repartition(5)) == want


def verified(monkeypatch):
    """Collects the pairs that go to verification."""
    seen, verify = [], ngram_join.verify

    def counted(pairs, texts, percent):
        seen.extend((r.a, r.b) for r in pairs.collect())
        return verify(pairs, texts, percent)

    monkeypatch.setattr(ngram_join, "verify", counted)
    return seen


def test_near_copies_that_do_not_link_make_few_pairs(spark, monkeypatch):
    # 280 copies of one text, and 120 of another that shares a passage with it; most are too far apart to link.
    rng = random.Random(5)
    words = [f"w{n}" for n in range(50_000)]
    base = rng.choices(words, k=150)
    texts = []
    for origin, members in ((base, 280), (base[:60] + rng.choices(words, k=90), 120)):
        for n in range(members):
            copy = list(origin)
            for at in rng.sample(range(150), 1 if n % 20 == 0 else rng.randrange(3, 6)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    seen = verified(monkeypatch)
    got = run(spark, table(spark, texts))
    assert got == brute(list(enumerate(texts)))
    assert len({c for _, c in got.values()}) > 200
    assert len(seen) == len(set(seen)) < 5 * len(texts)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 10, 200, 5000):
        x = rng.integers(0, 1 << 63, size).astype(np.uint64)
        y = np.concatenate([x[: size // 2], rng.integers(0, 1 << 63, size // 3).astype(np.uint64)])
        bits = int(np.bitwise_count(ngram_join.sketch(x) ^ ngram_join.sketch(y)).sum())
        assert bits <= len(np.setxor1d(x, y))
        assert size > 200 or bits >= len(np.setxor1d(x, y)) * 0.6


def test_sample_matches_all_pairs(spark, sample):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_rare_first_jaccard"](spark, "/root/testdata/sf0.001").collect()}
    assert rows == brute(sample)


def test_salted_tokens_match_all_pairs(spark, monkeypatch):
    # Every shingle counts as frequent, so that every group is dealt over parts.
    rng = random.Random(2)
    texts = near_copies(rng, 4, 30)
    docs = table(spark, texts)
    chosen = docs.select("doc_id", "text")
    order = spark.sparkContext.broadcast(np.full(ngram_join.COUNTERS, 0, np.uint32))
    rows = ngram_join.prefixes(chosen, order, 80)
    assert rows.count() > 0
    monkeypatch.setattr(ngram_join, "FREQUENT", -1)
    assert run(spark, docs) == brute(list(enumerate(texts)))


def test_empty_and_repeated_ids(spark):
    assert ngram_join.join(table(spark, [])).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z"), (2, "x y z"), (None, "x y z"), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.join(docs).collect())
    assert rows == [(0, 0, 0), (0, 1, 0), (1, 1, 1), (1, 2, 1), (2, 1, 1)]


def test_an_id_with_several_texts_ties_them_all(spark):
    texts = ["a b c d e f", "x y z", "one two three", "k l m n", "p q"]
    rows = [(9, t) for t in texts] + list(enumerate(texts, 1)) + [(20, "not tied")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.join(docs).collect()}
    assert got == {(n, 1) for n in (1, 2, 3, 4, 5, 9)} | {(20, 20)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {n: 0 for n in range(61)} | {100: 100, 101: 100}


def test_components_of_more_links_than_one_block_holds(spark, monkeypatch):
    monkeypatch.setattr(components_module, "BLOCK", 7)
    rng = random.Random(8)
    chain = [(n, n + 1) for n in range(60)]
    rng.shuffle(chain)
    got = {r.node: r.component for r in components(spark.createDataFrame([*chain, (-5, -5), (101, 100), (100, 101), (-9, 102)], "a long, b long")).collect()}
    assert got == {n: 0 for n in range(61)} | {100: 100, 101: 100, -9: -9, 102: -9}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_folded_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(4)
    for n in (120, 250, 1000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.concatenate([x, rng.integers(0, 1 << 63, n // 5).astype(np.uint64)])
        wide, slim = ngram_join.sketch(y)[None], ngram_join.sketch(x)[None]
        assert wide.shape == (1, 2 * slim.shape[1])
        assert 0 < np.bitwise_count(ngram_join.folded(wide, slim.shape[1]) ^ slim).sum() <= n // 5


def test_members_in_several_blocks_match_all_pairs(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("MOST_BLOCKS", 3), ("TILE", 2000)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(6)
    texts = [*near_copies(rng, 2, 130), *near_copies(rng, 6, 9)]
    assert run(spark, table(spark, texts)) == brute(list(enumerate(texts)))


def test_long_texts_that_share_a_passage_only_are_not_verified(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{n}" for n in range(90_000)]
    passage = rng.choices(words, k=90)
    texts = [" ".join([*rng.choices(words, k=700), *passage, *rng.choices(words, k=700)]) for _ in range(40)]
    texts += [" ".join(texts[0].split()[:-9]), " ".join(texts[1].split()[9:])]
    seen = verified(monkeypatch)
    got = run(spark, table(spark, texts))
    assert {n: c for n, (_, c) in got.items()} == {n: n for n in range(40)} | {40: 0, 41: 1}
    assert len(seen) == 2


def test_few_jobs(spark):
    # Every job leaves its plan and tasks in the driver's memory.
    rng = random.Random(9)
    docs = table(spark, near_copies(rng, 2, 40))
    spark.sparkContext.setJobGroup("few jobs", "few jobs")
    run(spark, docs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs")) < 120
