from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import gnat_negatives
from faultline.llm.gnat_negatives import NO_SCORE, Gnat

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, every=10, positives=5, negatives=5, low=80, high=100):
    """The same from all scores, rows being distinct (vec_id, vector, label)."""
    taking = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    held = {(i, label, tuple(int(np.floor(256.0 * float(np.float32(x)))) for x in v)) for i, v, label in taking}
    out = set()
    for anchor, label, q in held:
        if anchor % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, other, strict=True)), i, kind) for i, kind, other in held if i != anchor)
        for positive_score, positive, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [(s, i) for s, i, kind in scored if kind != label and -low * positive_score <= -100 * s <= -high * positive_score]
            out |= {(anchor, positive, n + 1, i, -positive_score, -s) for n, (s, i) in enumerate(fits[:negatives])}
    return out


def found(spark, rows, schema=SCHEMA, every=10, **options):
    held = gnat_negatives.quantised(spark.createDataFrame(rows, schema))
    got = [tuple(r) for r in gnat_negatives.mine(held, F.col("vec_id") % every == 0, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def clustered(seed, n, dimension=12, labels=3, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centres, dimension))
    points = middle[rng.integers(0, centres, n)] + rng.normal(0, 0.3, (n, dimension))
    points /= np.linalg.norm(points, axis=1)[:, None]
    return [(i, [float(x) for x in p], int(k)) for i, (p, k) in enumerate(zip(points, rng.integers(0, labels, n), strict=True))]


def test_equals_all_scores(spark):
    rows = clustered(1, 600)
    want = exact(rows)
    assert len(want) > 1000 and found(spark, rows) == want


def test_other_bounds_and_many_shards_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(gnat_negatives, "SHARD_ROWS", 40)
    monkeypatch.setattr(gnat_negatives, "QUERY_BLOCK", 16)
    rows = clustered(2, 500)
    assert found(spark, rows, positives=2, negatives=3, low=90, high=98) == exact(rows, positives=2, negatives=3, low=90, high=98)


def test_ties_copies_and_equal_vectors(spark):
    rows = [(n, [0.5, 0.25], n % 2) for n in range(60)] + [(100 + n, [0.5, 0.0], n % 3) for n in range(40)]
    assert found(spark, rows) == exact(rows)
    assert found(spark, [*rows, *rows[:30]]) == exact(rows)


def test_nulls_repeated_ids_lengths_and_extremes(spark):
    nan, inf = float("nan"), float("inf")
    odd = [
        (None, [1.0] * 12, 1), (1000, None, 1), (1001, [1.0] * 12, None), (1010, [nan] * 12, 1), (1020, [inf] * 12, 0), (1030, [None] * 12, 1),
        (1040, [0.0] * 12, 0), (1050, [-1.0] * 12, 1), (30, [0.3] * 12, 2), (30, [0.1] * 12, 0), (1061, [3e4] * 12, 1),
    ]
    rows = clustered(3, 200) + odd
    assert found(spark, rows) == exact(rows)
    # Vectors of another length, or too long for a score, take no part.
    assert found(spark, [*rows, (1070, [1.0] * 5, 1), (1080, [], 0), (1090, [1e30] * 12, 0)]) == exact(rows)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(n, [x * 3e5 for x in v], k) for n, v, k in clustered(4, 150)]
    want = exact(rows)
    assert max(s for *_, s in want) > 2**52 and found(spark, rows) == want


def test_empty_tables_clashing_names_and_labels_that_are_texts(spark):
    assert found(spark, []) == set()
    assert found(spark, [(10, [1.0], 1)]) == set()
    assert found(spark, [(10, [], 1), (20, [], 1)]) == set()
    rows = clustered(5, 120)
    schema = SCHEMA + ", q int, kind string, norm double, ask int, low int, score string, shard int"
    assert found(spark, [(*r, 1, "x", 0.5, 2, 3, "y", 4) for r in rows], schema) == exact(rows)
    texts = [(i, v, f"label {k}") for i, v, k in rows]
    assert found(spark, texts, "vec_id long, embedding array<float>, label string") == exact(rows)


def test_tree_finds_what_a_scan_finds_and_passes_over_the_rest():
    rng = np.random.default_rng(8)
    middle = rng.normal(0, 1, (40, 8)) * 400
    rows = np.floor(middle[rng.integers(0, 40, 4000)] + rng.normal(0, 10, (4000, 8))).astype(np.int64)
    ids, kinds = rng.permutation(4000), rng.integers(0, 4, 4000)
    longest = float((rows * rows).sum(axis=1).max())
    tree = Gnat.read(Gnat.build(rows, ids, kinds, longest).stored())
    assert sorted(tree.ids.tolist()) == list(range(4000)) and len(tree.leaves) > 40
    queries, own, kind = rows[:200], ids[:200], kinds[:200]
    scores = queries @ rows.T
    for same in (True, False):
        best = np.sort(np.where((kinds[None] == kind[:, None]) == same, scores, NO_SCORE), axis=1)[:, -6]
        low, high = (best * 0.8).astype(np.int64), best
        query, hit, score, computed = tree.search(queries, own, kind, low, high, same, 5)
        got = {(int(a), int(b), int(c)) for a, b, c in zip(query, hit, score, strict=True)}
        want = set()
        for n in range(200):
            fits = np.flatnonzero(((kinds == kind[n]) == same) & (ids != own[n]) & (scores[n] >= low[n]) & (scores[n] <= high[n]))
            fits = fits[np.lexsort((ids[fits], -scores[n][fits]))][:5]
            want |= {(n, int(ids[m]), int(scores[n][m])) for m in fits}
        assert got == want
        assert computed < 0.5 * scores.size


@pytest.mark.parametrize("copies", [0, 1, 500])
def test_tree_of_equal_rows(copies):
    rows = np.ones((copies, 3), np.int64)
    tree = Gnat.build(rows, np.arange(copies), np.zeros(copies, np.int64), 3.0)
    query, hit, score, _ = tree.search(np.ones((1, 3), np.int64), np.array([0]), np.array([0]), np.array([NO_SCORE]), np.array([10]), True, 5)
    assert hit.tolist() == list(range(1, min(copies, 6))) and set(score.tolist()) <= {3} and not query.any()
