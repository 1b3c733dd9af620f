from __future__ import annotations

import math

import numpy as np
import pytest

from faultline.llm import stable_dups
from faultline.llm.runs import whole_runs

SCHEMA = "vec_id long, embedding array<float>, label int"


def exact(rows, cosine=stable_dups.COSINE):
    """(vec_id, n_links, component_id, kept) by comparing all pairs, rows taken as they come."""
    def taking(row):
        return row[2] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1]) and any(row[1])

    linked = [[] for _ in rows]
    units = [np.array(r[1], np.float32).astype(float) if taking(r) else None for r in rows]
    units = [None if u is None else u / np.abs(u).max() / np.linalg.norm(u / np.abs(u).max()) for u in units]
    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b >= cosine:
                linked[i].append(j)
                linked[j].append(i)
    component = [-1] * len(rows)
    for n in range(len(rows)):
        if component[n] < 0:
            component[n], waiting = n, [n]
            while waiting:
                for m in linked[waiting.pop()]:
                    if component[m] < 0:
                        component[m] = n
                        waiting.append(m)
    low = {c: min((r[0] for r, d in zip(rows, component, strict=True) if d == c and r[0] is not None), default=None) for c in set(component)}
    return sorted(((r[0], len(n), low[c], r[0] == low[c]) for r, n, c in zip(rows, linked, component, strict=True)), key=repr)


def found(spark, rows, schema=SCHEMA, **options):
    return sorted((tuple(r) for r in stable_dups.link(spark.createDataFrame(rows, schema), **options).collect()), key=repr)


def cloud(rng, centre, spread, n):
    return centre + rng.normal(0, spread, (n, len(centre)))


def planted(seed, sizes, spreads, noise, dimension=32):
    """Vectors round a few centres, tight and wide ones, among noise, in two labels."""
    rng = np.random.default_rng(seed)
    held = [rng.normal(0, 1, (noise, dimension))]
    for size, spread in zip(sizes, spreads, strict=True):
        centre = rng.normal(0, 1, dimension)
        held.append(cloud(rng, centre / np.linalg.norm(centre), spread / math.sqrt(dimension), size))
    points = np.concatenate(held)
    ids = rng.permutation(len(points))
    return [(int(i), [float(x) for x in np.float32(p)], int(i) % 11 // 10) for i, p in zip(ids, points, strict=True)]


def test_equals_all_pairs_on_tight_and_wide_groups(spark):
    rows = planted(3, (60, 60, 60, 40), (0.05, 0.15, 0.25, 0.3), 150)
    want = exact(rows)
    assert found(spark, rows, recall=0.99999) == want
    assert sum(n for _, n, _, _ in want) > 4000 and len({c for *_, c, _ in want}) > 150


def test_few_links_are_missed_at_the_usual_recall(spark):
    rows = planted(4, (300,), (0.28,), 100)
    got, want = found(spark, rows), exact(rows)
    assert sum(n for _, n, _, _ in got) >= 0.99 * sum(n for _, n, _, _ in want) > 0
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(stable_dups, "BLOCK", 16)
    rows = planted(5, (120, 80), (0.05, 0.27), 60)
    assert found(spark, rows, recall=0.99999) == exact(rows)


def test_a_group_of_near_copies_is_one_ball_and_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(0, 1, 32)
    points = cloud(rng, centre / np.linalg.norm(centre), 0.05 / math.sqrt(32), 900)
    half = math.sqrt((1 + stable_dups.COSINE) / 2)
    assert (stable_dups.gather_balls(stable_dups.unit_rows(points), half) == 0).all()
    rows = [(n, [float(x) for x in p], 1) for n, p in enumerate(points)] + [(900 + n, [float(x) for x in points[0]], 1) for n in range(200)]
    met = []
    monkeypatch.setattr(stable_dups, "stage", lambda df, real=stable_dups.stage: met.append(real(df)) or met[-1])
    assert {r[1:3] for r in found(spark, rows)} == {(1099, 0)}
    pairs = [df for df in met if "whole" in df.columns]
    assert len(pairs) == 1 and pairs[0].count() < 900  # of 404,550


def test_nulls_lengths_copies_repeats_and_extremes(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, -0.0], 1),
        (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1.0, -0.0], 1), (13, [3e38, 1e30], 1),
        (14, [1e-38, 0.0], 1), (14, [1e-38, 0.0], 1), (None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (20, [0.0, 1.0], 3), (20, [1.0, 0.0], 3), (None, None, None),
    ]
    want = [(i, n, c, k if i is not None else i == c) for i, n, c, k in exact(rows)]
    assert found(spark, rows) == sorted(want, key=repr)


def test_empty_tables_and_clashing_names(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1, True)]
    schema = SCHEMA + ", key int, ball string, w double, cell int, bucket int, total int, v string"
    rows = planted(7, (30,), (0.1,), 20)
    got = found(spark, [(*r, 1, "x", 0.5, 2, 3, 4, "y") for r in rows], schema)
    assert got == exact(rows)
    renamed = spark.createDataFrame([(str(r[2]), r[1], r[0]) for r in rows], "kind string, e array<double>, number int")
    got = stable_dups.link(renamed, vec_id="number", embedding="e", label="kind").collect()
    assert sorted((tuple(r) for r in got), key=repr) == exact(rows)


def test_plan_follows_the_rows():
    assert stable_dups.meeting_probability(0.1) > stable_dups.meeting_probability(0.4) > stable_dups.meeting_probability(1.4)
    for points in (0, 1, 100, 10**6, 10**9):
        projections, tables = stable_dups.hash_plan(points)
        near = stable_dups.meeting_probability(math.sqrt(2 - 2 * stable_dups.COSINE)) ** projections
        assert 1 - (1 - near) ** tables >= stable_dups.RECALL
        assert points * stable_dups.meeting_probability(math.sqrt(2)) ** projections <= 1.0 + 1e-9


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_whole_runs(size):
    import pyarrow as pa

    keys = np.sort(np.random.default_rng(size).integers(0, 20, 100))
    table = pa.table({"k": keys, "n": np.arange(100)})
    seen = []
    for part, bounds in whole_runs(iter(table.to_batches(max_chunksize=size)), ["k"]):
        held = part.column("k").to_numpy()
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            assert len(set(held[begin:end].tolist())) == 1
            seen.append(int(held[begin]))
    assert seen == sorted(set(keys.tolist()))
