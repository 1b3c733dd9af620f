"""The quadtree join: equal to all pairs, linear in sites however candidates crowd."""

from __future__ import annotations

import random

import numpy as np
import pytest

from faultline.operators import nearest as module
from faultline.operators import planning
from faultline.operators.nearest import BoxTree, Square, nearest, quartered

SITE, SPOT = "g string, h int, x double, y double", "p string, g string, h int, px double, py double"


def found(spark, sites, spots):
    got = nearest(
        spark.createDataFrame(sites, SITE), spark.createDataFrame(spots, SPOT),
        group=["g", "h"], site_position=("x", "y"), position=("px", "py"), identity="p",
    )
    return sorted(tuple(r[c] for c in ("g", "h", "x", "y", "dist", "p")) for r in got.collect())


def pairs(sites, spots):
    def finite(*v):
        return all(c is not None and np.isfinite(c) for c in v)

    out = []
    for g, h, x, y in sites:
        if None not in (g, h) and finite(x, y):
            near = [((x - px) * (x - px) + (y - py) * (y - py), p) for p, pg, ph, px, py in spots if (pg, ph) == (g, h) and finite(px, py)]
            out += [(g, h, x, y, *min(near))] if near else []
    return sorted(out)


@pytest.mark.parametrize("crowded", [False, True])
def test_equals_all_pairs(spark, monkeypatch, crowded):
    if crowded:  # small leaves, samples and blocks, as far larger tables have
        for name, value in (("SAMPLE", 64), ("LEAF", 8), ("LEAST_IN_SAMPLE", 2), ("SITES", 16)):
            monkeypatch.setattr(module, name, value)
    rng = random.Random(5)

    def point():
        if rng.random() < 0.4:
            return 12 + rng.gauss(0, 1e-6), 77 + rng.gauss(0, 1e-6)
        return (rng.uniform(-200, 200), rng.uniform(-80, 80)) if rng.random() < 0.9 else (1e12 * rng.random(), -3e9)

    spots = [(f"P{n:04d}", rng.choice("ab"), rng.randrange(2), *point()) for n in range(300)]
    spots += [(f"Q{n}", "a", 0, float(n % 5), 3.0) for n in range(40)] + [("R", "only", 1, 0.0, 0.0)]
    sites = {(rng.choice(["a", "b", "none"]), rng.randrange(2), *point()) for _ in range(200)} | {("a", 0, float(n) / 2, 3.0) for n in range(10)} | {("only", 1, 9.0, 9.0)}
    assert found(spark, list(sites), spots) == pairs(sites, spots)


def test_positions_that_are_none(spark):
    nan, inf = float("nan"), float("inf")
    spots = [("P1", "a", 0, nan, 1.0), ("P2", "a", 0, inf, 1.0), ("P3", "a", 0, None, 1.0), ("P4", "a", 0, 5.0, 5.0), ("P5", None, 0, 1.0, 1.0), ("P6", "b", 0, nan, nan)]
    sites = [("a", 0, 1.0, 1.0), ("a", 0, nan, 1.0), ("a", 0, -inf, 1.0), ("a", 0, None, None), (None, 0, 1.0, 1.0), ("b", 0, 1.0, 1.0)]
    assert found(spark, sites, spots) == [("a", 0, 1.0, 1.0, 32.0, "P4")]
    assert found(spark, sites, spots[:3]) == []
    assert found(spark, sites[1:3], spots) == []


def test_crews_and_assets_without_a_real_position_are_chosen_by_id(spark):
    nan, inf = float("nan"), float("inf")
    crews = spark.createDataFrame(
        [("C1", "North", 1.0, 1.0, "available", ["pump"]), ("C2", "North", nan, 1.0, "available", ["pump"]), ("C3", "South", inf, 1.0, "available", ["line"]), ("C4", "South", 2.0, 2.0, "available", ["line"])],
        "crew_id string, region string, lat double, lon double, status string, skills array<string>",
    )
    base = spark.createDataFrame(
        [("I1", "pump", "North", 1.0, 1.0), ("I2", "pump", "North", nan, 1.0), ("I3", "line", "South", 2.0, 2.0), ("I4", "line", "East", 2.0, -inf)],
        "incident_id string, req_skill string, region string, asset_lat double, asset_lon double",
    )
    got = {r.incident_id: (r.cand_crew_id, r.region_match, r.dist) for r in planning.choose_crews(base, crews).collect()}
    # As with NULL: a distance that doesn't exist comes before any other, and then the id decides.
    assert got == {"I1": ("C2", 1, None), "I2": ("C1", 1, None), "I3": ("C3", 1, None), "I4": ("C3", 0, None)}


def test_comparisons_are_linear_in_sites_beside_a_spot_cloud():
    rng = np.random.default_rng(2)
    per_site = []
    for n in (10_000, 100_000):
        cloud = rng.normal(0, 1e-9, (n, 2)) + (12.0, 77.0)
        beside = rng.normal(0, 1.0, (n, 2)) + (14.0, 77.0)
        tree = BoxTree(cloud[:, 0], cloud[:, 1], cloud[:, 0], cloud[:, 1])
        site, spot, distance = tree.near(beside[:, 0], beside[:, 1])
        assert len(set(site.tolist())) == n
        for at in range(0, n, n // 50):
            d = ((beside[at] - cloud) ** 2).sum(axis=1)
            assert distance[site == at][0] == d.min() and d.argmin() in spot[site == at]
        per_site.append(tree.compared / n)
    assert per_site[1] < 2 * per_site[0] and per_site[1] < 1000


def test_leaves_follow_the_candidates():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1e-5, 5000), rng.uniform(-100, 100, 500)])
    y = np.concatenate([rng.normal(0, 1e-5, 5000), rng.uniform(-100, 100, 500)])
    square = Square(x.min(), y.min(), max(np.ptp(x), np.ptp(y)))
    cells = square.cells(x, y)
    starts = quartered(cells, 50)
    held = np.bincount(np.searchsorted(starts, cells, "right") - 1, minlength=len(starts))
    assert held.max() <= 50 and starts[0] == 0 and held.sum() == len(x)
    assert len(quartered(np.zeros(1000, np.int64), 10)) < 200  # one spot, which can't be divided
    tree = BoxTree(x, y, x, y)
    assert sorted(tree.order.tolist()) == list(range(len(x)))


def test_extreme_positions_do_not_overflow():
    x = np.array([1e308, -1e308, 0.0, 5e-324])
    tree = BoxTree(x, x, x, x)
    site, spot, _ = tree.near(np.array([1.0, -1e308]), np.array([1.0, -1e308]))
    assert {(s, p) for s, p in zip(site.tolist(), spot.tolist(), strict=True)} >= {(0, 2), (1, 1)}
