"""As-of, recovery, nearest crew and upsert against brute force."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.operators import planning, recovery
from faultline.operators.asof import asof_join, asof_strategy
from faultline.operators.latest import last_n_per_key, latest_per_key, upsert
from faultline.operators.nearest import nearest
from faultline.operators.slicing import hot_slices

BASE = datetime(2024, 1, 1)


def at(seconds):
    return BASE + timedelta(seconds=seconds)


def readings(spark, rows):
    return spark.createDataFrame([(k, at(s), i) for i, (k, s) in enumerate(rows)], "asset_id string, ts timestamp, event_id long")


def versions(spark, rows):
    return spark.createDataFrame(
        [(k, at(s), v, seq, op) for k, s, v, seq, op in rows],
        "asset_id string, valid_ts timestamp, v int, seq int, _op string",
    )


@pytest.mark.parametrize("strategy", ["interval", "merge"])
def test_asof_tie_miss_delete_and_duplicate_versions(spark, strategy):
    left = readings(spark, [("A", 5), ("A", 10), ("A", 15), ("A", 20), ("A", 25), ("A", 30), ("B", 10), (None, 10)])
    right = versions(
        spark,
        [("A", 10, 1, 0, None), ("A", 20, 2, 0, None), ("A", 20, 3, 1, None), ("A", 25, 0, 0, "delete"), ("A", 30, 4, 0, None)],
    )
    got = asof_join(left, right, payload=["v"], tie=["seq"], strategy=strategy)
    assert [r.v for r in got.orderBy("event_id").collect()] == [None, 1, 1, 3, None, 4, None, None]


def brute_asof(left, right, direction):
    out = {}
    for key, s, i in left:
        if direction == "backward":
            found = [(t, seq, v, op) for k, t, v, seq, op in right if k == key and t <= s]
            best = max(found, default=None)
        else:
            found = [(-t, seq, v, op) for k, t, v, seq, op in right if k == key and t >= s]
            best = max(found, default=None)
        out[i] = None if best is None or best[3] == "delete" else best[2]
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("rows_per_slice", [None, 15])
def test_merged_asof_with_hot_key_equals_brute_force(spark, direction, rows_per_slice):
    rng = random.Random(5)
    left = [(k, rng.randint(0, 3000), i) for i, k in enumerate(["H"] * 300 + ["S"] * 10)]
    right = [("H", rng.randint(0, 3000), n, n, rng.choice([None] * 9 + ["delete"])) for n in range(40)]
    right += [("S", rng.randint(0, 3000), n, n, None) for n in range(3)]
    df = spark.createDataFrame([(k, at(s), i) for k, s, i in left], "asset_id string, ts timestamp, event_id long")
    slices = None if rows_per_slice is None else hot_slices(df, rows_per_slice=rows_per_slice)
    got = asof_join(df, versions(spark, right), payload=["v"], tie=["seq"], direction=direction, strategy="merge", slices=slices)
    assert {r.event_id: r.v for r in got.collect()} == brute_asof(left, right, direction)


def test_strategy_follows_measured_size(spark):
    few = versions(spark, [("A", i, i, 0, None) for i in range(64)])
    many = versions(spark, [("A", i, i, 0, None) for i in range(65)])
    assert (asof_strategy(few), asof_strategy(many), asof_strategy(few.limit(0))) == ("interval", "merge", "interval")


def test_recovery_window_includes_both_ends(spark):
    actions = spark.createDataFrame(
        [(f"i{n}", k, a, at(s)) for n, (k, a, s) in enumerate([("A", "isolate", 0), ("B", "isolate", 0), ("C", "isolate", 0), ("D", "monitor", 0), ("E", "dispatch_crew", 0.9)])],
        "incident_id string, asset_id string, action_type string, ts timestamp",
    )
    enriched = spark.createDataFrame(
        [(k, at(s), v) for k, s, v in [("A", 0, "info"), ("B", 600, "info"), ("C", 600.001, "info"), ("C", 1, "warning"), ("D", 1, "info"), ("E", 2.1, "info"), ("E", 3, "info"), ("A", -1, "info")]],
        "asset_id string, ts timestamp, severity string",
    )
    resolved = recovery.resolve(recovery.first_recovery(actions, enriched))
    assert {r.asset_id: r.recovery_seconds for r in resolved.collect()} == {"A": 0.0, "B": 600.0, "E": 1.0}


def test_recovery_plan_pairs_nothing(spark):
    actions = spark.createDataFrame([("i", "A", "isolate", at(0))], "incident_id string, asset_id string, action_type string, ts timestamp")
    enriched = spark.createDataFrame([("A", at(0), "info")], "asset_id string, ts timestamp, severity string")
    plan = recovery.first_recovery(actions, enriched)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def crews(spark, rows):
    return spark.createDataFrame(rows, "crew_id string, region string, lat double, lon double, status string, skills array<string>")


def bases(spark, rows):
    return spark.createDataFrame(rows, "incident_id string, req_skill string, region string, asset_lat double, asset_lon double")


def brute_crews(plans, roster):
    out = {}
    for incident, skill, region, lat, lon in plans:
        ranked = []
        for crew, crew_region, clat, clon, status, skills in roster:
            if status == "available" and (skill in skills or "general" in skills):
                missing = None in (lat, lon, clat, clon)
                dist = None if missing else (lat - clat) * (lat - clat) + (lon - clon) * (lon - clon)
                match = 1 if crew_region == region and region is not None else 0
                ranked.append((-match, dist is not None, dist or 0.0, crew, dist))
        best = min(ranked, default=None)
        out[incident] = (None, 0, 1e18) if best is None else (best[3], -best[0], best[4])
    return out


def test_crew_choice_equals_brute_force(spark):
    rng = random.Random(11)
    skills = ["transformer", "line", "pump", "general"]
    roster = [
        (f"C{n:03d}", rng.choice(["North", "South", "East", None]), rng.choice([None] + [rng.uniform(-60, 60)] * 9), round(rng.uniform(-170, 170), 1),
         rng.choice(["available", "available", "enroute"]), rng.sample(skills[:3], rng.randint(0, 2)) + (["general"] if n % 7 == 0 else []))
        for n in range(120)
    ]
    roster += [("T2", "West", 10.0, 10.0, "available", ["line"]), ("T1", "West", 10.0, 10.0, "available", ["line"])]
    plans = [
        (f"I{n}", rng.choice(skills), rng.choice(["North", "South", "East", "West", None]),
         rng.choice([None] + [rng.uniform(-60, 60)] * 9), rng.uniform(-170, 170))
        for n in range(150)
    ]
    plans.append(("tie", "line", "West", 10.5, 10.5))
    got = planning.choose_crews(bases(spark, plans), crews(spark, roster)).collect()
    assert {r.incident_id: (r.cand_crew_id, r.region_match, r.dist) for r in got} == brute_crews(plans, roster)


def test_plan_without_any_crew_stays(spark):
    got = planning.choose_crews(bases(spark, [("I", "pump", "North", 1.0, 1.0)]), crews(spark, [("C", "North", 1.0, 1.0, "enroute", ["pump"])]))
    row = got.first()
    assert (row.cand_crew_id, row.region_match, row.dist) == (None, 0, 1e18)


def test_crew_plan_has_no_nested_loop(spark):
    got = planning.choose_crews(bases(spark, [("I", "pump", "North", 1.0, 1.0)]), crews(spark, [("C", "North", 1.0, 1.0, "available", ["pump"])]))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nearest_in_a_dense_cluster_and_far_away(spark):
    rng = random.Random(3)
    points = [(f"P{n}", "g", 12 + rng.gauss(0, 1e-4), 77 + rng.gauss(0, 1e-4)) for n in range(300)] + [("far", "g", -80.0, -170.0)]
    sites = [("g", 12 + rng.gauss(0, 3), 77 + rng.gauss(0, 3)) for _ in range(60)] + [("g", -79.0, 170.0), ("none", 0.0, 0.0)]
    got = nearest(
        spark.createDataFrame(sites, "g string, x double, y double"),
        spark.createDataFrame(points, "p string, g string, px double, py double"),
        group=["g"], site_position=("x", "y"), position=("px", "py"), identity="p",
    )
    found = {(r.x, r.y): (r.dist, r.p) for r in got.collect()}
    want = {(x, y): min(((x - px) * (x - px) + (y - py) * (y - py), p) for p, _, px, py in points) for g, x, y in sites if g == "g"}
    assert found == want


def test_latest_and_upsert(spark):
    changes = spark.createDataFrame(
        [("a", 1, 1, "x", None), ("a", 2, 1, "y", None), ("b", 1, 1, "x", None), ("b", 3, 1, None, "delete"), ("c", 1, 1, "p", None), ("c", 1, 2, "q", None)],
        "k string, ts int, seq int, v string, _op string",
    )
    assert {(r.k, r.v) for r in latest_per_key(changes, "k", ["ts", "seq"]).collect()} == {("a", "y"), ("b", None), ("c", "q")}
    assert {(r.k, r.v) for r in upsert(changes, "k", ["ts", "seq"]).collect()} == {("a", "y"), ("c", "q")}
    again = upsert(changes, "k", ["ts", "seq"], upsert(changes, "k", ["ts", "seq"]))
    assert {(r.k, r.v) for r in again.collect()} == {("a", "y"), ("c", "q")}


def test_last_n_per_key_is_exact_across_partitions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 400)).alias("k"), F.col("id").alias("ts")).repartition(16)
    got = last_n_per_key(df, "k", 5, ["ts"])
    assert sorted(r.ts for r in got.filter("k = 'hot'").collect()) == [4986, 4989, 4992, 4995, 4998]
    assert got.count() == sum(min(5, r["count"]) for r in df.groupBy("k").count().collect())


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strategy", ["interval", "merge"])
def test_asof_null_keys_and_times_match_nothing(spark, strategy, direction):
    if (strategy, direction) == ("interval", "forward"):
        pytest.skip("interval joins look backward only")
    left = spark.createDataFrame([("A", at(5), 1), (None, at(5), 2), ("A", None, 3), (None, None, 4)], "asset_id string, ts timestamp, event_id long")
    right = spark.createDataFrame(
        [(None, at(5), 7), ("A", None, 9), ("A", at(5), 1)], "asset_id string, valid_ts timestamp, v int"
    )
    got = asof_join(left, right, payload=["v"], strategy=strategy, direction=direction)
    assert {r.event_id: r.v for r in got.collect()} == {1: 1, 2: None, 3: None, 4: None}


def test_nearest_has_no_edge_of_the_world(spark):
    sites = spark.createDataFrame([("s", 300.0, 0.0), ("s", -5000.0, 80.0), ("s", 0.0, 0.0)], "g string, x double, y double")
    crews = spark.createDataFrame([("s", 250.0, 0.0, "near"), ("s", -9000.0, 0.0, "far")], "g string, cx double, cy double, crew string")
    got = nearest(sites, crews, group=["g"], site_position=("x", "y"), position=("cx", "cy"), identity="crew")
    assert {r.x: r.crew for r in got.collect()} == {300.0: "near", -5000.0: "far", 0.0: "near"}


def test_a_hot_key_has_as_many_slices_as_it_needs(spark):
    rows = spark.range(40_000).select(F.lit("A").alias("asset_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    slices = hot_slices(rows, rows_per_slice=20)
    sizes = slices.assign(rows, "ts").groupBy("_slice").count().collect()
    assert len(sizes) > 1500 and max(r["count"] for r in sizes) < 200
    assert sum(r["count"] for r in sizes) == 40_000
    cuts = slices.cuts.first()["_cuts"]
    probe = spark.createDataFrame([("A", c - 1) for c in cuts[:300]] + [("A", c) for c in cuts[:300]], "asset_id string, us long")
    got = slices.assign(probe.withColumn("ts", F.timestamp_micros("us")), "ts").orderBy("us").collect()
    assert all(r._slice == sum(c <= r.us for c in cuts) for r in got)


def test_null_keys_are_sliced_like_any_other(spark):
    rows = spark.range(1000).select(F.lit(None).cast("string").alias("asset_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    slices = hot_slices(rows, rows_per_slice=50)
    assert slices.assign(rows, "ts").select("_slice").distinct().count() > 10
