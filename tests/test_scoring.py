"""Hand-computed scoring: smoke sequence, boundaries, null rules, rolling frame."""

from __future__ import annotations

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultline.functions.scalar import floor_at_zero, lookup, ratio, round_exact, stable_uuid
from faultline.operators import incidents, scoring
from faultline.operators.anomaly import rolling_zscore
from faultline.operators.asof import VersionTable, asof_join_all
from faultline.operators.slicing import hot_slices
from faultline.plans import domain, pipeline

BASE = datetime(2024, 1, 1)
SPEC = {
    "warning_temp_c": 85.0, "critical_temp_c": 95.0, "warning_vibration_mm_s": 4.5,
    "nominal_oil_pressure_kpa": 140.0, "rated_load_mw": 100.0,
}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_smoke_sequence(spark):
    readings = [(58.0, 55.0)] * 3 + [(102.0, 116.0)] * 4 + [(57.0, 50.0)] * 3
    telemetry = frame(
        spark,
        [("TX", "transformer", BASE + timedelta(seconds=i), "North", "SUB", load, temp, 1.2, 140.0, i) for i, (temp, load) in enumerate(readings)],
        "asset_id string, asset_type string, ts timestamp, region string, substation string, load_pct double, "
        "temp_c double, vibration_mm_s double, oil_pressure_kpa double, event_id long",
    )
    specs = frame(spark, [("TX", BASE, *SPEC.values())], "asset_id string, valid_ts timestamp, " + ", ".join(f"{c} double" for c in SPEC))
    registry = frame(spark, [("TX", BASE, ["A", "B"])], "asset_id string, valid_ts timestamp, tie_assets array<string>")
    scored = pipeline.score(telemetry, specs, registry)
    rows = scored.orderBy("event_id").collect()
    for row in rows[:3] + rows[7:]:
        assert row.severity == "info"
        assert row.fault_score == pytest.approx(1 / (1 + math.exp(3.6)))
    for row in rows[3:7]:
        assert (row.severity, row.temp_ratio, row.load_over) == ("critical", 1.7, 0.8)
        assert row.fault_score == pytest.approx(1 / (1 + math.exp(-6.02)))
    assert [r.temp_zscore for r in rows[:3]] == [0.0, 0.0, 0.0]
    assert rows[3].temp_zscore == pytest.approx(math.sqrt(3))
    raised = incidents.build_incidents(scored).collect()
    assert len(raised) == 4
    assert {(r.signal, r.reasoning_needed, r.tie_assets) for r in raised} == {("temp_c", True, "A,B")}
    assert {r.incident_id for r in raised} == {r.incident_id for r in incidents.build_incidents(scored).collect()}


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, "info"),
        ({"temp_c": 95.0}, "critical"), ({"temp_c": 94.99}, "warning"), ({"temp_c": 85.0}, "warning"), ({"temp_c": 84.99}, "info"),
        ({"vibration_mm_s": 6.75}, "critical"), ({"vibration_mm_s": 6.74}, "warning"), ({"vibration_mm_s": 4.49}, "info"),
        ({"oil_pressure_kpa": 98.0}, "critical"), ({"oil_pressure_kpa": 99.0}, "warning"),
        ({"oil_pressure_kpa": 119.0}, "warning"), ({"oil_pressure_kpa": 119.1}, "info"),
        ({"load_pct": 115.0}, "critical"), ({"load_pct": 114.9}, "warning"), ({"load_pct": 102.0}, "warning"), ({"load_pct": 101.9}, "info"),
        ({"fault_score": 0.80}, "critical"), ({"fault_score": 0.79}, "warning"), ({"fault_score": 0.5}, "warning"), ({"fault_score": 0.49}, "info"),
        ({"fault_score": None, "temp_c": 96.0}, "critical"), ({"fault_score": None}, "info"),
        ({"vibration_mm_s": None, "load_pct": 103.0}, "warning"),
        ({"warning_vibration_mm_s": 0.0, "vibration_mm_s": 99.0}, "info"),
    ],
)
def test_severity_boundaries(spark, change, expected):
    row = {"temp_c": 60.0, "vibration_mm_s": 1.0, "oil_pressure_kpa": 140.0, "load_pct": 50.0, "fault_score": 0.1, **SPEC, **change}
    df = frame(spark, [tuple(row.values())], ", ".join(f"{c} double" for c in row))
    assert scoring.grade_severity(df).first().severity == expected


def test_missing_sensor_makes_the_score_null_not_small(spark):
    row = {"temp_c": 60.0, "vibration_mm_s": None, "oil_pressure_kpa": 140.0, "load_pct": 50.0, **SPEC}
    df = frame(spark, [tuple(row.values())], ", ".join(f"{c} double" for c in row))
    out = scoring.fault_score(scoring.normalise_features(df)).first()
    assert out.vib_ratio is None and out.fault_score is None


def test_equal_limits_make_the_temperature_ratio_null(spark):
    row = {"temp_c": 90.0, "vibration_mm_s": 1.0, "oil_pressure_kpa": 140.0, "load_pct": 50.0, **SPEC, "critical_temp_c": 85.0}
    df = frame(spark, [tuple(row.values())], ", ".join(f"{c} double" for c in row))
    assert scoring.normalise_features(df).first().temp_ratio is None


def test_gate_branches_and_null(spark):
    rows = [("critical", None, 0.0), ("warning", 0.5, 0.0), ("warning", 0.4, 3.0), ("warning", 0.4, -3.0), ("warning", 0.4, 2.9), ("warning", None, 0.0)]
    df = frame(spark, rows, "severity string, fault_score double, zscore double")
    got = df.withColumn("reasoning_needed", incidents.cost_gate())
    assert [r.reasoning_needed for r in got.collect()] == [True, True, True, True, False, None]
    assert {(r.branch, r.n) for r in incidents.gate_counts(got).collect()} == {
        ("reasoned", 1), ("reasoned", 3), ("gated_skip", 1), ("dropped_null_gate", 1),
    }


def brute_zscores(values):
    out = []
    for i in range(len(values)):
        window = values[max(0, i - 30) : i + 1]
        std = statistics.pstdev(window)
        out.append((values[i] - statistics.fmean(window)) / std if std > 0 else 0.0)
    return out


def test_rolling_frame_edges(spark):
    values = [float(i * i % 17) for i in range(40)]
    df = frame(spark, [("A", BASE + timedelta(seconds=i), i, v) for i, v in enumerate(values)], "asset_id string, ts timestamp, event_id long, temp_c double")
    got = [r.temp_zscore for r in rolling_zscore(df).orderBy("event_id").collect()]
    want = brute_zscores(values)
    for i in (0, 1, 29, 30, 31, 32, 39):
        assert got[i] == pytest.approx(want[i])


@pytest.mark.parametrize("rows_per_slice", [3, 20, 90, 400])
def test_sliced_zscore_equals_plain_with_a_hot_key(spark, rows_per_slice):
    rng = random.Random(rows_per_slice)
    rows, event = [], 0
    for asset, n in (("HOT", 400), ("BURST", 120), ("SMALL", 5), (None, 4)):
        at = BASE
        for _ in range(n):
            # BURST readings share few instants, so that some slices come out empty or tiny.
            at += timedelta(seconds=rng.choice([0, 0, 0, 900]) if asset == "BURST" else rng.randint(0, 5))
            rows.append((asset, at, event, float(rng.randint(0, 50))))
            event += 1
    df = frame(spark, rows, "asset_id string, ts timestamp, event_id long, temp_c double").repartition(4)
    slices = hot_slices(df, rows_per_slice=rows_per_slice)
    assert (slices is None) == (rows_per_slice == 400)
    if slices is not None:
        assert slices.assign(df, "ts").select("asset_id", "_slice").distinct().count() > 4
    plain = {r.event_id: r.temp_zscore for r in rolling_zscore(df).collect()}
    sliced = {r.event_id: r.temp_zscore for r in rolling_zscore(df, slices=slices).collect()}
    assert sliced.keys() == plain.keys()
    assert all(sliced[k] == pytest.approx(plain[k], abs=1e-9) for k in plain)


def test_no_slices_for_small_or_even_data(spark):
    df = spark.range(1000).select(F.concat(F.lit("A"), (F.col("id") % 50).cast("string")).alias("asset_id"), F.timestamp_seconds("id").alias("ts"))
    assert hot_slices(df) is None
    assert hot_slices(df, rows_per_slice=100) is None


def test_scalar_helpers(spark):
    numbers = [95.65, 95.85, 95.75, 0.125, 0.375, 2.5, 3.5, -95.65, 1e-9, 0.005, 0.285, 1.005, 102.335]
    df = frame(spark, [(n,) for n in numbers], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(round_exact(F.col("x"), digits)).collect()]
        assert got == [round(n, digits) for n in numbers]
    one = frame(spark, [(None, 0.0, "b")], "n double, z double, k string")
    row = one.select(
        floor_at_zero(F.col("n")).alias("f"), ratio(F.col("z"), F.col("z")).alias("r"),
        lookup(F.col("k"), {"a": 1, "b": 2}, 0).alias("l"), stable_uuid(F.col("k"), F.lit(1)).alias("u"),
    ).first()
    assert (row.f, row.r, row.l) == (None, None, 2)
    assert [len(p) for p in row.u.split("-")] == [8, 4, 4, 4, 12]


@pytest.mark.parametrize("sliced", [False, True])
def test_scoring_with_merged_versions_exchanges_and_sorts_telemetry_once(spark, sf, sliced):
    telemetry = domain.telemetry(spark, sf)
    specs, registry = domain.spec_versions(spark, sf), domain.registry(spark, sf)
    slices = hot_slices(telemetry, rows_per_slice=8) if sliced else None
    merged = pipeline.score(telemetry, specs, registry, slices=slices, strategies=("merge", "merge"))
    broadcast = pipeline.score(telemetry, specs, registry, strategies=("interval", "interval"))
    columns = ["event_id", "severity", "tie_assets", *scoring.SPEC_COLUMNS, F.round("temp_zscore", 6).alias("z"), F.round("fault_score", 9).alias("f")]
    a, b = merged.select(*columns), broadcast.select(*columns)
    assert a.count() == telemetry.count() and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    if not sliced:
        text = merged._jdf.queryExecution().executedPlan().toString()
        windows = text[: text.index("Union")]
        assert windows.count("Exchange hashpartitioning(asset_id") == 1 and windows.count("Sort [") == 1 and windows.count("Window [") == 2


def test_merged_versions_with_null_keys_times_deletes_and_ties(spark):
    left = spark.createDataFrame(
        [("A", 5, 1), ("A", 10, 2), ("A", 20, 3), (None, 10, 4), ("A", None, 5), (None, None, 6), ("B", 10, 7)], "asset_id string, s long, event_id long"
    ).withColumn("ts", F.timestamp_seconds("s"))
    one = spark.createDataFrame(
        [("A", 10, 1, 0, None), ("A", 10, 2, 1, None), ("A", 20, None, 0, "delete"), (None, 1, 9, 0, None), ("A", None, 9, 0, None)],
        "asset_id string, s long, v int, seq int, _op string",
    ).withColumn("valid_ts", F.timestamp_seconds("s"))
    two = spark.createDataFrame([("A", 0, "x"), ("B", 11, "y")], "asset_id string, s long, w string").withColumn("valid_ts", F.timestamp_seconds("s"))
    for slices in (None, hot_slices(left, rows_per_slice=1)):
        got = asof_join_all(left, [VersionTable(one, ["v"], tie=["seq"]), VersionTable(two, ["w"])], order=("ts", "event_id"), slices=slices)
        assert {r.event_id: (r.v, r.w) for r in got.collect()} == {
            1: (None, "x"), 2: (2, "x"), 3: (None, "x"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None),
        }
        assert got.columns == [*left.columns, "v", "w"]
