"""Quality, contracts, codecs, reports and KPIs."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from faultline import schemas
from faultline.operators import kpi, planning, quality, reports
from faultline.sources import decode, readers

AT = datetime(2024, 1, 1)


def test_rules_treat_null_as_violation_and_rank_error_first(spark):
    df = spark.createDataFrame(
        [(1, 20.0, 1.0, 1.0, 20.0), (2, 201.0, 0.0, -1.0, 71.0), (3, None, 1.0, 1.0, 20.0), (4, -40.0, 0.1, 0.0, -50.0)],
        "i int, temp_c double, voltage_kv double, load_pct double, ambient_c double",
    )
    got = {r.i: (r.violations, r.route) for r in quality.check_rules(df, "telemetry").collect()}
    assert got == {
        1: ([], "clean"),
        2: (["temp_in_range", "voltage_positive", "load_non_negative", "ambient_in_range"], "dlq"),
        3: (["temp_in_range"], "dlq"),
        4: ([], "clean"),
    }
    bad = spark.createDataFrame([(1.2, "fatal"), (0.5, "info")], "fault_score double, severity string")
    checked = quality.check_rules(bad, "incidents")
    assert {r.route for r in checked.collect()} == {"error", "clean"}
    assert {k: v.count() for k, v in quality.split_routes(checked).items()} == {"clean": 1, "dlq": 0, "error": 1}
    assert {(r["rule"], r.n) for r in quality.violation_summary({"incidents": checked}).collect()} == {
        ("fault_score_unit_interval", 1), ("severity_enum", 1),
    }


def test_decode_routes_json_avro_and_tombstones(spark):
    good = '{"region":"N","ts":1700000000123,"ambient_c":1,"humidity_pct":2.5,"wind_kph":3,"condition":"clear"}'
    messages = [good, good.replace("2.5", '"x"'), good.replace('"condition":"clear"', '"other":1'), good.replace('"clear"', "null"), "{", None]
    rows = [(i, None if m is None else bytearray(m.encode())) for i, m in enumerate(messages)] + [(6, bytearray(b"\x00\x00\x00\x00\x01abc"))]
    df = spark.createDataFrame(rows, "i int, value binary")
    decoded, rejects = decode.decode(df, schemas.WEATHER)
    row = decoded.collect()
    assert [(r.i, r.humidity_pct, r.ambient_c) for r in row] == [(0, 2.5, 1.0)]
    assert decoded.select(F.unix_millis("ts")).first()[0] == 1700000000123
    assert {r.i: r.reason for r in rejects.collect()} == {
        1: "type:humidity_pct", 2: "missing:condition", 3: "missing:condition", 4: "malformed", 6: "avro: no decoder",
    }


def test_encode_then_decode_round_trips(spark):
    df = spark.createDataFrame([("C1", AT, "North", 1.5, 2.5, "available", ["line"])], schemas.CREW_LOCATION)
    messages = decode.encode(df, schemas.CREW_LOCATION).withColumn("value", F.encode("value", "UTF-8"))
    decoded, rejects = decode.decode(messages, schemas.CREW_LOCATION)
    assert decoded.select(*df.columns).collect() == df.collect()
    assert rejects.isEmpty()


def test_restricted_view(spark):
    df = spark.createDataFrame([("C1", 1.0, 2.0, "North")], "crew_id string, lat double, lon double, region string")
    assert quality.restricted_view(df, "crew_location").columns == ["region"]
    view = quality.restricted_view(df, "crew_location", keep_hashed=["crew_id"], secret=F.lit("s"))
    assert view.columns == ["crew_id", "region"]
    assert len(view.first().crew_id) == 64


def test_version_history_and_preview(spark):
    df = spark.createDataFrame([("A", None), ("B", AT)], "asset_id string, valid_ts timestamp")
    got = {r.asset_id: r.valid_ts.year for r in readers.version_history(df).collect()}
    assert got == {"A": 1970, "B": 2024}
    assert readers.version_history(df.drop("valid_ts")).columns == ["asset_id", "valid_ts"]
    assert readers.preview(df, 1).count() == 1
    with pytest.raises(LookupError):
        readers.preview(df.limit(0))


def test_citation_sources(spark):
    df = spark.createDataFrame(
        [(1, [("b", "x"), ("a", "y"), ("b", "z")]), (2, None), (3, [(None, "x"), ("c", "y")]), (4, [])],
        "i int, dx_citations array<struct<source:string,snippet:string>>",
    )
    got = df.select("i", reports.citation_sources(F.col("dx_citations")).alias("s"))
    assert {r.i: r.s for r in got.collect()} == {1: "a, b", 2: "", 3: ", c", 4: ""}


def test_kpis_count_as_specified(spark):
    incidents = spark.range(4)
    executed = spark.createDataFrame([("monitor",), ("isolate",)], "action_type string")
    resolved = spark.createDataFrame(
        [("resolved", "isolate"), ("resolved", "dispatch_crew"), ("open", "isolate"), ("resolved", "reroute_load")],
        "status string, action_type string",
    )
    row = kpi.kpis(incidents, executed, resolved).first()
    assert (row.incidents, row.actions, row.resolved, row.outages_avoided, row.cost_avoided, row.resolved_ratio) == (4, 2, 3, 2, 600000, 0.75)
    none = kpi.kpis(incidents.limit(0), executed.limit(0), resolved).first()
    assert (none.incidents, none.resolved_ratio) == (0, 1.0)


def test_fleet_state_counts_silent_assets_as_info(spark):
    fleet = spark.createDataFrame([("A", 1.0, 2.0), ("B", 1.0, 2.0), ("C", 1.0, 2.0)], "asset_id string, lat double, lon double").withColumns(
        {"asset_type": F.lit("t"), "region": F.lit("r")}
    )
    enriched = spark.createDataFrame(
        [("A", 1, "critical", 95.65, 50.5, 0.125), ("A", 0, "info", 1.0, 1.0, 0.0), ("B", 1, "warning", None, 51.5, None)],
        "asset_id string, ts int, severity string, temp_c double, load_pct double, fault_score double",
    )
    state = kpi.fleet_state(fleet, enriched)
    assert {r.severity: r.n for r in kpi.severity_counts(state).collect()} == {"info": 1, "warning": 1, "critical": 1}
    table = reports.fleet_status(state).collect()
    assert [(r.asset, r.severity, r.temp_c, r.load_pct, r.fault) for r in table] == [
        ("A", "critical", 95.7, 50.0, 0.12), ("B", "warning", None, 52.0, 0.0), ("C", "info", None, None, 0.0),
    ]
    assert {r.asset_id for r in reports.needs_attention(state).collect()} == {"A", "B"}


def test_plan_fields(spark):
    rows = [("12345678-9", s, a) for s in ("critical", "warning", "info") for a in ("monitor", "throttle_load", "isolate")]
    ranked = spark.createDataFrame(rows, "incident_id string, severity string, action_type string").select(
        "*", F.lit("A").alias("asset_id"), F.lit("t").alias("asset_type"), F.lit("r").alias("region"), F.lit("").alias("tie_assets"),
        F.lit("C1").alias("cand_crew_id"), F.lit(None).cast("string").alias("dx_root_cause"),
        F.lit("why").alias("dx_rationale"), F.lit(0.5).alias("dx_confidence"),
    )
    plans = planning.build_plans(ranked, F.lit(AT))
    assert plans.columns == schemas.PLANNED.names
    got = {(r.severity, r.action_type): (r.target_load_pct, r.need_crew, r.crew_id, r.need_work_order, r.priority, r.sla_hours) for r in plans.collect()}
    assert got["critical", "monitor"] == ("", True, "C1", False, "P1", 2)
    assert got["warning", "throttle_load"] == ("52", False, None, True, "P2", 8)
    assert got["info", "isolate"] == ("", True, "C1", True, "P3", 24)
    assert {r.plan_id for r in plans.collect()} == {"PLAN-12345678"}
    assert {(r.action_type, r.status) for r in planning.executed_actions(plans).collect()} == {("monitor", "completed"), ("throttle_load", "issued"), ("isolate", "issued")}
    assert planning.control_commands(plans).count() == 6
    orders = planning.work_orders(plans)
    assert orders.count() == 6 and orders.first().description == "throttle_load on A. Root cause: "
    long = plans.withColumn("root_cause", F.lit("x" * 900))
    assert {len(r.description) for r in planning.work_orders(long).collect()} == {500}
