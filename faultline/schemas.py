"""Declared schemas. Readers never infer; required fields are the non-nullable ones."""

from __future__ import annotations

from pyspark.sql import types as T


CITATION = T.StructType([T.StructField("source", T.StringType()), T.StructField("snippet", T.StringType())])
_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "strings": T.ArrayType(T.StringType()),
    "vector": T.ArrayType(T.FloatType()),
    "citations": T.ArrayType(CITATION),
}


def _struct(fields: str, optional: tuple[str, ...] | None = None) -> T.StructType:
    """``optional`` names the nullable fields; None makes all nullable."""
    pairs = [f.split() for f in fields.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t], optional is None or n in optional) for n, t in pairs])


TELEMETRY = _struct(
    "asset_id string, asset_type string, ts timestamp, region string, substation string, "
    "voltage_kv double, current_a double, load_mw double, load_pct double, temp_c double, "
    "ambient_c double, vibration_mm_s double, oil_pressure_kpa double",
    optional=("vibration_mm_s", "oil_pressure_kpa"),
)
CREW_LOCATION = _struct(
    "crew_id string, ts timestamp, region string, lat double, lon double, status string, "
    "skills strings",
    optional=(),
)
WEATHER = _struct(
    "region string, ts timestamp, ambient_c double, humidity_pct double, wind_kph double, "
    "condition string",
    optional=(),
)
ASSETS = _struct(
    "asset_id string, name string, asset_type string, region string, substation string, "
    "voltage_kv int, criticality string, install_year int, lat double, lon double, "
    "rated_load_mw double, nominal_temp_c double, warning_temp_c double, critical_temp_c double, "
    "nominal_vibration_mm_s double, warning_vibration_mm_s double, "
    "nominal_oil_pressure_kpa double, feeds strings, tie_assets strings, "
    "spec_sheet_id string"
)
ASSET_SPECS = _struct(
    "spec_sheet_id string, asset_id string, asset_type string, name string, voltage_kv int, "
    "rated_load_mw double, nominal_temp_c double, warning_temp_c double, critical_temp_c double, "
    "warning_vibration_mm_s double, nominal_vibration_mm_s double, "
    "nominal_oil_pressure_kpa double, install_year int, criticality string, "
    "tie_assets strings, reference_guide string, spec_text string"
)
CREW = _struct(
    "crew_id string, name string, region string, lat double, lon double, status string, "
    "skills strings"
)
MAINTENANCE_HISTORY = _struct(
    "asset_id string, ts long, note string, technician string, result string"
)
MANUAL_CHUNKS = _struct(
    "text string, source string, chunk int, asset_id string, asset_type string, "
    "embedding vector"
)

ENRICHED = _struct(
    "asset_id string, asset_type string, ts timestamp, region string, substation string, "
    "load_pct double, temp_c double, vibration_mm_s double, oil_pressure_kpa double, "
    "fault_score double, severity string, warning_temp_c double, critical_temp_c double"
)
INCIDENTS = _struct(
    "asset_id string, incident_id string, asset_type string, ts timestamp, region string, "
    "substation string, signal string, value double, threshold double, zscore double, "
    "fault_score double, severity string, warning_temp_c double, critical_temp_c double, "
    "warning_vibration_mm_s double, nominal_oil_pressure_kpa double, rated_load_mw double, "
    "tie_assets string, reasoning_needed boolean"
)
DIAGNOSED = _struct(
    "asset_id string, incident_id string, asset_type string, region string, severity string, "
    "signal string, value double, fault_score double, zscore double, tie_assets string, "
    "dx_root_cause string, dx_recommended_action string, dx_rationale string, "
    "dx_confidence double, dx_citations citations, "
    "dx_method string, diagnosed_ts timestamp"
)
PLANNED = _struct(
    "incident_id string, asset_id string, plan_id string, asset_type string, region string, "
    "ts timestamp, action_type string, target_load_pct string, tie_assets string, "
    "need_crew boolean, crew_id string, need_work_order boolean, priority string, "
    "sla_hours int, severity string, root_cause string, rationale string, confidence double"
)
EXECUTED = _struct(
    "incident_id string, asset_id string, action_id string, ts timestamp, action_type string, "
    "rationale string, status string, issued_by string"
)
CONTROL = _struct(
    "incident_id string, asset_id string, action_id string, ts timestamp, action_type string"
)
WORK_ORDERS = _struct(
    "incident_id string, work_order_id string, asset_id string, ts timestamp, priority string, "
    "crew_id string, sla_hours int, description string, status string"
)
RESOLVED = _struct(
    "incident_id string, asset_id string, status string, action_type string, "
    "recovery_seconds double, resolved_ts timestamp"
)

CITATIONS_TYPE = T.ArrayType(CITATION)
