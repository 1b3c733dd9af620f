"""The public contract of the pipeline, stated in one place.

Everything here must have exactly this value for results to be right, so it is
written out plainly and nothing else in the package repeats it.
"""

from __future__ import annotations

# --- Fixed values: enumerations ---------------------------------------------
ASSET_TYPES = ("transformer", "transmission_line", "substation", "water_pump")
REGIONS = ("North", "South", "East", "West")
SEVERITIES = ("info", "warning", "critical")
ACTIONS = ("monitor", "throttle_load", "reroute_load", "dispatch_crew", "isolate")
PHYSICAL_ACTIONS = ("throttle_load", "reroute_load", "isolate", "dispatch_crew")
OUTAGE_AVOIDING_ACTIONS = ("isolate", "reroute_load", "throttle_load")
CREW_ACTIONS = ("dispatch_crew", "isolate")
SKILLS = ("transformer", "line", "pump", "general")
REQUIRED_SKILL = {"transformer": "transformer", "transmission_line": "line", "water_pump": "pump"}
FALLBACK_SKILL = "general"

# --- Fixed values: operating envelope used when an asset has no spec ---------
ENVELOPE_DEFAULTS = {
    "warning_temp_c": 85.0,
    "critical_temp_c": 95.0,
    "warning_vibration_mm_s": 0.0,
    "nominal_oil_pressure_kpa": 0.0,
    "rated_load_mw": 0.0,
}

# --- Fixed values: rolling window, fault model, severity, gate ---------------
ROLLING_PRECEDING_ROWS = 30
FAULT_INTERCEPT = -3.6
FAULT_WEIGHTS = {"temp_ratio": 4.2, "load_over": 3.1, "vib_ratio": 2.6, "pressure_drop": 2.4}
CRITICAL = {"vibration_factor": 1.5, "pressure_drop": 0.30, "load_pct": 115.0, "fault_score": 0.80}
WARNING = {"vibration_factor": 1.0, "pressure_drop": 0.15, "load_pct": 102.0, "fault_score": 0.50}
GATE_FAULT_SCORE = 0.5
GATE_ZSCORE = 3.0

# --- Fixed values: diagnosis --------------------------------------------------
GATED_ROOT_CAUSE = "Stable warning within tolerance; no immediate hazard."
GATED_RATIONALE = "Cost gate: low fault score and no abnormal deviation."
GATED_CONFIDENCE = 0.55
GATED_METHOD = "gated-skip"
RAG_METHOD_SUFFIX = "+vector-rag"
MISSING_ACTION = "dispatch_crew"
RETRIEVAL_K = 3
CONTEXT_SEPARATOR = " --- "
SNIPPET_CHARS = 200
EMBEDDING_DIM = 3072

# --- Fixed values: planning ---------------------------------------------------
NO_CREW_DISTANCE = 1e18
THROTTLE_TARGET_PCT = "52"
PRIORITY = {"critical": "P1", "warning": "P2"}
LOWEST_PRIORITY = "P3"
SLA_HOURS = {"critical": 2, "warning": 8}
LOWEST_SLA_HOURS = 24
ISSUED_BY = "flink-action"
DESCRIPTION_CHARS = 500
RECOVERY_WINDOW_SECONDS = 600
OUTAGE_COST = 300000

# --- Fixed values: corpus -----------------------------------------------------
CHUNK_CHARS = 750
MANUAL_SCOPE = {
    "transformer_oil_thermal_guide.md": "transformer",
    "transmission_line_dynamic_rating.md": "transmission_line",
    "pump_vibration_maintenance.md": "water_pump",
    "grid_emergency_response_sop.md": "all",
}
ANY_SCOPE = "all"
REFERENCE_GUIDE = {
    "transformer": "Transformer Oil Thermal Loading Guide (IEEE C57.91)",
    "transmission_line": "Transmission Line Dynamic Rating Guide (IEEE 738)",
    "water_pump": "Pump Vibration & Cavitation Maintenance Guide (ISO 10816)",
    "substation": "Substation Operations Guide",
}
FALLBACK_GUIDE = "Asset Operations Guide"

# --- Fixed values: data-quality rules (dataset, rule, predicate, route) -------
QUALITY_RULES = (
    ("telemetry", "temp_in_range", "temp_c >= -40.0 AND temp_c <= 200.0", "dlq"),
    ("telemetry", "voltage_positive", "voltage_kv > 0.0", "dlq"),
    ("telemetry", "load_non_negative", "load_pct >= 0.0", "dlq"),
    ("telemetry", "ambient_in_range", "ambient_c >= -50.0 AND ambient_c <= 70.0", "dlq"),
    ("weather", "humidity_pct_range", "humidity_pct >= 0.0 AND humidity_pct <= 100.0", "dlq"),
    ("weather", "wind_non_negative", "wind_kph >= 0.0", "dlq"),
    ("crew_location", "lat_range", "lat >= -90.0 AND lat <= 90.0", "dlq"),
    ("crew_location", "lon_range", "lon >= -180.0 AND lon <= 180.0", "dlq"),
    ("incidents", "fault_score_unit_interval", "fault_score >= 0.0 AND fault_score <= 1.0", "error"),
    ("incidents", "severity_enum", "severity IN ('info', 'warning', 'critical')", "error"),
)

# --- Fixed values: column tags ------------------------------------------------
COLUMN_TAGS = {
    "crew_location": {"crew_id": ("PII",), "lat": ("PII",), "lon": ("PII",)},
    "incidents": {"fault_score": ("ai-derived",)},
}

# --- Fixed values: reports ----------------------------------------------------
HISTORY_ROWS = 240
FEED_SHOWN = 25
FEED_KEPT = 120
WORK_ORDERS_SHOWN = 12
RECENT_KEPT = 50
