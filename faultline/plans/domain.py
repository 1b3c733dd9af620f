"""Domain views over the star-schema test tables.

The formulas are plain expressions that Spark and the oracle engine read alike, so
both derive the same rows from the same files. The operators know nothing of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.sources.readers import spread

REGION_CASE = (
    "case {k} % 5 when 0 then 'North' when 1 then 'South' when 2 then 'East' else 'West' end"
)
TYPE_CASE = (
    "case user_id % 4 when 0 then 'transformer' when 1 then 'transmission_line' "
    "when 2 then 'substation' else 'water_pump' end"
)
ASSET_ID = "concat('AST-', lpad(cast({k} as string), 8, '0'))"
CREW_ID = "concat('CREW-', lpad(cast({k} as string), 8, '0'))"

TELEMETRY = {
    "event_id": "event_id",
    "asset_id": ASSET_ID.format(k="user_id"),
    "asset_type": TYPE_CASE,
    "ts": "cast(ts as timestamp)",
    "region": REGION_CASE.format(k="user_id"),
    "substation": "concat('SUB-', cast(user_id % 6 as string))",
    "voltage_kv": "case when event_id % 211 = 0 then cast(0 as double) else cast(220 as double) end",
    "current_a": "cast(100 as double) + value",
    "load_mw": "cast(20 as double) + value % 75",
    "load_pct": "cast(45 as double) + value % 75",
    "temp_c": "cast(50 as double) + (value * 7) % 48",
    "ambient_c": "case when event_id % 173 = 0 then cast(99 as double) else cast(25 + event_id % 15 as double) end",
    "vibration_mm_s": (
        "case when user_id % 4 = 0 then cast(1 as double) + (event_id % 60) / cast(10 as double) "
        "when user_id % 4 = 3 and event_id % 97 <> 0 then cast(1 as double) + (event_id % 110) / cast(10 as double) end"
    ),
    "oil_pressure_kpa": (
        "case when user_id % 4 = 0 then cast(140 - event_id % 50 as double) "
        "when user_id % 4 = 3 then cast(320 - event_id % 110 as double) end"
    ),
}

_WARN = (
    "(case user_id % 4 when 0 then cast(85 as double) when 1 then cast(75 as double) "
    "when 2 then cast(70 as double) else cast(78 as double) end - v)"
)
SPEC_VERSIONS = {
    "asset_id": ASSET_ID.format(k="user_id"),
    "asset_type": TYPE_CASE,
    "valid_ts": (
        "case when v = 1 then cast('2024-01-11 00:00:00' as timestamp) "
        "when v = 2 then cast('2024-01-21 00:00:00' as timestamp) "
        "when user_id % 7 = 0 then cast('2024-01-04 00:00:00' as timestamp) "
        "else cast('2024-01-01 00:00:00' as timestamp) end"
    ),
    "warning_temp_c": _WARN,
    "critical_temp_c": (
        f"case when user_id % 23 = 0 then {_WARN} else case user_id % 4 when 0 then cast(95 as double) "
        "when 1 then cast(90 as double) when 2 then cast(85 as double) else cast(92 as double) end end"
    ),
    "warning_vibration_mm_s": (
        "case user_id % 4 when 0 then cast(4.5 as double) when 3 then cast(7.1 as double) else cast(0 as double) end"
    ),
    "nominal_oil_pressure_kpa": (
        "case user_id % 4 when 0 then cast(140 as double) when 3 then cast(320 as double) else cast(0 as double) end"
    ),
    "rated_load_mw": (
        "case user_id % 4 when 0 then cast(100 as double) when 1 then cast(200 as double) "
        "when 2 then cast(220 as double) else cast(3 as double) end"
    ),
}
SPEC_FILTER = "user_id % 10 <> 9"

_TIES = (
    "case when user_id % 4 in (0, 1) then split(concat("
    + ASSET_ID.format(k="user_id + 4") + ", ',', " + ASSET_ID.format(k="user_id + 8") + "), ',') end"
)
REGISTRY = {
    "asset_id": ASSET_ID.format(k="user_id"),
    "valid_ts": "cast('2024-01-01 00:00:00' as timestamp)",
    "lat": "cast(12 as double) + (user_id % 97) / cast(50 as double)",
    "lon": "cast(77 as double) + (user_id % 89) / cast(50 as double)",
    "tie_assets": _TIES,
}
REGISTRY_FILTER = "user_id % 11 <> 0"

CREW_PINGS = {
    "crew_id": CREW_ID.format(k="l_suppkey"),
    "ts": "cast(l_shipdate as timestamp)",
    "region": REGION_CASE.format(k="l_suppkey"),
    "lat": "cast(12 as double) + (l_partkey % 97) / cast(50 as double)",
    "lon": "cast(77 as double) + (l_partkey % 89) / cast(50 as double)",
    "status": "case when l_orderkey % 3 = 0 then 'enroute' else 'available' end",
    "skills": (
        "split(case l_suppkey % 4 when 0 then 'general,transformer' when 1 then 'line' "
        "when 2 then 'pump,transformer' else 'general,line,pump' end, ',')"
    ),
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
}
CREW_ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey")

WEATHER = {
    "region": REGION_CASE.format(k="user_id"),
    "ts": "cast(ts as timestamp)",
    "ambient_c": "cast(20 + event_id % 20 as double)",
    "humidity_pct": "case when event_id % 157 = 0 then cast(120 as double) else cast(event_id % 100 as double) end",
    "wind_kph": "case when event_id % 131 = 0 then cast(-1 as double) when event_id % 139 = 0 then null else value end",
    "condition": (
        "case event_id % 5 when 0 then 'clear' when 1 then 'cloudy' when 2 then 'rain' "
        "when 3 then 'storm' else 'heatwave' end"
    ),
}

FLEET = {
    "asset_id": ASSET_ID.format(k="user_id"),
    "name": "concat('Asset ', cast(user_id as string))",
    "asset_type": TYPE_CASE,
    "region": REGION_CASE.format(k="user_id"),
    "substation": "concat('SUB-', cast(user_id % 6 as string))",
    "voltage_kv": "cast(case when user_id % 4 = 3 then 11 else 220 end as int)",
    "criticality": "case when user_id % 3 = 0 then 'critical' when user_id % 3 = 1 then 'high' else 'medium' end",
    "install_year": "cast(1990 + user_id % 30 as int)",
    "lat": REGISTRY["lat"],
    "lon": REGISTRY["lon"],
    "rated_load_mw": (
        "case when user_id % 8 = 7 then cast(0 as double) else case user_id % 4 when 0 then cast(100 as double) "
        "when 1 then cast(200 as double) when 2 then cast(220 as double) else cast(2.5 as double) end end"
    ),
    "nominal_temp_c": "cast(42 + user_id % 16 as double)",
    "warning_temp_c": "case when user_id % 13 = 0 then cast(0 as double) else cast(70 + user_id % 16 as double) end",
    "critical_temp_c": "cast(85 + user_id % 11 as double)",
    "nominal_vibration_mm_s": "case user_id % 4 when 0 then cast(1.2 as double) when 3 then cast(1.8 as double) else cast(0 as double) end",
    "warning_vibration_mm_s": SPEC_VERSIONS["warning_vibration_mm_s"],
    "nominal_oil_pressure_kpa": SPEC_VERSIONS["nominal_oil_pressure_kpa"],
    "tie_assets": _TIES,
    "spec_sheet_id": "concat('spec-', cast(user_id as string))",
}

PAYLOAD = (
    "case when event_id % 29 = 0 then '{{\"asset_id\": \"trunc' else concat("
    "'{{\"asset_id\": \"', {asset}, '\"', "
    "case when event_id % 17 = 0 then '' else concat(', \"asset_type\": \"', {type}, '\"') end, "
    "', \"ts\": ', cast(event_id as string), "
    "', \"region\": \"', {region}, '\", \"substation\": \"SUB\"', "
    "', \"voltage_kv\": 220.0, \"current_a\": 10, \"load_mw\": 5.5', "
    "', \"load_pct\": ', case when event_id % 19 = 0 then 'null' else cast(event_id % 100 as string) end, "
    "', \"temp_c\": ', case when event_id % 13 = 0 then '\"hot\"' else cast(event_id % 90 as string) end, "
    "', \"ambient_c\": 30.25, \"vibration_mm_s\": null, \"oil_pressure_kpa\": ', "
    "case when event_id % 23 = 0 then '[1]' else '140.5' end, '}}') end"
).format(
    asset=ASSET_ID.format(k="user_id"), type=TYPE_CASE, region=REGION_CASE.format(k="user_id")
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr(*[f"{expression} AS {name}" for name, expression in columns.items()])


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), TELEMETRY)


def _assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id").distinct()


def spec_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _assets(spark, sf_dir).filter(SPEC_FILTER).withColumn("v", F.explode(F.array(*map(F.lit, range(3)))))
    return _select(versions, SPEC_VERSIONS)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_assets(spark, sf_dir).filter(REGISTRY_FILTER), REGISTRY)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(_assets(spark, sf_dir), FLEET)


def crew_pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "lineitem"), CREW_PINGS)


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _select(table(spark, sf_dir, "events"), WEATHER)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events").select("event_id", "user_id"))
    return events.selectExpr("event_id", f"{PAYLOAD} AS payload")


def manuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as manuals: every line a paragraph, the whole text kept."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("source"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
