"""From scored readings to enriched rows, incidents and the cost gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import schemas
from faultline.functions.scalar import event_micros, stable_uuid


def enriched(scored: DataFrame) -> DataFrame:
    return scored.select(*schemas.ENRICHED.names)


def attribute_signal() -> Column:
    """The first out-of-range signal; oil pressure also covers score-only warnings."""
    warn_v = F.col("warning_vibration_mm_s")
    return (
        F.when(F.col("temp_c") >= F.col("warning_temp_c"), "temp_c")
        .when((warn_v > 0) & (F.col("vibration_mm_s") >= warn_v), "vibration_mm_s")
        .when(F.col("load_pct") >= K.WARNING["load_pct"], "load_pct")
        .otherwise("oil_pressure_kpa")
    )


def cost_gate() -> Column:
    """Whether an incident is worth a model call; NULL when that cannot be decided."""
    return (
        (F.col("severity") == "critical")
        | (F.col("fault_score") >= K.GATE_FAULT_SCORE)
        | (F.abs(F.col("zscore")) >= K.GATE_ZSCORE)
    )


def build_incidents(scored: DataFrame, id_columns: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """One incident per warning or critical reading.

    ``value`` and ``threshold`` are always the temperature pair. The id derives
    from asset, event time and ``id_columns``, so a replay produces the same rows.
    """
    incident_id = stable_uuid(F.col("asset_id"), event_micros(F.col("ts")), *[F.col(c) for c in id_columns])
    return (
        scored.filter(F.col("severity").isin("warning", "critical"))
        .withColumns(
            {
                "incident_id": incident_id,
                "signal": attribute_signal(),
                "value": F.col("temp_c"),
                "threshold": F.col("warning_temp_c"),
                "zscore": F.col("temp_zscore"),
            }
        )
        .withColumn("reasoning_needed", cost_gate())
        .select(*schemas.INCIDENTS.names)
    )


def gated_in(incidents: DataFrame) -> DataFrame:
    return incidents.filter(F.col("reasoning_needed"))


def gated_out(incidents: DataFrame) -> DataFrame:
    return incidents.filter(~F.col("reasoning_needed"))


def gate_counts(incidents: DataFrame) -> DataFrame:
    """Rows per gate branch; ``dropped_null_gate`` rows reach neither branch."""
    branch = (
        F.when(F.col("reasoning_needed"), "reasoned")
        .when(~F.col("reasoning_needed"), "gated_skip")
        .otherwise("dropped_null_gate")
    )
    return incidents.groupBy("severity", branch.alias("branch")).agg(F.count(F.lit(1)).alias("n"))


def enriched_with(scored: DataFrame, *extra: str) -> DataFrame:
    """Enriched rows keeping further columns, such as a tie-breaking event id."""
    return scored.select(*schemas.ENRICHED.names, *extra)
