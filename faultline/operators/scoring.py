"""Operating envelope, feature normalisation, logistic fault score, severity."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.functions.scalar import floor_at_zero, ratio

SPEC_COLUMNS = tuple(K.ENVELOPE_DEFAULTS)
#: What of a reading its grade follows from.
READING_COLUMNS = ("temp_c", "load_pct", "vibration_mm_s", "oil_pressure_kpa")


def apply_envelope(df: DataFrame) -> DataFrame:
    """Defaults for assets without a spec version; tie assets as comma-joined text."""
    columns = {c: F.coalesce(F.col(c), F.lit(default)) for c, default in K.ENVELOPE_DEFAULTS.items()}
    columns["tie_assets"] = F.coalesce(F.array_join("tie_assets", ","), F.lit(""))
    return df.withColumns(columns)


def _relative_drop() -> Column:
    nominal = F.col("nominal_oil_pressure_kpa")
    return ratio(nominal - F.col("oil_pressure_kpa"), nominal)


def normalise_features(df: DataFrame) -> DataFrame:
    """Four ratios that are 0 inside the envelope and grow beyond it; NULL propagates."""
    warn_t, crit_t = F.col("warning_temp_c"), F.col("critical_temp_c")
    warn_v, nominal = F.col("warning_vibration_mm_s"), F.col("nominal_oil_pressure_kpa")
    return df.withColumns(
        {
            "temp_ratio": floor_at_zero(ratio(F.col("temp_c") - warn_t, crit_t - warn_t)),
            "load_over": floor_at_zero((F.col("load_pct") - 100.0) / 20.0),
            "vib_ratio": F.when(
                warn_v > 0, floor_at_zero(ratio(F.col("vibration_mm_s") - warn_v, warn_v))
            ).otherwise(F.lit(0.0)),
            "pressure_drop": F.when(nominal > 0, floor_at_zero(_relative_drop())).otherwise(F.lit(0.0)),
        }
    )


def fault_score(
    df: DataFrame, weights: dict[str, float] = K.FAULT_WEIGHTS, intercept: float = K.FAULT_INTERCEPT
) -> DataFrame:
    linear = F.lit(intercept)
    for feature, weight in weights.items():
        linear = linear + F.lit(weight) * F.col(feature)
    return df.withColumn("fault_score", F.lit(1.0) / (F.lit(1.0) + F.exp(-linear)))


def grade_severity(df: DataFrame) -> DataFrame:
    """First level whose any condition holds; a NULL condition does not block the others."""

    def exceeds(limits: dict[str, float], temp_limit: str) -> Column:
        warn_v, nominal = F.col("warning_vibration_mm_s"), F.col("nominal_oil_pressure_kpa")
        conditions = (
            F.col("temp_c") >= F.col(temp_limit),
            (warn_v > 0) & (F.col("vibration_mm_s") >= warn_v * limits["vibration_factor"]),
            (nominal > 0) & (_relative_drop() >= limits["pressure_drop"]),
            F.col("load_pct") >= limits["load_pct"],
            F.col("fault_score") >= limits["fault_score"],
        )
        return reduce(or_, conditions)

    severity = (
        F.when(exceeds(K.CRITICAL, "critical_temp_c"), "critical")
        .when(exceeds(K.WARNING, "warning_temp_c"), "warning")
        .otherwise("info")
    )
    return df.withColumn("severity", severity)
