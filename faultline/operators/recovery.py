"""Verified recovery: the first healthy reading soon enough after a physical action."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as K
from faultline import schemas
from faultline.operators.asof import asof_join
from faultline.operators.slicing import Slices


def first_recovery(
    executed: DataFrame,
    enriched: DataFrame,
    *,
    window_seconds: int = K.RECOVERY_WINDOW_SECONDS,
    slices: Slices | None = None,
) -> DataFrame:
    """Actions with the time of their first healthy reading within the window, both ends included.

    The first reading in a window is the next one at all if that lies in the
    window: a forward as-of join, so no action is paired with every reading.
    """
    actions = executed.filter(F.col("action_type").isin(*K.PHYSICAL_ACTIONS)).select(
        "incident_id", "asset_id", "action_type", F.col("ts").alias("act_time")
    )
    healthy = enriched.filter(F.col("severity") == "info").select("asset_id", "ts", F.col("ts").alias("rec_time"))
    matched = asof_join(
        actions, healthy, payload=["rec_time"], left_ts="act_time", right_ts="ts",
        direction="forward", strategy="merge", slices=slices,
    )
    limit = F.col("act_time") + F.make_dt_interval(secs=F.lit(window_seconds))
    return matched.filter(F.col("rec_time") <= limit)


def resolve(recoveries: DataFrame) -> DataFrame:
    seconds = F.timestamp_diff("SECOND", F.col("act_time"), F.col("rec_time")).cast("double")
    return recoveries.select(
        "incident_id",
        "asset_id",
        F.lit("resolved").alias("status"),
        "action_type",
        seconds.alias("recovery_seconds"),
        F.col("rec_time").alias("resolved_ts"),
    ).select(*schemas.RESOLVED.names)
