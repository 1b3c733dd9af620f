"""First healthy reading after an action, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as K
from faultline.streaming.ordered import TIME, InOrder, in_order, retimed, timed

_HEALTHY = "healthy"
_INPUT = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("incident_id", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField(_HEALTHY, T.IntegerType()),
        T.StructField(TIME, T.LongType()),
    ]
)
_OUTPUT = T.StructType(
    [
        T.StructField("incident_id", T.StringType()),
        T.StructField("asset_id", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("act_us", T.LongType()),
        T.StructField("rec_us", T.LongType()),
    ]
)


class Recovery(InOrder):
    """Memory holds open actions (incident, type, time); each leaves on its recovery or when its window closes."""

    def __init__(self, window_us: int, report_unresolved: bool):
        super().__init__(_INPUT, _OUTPUT, [TIME, _HEALTHY, "incident_id"])
        self.window_us, self.report_unresolved = window_us, report_unresolved

    def wake_at(self, memory: list[tuple]) -> int | None:
        return min((a[2] + self.window_us for a in memory), default=None)

    def on_rows(self, key: tuple, rows: list[tuple], memory: list[tuple], watermark_us: int):
        waiting, done = list(memory), []
        for _, incident, action, healthy, at in rows:
            if not healthy:
                waiting.append((incident, action, at))
            elif waiting:
                done += [(*a, at if at <= a[2] + self.window_us else None) for a in waiting]
                waiting = []
        done += [(*a, None) for a in waiting if a[2] + self.window_us <= watermark_us]
        waiting = [a for a in waiting if a[2] + self.window_us > watermark_us]
        out = [
            (incident, key[0], action, acted, recovered)
            for incident, action, acted, recovered in done
            if recovered is not None or self.report_unresolved
        ]
        return out, waiting


def recovery_stream(
    actions: DataFrame,
    enriched: DataFrame,
    *,
    delay: str,
    window_seconds: int = K.RECOVERY_WINDOW_SECONDS,
    report_unresolved: bool = False,
) -> DataFrame:
    """Actions with their first healthy reading within the window, both ends included.

    ``report_unresolved`` (an addition) also emits actions whose window closed
    without one, with a NULL ``rec_time``.
    """
    right = timed(enriched.filter(F.col("severity") == "info").select("asset_id", "ts"), delay)
    return _recoveries(actions, right, delay, window_seconds, report_unresolved)


def recovery_chain(
    actions: DataFrame,
    graded: DataFrame,
    *,
    delay: str,
    window_seconds: int = K.RECOVERY_WINDOW_SECONDS,
    report_unresolved: bool = False,
) -> DataFrame:
    """As ``recovery_stream``, fed by a chained scoring stream in the same query.

    The scores carry their event time on, so the watermark here is the slower one of the scores'
    and the actions' own.
    """
    right = retimed(graded.filter(F.col("severity") == "info")).select("asset_id", TIME, "ts")
    return _recoveries(actions, right, delay, window_seconds, report_unresolved)


def _recoveries(actions: DataFrame, healthy: DataFrame, delay: str, window_seconds: int, report_unresolved: bool) -> DataFrame:
    physical = actions.filter(F.col("action_type").isin(*K.PHYSICAL_ACTIONS))
    left = timed(physical.select("asset_id", "incident_id", "action_type", "ts"), delay)
    both = left.withColumn(_HEALTHY, F.lit(0)).unionByName(
        healthy.withColumn(_HEALTHY, F.lit(1)), allowMissingColumns=True
    )
    found = in_order(both.select(*_INPUT.names, "ts"), "asset_id", Recovery(window_seconds * 1_000_000, report_unresolved))
    return found.select(
        "incident_id", "asset_id", "action_type",
        F.timestamp_micros("act_us").alias("act_time"), F.timestamp_micros("rec_us").alias("rec_time"),
    )
