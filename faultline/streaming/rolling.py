"""Rolling z-score on a stream; same values as the batch operator."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as K
from faultline.streaming.ordered import LATE, TIME, InOrder, in_order, state_schema, timed


def zscore(frame: list[float | None]) -> float | None:
    """Deviation of the frame's last value from its mean in population std units, 0 without spread.

    A missing value has no deviation where there is spread, as in the batch operator.
    """
    known = [x for x in frame if x is not None]
    if not known:
        return 0.0
    value = frame[-1]
    # Measured from one member: equal values then give exactly no spread.
    origin = known[-1]
    shifted = [x - origin for x in known]
    mean = sum(shifted) / len(shifted)
    variance = sum((x - mean) ** 2 for x in shifted) / len(shifted)
    if variance <= 0:
        return 0.0
    return None if value is None else (value - origin - mean) / variance**0.5


class RollingScore(InOrder):
    """Memory holds the last values of the key."""

    def __init__(self, input_schema: T.StructType, value: str, output: str, preceding: int, order: list[str]):
        scored = T.StructType([*input_schema.fields, T.StructField(output, T.DoubleType())])
        super().__init__(input_schema, scored, order)
        self.value, self.preceding = input_schema.names.index(value), preceding

    def on_rows(self, key: tuple, rows: list[tuple], memory: list[tuple], watermark_us: int):
        if not rows:
            return [], memory
        frame = deque((m[0] for m in memory), maxlen=self.preceding + 1)
        out = []
        for row in rows:
            frame.append(row[self.value])
            out.append((*row, zscore(list(frame))))
        return out, [(v,) for v in list(frame)[-self.preceding :]]


def rolling_zscore_stream(
    telemetry: DataFrame,
    *,
    delay: str,
    value: str = "temp_c",
    key: str = "asset_id",
    tie: tuple[str, ...] = ("event_id",),
    preceding: int = K.ROLLING_PRECEDING_ROWS,
    output: str = "temp_zscore",
    beats: DataFrame | None = None,
    late_rows: bool = False,
) -> DataFrame:
    """Telemetry with its z-score, each row emitted once the watermark reaches it.

    State per key: the last ``preceding`` values and the rows inside ``delay``. With ``late_rows``
    a boolean ``late`` marks rows that came too late, which have no score.
    """
    rows = timed(telemetry, delay, beats=beats)
    plain = state_schema(rows)
    scored = in_order(rows, key, RollingScore(plain, value, output, preceding, [TIME, *tie]), late_rows=late_rows)
    flag = [LATE] if late_rows else []
    return scored.withColumn("ts", F.timestamp_micros(TIME)).select(*telemetry.columns, output, *flag)
