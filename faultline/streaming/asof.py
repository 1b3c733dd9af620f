"""As-of joins on a stream: versions as a second stream, or as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.asof import asof_join, asof_strategy
from faultline.operators.latest import DELETE, OP_COLUMN
from faultline.streaming.ordered import TIME, InOrder, in_order, state_schema, timed

_SIDE = "side"


class AsOf(InOrder):
    """Memory holds the one version in force at the watermark; none after a delete."""

    def __init__(self, input_schema: T.StructType, payload: Sequence[str], order: list[str]):
        super().__init__(input_schema, input_schema, order)
        self.side, self.op = input_schema.names.index(_SIDE), input_schema.names.index(OP_COLUMN)
        self.payload = [n for n, c in enumerate(input_schema.names) if c in payload]

    def on_rows(self, key: tuple, rows: list[tuple], memory: list[tuple], watermark_us: int):
        out = []
        for row in rows:
            if row[self.side] == 0:
                memory = [] if row[self.op] == DELETE else [tuple(row[i] for i in self.payload)]
            else:
                joined = list(row)
                for i, value in zip(self.payload, memory[0] if memory else (), strict=False):
                    joined[i] = value
                out.append(tuple(joined))
        return out, memory


def asof_join_stream(
    telemetry: DataFrame,
    versions: DataFrame,
    *,
    payload: Sequence[str],
    delay: str,
    key: str = "asset_id",
    version_ts: str = "valid_ts",
    tie: tuple[str, ...] = ("event_id",),
    beats: DataFrame | None = None,
) -> DataFrame:
    """Each telemetry row with the newest version at or before it, as of event time.

    Both inputs are streams; a row waits until the watermark, the slower of the two,
    has reached it. State per key: one version and the rows inside ``delay``. ``beats``
    (see ``ordered.timed``) keep versions that seldom change from holding up telemetry.
    """
    op = F.col(OP_COLUMN) if OP_COLUMN in versions.columns else F.lit(None).cast("string")
    left = timed(telemetry, delay).withColumn(_SIDE, F.lit(1))
    changes = versions.select(key, F.col(version_ts).alias("ts"), *payload, op.alias(OP_COLUMN))
    right = timed(changes, delay, beats=beats).withColumn(_SIDE, F.lit(0))
    both = left.unionByName(right, allowMissingColumns=True)
    plain = state_schema(both)
    joined = in_order(both, key, AsOf(plain, payload, [TIME, _SIDE, *tie]))
    return joined.withColumn("ts", F.timestamp_micros(TIME)).select(*telemetry.columns, *payload)


def asof_join_table(telemetry: DataFrame, versions: DataFrame, *, payload: Sequence[str], **options) -> DataFrame:
    """Stateless form for a version table that is proven small enough to broadcast (``asof_strategy``).

    The table is the one that the query started with; versions that change while it runs are a
    stream (``asof_join_stream``, ``scoring.versioned_score_stream``).
    """
    if asof_strategy(versions, options.get("key", "asset_id")) != "interval":
        raise ValueError("the version table is too large to broadcast; pass its versions as a stream")
    return asof_join(telemetry, versions, payload=payload, strategy="interval", **options)
