"""Scoring on streams of telemetry and of versions, in one keyed exchange."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as K
from faultline.operators import scoring
from faultline.operators.latest import DELETE, OP_COLUMN
from faultline.streaming.ordered import BEAT, EVENT_TS, LATE, TIME, InOrder, in_order, state_schema, timed
from faultline.streaming.rolling import zscore

_SIDE, _TIE = "_side", "_tie_"


@dataclass(frozen=True)
class Versions:
    """A stream of versions: what it adds to a reading, and from when each version holds.

    Among versions of equal time the one with the greatest ``tie`` wins. ``_op = 'delete'``
    ends a key. ``beats`` move its watermark while nothing changes (``ordered.timed``).
    """

    stream: DataFrame
    payload: Sequence[str]
    valid_ts: str = "valid_ts"
    tie: tuple[str, ...] = ()
    beats: DataFrame | None = None


class VersionedScore(InOrder):
    """Memory holds the key's last values, and of each kind the version in force; none after a delete."""

    def __init__(
        self, input_schema: T.StructType, payloads: list[list[str]], value: str, output: str, preceding: int, order: list[str]
    ):
        added = [c for payload in payloads for c in payload]
        hidden = {_SIDE, OP_COLUMN, BEAT, *added}
        shown = [f for f in input_schema.fields if f.name not in hidden and not f.name.startswith(_TIE)]
        kept = [input_schema[c] for c in added]
        scored = T.StructType([*shown, T.StructField(output, T.DoubleType()), *kept])
        super().__init__(input_schema, scored, order)
        names = input_schema.names
        self.side, self.op, self.value = names.index(_SIDE), names.index(OP_COLUMN), names.index(value)
        self.shown = [names.index(f.name) for f in shown]
        self.payloads = [[names.index(c) for c in payload] for payload in payloads]
        self.preceding = preceding

    def on_rows(self, key: tuple, rows: list[tuple], memory: list[tuple], watermark_us: int):
        if not rows:
            return [], memory
        sizes = [len(payload) for payload in self.payloads]
        starts = [2 + sum(sizes[:n]) for n in range(len(sizes))]
        none = [(None,) * size for size in sizes]
        reading = len(sizes)
        frame = deque((m[1] for m in memory if m[0] == reading), maxlen=self.preceding + 1)
        force = {m[0]: m[starts[m[0]] : starts[m[0]] + sizes[m[0]]] for m in memory if m[0] < reading}
        out = []
        for row in rows:
            side = row[self.side]
            if side == reading:
                frame.append(row[self.value])
                found = [v for n in range(reading) for v in force.get(n, none[n])]
                out.append((*(row[i] for i in self.shown), zscore(list(frame)), *found))
            elif row[self.op] == DELETE:
                force.pop(side, None)
            else:
                force[side] = tuple(row[i] for i in self.payloads[side])
        blank = [v for part in none for v in part]
        kept = [(reading, v, *blank) for v in list(frame)[-self.preceding :]]
        for side, version in sorted(force.items()):
            kept.append((side, None, *(v for n in range(reading) for v in (version if n == side else none[n]))))
        return out, kept

    def on_late(self, row: tuple) -> tuple | None:
        return super().on_late(row) if row[self.side] == len(self.payloads) else None


def versioned_score_stream(
    telemetry: DataFrame,
    versions: Sequence[Versions],
    *,
    delay: str,
    value: str = "temp_c",
    key: str = "asset_id",
    tie: tuple[str, ...] = ("event_id",),
    preceding: int = K.ROLLING_PRECEDING_ROWS,
    output: str = "temp_zscore",
    beats: DataFrame | None = None,
    late_rows: bool = False,
    chained: bool = False,
) -> DataFrame:
    """Telemetry with its z-score and, of each kind, the version in force at its time.

    All inputs are streams that meet in one exchange by key. A reading waits until the
    watermark, that of the slowest input, has reached it, so a version that arrives after the
    readings it holds for, but within ``delay``, still reaches them. State per key: the last
    ``preceding`` values, one version of each kind and the rows inside ``delay``.

    ``late_rows`` adds a boolean ``late`` and the readings that came too late, without score or
    version. ``chained`` adds the event time for a further stateful operator (``ordered.retimed``).
    """
    reading = len(versions)
    both = timed(telemetry, delay, beats=beats).withColumn(_SIDE, F.lit(reading))
    for side, kind in enumerate(versions):
        op = F.col(OP_COLUMN) if OP_COLUMN in kind.stream.columns else F.lit(None).cast("string")
        ties = [F.col(c).alias(f"{_TIE}{side}_{n}") for n, c in enumerate(kind.tie)]
        changes = kind.stream.select(key, F.col(kind.valid_ts).alias("ts"), *kind.payload, op.alias(OP_COLUMN), *ties)
        both = both.unionByName(timed(changes, delay, beats=kind.beats).withColumn(_SIDE, F.lit(side)), allowMissingColumns=True)
    ties = [f"{_TIE}{side}_{n}" for side, kind in enumerate(versions) for n in range(len(kind.tie))]
    payloads = [list(kind.payload) for kind in versions]
    processor = VersionedScore(state_schema(both), payloads, value, output, preceding, [TIME, _SIDE, *ties, *tie])
    scored = in_order(both, key, processor, late_rows=late_rows, chained=chained)
    flags = ([LATE] if late_rows else []) + ([TIME, EVENT_TS] if chained else [])
    added = [c for payload in payloads for c in payload]
    return scored.withColumn("ts", F.timestamp_micros(TIME)).select(*telemetry.columns, output, *added, *flags)


def spec_and_registry(specs: DataFrame, registry: DataFrame, **options) -> list[Versions]:
    """The two kinds of versions that scoring needs."""
    return [Versions(specs, scoring.SPEC_COLUMNS, **options), Versions(registry, ("tie_assets",), **options)]
