"""Event-time order per key: the base of the stateful operators."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "event_us"
#: Event time as the engine knows it, on a stream that feeds another stateful operator.
EVENT_TS = "event_ts"
LATE = "late"
BEAT = "_beat"
NO_WATERMARK = -(2**62)
#: Watermarks begin at 1970, and rows before one are late. Event times are told to the engine
#: later by 1969 years, so that any time from the year 1 on is after its beginning.
SHIFT_US = 62_135_596_800_000_000
#: Waiting rows lie in state in buckets of so much event time.
BUCKET_US = 900_000_000
#: So many waiting rows of a key lie beside its memory and in no bucket. Buckets that a batch opens and that hold few
#: rows are put together up to so many. Each bucket costs calls to the state.
PACKED_ROWS = 64

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
_BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
# State holds packed values: the engine would turn every cell of a row into an object of its own and back.
_ROWS = T.StructType([T.StructField("rows", T.ArrayType(T.BinaryType()))])
_PACKED = T.StructType([T.StructField("packed", T.BinaryType())])


def use_rocksdb(spark: SparkSession) -> None:
    """State that may exceed memory; required by the stateful operators."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class InOrder(StatefulProcessor):
    """Hands a subclass each key's rows in event-time order, once the watermark has reached them.

    A few waiting rows lie in one value with the memory, so that a key costs a batch one read and one write. More wait
    in buckets of event time, sparse ones packed: a batch reads and writes the buckets that
    are due and those that it adds to, however many rows wait in others. The engine drops
    rows that an earlier watermark has reached; whatever it lets pass can still be put in
    order, because a batch releases only up to its own watermark. With ``late_rows`` the
    engine is not told the rows' times, and rows at or before the watermark are given back
    as late instead. With ``chained`` the output carries its event time on to a further
    stateful operator. ``memory`` is what the subclass keeps between calls: a small list
    of tuples it must bound itself, given the watermark.
    """

    bucket_us = BUCKET_US

    def __init__(self, input_schema: T.StructType, output_schema: T.StructType, order: list[str]):
        self.input_schema, self.output_schema = input_schema, output_schema
        self.time = input_schema.names.index(TIME)
        self.beat = input_schema.names.index(BEAT) if BEAT in input_schema.names else None
        self.order = [input_schema.names.index(c) for c in order]
        self.late_rows = self.chained = False

    def on_rows(
        self, key: tuple, rows: list[tuple], memory: list[tuple], watermark_us: int
    ) -> tuple[list[tuple], list[tuple]]:
        """Output tuples for rows in order, and the new memory. Rows are empty when only time has passed."""
        raise NotImplementedError

    def wake_at(self, memory: list[tuple]) -> int | None:
        """When, in microseconds, memory needs attention even without rows."""
        return None

    def on_late(self, row: tuple) -> tuple | None:
        """What to give back for a row that came too late: its own columns, and nothing in those that the operator adds."""
        by_name = dict(zip(self.input_schema.names, row, strict=True))
        return tuple(by_name.get(c) for c in self.output_schema.names)

    def emitted_schema(self) -> T.StructType:
        extra = [T.StructField(LATE, T.BooleanType())] if self.late_rows else []
        extra += [T.StructField(EVENT_TS, T.TimestampType())] if self.chained else []
        return T.StructType([*self.output_schema.fields, *extra])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", _BUCKET, _ROWS)
        #: While rows wait all but the buckets lies in the one, otherwise in the other, if there is any.
        self.waiting = handle.getValueState("buckets", _PACKED)
        self.resting = handle.getValueState("memory", _PACKED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = _watermark(timerValues)
        at = None
        arrived = []
        for row in rows:
            at = at or itemgetter(*[row.__fields__.index(c) for c in self.input_schema.names])
            arrived.append(at(tuple(row)))
        if self.beat is not None:
            arrived = [r for r in arrived if not r[self.beat]]
        if self.late_rows:
            late = [r for r in arrived if r[self.time] <= watermark]
            arrived = [r for r in arrived if r[self.time] > watermark]
            yield from self._rows([v for v in map(self.on_late, late) if v is not None], True)
        yield from self._drain(key, arrived, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._drain(key, [], _watermark(timerValues))

    def close(self) -> None:
        pass

    def _rank(self, row: tuple) -> list[tuple]:
        return [(False, 0) if row[i] is None else (True, row[i]) for i in self.order]

    def _drain(self, key: tuple, arrived: list[tuple], watermark: int) -> Iterator[Row]:
        held = self.waiting.get()
        waits = held is not None
        held = held or self.resting.get()
        before = held and bytes(held[0])
        firsts, few, memory, timer = pickle.loads(before) if held else ({}, [], [], None)
        early = [row for row in arrived if row[self.time] <= watermark]
        later = [row for row in few if row[self.time] > watermark] + [row for row in arrived if row[self.time] > watermark]
        few, soon = later, [row for row in few if row[self.time] <= watermark]
        added = {}
        if len(later) > PACKED_ROWS:
            for row in later:
                added.setdefault(row[self.time] // self.bucket_us, []).append(row)
            few, added = [], _packed(added, firsts)
        reached = [bucket for bucket, first in firsts.items() if first <= watermark]
        due = early
        for bucket in {*reached, *added}:
            rows = self._bucket(bucket) if bucket in firsts else []
            due += [r for r in rows if r[self.time] <= watermark]
            stay = [r for r in rows if r[self.time] > watermark] + added.get(bucket, [])
            if stay:
                self.pending.updateValue((bucket,), ([_pack(r) for r in stay],))
                firsts[bucket] = min(r[self.time] for r in stay)
            else:
                self.pending.removeKey((bucket,))
                del firsts[bucket]
        due += soon
        wake = self.wake_at(memory)
        out = []
        if due or (wake is not None and wake <= watermark):
            out, memory = self.on_rows(key, sorted(due, key=self._rank), memory, watermark)
            wake = self.wake_at(memory)
        wakes = [wake, min(firsts.values(), default=None), min((r[self.time] for r in few), default=None)]
        timer = self._wake([w for w in wakes if w is not None], timer, watermark)
        self._keep(firsts, few, memory, timer, before, waits)
        yield from self._rows(out, False)

    def _wake(self, wakes: list[int], timer: int | None, watermark: int) -> int | None:
        """The timer that a key waits for; one that is registered and still ahead is not registered again."""
        if not wakes:
            return None
        # Timers expire below the watermark, and a row is due as soon as the watermark is its time.
        at = -(-(min(wakes) + SHIFT_US) // 1000) - 1
        if at != timer or at * 1000 < watermark + SHIFT_US:
            self.handle.registerTimer(at)
        return at

    def _keep(self, firsts: dict, few: list, memory: list, timer: int | None, before: bytes | None, waits: bool) -> None:
        packed = _pack((firsts, few, memory, timer))
        if firsts or few:
            if not waits or packed != before:
                self.waiting.update((packed,))
            return
        if waits:
            self.waiting.clear()
        if memory:
            if waits or packed != before:
                self.resting.update((packed,))
        elif waits or before:
            self.resting.clear()

    def _bucket(self, bucket: int) -> list[tuple]:
        return [pickle.loads(r) for r in self.pending.getValue((bucket,))[0]]

    def _rows(self, out: list[tuple], late: bool) -> Iterator[Row]:
        names = self.emitted_schema().names
        at = self.output_schema.names.index(TIME) if self.chained else 0
        for values in out:
            extra = [late] if self.late_rows else []
            extra += [_EPOCH + timedelta(microseconds=values[at] + SHIFT_US)] if self.chained else []
            yield _flat(names, (*values, *extra))


def _watermark(timer_values) -> int:
    """The watermark in microseconds of event time. Before there is one the engine reports 0."""
    millis = timer_values.getCurrentWatermarkInMs()
    return millis * 1000 - SHIFT_US if millis > 0 else NO_WATERMARK


def _packed(added: dict[int, list[tuple]], held: dict[int, int]) -> dict[int, list[tuple]]:
    """New buckets that follow one another in few larger ones, each under the number of its first; those held already stay."""
    out, open_bucket = {}, None
    for bucket in sorted(added):
        if bucket in held:
            out[bucket] = added[bucket]
        elif open_bucket is not None and len(out[open_bucket]) + len(added[bucket]) <= PACKED_ROWS:
            out[open_bucket] = out[open_bucket] + added[bucket]
        else:
            open_bucket, out[bucket] = bucket, added[bucket]
    return out


class _Flat(Row):
    """A row without rows inside, which need not be looked for when it is written."""

    def asDict(self, recursive: bool = False) -> dict:
        return dict(zip(self.__fields__, self, strict=True))


def _flat(names: list[str], values: tuple) -> Row:
    row = tuple.__new__(_Flat, values)
    row.__fields__ = names
    return row


def _pack(value: tuple) -> bytes:
    return pickle.dumps(value, 5)


def in_order(stream: DataFrame, key: str, processor: InOrder, *, late_rows: bool = False, chained: bool = False) -> DataFrame:
    """Run a processor per key; ``stream`` needs a watermark and the time column.

    ``late_rows`` adds a boolean ``late`` and rows that came too late; ``chained`` adds ``event_ts``,
    the event time that a further stateful operator sees (``retimed``).
    """
    if late_rows and chained:
        raise ValueError("late rows can't be sent to a further stateful operator")
    processor.late_rows, processor.chained = late_rows, chained
    if late_rows:
        stream = stream.select(*processor.input_schema.names)
    return stream.groupBy(key).transformWithState(
        statefulProcessor=processor,
        outputStructType=processor.emitted_schema(),
        outputMode="append",
        timeMode="eventTime",
        eventTimeColumnName=EVENT_TS if chained else "",
    )


def timed(df: DataFrame, delay: str, ts: str = "ts", beats: DataFrame | None = None) -> DataFrame:
    """Event time as a number, so that state is free of time zones, and ``ts`` shifted, with a watermark.

    A row without a time has no place in the order and is left out; ``untimed`` gives those rows.
    ``beats`` is a stream of times, as ``ts``, up to which the source is complete apart from ``delay``: they
    move its watermark while it has no rows, and nothing else.
    """
    if beats is not None:
        told = beats.select(F.col("ts").alias(ts), F.lit(True).alias(BEAT))
        df = df.withColumn(BEAT, F.lit(False)).unionByName(told, allowMissingColumns=True)
    known = df.filter(F.col(ts).isNotNull()).withColumn(TIME, F.unix_micros(ts))
    return known.withColumn(ts, F.timestamp_micros(F.col(TIME) + SHIFT_US)).withWatermark(ts, delay)


def retimed(chained: DataFrame, ts: str = "ts") -> DataFrame:
    """The output of a chained operator as ``timed`` would give it: the watermark goes on with it."""
    return chained.drop(ts).withColumnRenamed(EVENT_TS, ts)


def clock(spark: SparkSession, idle_seconds: int, beats_per_second: int = 1) -> DataFrame:
    """Heartbeats for a source whose event time follows the clock: after ``idle_seconds`` without rows it stalls nothing."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", beats_per_second).option("numPartitions", 1).load()
    return rate.select((F.col("timestamp") - F.make_dt_interval(secs=F.lit(idle_seconds))).alias("ts"))


def untimed(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows that the ordered operators leave out, for a reject output."""
    return df.filter(F.col(ts).isNull())


def state_schema(df: DataFrame, ts: str = "ts") -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields if f.name != ts])
