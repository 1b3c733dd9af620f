"""Streaming forms: replaying the rows in several files gives the batch result."""

from __future__ import annotations

import random
from datetime import UTC

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas
from faultline.operators import planning, recovery
from faultline.operators.anomaly import rolling_zscore
from faultline.operators.asof import asof_join
from faultline.operators.scoring import SPEC_COLUMNS
from faultline.plans import domain, pipeline, registry
from faultline.sources.readers import stream_files
from faultline.sources.sinks import KeyedTable, append_stream, read_fanned, run_available, upsert_stream, work_order_documents
from faultline.streaming import tables
from faultline.streaming.asof import asof_join_stream
from faultline.streaming.ordered import BUCKET_US, SHIFT_US, TIME, use_rocksdb
from faultline.streaming.recovery import recovery_stream
from faultline.streaming.rolling import RollingScore, rolling_zscore_stream, zscore
from faultline.streaming.scoring import Versions, versioned_score_stream

DELAY = "2 days"
EPOCH = 1_700_000_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.fixture(scope="module")
def telemetry(spark, sf):
    return domain.telemetry(spark, sf)


def in_files(df, path, parts, ts="ts", sentinel=True):
    """Write rows in rough time order as ``parts`` files, then one far-future row that moves the watermark."""
    bounds = df.select(F.unix_micros(ts).alias("us")).agg(F.min("us"), F.max("us")).first()
    width = (bounds[1] - bounds[0]) // parts + 1
    # A day of disorder: rows of one file are not older than the next file's by more than the delay.
    jitter = F.pmod(F.xxhash64(ts), F.lit(86_400_000_000))
    part = F.least(F.floor((F.unix_micros(ts) - bounds[0] + jitter) / width), F.lit(parts - 1))
    rows = df.withColumn("_part", part)
    for n in range(parts):
        rows.filter(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(path)
    if sentinel:
        future = df.limit(1).withColumn(ts, F.lit("2030-01-01 00:00:00").cast("timestamp"))
        future = future.withColumn("asset_id", F.lit("SENTINEL")) if "asset_id" in df.columns else future
        future.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def as_stream(spark, df, path, parts=2, ts="ts", sentinel=True):
    schema = in_files(df, path, parts, ts, sentinel)
    return stream_files(spark, path, schema, max_files_per_trigger=1)


def collected(spark, stream, tmp_path, name):
    run_available(append_stream(stream, f"{tmp_path}/{name}", f"{tmp_path}/{name}_cp"))
    return spark.read.parquet(f"{tmp_path}/{name}").filter("asset_id <> 'SENTINEL'")


def same(a, b):
    columns = sorted(a.columns)
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_zscore_of_constant_and_short_frames():
    assert zscore([5.1] * 31) == 0.0
    assert zscore([58.0]) == 0.0
    assert zscore([58.0, 58.0, 58.0, 102.0]) == pytest.approx(3**0.5)
    assert zscore([1.0, None]) == 0.0


def test_rolling_stream_equals_batch(spark, telemetry, tmp_path):
    rows = telemetry.select("event_id", "asset_id", "ts", "temp_c")
    stream = as_stream(spark, rows, f"{tmp_path}/in")
    got = collected(spark, rolling_zscore_stream(stream, delay=DELAY), tmp_path, "z")
    want = rolling_zscore(rows)
    rounded = F.round("temp_zscore", 6).alias("z")
    assert got.count() == rows.count()
    assert same(got.select("event_id", rounded), want.select("event_id", rounded))


def test_asof_stream_equals_batch(spark, sf, telemetry, tmp_path):
    rows = telemetry.select("event_id", "asset_id", "ts", "temp_c")
    versions = domain.spec_versions(spark, sf).select("asset_id", "valid_ts", *SPEC_COLUMNS)
    left = as_stream(spark, rows, f"{tmp_path}/left")
    right = as_stream(spark, versions, f"{tmp_path}/right", parts=2, ts="valid_ts")
    got = collected(spark, asof_join_stream(left, right, payload=list(SPEC_COLUMNS), delay="40 days"), tmp_path, "asof")
    want = asof_join(rows, versions, payload=SPEC_COLUMNS)
    assert same(got, want.select(*got.columns))


def test_recovery_stream_equals_batch(spark, sf, telemetry, tmp_path):
    scored = pipeline.score(telemetry, domain.spec_versions(spark, sf), domain.registry(spark, sf))
    enriched = scored.select("asset_id", "ts", "severity", "event_id")
    actions = (
        enriched.filter(F.col("severity") == "critical")
        .withColumns({"incident_id": F.col("event_id").cast("string"), "action_type": F.lit("isolate")})
        .select("asset_id", "incident_id", "action_type", "ts")
    )
    window = 6 * 3600
    a = as_stream(spark, actions, f"{tmp_path}/a")
    e = as_stream(spark, enriched.drop("event_id"), f"{tmp_path}/e")
    got = collected(spark, recovery_stream(a, e, delay=DELAY, window_seconds=window), tmp_path, "r")
    want = recovery.first_recovery(actions, enriched, window_seconds=window)
    assert want.count() > 0
    assert same(got, want.select(*got.columns))


def test_recovery_stream_reports_unresolved(spark, tmp_path):
    actions = spark.createDataFrame(
        [("A", "i1", "isolate", 0), ("A", "i2", "isolate", 5000)], "asset_id string, incident_id string, action_type string, s int"
    ).select("asset_id", "incident_id", "action_type", F.timestamp_seconds(F.col("s") + EPOCH).alias("ts"))
    enriched = spark.createDataFrame([("A", "info", 600)], "asset_id string, severity string, s int").select(
        "asset_id", "severity", F.timestamp_seconds(F.col("s") + EPOCH).alias("ts")
    )
    a, e = as_stream(spark, actions, f"{tmp_path}/a", parts=1), as_stream(spark, enriched, f"{tmp_path}/e", parts=1)
    got = collected(spark, recovery_stream(a, e, delay="1 hour", report_unresolved=True), tmp_path, "r")
    found = {r.incident_id: r.rec_time for r in got.collect()}
    assert found["i1"].replace(tzinfo=UTC).timestamp() == EPOCH + 600
    assert found["i2"] is None


def test_detect_fans_out_once(spark, sf, telemetry, tmp_path):
    specs, registry = domain.spec_versions(spark, sf), domain.registry(spark, sf)
    stream = as_stream(spark, telemetry, f"{tmp_path}/in", parts=2)
    graded = tables.score_stream(stream, specs, registry, delay=DELAY)
    run_available(tables.detect(graded, f"{tmp_path}/out", f"{tmp_path}/cp"))
    want = pipeline.score(telemetry, specs, registry)
    live = F.col("asset_id") != "SENTINEL"
    enriched = read_fanned(spark, f"{tmp_path}/out", "enriched").filter(live)
    assert enriched.columns == schemas.ENRICHED.names
    assert enriched.count() == telemetry.count()
    got = read_fanned(spark, f"{tmp_path}/out", "incidents").filter(live)
    raised = pipeline.incidents.build_incidents(want)
    key = ["incident_id", "severity", "signal", "reasoning_needed"]
    assert same(got.select(*key), raised.select(*key))


def test_latest_crew_stream_with_replay_and_delete(spark, tmp_path):
    schema = "crew_id string, ts timestamp, status string, _op string"

    def rows(*items):
        return spark.createDataFrame([(c, s, st, op) for c, s, st, op in items], "crew_id string, s int, status string, _op string").select(
            "crew_id", F.timestamp_seconds("s").alias("ts"), "status", "_op"
        )

    first = rows(("C1", 1, "available", None), ("C1", 3, "enroute", None), ("C2", 2, "available", None))
    second = rows(("C1", 2, "on_site", None), ("C2", 4, "", "delete"), ("C3", 1, "available", None))
    third = rows(("C2", 3, "available", None))
    table_schema = first.drop("_op").schema
    table = KeyedTable(f"{tmp_path}/crew", table_schema, "crew_id", ("ts",))
    for part in (first, second, third):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_files(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
    run_available(upsert_stream(stream, table, f"{tmp_path}/cp"))
    want = {("C1", "enroute"), ("C3", "available")}
    assert {(r.crew_id, r.status) for r in table.read(spark).collect()} == want
    table.apply(second, 1)  # a replay
    assert {(r.crew_id, r.status) for r in table.read(spark).collect()} == want
    table.compact(spark)
    assert {(r.crew_id, r.status) for r in table.read(spark).collect()} == want
    table.apply(rows(("C1", 9, "off_shift", None)), 7)
    assert {(r.crew_id, r.status) for r in table.read(spark).collect()} == {("C1", "off_shift"), ("C3", "available")}


def shown_diagnoses(spark, sf):
    ids = F.format_string("%08d-x", F.col("event_id"))
    return domain.telemetry(spark, sf).select(
        "asset_id", ids.alias("incident_id"), "asset_type", "region",
        F.when(F.col("event_id") % 2 == 0, "critical").otherwise("warning").alias("severity"),
        F.lit("temp_c").alias("signal"), F.col("temp_c").alias("value"), F.lit(0.5).alias("fault_score"),
        F.lit(0.0).alias("zscore"), F.lit("").alias("tie_assets"), F.lit("cause").alias("dx_root_cause"),
        F.when(F.col("event_id") % 3 == 0, "isolate").otherwise("monitor").alias("dx_recommended_action"),
        F.lit("why").alias("dx_rationale"), F.lit(0.9).alias("dx_confidence"),
        F.lit(None).cast(schemas.CITATIONS_TYPE).alias("dx_citations"), F.lit("m").alias("dx_method"),
        F.col("ts").alias("diagnosed_ts"),
    )


def test_plan_stream_matches_batch_and_replays(spark, sf, tmp_path):
    registry = domain.registry(spark, sf)
    pings = domain.crew_pings(spark, sf)
    crews = KeyedTable(f"{tmp_path}/crews", pings.schema, "crew_id", domain.CREW_ORDER)
    crews.apply(pings, 0)
    diagnosed = shown_diagnoses(spark, sf)
    stream = as_stream(spark, diagnosed, f"{tmp_path}/in", parts=2, ts="diagnosed_ts", sentinel=False)
    out = {
        "planned": KeyedTable(f"{tmp_path}/planned", schemas.PLANNED, "incident_id", ("ts",)),
        "work_orders": work_order_documents(f"{tmp_path}/orders"),
    }
    run_available(tables.plan_stream(stream, registry, crews, out, f"{tmp_path}/cp"))
    want = pipeline.plan(diagnosed, registry, planning.crew_latest(pings, domain.CREW_ORDER))
    assert same(out["planned"].read(spark), want)
    assert same(out["work_orders"].read(spark), planning.work_orders(want, F.col("ts")))


def test_duplicates_within_watermark_pass_once(spark, tmp_path):
    rows = spark.range(4).select(
        F.concat(F.lit("i"), (F.col("id") % 2).cast("string")).alias("incident_id"),
        F.lit("A").alias("asset_id"), F.timestamp_seconds(F.col("id")).alias("ts"),
    )
    stream = as_stream(spark, rows, f"{tmp_path}/in", parts=2)
    got = collected(spark, tables.unique_incidents(stream, "1 hour"), tmp_path, "once")
    assert sorted(r.incident_id for r in got.select("incident_id").collect()) == ["i0", "i1"]


def test_late_rows_go_aside_by_the_operators_own_mark(spark, tmp_path):
    def rows(*secs):
        held = spark.createDataFrame([(s, float(s % 7)) for s in secs], "s long, temp_c double")
        return held.select(F.lit("A").alias("asset_id"), F.timestamp_seconds(F.col("s") + EPOCH).alias("ts"), F.col("s").alias("event_id"), "temp_c")

    parts = ((100, 200), (150, 20, 300), (140, 139, 250, 30), (2_000_000,), (2_000_001, 1_999_941))
    for part in parts:
        rows(*part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_files(spark, f"{tmp_path}/in", rows(1).schema, max_files_per_trigger=1)
    flagged = rolling_zscore_stream(stream, delay="60 seconds", late_rows=True)
    run_available(tables.split_late(flagged, f"{tmp_path}/out", f"{tmp_path}/cp"))
    late = read_fanned(spark, f"{tmp_path}/out", "late")
    on_time = read_fanned(spark, f"{tmp_path}/out", "on_time")
    assert sorted(r.event_id for r in late.collect()) == [20, 30, 139, 140]
    assert {r.temp_zscore for r in late.collect()} == {None}
    # Rows of the last minute still wait for the watermark.
    given = sorted(r.event_id for r in on_time.collect())
    assert given == sorted({s for part in parts for s in part} - {20, 30, 139, 140, 2_000_000, 2_000_001})
    want = rolling_zscore(rows(*given))
    assert {r.event_id: r.temp_zscore for r in on_time.collect()} == pytest.approx({r.event_id: r.temp_zscore for r in want.collect()})


def version_streams(spark, sf, tmp_path, lag):
    """Specs and registry as streams whose files come ``lag`` seconds of event time late."""
    out = []
    for name, df in (("specs", domain.spec_versions(spark, sf)), ("registry", domain.registry(spark, sf))):
        columns = [c for c in ("asset_id", "valid_ts", *SPEC_COLUMNS, "tie_assets") if c in df.columns]
        late = df.select(*columns).withColumn("_at", F.col("valid_ts") + F.make_dt_interval(secs=F.lit(lag)))
        bounds = late.agg(F.min("valid_ts"), F.max("_at")).first()
        cut = bounds[0] + (bounds[1] - bounds[0]) / 2
        for part in (late.filter(F.col("_at") < cut), late.filter(F.col("_at") >= cut)):
            part.drop("_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        future = late.limit(1).withColumns({"valid_ts": F.lit("2030-01-01").cast("timestamp"), "asset_id": F.lit("SENTINEL")})
        future.drop("_at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        out.append(stream_files(spark, f"{tmp_path}/{name}", df.select(*columns).schema, max_files_per_trigger=1))
    return out


def test_scored_stream_equals_batch_when_versions_come_after_their_readings(spark, sf, telemetry, tmp_path):
    specs, registry = version_streams(spark, sf, tmp_path, 9 * 86_400)
    stream = as_stream(spark, telemetry, f"{tmp_path}/in", parts=3)
    graded = tables.score_stream(stream, specs, registry, delay="12 days")
    exchanges = graded._jdf.queryExecution().analyzed().toString().count("TransformWithStateInPySpark")
    assert exchanges == 1
    got = collected(spark, graded, tmp_path, "graded")
    want = pipeline.score(telemetry, domain.spec_versions(spark, sf), domain.registry(spark, sf))
    columns = ["event_id", "severity", "tie_assets", *SPEC_COLUMNS, *[F.round(c, 6).alias(c) for c in ("temp_zscore", "fault_score")]]
    assert got.count() == telemetry.count()
    assert same(got.select(*columns), want.select(*columns))


def test_resolutions_of_chained_operators_equal_the_batch_and_a_replay_changes_nothing(spark, sf, telemetry, tmp_path):
    scored = pipeline.score(telemetry, domain.spec_versions(spark, sf), domain.registry(spark, sf))
    actions = scored.filter(F.col("severity") != "info").select(
        "asset_id", F.col("event_id").cast("string").alias("incident_id"), F.lit("throttle_load").alias("action_type"), "ts"
    )
    window = 6 * 3600
    specs, registry = version_streams(spark, sf, tmp_path, 9 * 86_400)
    stream, acted = as_stream(spark, telemetry, f"{tmp_path}/in", parts=3), as_stream(spark, actions, f"{tmp_path}/acted", parts=2)
    table = KeyedTable(f"{tmp_path}/resolved", schemas.RESOLVED, "incident_id", ("resolved_ts",))
    writer = tables.resolve_stream(stream, specs, registry, acted, table, f"{tmp_path}/cp", delay="12 days", window_seconds=window)
    run_available(writer)
    want = recovery.resolve(recovery.first_recovery(actions, scored, window_seconds=window))
    live = table.read(spark).filter("asset_id <> 'SENTINEL'")
    assert want.count() > 50 and same(live, want)
    log = sorted(table._batches(spark, "log"))
    for batch in log:
        changes = spark.read.schema(table.schema).parquet(f"{tmp_path}/resolved/log/batch={batch}").collect()
        table.apply(spark.createDataFrame(changes, table.schema), batch)
    assert sorted(table._batches(spark, "log")) == log
    assert same(table.read(spark).filter("asset_id <> 'SENTINEL'"), want)


def test_a_deleted_version_ends_and_ties_are_broken(spark, tmp_path):
    readings = spark.createDataFrame([("A", s, s, 1.0) for s in range(0, 100, 10)], "asset_id string, s long, event_id long, temp_c double")
    readings = readings.select("asset_id", F.timestamp_seconds(F.col("s") + EPOCH).alias("ts"), "event_id", "temp_c")
    changes = spark.createDataFrame(
        [("A", 20, 1, 1.0, None), ("A", 20, 2, 2.0, None), ("A", 50, 3, None, "delete"), ("A", 70, 4, 3.0, None), (None, 0, 5, 9.0, None)],
        "asset_id string, s long, version long, limit double, _op string",
    ).select("asset_id", F.timestamp_seconds(F.col("s") + EPOCH).alias("valid_ts"), "version", "limit", "_op")
    kinds = []
    for n in range(2):
        kinds.append(Versions(as_stream(spark, changes.withColumnRenamed("limit", f"limit_{n}"), f"{tmp_path}/v{n}", parts=1, ts="valid_ts"), [f"limit_{n}"], tie=("version",)))
    stream = as_stream(spark, readings, f"{tmp_path}/in", parts=1)
    got = collected(spark, versioned_score_stream(stream, kinds, delay="1 hour"), tmp_path, "out")
    want = {s: 2.0 if 20 <= s < 50 else 3.0 if s >= 70 else None for s in range(0, 100, 10)}
    assert {r.event_id: (r.limit_0, r.limit_1) for r in got.collect()} == {s: (v, v) for s, v in want.items()}


def test_heartbeats_keep_a_silent_source_from_stalling(spark, tmp_path):
    def version(s, limit, asset="A"):
        return spark.createDataFrame([(asset, limit)], "asset_id string, limit double").withColumn("valid_ts", F.timestamp_seconds(F.lit(s + EPOCH)))

    def readings(*secs):
        held = spark.createDataFrame([(s, 1.0) for s in secs], "event_id long, temp_c double")
        return held.select(F.lit("A").alias("asset_id"), F.timestamp_seconds(F.col("event_id") + EPOCH).alias("ts"), "event_id", "temp_c")

    def beat(s):
        return spark.range(1).select(F.timestamp_seconds(F.lit(s + EPOCH)).alias("ts"))

    def write(df, name):
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run(with_beats):
        streams = {n: stream_files(spark, f"{tmp_path}/{n}", df.schema, max_files_per_trigger=1) for n, df in schemas_of.items()}
        kind = Versions(streams["versions"], ["limit"], beats=streams["beats"] if with_beats else None)
        out = versioned_score_stream(streams["in"], [kind], delay="100 seconds")
        name = "beaten" if with_beats else "stalled"
        run_available(append_stream(out, f"{tmp_path}/{name}", f"{tmp_path}/{name}_cp"))
        return {r.event_id: r.limit for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}

    schemas_of = {"versions": version(0, 1.0), "in": readings(0), "beats": beat(0)}
    write(version(0, 1.0), "versions")
    for secs in ((10, 20), (500, 510), (1000, 1010)):
        write(readings(*secs), "in")
    for s in (400, 900, 1000):
        write(beat(s), "beats")
    assert run(False) == {}  # the versions stay at 0 and hold up everything
    assert run(True) == {10: 1.0, 20: 1.0, 500: 1.0, 510: 1.0}
    # The silent source speaks again, of a time inside the delay: its version reaches the readings that wait.
    write(version(950, 2.0), "versions")
    write(readings(2000), "in")
    write(beat(2000), "beats")
    assert run(True) == {10: 1.0, 20: 1.0, 500: 1.0, 510: 1.0, 1000: 2.0, 1010: 2.0}


class Stub:
    """State in memory that counts how many rows are written."""

    def __init__(self):
        self.states, self.timers, self.written = {}, [], 0

    def getMapState(self, name, *_):
        return self.states.setdefault(name, StubMap(self))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, StubValue(self))

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class StubValue:
    def __init__(self, stub):
        self.stub, self.held = stub, None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    put = update

    def clear(self):
        self.held = None


class StubMap(dict):
    def __init__(self, stub):
        super().__init__()
        self.stub = stub

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.stub.written += len(value[0])
        self[key] = value

    def removeKey(self, key):
        self.pop(key, None)


def test_one_row_among_many_waiting_ones_writes_only_its_bucket():
    schema = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("temp_c", T.DoubleType()), T.StructField(TIME, T.LongType())])
    processor = RollingScore(schema, "temp_c", "z", 30, [TIME, "event_id"])
    stub = Stub()
    processor.init(stub)
    second = 1_000_000

    def give(rows, watermark_s):
        stub.watermark = (watermark_s * second + SHIFT_US) // 1000
        stub.written = 0
        named = Row("asset_id", "event_id", "temp_c", TIME)
        return list(processor.handleInputRows(("A",), iter(named("A", n, 1.0, at) for n, at in rows), stub))

    many = [(n, (1000 + n) * second) for n in range(100_000)]
    assert give(many, 500) == [] and stub.written == 100_000
    bucket = BUCKET_US // second
    assert give([(-1, 50_000 * second)], 600) == [] and stub.written <= bucket + 1
    out = give([(-2, 90_000 * second)], 1009)
    assert [r.event_id for r in out] == list(range(10)) and stub.written <= 2 * bucket + 1
    rest = give([], 200_000)
    assert len(rest) == 99_992 and stub.written == 0 and [r[TIME] for r in rest] == sorted(r[TIME] for r in rest)
    assert not stub.states["pending"] and stub.states["buckets"].held is None


class Counted(Stub):
    """As ``Stub``, and counts every call to the state."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Counting(StubMap(self), self))

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Counting(StubValue(self), self))

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        super().registerTimer(at)


class Counting:
    def __init__(self, state, stub):
        self.state, self.stub = state, stub

    def __getattr__(self, name):
        self.stub.calls += 1
        return getattr(self.state, name)


def test_a_key_with_few_waiting_rows_costs_a_batch_few_calls_and_keeps_its_order():
    schema = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("temp_c", T.DoubleType()), T.StructField(TIME, T.LongType())])
    processor = RollingScore(schema, "temp_c", "z", 30, [TIME, "event_id"])
    stub = Counted()
    processor.init(stub)
    day = 86_400 * 1_000_000
    named = Row("asset_id", "event_id", "temp_c", TIME)
    rng = random.Random(5)
    times = [rng.randrange(40 * day) for _ in range(120)]
    frame, want = [], []
    for n in sorted(range(120), key=lambda n: (times[n], n)):
        frame = [*frame, float(n % 7)][-31:]
        want.append((n, zscore(frame)))
    got = []
    for step in range(45):
        stub.watermark, stub.calls = ((step - 8) * day + SHIFT_US) // 1000, 0
        rows = [named("A", n, float(n % 7), at) for n, at in enumerate(times) if step * day <= at < (step + 1) * day]
        got += processor.handleInputRows(("A",), iter(rows), stub)
        assert stub.calls <= 5
        stub.calls, again = 0, list(processor.handleExpiredTimer(("A",), stub, None))
        assert not again and stub.calls <= 2
    stub.watermark = (100 * day + SHIFT_US) // 1000
    got += processor.handleExpiredTimer(("A",), stub, None)
    assert [(r.event_id, r.z) for r in got] == want


def test_plan_stream_leaves_no_stages(spark, sf, tmp_path):
    from faultline.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext.getCheckpointDir())
    fs = shared.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def stages():
        return {f.getPath().getName() for f in fs.listStatus(shared) if f.getPath().getName().startswith("stage-")}

    registry = domain.registry(spark, sf)
    crews = KeyedTable(f"{tmp_path}/crews", domain.crew_pings(spark, sf).schema, "crew_id", domain.CREW_ORDER)
    crews.apply(domain.crew_pings(spark, sf), 0)
    versions = KeyedTable(f"{tmp_path}/versions", registry.schema, ("asset_id", "valid_ts"), ("valid_ts",))
    versions.apply(registry, 0)
    diagnosed = shown_diagnoses(spark, sf).limit(200)
    for n in range(3):
        diagnosed.filter(F.pmod(F.xxhash64("incident_id"), F.lit(3)) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_files(spark, f"{tmp_path}/in", diagnosed.schema, max_files_per_trigger=1)
    out = {"planned": KeyedTable(f"{tmp_path}/planned", schemas.PLANNED, "incident_id", ("ts",))}
    before = stages()
    run_available(tables.plan_stream(stream, versions, crews, out, f"{tmp_path}/cp"))
    assert out["planned"].read(spark).count() == diagnosed.count()
    assert stages() == before


def test_zscore_of_a_missing_value_is_null_where_there_is_spread():
    assert zscore([1.0, 3.0, None]) is None
    assert zscore([None]) == 0.0
    assert zscore([None, 2.0, 4.0]) == pytest.approx(1.0)


def test_early_missing_and_untimed_values_match_the_batch(spark, tmp_path):
    rows = [
        ("A", "1969-05-01 00:00:00", 1, 1.0), ("A", "1969-05-02 00:00:00", 2, 3.0), ("A", "1975-01-01 00:00:00", 3, None),
        ("A", "1975-01-02 00:00:00", 4, 5.0), ("A", None, 5, 9.0),
    ]
    telemetry = spark.createDataFrame(rows, "asset_id string, t string, event_id long, temp_c double")
    telemetry = telemetry.select("asset_id", F.to_timestamp("t").alias("ts"), "event_id", "temp_c")
    future = telemetry.limit(1).select(F.lit("SENTINEL").alias("asset_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), "event_id", "temp_c")
    for part in (telemetry, future):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = stream_files(spark, f"{tmp_path}/in", telemetry.schema, max_files_per_trigger=1)
    scored = collected(spark, rolling_zscore_stream(stream, delay=DELAY), tmp_path, "early")
    want = rolling_zscore(telemetry.filter("ts is not null"))
    assert {r.event_id: r.temp_zscore for r in scored.collect()} == pytest.approx({r.event_id: r.temp_zscore for r in want.collect()}, nan_ok=True)


def test_orders_that_share_eight_characters_are_kept_apart(spark, tmp_path):
    plans = [(f"12345678-{n}", "WO-12345678", "A", "P1", None, 2, "d", "open") for n in range(3)]
    orders = spark.createDataFrame(plans, "incident_id string, work_order_id string, asset_id string, priority string, crew_id string, sla_hours int, description string, status string")
    orders = orders.withColumn("ts", F.timestamp_seconds(F.lit(EPOCH))).select(*schemas.WORK_ORDERS.names)
    table = work_order_documents(f"{tmp_path}/orders")
    table.apply(orders, 0)
    table.apply(orders.limit(1).withColumn("status", F.lit("closed")).withColumn("ts", F.timestamp_seconds(F.lit(EPOCH + 1))), 1)
    assert sorted(r.status for r in table.read(spark).collect()) == ["closed", "open", "open"]


def test_compaction_keeps_the_listing_short_and_survives_a_replay(spark, tmp_path):
    table = KeyedTable(f"{tmp_path}/t", spark.range(1).selectExpr("id", "id as v").schema, "id", ("v",))
    for n in range(12):
        table.apply(spark.createDataFrame([(n % 3, n)], "id long, v long"), n)
        if n % 3 == 2:
            table.compact(spark)
            table.compact(spark)
            table.apply(spark.createDataFrame([(n % 3, n)], "id long, v long"), n)
    assert {r.id: r.v for r in table.read(spark).collect()} == {0: 9, 1: 10, 2: 11}
    assert len(table._batches(spark, "log")) <= 6 and len(table._batches(spark, "base")) <= 2


def test_stages_are_dropped(spark):
    from faultline.session import drop_stages, materialize

    drop_stages(spark)
    stored = materialize(spark.range(3))
    assert stored.count() == 3
    assert drop_stages(spark) == 1 and drop_stages(spark) == 0


def test_a_replayed_part_is_dealt_over_all_cores(spark):
    rows = spark.range(3000).selectExpr("id", "timestamp_seconds(1704067200 + id * 60) AS ts", "cast(id % 7 AS string) AS asset_id")
    folder, stream = registry._replayed(spark, rows, trickle=True)
    sizes = spark.read.parquet(f"{folder}/in").groupBy(F.input_file_name()).count().collect()
    files = spark.sparkContext.defaultParallelism
    assert len(sizes) == 3 * files + 1 and max(r["count"] for r in sizes) < 2 * 1000 / files
    assert registry._streamed(spark, folder, stream).count() == 3000
