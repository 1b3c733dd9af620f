"""Costs that must not grow with the tables: what a task holds, parses and reads."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas
from faultline.functions.hashing import hash_batch, sparse_hash_vector
from faultline.functions.text import slices_of_chars
from faultline.operators import quality, retrieval
from faultline.sources.readers import spread
from faultline.streaming.ordered import PACKED_ROWS, SHIFT_US, TIME
from faultline.streaming.rolling import RollingScore
from test_streaming import Stub


def test_texts_are_held_a_bounded_number_of_characters_at_a_time():
    texts = pa.array(["ab", None, "abcdefgh", "", "x", "yy", "é" * 30])
    parts = [part.to_pylist() for part in slices_of_chars(texts, 4)]
    assert [t for part in parts for t in part] == texts.to_pylist()
    assert [len(part) for part in parts] == [2, 3, 1, 1]  # a text longer than the limit ends its part, with those that add nothing to it
    assert [part.to_pylist() for part in slices_of_chars(pa.array([], pa.string()), 4)] == [[]]


def test_embedding_in_parts_equals_embedding_at_once(spark):
    texts = [None, "", *[f"alpha beta{n % 7} " * (n % 50) for n in range(900)], "word " * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    rows = df.select("id", sparse_hash_vector(F.col("text"), 64).alias("v")).orderBy("id").collect()
    offsets, at, w = hash_batch(texts, 64)
    for row, start, end in zip(rows, offsets, offsets[1:], strict=False):
        assert (row.v.at, row.v.w) == (at[start:end].tolist(), w[start:end].tolist())


def test_search_holds_only_the_asked_positions_of_sparse_rows():
    queries = np.zeros((2, 3072))
    queries[0, [5, 70]], queries[1, 70] = (1, -2), 3
    asked = np.flatnonzero(queries.any(axis=0))
    vectors = [([5, 9], [2, 1]), ([70], [-1]), ([], []), ([1, 2], [1, 1])]
    batch = pa.RecordBatch.from_pydict({
        "_at": pa.array([v[0] for v in vectors], pa.list_(pa.int32())), "_values": pa.array([v[1] for v in vectors], pa.list_(pa.int32())),
    })
    block, norms, _ = retrieval._scanned(batch, 3072, asked)
    assert block.shape == (4, 2)
    assert (queries[:, asked] @ block.T).tolist() == [[2, 2, 0, 0], [0, -3, 0, 0]]
    assert np.allclose(norms, [5**0.5, 1, 1, 2**0.5])


def test_a_filter_on_the_reason_parses_a_payload_once(spark):
    checked = quality.check_contract(spark.createDataFrame([("{}",)], "payload string"), "payload", schemas.TELEMETRY)
    plan = checked.filter(F.col("reason").isNull()).drop("reason")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") + plan.count("JsonToStructs") + plan.count("jsontostructs") <= 1
    assert checked.collect()[0].reason == "missing:asset_id"


def test_rows_of_one_row_group_are_spread_though_the_file_has_many_splits(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= 8
        sizes = [r.n for r in spread(scan).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 8 and max(sizes) <= 1000
        half = str(tmp_path / "half")  # as many row groups as half of the cores, but more splits than cores
        spark.range(4000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).repartition(4).write.parquet(half)
        scan = spark.read.parquet(half)
        assert scan.rdd.getNumPartitions() >= 8 and spread(scan).groupBy(F.spark_partition_id()).count().count() >= 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_sparse_waiting_rows_lie_in_few_buckets_and_leave_in_order():
    schema = T.StructType([T.StructField("asset_id", T.StringType()), T.StructField("event_id", T.LongType()), T.StructField("temp_c", T.DoubleType()), T.StructField(TIME, T.LongType())])
    processor = RollingScore(schema, "temp_c", "z", 30, [TIME, "event_id"])
    stub = Stub()
    processor.init(stub)
    hour = 3_600_000_000
    named = Row("temp_c", TIME, "asset_id", "event_id")  # not in the order of the schema

    def give(rows, watermark):
        stub.watermark, stub.written = (watermark + SHIFT_US) // 1000, 0
        return [r.event_id for r in processor.handleInputRows(("A",), iter(named(1.0, at, "A", n) for n, at in rows), stub)]

    assert give([(n, n * hour) for n in range(1, 641)], 0) == []
    assert len(stub.states["pending"]) <= 640 // PACKED_ROWS + 1
    assert give([(1000, 10 * hour + 1), (1001, 64 * hour + 1)], hour) == [1] and stub.written <= PACKED_ROWS + 2
    assert give([], 20 * hour) == [*range(2, 11), 1000, *range(11, 21)] and stub.written <= PACKED_ROWS
    assert give([], 700 * hour) == [*range(21, 65), 1001, *range(65, 641)]
    assert not stub.states["pending"] and stub.states["buckets"].held is None
