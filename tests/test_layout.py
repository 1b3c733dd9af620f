"""Tables laid out by key, and the latest row without a sort."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import latest
from faultline.operators.latest import latest_by_hash, latest_per_key, upsert
from faultline.plans import domain
from faultline.sources.layout import read_partitions, store_by_key, upsert_partitions

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("seq", T.LongType()), T.StructField("v", T.StringType())])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def changes(spark, seed, n=400, keys=40):
    rng = random.Random(seed)
    held = [
        (rng.choice([None, *(f"k{m}" for m in range(keys))]), rng.choice([None, 10, 20, 30]), rng.choice([None, -5, 0, 2**62]), f"v{m}", rng.choice([None, None, "delete"]))
        for m in range(n)
    ]
    return spark.createDataFrame(held, "k string, s long, seq long, v string, _op string").select("k", F.timestamp_seconds("s").alias("ts"), "seq", "v", "_op")


def test_stored_tables_join_and_aggregate_without_an_exchange(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        readings = store_by_key(domain.telemetry(spark, sf).select("asset_id", "event_id", "temp_c"), "asset_id")
        fleet = store_by_key(domain.fleet(spark, sf).select("asset_id", "region"), "asset_id")
        joined = fleet.join(readings, "asset_id").groupBy("asset_id", "region").agg(F.count("*").alias("n"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: 6 out of 6" in plan
        assert joined.agg(F.sum("n")).first()[0] == domain.telemetry(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_batch_of_one_key_rewrites_one_folder(spark, tmp_path):
    path = f"{tmp_path}/t"
    table = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 100).alias("k"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.lit("v").alias("v"))
    assert upsert_partitions(table, path, SCHEMA, "k", ("ts", "seq"), parts=8) == 8

    def files():
        return {str(f): f.stat().st_mtime_ns for part in tmp_path.glob("t/_part=*") for f in part.glob("*.parquet")}

    old = files()
    one = spark.createDataFrame([("k7", 5000, 1, "new")], "k string, s long, seq long, v string").select("k", F.timestamp_seconds("s").alias("ts"), "seq", "v")
    assert upsert_partitions(one, path, SCHEMA, "k", ("ts", "seq"), parts=8) == 1
    kept = {n for n, at in files().items() if old.get(n) == at}
    assert len(old) - len(kept) == 1 and len(list(tmp_path.glob("t/_part=*"))) == 8
    read = read_partitions(spark, path, SCHEMA)
    assert read.count() == 100 and [r.v for r in read.filter("k = 'k7'").collect()] == ["new"]
    assert upsert_partitions(one.limit(0), path, SCHEMA, "k", ("ts", "seq"), parts=8) == 0


def test_batches_in_any_order_and_replays_equal_one_upsert(spark, tmp_path):
    whole = changes(spark, 3).withColumn("seq", F.monotonically_increasing_id())  # no ties
    parts = [whole.filter(F.pmod(F.xxhash64("v"), F.lit(3)) == n) for n in range(3)]
    for n in (2, 0, 1, 0, 2):
        upsert_partitions(parts[n], f"{tmp_path}/t", SCHEMA, "k", ("ts", "seq"), parts=4)
    want = upsert(whole, "k", ("ts", "seq"))
    assert rows(read_partitions(spark, f"{tmp_path}/t", SCHEMA), "k", "ts", "seq", "v") == rows(want, "k", "ts", "seq", "v")
    assert read_partitions(spark, f"{tmp_path}/none", SCHEMA).count() == 0


@pytest.mark.parametrize("order", [["ts"], ["ts", "seq"], ["seq", "ts"], ["seq", "other", "ts"]])
def test_latest_by_hash_equals_the_sorted_form(spark, order):
    table = changes(spark, 5).withColumn("other", F.col("seq") % 7)
    tied = latest_per_key(table.groupBy("k", *order).agg(F.max("v").alias("v")), "k", order)
    got = latest_by_hash(table, "k", order)
    assert rows(got, "k", *order) == rows(tied, "k", *order)
    assert got.count() == table.select("k").distinct().count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bSort(Aggregate| \[)", plan)


def test_latest_by_hash_beyond_its_bounds(spark, monkeypatch):
    table = changes(spark, 6)
    want = rows(latest_per_key(table, "k", ["v"]), "k", "v")
    assert rows(latest_by_hash(table, "k", ["v"]), "k", "v") == want  # an order that can't be packed
    whole = table.withColumn("seq", F.monotonically_increasing_id())
    exact = rows(latest_per_key(whole, "k", ["ts", "seq"]), "k", "v")
    assert rows(latest_by_hash(whole, "k", ["ts", "seq"]), "k", "v") == exact
    monkeypatch.setattr(latest, "BROADCAST_KEYS", 3)
    assert rows(latest_by_hash(whole, "k", ["ts", "seq"]), "k", "v") == exact
    assert latest_by_hash(whole.limit(0), "k", ["ts", "seq"]).count() == 0
