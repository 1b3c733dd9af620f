"""Tables laid out by key: joins without an exchange, upserts that rewrite only what they touch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.latest import DELETE, OP_COLUMN, latest_per_key
from faultline.session import materialize, new_stage, stage_scope
from faultline.sources.sinks import distribute

BUCKETS = 6
PART = "_part"


def store_by_key(df: DataFrame, key: str, *, buckets: int = BUCKETS, path: str | None = None, name: str | None = None) -> DataFrame:
    """Write a table bucketed and sorted by its key, and read it from the catalog.

    Two such tables with equally many buckets join on the key, and aggregate by it, without an exchange.
    Rows are dealt by key before the write, so a bucket is one file. Choose ``buckets`` for the largest table
    that joins; a key that holds most rows is read by one task in such a join, so keep that one unbucketed.
    """
    name = name or f"stored_{uuid.uuid4().hex}"
    dealt = distribute(df, key, buckets)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path or new_stage(df.sparkSession)).saveAsTable(name)
    return df.sparkSession.table(name)


def _part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias(PART)


def upsert_partitions(changes: DataFrame, path: str, schema: T.StructType, key: str | Sequence[str], order: Sequence[str], *, parts: int) -> int:
    """Apply changes to a table whose rows lie in ``parts`` folders by hash of their key. Returns how many folders were rewritten.

    Only the folders of keys that changed are read and written, by one dynamic partition overwrite. The
    greatest ``order`` of a key wins, so a replay writes the same rows; a row with ``_op = 'delete'`` hides its key
    and stays, so that an older change can't bring it back. ``parts`` is the table's for good.
    """
    spark = changes.sparkSession
    keys = [key] if isinstance(key, str) else list(key)
    if OP_COLUMN not in changes.columns:
        changes = changes.withColumn(OP_COLUMN, F.lit(None).cast("string"))
    stored = T.StructType([*schema.fields, T.StructField(OP_COLUMN, T.StringType()), T.StructField(PART, T.IntegerType())])
    with stage_scope(spark):
        new = materialize(latest_per_key(changes.select(*schema.names, OP_COLUMN), keys, order).withColumn(PART, _part_of(keys, parts)))
        touched = sorted(r[PART] for r in new.select(PART).distinct().collect())  # at most ``parts`` rows
        if not touched:
            return 0
        both = _rows(spark, path, stored).filter(F.col(PART).isin(touched)).unionByName(new)
        # Written aside first: a folder can't be overwritten while it is read.
        merged = materialize(latest_per_key(both, keys, order))
        dealt = merged.repartition(len(touched), PART)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return len(touched)


def read_partitions(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current rows of such a table."""
    stored = T.StructType([*schema.fields, T.StructField(OP_COLUMN, T.StringType()), T.StructField(PART, T.IntegerType())])
    rows = _rows(spark, path, stored)
    return rows.filter(F.coalesce(F.col(OP_COLUMN) != DELETE, F.lit(True))).select(*schema.names)


def _rows(spark: SparkSession, path: str, stored: T.StructType) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(stored).parquet(path) if there else spark.createDataFrame([], stored)
