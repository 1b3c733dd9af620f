"""Sources. Files by default; Kafka where its connector is on the classpath."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import schemas

CONTRACTS = {
    "telemetry": schemas.TELEMETRY,
    "crew_location": schemas.CREW_LOCATION,
    "weather": schemas.WEATHER,
    "assets": schemas.ASSETS,
    "asset_specs": schemas.ASSET_SPECS,
}


def read_table(spark: SparkSession, path: str, contract: T.StructType, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(contract).format(file_format).load(path)


def stream_files(
    spark: SparkSession,
    path: str,
    contract: T.StructType,
    file_format: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Files appended to a folder as a stream; ``ts`` is the event time."""
    reader = spark.readStream.schema(contract).format(file_format)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_kafka(
    spark: SparkSession, servers: str, topic: str, starting: str = "latest", options: Mapping[str, str] | None = None
) -> DataFrame:
    """A topic as ``key``, ``value``, ``timestamp``; decode ``value`` with :mod:`faultline.sources.decode`.

    Needs the public Kafka connector package on the session's classpath.
    """
    if starting not in ("earliest", "latest"):
        raise ValueError(f"starting must be earliest or latest, not {starting!r}")
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**(options or {}))
        .load()
        .select(F.col("key").cast("string").alias("key"), "value", "timestamp")
    )


def version_history(documents: DataFrame, valid_ts: str = "valid_ts") -> DataFrame:
    """A reference feed as version rows: a copied or changed document is valid from its time on.

    A document without a time is part of the initial copy and valid from the start.
    ``_op = 'delete'`` ends a key.
    """
    start = F.lit("1970-01-01 00:00:00").cast("timestamp")
    if valid_ts not in documents.columns:
        return documents.withColumn(valid_ts, start)
    return documents.withColumn(valid_ts, F.coalesce(F.col(valid_ts), start))


def read_manuals(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """Text files whole, one row each, as ``(source, text)`` with line ends normalised."""
    files = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    text = F.regexp_replace("value", "\r\n?", "\n")
    return files.select(F.col("_metadata.file_name").alias("source"), text.alias("text"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows; an empty source is an error."""
    if df.isEmpty():
        raise LookupError("no rows received")
    return df.limit(n)


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of a table whose rows are stored in too few places for that.

    For scans feeding heavy per-row work. A file's row groups are never divided, so many splits may
    have no rows: a job that reads no column counts those of each. An evenly stored table is left alone.
    """
    cores, splits = scan.sparkSession.sparkContext.defaultParallelism, scan.rdd.getNumPartitions()
    if splits >= cores:
        held = scan.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
        if (held[1] or 0) * cores * 2 <= 3 * (held[0] or 0):
            return scan
    return scan.repartition(max(cores, splits))
