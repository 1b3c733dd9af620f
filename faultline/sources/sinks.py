"""Sinks: append tables, keyed tables with upserts and deletes, fan-out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from faultline import schemas
from faultline.operators.latest import DELETE, OP_COLUMN, latest_per_key


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_stream(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)


def distribute(df: DataFrame, key: str, buckets: int = 6) -> DataFrame:
    """Rows of a key together, for table layouts read by key."""
    return df.repartition(buckets, key)


# JSON would otherwise keep milliseconds only.
FORMAT_OPTIONS = {"json": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}}


class KeyedTable:
    """Latest row per key over a log of change batches.

    A batch costs only its own rows: it is reduced to one change per key and written
    to its own folder, which a replay overwrites. Reading merges the log; compacting
    folds it into a base so that reads stay cheap. A row with ``_op = 'delete'``
    hides its key, and stays in the log so that an older change cannot revive it.
    """

    def __init__(
        self, path: str, schema: T.StructType, key: str | Sequence[str], order: Sequence[str], file_format: str = "parquet"
    ):
        self.path, self.key, self.order, self.file_format = path, key, tuple(order), file_format
        self.schema = T.StructType([*schema.fields, T.StructField(OP_COLUMN, T.StringType())])
        self.options = FORMAT_OPTIONS.get(file_format, {})

    def _batches(self, spark: SparkSession, part: str) -> list[int]:
        """Numbers of the complete batches in a folder."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.path}/{part}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        paths = [status.getPath() for status in fs.listStatus(folder)]
        complete = [p.getName() for p in paths if fs.exists(hadoop.Path(p, "_SUCCESS"))]
        return sorted(int(name.removeprefix("batch=")) for name in complete if name.startswith("batch="))

    def _changes(self, spark: SparkSession) -> tuple[DataFrame, int]:
        bases, log = self._batches(spark, "base"), self._batches(spark, "log")
        base = bases[-1] if bases else -1
        paths = [f"{self.path}/base/batch={base}"] if bases else []
        paths += [f"{self.path}/log/batch={n}" for n in log if n > base]
        if not paths:
            return spark.createDataFrame([], self.schema), -1
        changes = spark.read.schema(self.schema).format(self.file_format).options(**self.options).load(paths)
        return latest_per_key(changes, self.key, self.order), max(base, *log, -1)

    def apply(self, changes: DataFrame, batch: int) -> None:
        if OP_COLUMN not in changes.columns:
            changes = changes.withColumn(OP_COLUMN, F.lit(None).cast("string"))
        latest = latest_per_key(changes.select(*self.schema.names), self.key, self.order)
        self._write(latest, f"log/batch={batch}")

    def read(self, spark: SparkSession) -> DataFrame:
        latest, _ = self._changes(spark)
        return latest.filter(F.coalesce(F.col(OP_COLUMN) != DELETE, F.lit(True))).drop(OP_COLUMN)

    def compact(self, spark: SparkSession) -> None:
        """Fold the log into a new base, and drop what the base before this one had folded already.

        A base is written once, under the number of its newest batch, and never read by its own
        writing. The last base but one and its log stay for readers that began before.
        """
        bases, log = self._batches(spark, "base"), self._batches(spark, "log")
        if not log or bases and log[-1] <= bases[-1]:
            return
        latest, newest = self._changes(spark)
        self._write(latest, f"base/batch={newest}")
        if bases:
            self._drop(spark, [f"base/batch={n}" for n in bases[:-1]] + [f"log/batch={n}" for n in log if n <= bases[-1]])

    def _drop(self, spark: SparkSession, folders: list[str]) -> None:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in folders:
            folder = hadoop.Path(f"{self.path}/{name}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def _write(self, df: DataFrame, folder: str) -> None:
        df.write.mode("overwrite").format(self.file_format).options(**self.options).save(f"{self.path}/{folder}")


def work_order_documents(path: str) -> KeyedTable:
    """Work orders as JSON documents, one an incident; the newest replaces the rest.

    The displayed ``work_order_id`` holds eight characters of the incident id, which many
    orders may share, so documents are told apart by the whole ``incident_id``.
    """
    return KeyedTable(path, schemas.WORK_ORDERS, "incident_id", ("ts", "work_order_id"), "json")


def upsert_stream(
    changes: DataFrame, table: KeyedTable, checkpoint: str, compact_every: int = 100
) -> DataStreamWriter:
    """Keep a table current from a change stream, folding its log now and then."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table.apply(batch, batch_id)
        if batch_id % compact_every == compact_every - 1:
            table.compact(batch.sparkSession)

    return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def fan_out(
    stream: DataFrame, outputs: Mapping[str, Callable[[DataFrame], DataFrame]], base: str, checkpoint: str
) -> DataStreamWriter:
    """Several tables from one view, computed once per batch.

    Each batch goes to its own folder under ``<base>/<name>``, overwritten on replay.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, view in outputs.items():
                view(batch).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def read_fanned(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}").drop("batch")


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Process what is there, then stop."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query
