"""Session settings and the one durable place to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "16g", app: str = "faultline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started.

    The archive is made beside the driver, which serves it to the executors as it
    does any ``addPyFile``. Not needed where the package is installed on every node.
    """
    context = spark.sparkContext
    if getattr(context, "_ships_faultline", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="faultline-package-")
    context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", root.parent, root.name))
    context._ships_faultline = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; invent one only for a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="faultline-")
    context.setCheckpointDir(shared)


_scopes = threading.local()


def new_stage(spark: SparkSession) -> str:
    """A new folder in the shared one, which the enclosing ``stage_scope`` removes, or else ``drop_stages``."""
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    path = f"{context.getCheckpointDir()}/stage-{uuid.uuid4()}"
    open_scopes = getattr(_scopes, "held", [])
    if open_scopes:
        open_scopes[-1].append(path)
    else:
        context._faultline_stages = [*getattr(context, "_faultline_stages", []), path]
    return path


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the stages that this thread makes inside. Write what must outlive them before."""
    _scopes.held = [*getattr(_scopes, "held", []), []]
    try:
        yield
    finally:
        made = _scopes.held.pop()
        _remove(spark, made)


def _remove(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    for path in paths:
        folder = hadoop.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write a stage that several consumers read, so none of them recomputes it.

    A columnar table in the shared folder: it outlives an executor, later readers
    take only the columns they need, and its known size guides their joins.
    """
    path = new_stage(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Remove the stages of this session; call it when their results are written. Returns how many there were."""
    context = spark.sparkContext
    paths, context._faultline_stages = getattr(context, "_faultline_stages", []), []
    _remove(spark, paths)
    return len(paths)
