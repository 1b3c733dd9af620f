"""Small helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import new_stage


def whole_text(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Whole texts make long rows, so fewer of them go to a Python worker at a time than the engine's default.
ROWS_PER_BATCH = 2000


def short_batches(spark: SparkSession) -> None:
    """Bound the texts that a Python worker holds at once; queries and pipeline stages call it first."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def stage(df: DataFrame) -> DataFrame:
    """Write a table that is read more than once to the shared folder, and read it from there."""
    path = new_stage(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
