"""Cutting hot keys into time slices.

A window or merge partitioned by key runs each key in one task. A key that holds
a large share of the rows is cut at quantiles of its own event time, and operators
partition by (key, slice) instead, carrying a bounded amount of state over each cut.
Ordinary keys stay whole, in slice 0.

Sizes are bounded by construction: a key is hot only above 1/16384 of all rows, so
there are at most 16,384 hot keys and, all together, a few times as many cuts however
large the data is; one key may hold them all. That is what makes the driver-side list
and the broadcast below safe. NULL is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.scalar import event_micros

MAX_SHARE = 16384
#: Cuts are looked up in steps of so many.
STEP = 128
DEFAULT_ROWS_PER_SLICE = 2_000_000
SLICE = "_slice"


@dataclass(frozen=True)
class Slices:
    """Time cuts (microseconds) per hot key."""

    key: str
    cuts: DataFrame

    def hot_rows(self, df: DataFrame) -> DataFrame:
        hot = self.cuts.select(F.col(self.key).alias("_hot"))
        return df.join(F.broadcast(hot), F.col(self.key).eqNullSafe(F.col("_hot")), "left_semi")

    def assign(self, df: DataFrame, ts: str) -> DataFrame:
        """Add the slice number: how many of the key's cuts are at or before ``ts``."""
        at = event_micros(F.col(ts))
        heads = F.transform(
            F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / STEP).cast("int")), lambda n: F.get("_cuts", n * STEP)
        )
        cuts = self.cuts.filter(F.size("_cuts") > 0).select(F.col(self.key).alias("_hot"), "_cuts", heads.alias("_heads"))
        whole = F.size(F.filter("_heads", lambda head: head <= at))
        step = F.slice("_cuts", (whole - 1) * STEP + 1, F.lit(STEP))
        passed = F.when(whole > 0, (whole - 1) * STEP + F.size(F.filter(step, lambda cut: cut <= at)))
        return (
            df.join(F.broadcast(cuts), F.col(self.key).eqNullSafe(F.col("_hot")), "left")
            .withColumn(SLICE, F.coalesce(passed, F.lit(0)))
            .drop("_hot", "_cuts", "_heads")
        )


def hot_slices(
    df: DataFrame, key: str = "asset_id", ts: str = "ts", rows_per_slice: int | None = None
) -> Slices | None:
    """Measure the key distribution; None when no key needs cutting.

    One pass over the key column (map-side combined). Only if a key is hot does a
    second pass read its timestamps, into mergeable quantile sketches.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total, most = counts.agg(F.sum("n"), F.max("n")).first()
    limit = max(rows_per_slice or DEFAULT_ROWS_PER_SLICE, -(-(total or 0) // MAX_SHARE))
    if (most or 0) <= limit:
        return None
    hot = {row[key]: row["n"] for row in counts.filter(F.col("n") > limit).collect()}

    spark = df.sparkSession
    key_type = df.schema[key].dataType
    pieces = max(-(-n // limit) for n in hot.values())
    strides = spark.createDataFrame(
        [(k, max(1, pieces // min(pieces, -(-n // limit)))) for k, n in hot.items()],
        T.StructType([T.StructField(key, key_type), T.StructField("stride", T.IntegerType())]),
    )
    fractions = F.array(*[F.lit(i / pieces) for i in range(1, pieces)])
    quantiles = (
        df.select(key, event_micros(F.col(ts)).alias("us"))
        .join(F.broadcast(strides.withColumnRenamed(key, "_hot")), F.col(key).eqNullSafe(F.col("_hot")))
        .groupBy(key, "stride")
        .agg(F.percentile_approx("us", fractions, F.lit(4 * MAX_SHARE)).alias("q"))
    )
    kept = F.filter("q", lambda _, i: (i + 1) % F.col("stride") == 0)
    cuts = quantiles.select(key, F.array_sort(F.array_distinct(kept)).alias("_cuts")).collect()
    schema = T.StructType(
        [T.StructField(key, key_type), T.StructField("_cuts", T.ArrayType(T.LongType()))]
    )
    return Slices(key, spark.createDataFrame([tuple(r) for r in cuts], schema))


def slice_key(key: str, slices: Slices | None) -> list[str]:
    return [key] if slices is None else [key, SLICE]


def desc_all(columns: list[str]) -> list[Column]:
    return [F.col(c).desc() for c in columns]
