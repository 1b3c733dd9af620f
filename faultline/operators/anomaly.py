"""Rolling z-score over a row-count frame per asset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.operators.asof import VersionTable, asof_join_all
from faultline.operators.slicing import SLICE, Slices, desc_all, slice_key

_HALO = "_halo"


def rolling_zscore(
    telemetry: DataFrame,
    *,
    value: str = "temp_c",
    key: str = "asset_id",
    order: Sequence[str] = ("ts", "event_id"),
    preceding: int = K.ROLLING_PRECEDING_ROWS,
    slices: Slices | None = None,
    output: str = "temp_zscore",
) -> DataFrame:
    """Deviation from the mean of the last ``preceding`` + 1 rows, in population std units.

    A constant frame, so also the first row, scores 0.0. With ``slices`` a hot key
    is computed slice by slice, each starting with a copy of the rows just before it.
    """
    order = list(order)
    rows = telemetry
    if slices is not None:
        main = slices.assign(telemetry, order[0]).withColumn(_HALO, F.lit(False))
        halo = halo_rows(telemetry, value, key, order, preceding, slices)
        rows = main.unionByName(halo.withColumn(_HALO, F.lit(True)), allowMissingColumns=True)

    rows = rows.withColumns(_moments(Window.partitionBy(*slice_key(key, slices)).orderBy(*order), value, preceding))
    if slices is not None:
        rows = rows.filter(~F.col(_HALO)).drop(_HALO, SLICE)
    return _deviation(rows, value, output)


def _moments(in_order: WindowSpec, value: str, preceding: int) -> dict[str, Column]:
    frame = in_order.rowsBetween(-preceding, 0)
    return {"_mean": F.avg(value).over(frame), "_std": F.stddev_pop(value).over(frame)}


def _deviation(rows: DataFrame, value: str, output: str) -> DataFrame:
    score = F.when(F.col("_std") > 0, (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(F.lit(0.0))
    return rows.withColumn(output, score).drop("_mean", "_std")


def rolling_zscore_with_versions(
    telemetry: DataFrame,
    tables: Sequence[VersionTable],
    *,
    value: str = "temp_c",
    key: str = "asset_id",
    order: Sequence[str] = ("ts", "event_id"),
    preceding: int = K.ROLLING_PRECEDING_ROWS,
    slices: Slices | None = None,
    output: str = "temp_zscore",
) -> DataFrame:
    """``rolling_zscore`` and the versions in force at each reading, in one exchange and one sort of telemetry."""
    order = list(order)
    halo = None if slices is None else halo_rows(telemetry, value, key, order, preceding, slices)
    rows = asof_join_all(
        telemetry, tables, key=key, order=order, slices=slices, halo=halo, frames=lambda spec: _moments(spec, value, preceding)
    )
    return _deviation(rows, value, output)


def halo_rows(
    telemetry: DataFrame, value: str, key: str, order: list[str], preceding: int, slices: Slices
) -> DataFrame:
    """For each slice after a key's first, copies of the ``preceding`` rows before its start.

    At most ``preceding`` rows per slice leave the scan of the hot keys (the rank
    filter is applied before the shuffle), so everything after it is small.
    """
    needed = telemetry.select(key, *order, value)
    sliced = slices.assign(slices.hot_rows(needed), order[0])
    last_first = Window.partitionBy(key, SLICE).orderBy(*desc_all(order))
    tails = sliced.withColumn("_back", F.row_number().over(last_first)).filter(F.col("_back") <= preceding)
    in_order = Window.partitionBy(key).orderBy(*order)
    first_of_slice = F.lag(SLICE).over(in_order).isNull() | (F.lag(SLICE).over(in_order) != F.col(SLICE))
    tails = tails.withColumns({"_pos": F.row_number().over(in_order), "_first": first_of_slice})
    # At most 1,001 starts per key; a row serves every later slice it is close enough to.
    start = F.when(F.col("_first"), F.struct(F.col("_pos").alias("pos"), F.col(SLICE).alias("slice")))
    tails = tails.withColumn("_starts", F.collect_list(start).over(Window.partitionBy(key)))
    position = F.col("_pos")
    served = F.filter("_starts", lambda s: (s.pos > position) & (s.pos - preceding <= position))
    return tails.withColumn(SLICE, F.explode(F.transform(served, lambda s: s["slice"]))).select(
        key, *order, value, SLICE
    )
