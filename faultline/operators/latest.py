"""Latest row(s) per key, and upsert with tombstones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.slicing import desc_all
from faultline.session import materialize

OP_COLUMN = "_op"
DELETE = "delete"
SALTS = 64


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key.

    An aggregate, so each task sends one row per key whatever the key's share.
    """
    keys = [key] if isinstance(key, str) else list(key)
    newest = F.max_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select("_row.*")


#: Bits that a column of each fixed-width type needs in a packed order, one value being kept for NULL.
_BITS = {"timestamp": 59, "date": 33, "tinyint": 33, "smallint": 33, "int": 33, "bigint": 65}
PACKED_BITS = 125
BROADCAST_KEYS = 200_000
_YEAR_ONE_US = 62_135_596_800_000_000


def _packed_orders(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns as few numbers of 38 digits, the first deciding first; NULL is below any value."""
    kinds = dict(df.dtypes)
    wide, packed, used = "decimal(38,0)", [], PACKED_BITS + 1
    for column in order:
        bits = _BITS[kinds[column]]
        value = F.unix_micros(column) + _YEAR_ONE_US if kinds[column] == "timestamp" else F.unix_date(column) if kinds[column] == "date" else F.col(column)
        least = 0 if kinds[column] == "timestamp" else 2 ** (bits - 2)
        level = F.coalesce(value.cast("decimal(20,0)") + F.lit(str(least + 1)).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")).cast(wide)
        if used + bits > PACKED_BITS:
            packed.append(level)
            used = bits
        else:
            packed[-1] = ((packed[-1] * F.lit(str(2**bits)).cast("decimal(20,0)")).cast(wide) + level).cast(wide)
            used += bits
    return packed


def latest_by_hash(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """``latest_per_key`` without a sort, for a stored table with an order of times and whole numbers.

    The greatest packed order of each key comes from a hash aggregate; a join back finds its row, which
    rereads the table, so ``df`` should be a table and not a long computation. Keys up to ``BROADCAST_KEYS``
    are counted and broadcast; with more of them the sort of ``latest_per_key`` moves less. Of rows that tie
    in the whole order the one with the greatest hash is kept, and equal rows are one.
    """
    keys = [key] if isinstance(key, str) else list(key)
    kinds = dict(df.dtypes)
    if any(kinds[c] not in _BITS for c in order):
        return latest_per_key(df, key, order)
    rows = df
    for level in [*_packed_orders(df, order), F.xxhash64(*df.columns)]:
        ranked = rows.withColumn("_level", level)
        best = materialize(ranked.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.max("_level").alias("_best")))
        if best.count() > BROADCAST_KEYS:
            return latest_per_key(rows, key, order)
        same = F.col("_level") == F.col("_best")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        rows = ranked.join(F.broadcast(best), same, "left_semi").select(*df.columns)
    return rows.distinct()


def last_n_per_key(df: DataFrame, key: str, n: int, order: Sequence[str]) -> DataFrame:
    """The ``n`` greatest rows per key, as two rank filters.

    The first runs inside every task and then per (key, salt); a task uses a single
    salt, so it still sends at most ``n`` rows per key and no reducer gets them all.
    """
    newest = desc_all(list(order))
    salted = Window.partitionBy(key, "_salt").orderBy(*newest)
    final = Window.partitionBy(key).orderBy(*newest)
    return (
        df.withColumn("_salt", F.spark_partition_id() % SALTS)
        .withColumn("_rank", F.row_number().over(salted))
        .filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= n)
        .drop("_salt", "_rank")
    )


def upsert(
    changes: DataFrame, key: str, order: Sequence[str], current: DataFrame | None = None
) -> DataFrame:
    """Current state after applying a change log: latest row wins, deletes remove the key.

    ``current`` rows carry their own order columns, so an out-of-order or replayed
    change never overwrites a newer row. Deleted keys leave the result.
    """
    if OP_COLUMN not in changes.columns:
        changes = changes.withColumn(OP_COLUMN, F.lit("upsert"))
    if current is not None:
        changes = current.unionByName(changes, allowMissingColumns=True)
    latest = latest_per_key(changes, key, order)
    return latest.filter(F.coalesce(F.col(OP_COLUMN) != DELETE, F.lit(True))).drop(OP_COLUMN)
