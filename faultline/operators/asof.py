"""As-of joins: for each left row the nearest right row in time, never a pair per version."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from faultline.functions.scalar import event_micros
from faultline.operators.slicing import SLICE, Slices, slice_key

BROADCAST_ROWS = 200_000
BROADCAST_VERSIONS_PER_KEY = 64
APART_PARTS = 1024
OP_COLUMN = "_op"
DELETE = "delete"

_SIDE, _TIME, _HIT = "_side", "_time", "_hit"
_APART, _HALO = "_apart", "_halo"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    payload: Sequence[str],
    key: str = "asset_id",
    left_ts: str = "ts",
    right_ts: str = "valid_ts",
    tie: Sequence[str] = (),
    direction: str = "backward",
    strategy: str = "auto",
    slices: Slices | None = None,
) -> DataFrame:
    """LEFT as-of join adding ``payload`` columns, NULL where nothing qualifies.

    ``backward`` takes the newest right row at or before the left time, ``forward``
    the earliest at or after it. Among right rows with equal time the largest
    ``tie`` wins. A right row with ``_op = 'delete'`` ends its key: later left rows
    are unmatched until a new version arrives. A NULL key or time on either side
    matches nothing.

    ``interval`` broadcasts validity intervals and moves no left row; ``merge``
    sorts both sides together, linear in their rows for any number of versions.
    ``auto`` measures the right side and picks ``interval`` only when it is small.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction must be backward or forward, not {direction!r}")
    if strategy == "auto":
        strategy = asof_strategy(right, key) if direction == "backward" else "merge"
    if strategy == "interval":
        if direction != "backward":
            raise ValueError("interval joins look backward only")
        return _interval_join(left, right, payload, key, left_ts, right_ts, tie)
    return _merge_join(left, right, payload, key, left_ts, right_ts, tie, direction, slices)


def asof_strategies(rights: Sequence[DataFrame], key: str = "asset_id") -> list[str]:
    """For each right side ``interval`` if it is proven small, in rows and per key, else ``merge``.

    All are measured in one job.
    """
    parts = [
        right.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.lit(i).alias("i"), F.sum("n").alias("rows"), F.max("n").alias("most"))
        for i, right in enumerate(rights)
    ]
    sizes = {r.i: (r.rows or 0, r.most or 0) for r in reduce(DataFrame.unionByName, parts).collect()}
    small = [sizes[i][0] <= BROADCAST_ROWS and sizes[i][1] <= BROADCAST_VERSIONS_PER_KEY for i in range(len(parts))]
    return ["interval" if s else "merge" for s in small]


def asof_strategy(right: DataFrame, key: str = "asset_id") -> str:
    return asof_strategies([right], key)[0]


def _alive(right: DataFrame) -> Column:
    if OP_COLUMN not in right.columns:
        return F.lit(True)
    return F.coalesce(F.col(OP_COLUMN) != DELETE, F.lit(True))


def _placed(right: DataFrame, key: str, right_ts: str) -> DataFrame:
    """Versions that can match at all."""
    return right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull())


def _interval_join(left, right, payload, key, left_ts, right_ts, tie) -> DataFrame:
    versions = Window.partitionBy(key).orderBy(right_ts, *tie)
    intervals = (
        _placed(right, key, right_ts).withColumn("_until", F.lead(right_ts).over(versions))
        .filter(_alive(right))
        .select(
            F.col(key).alias("_key"),
            F.col(right_ts).alias("_from"),
            "_until",
            *[F.col(c).alias(f"_p_{c}") for c in payload],
        )
    )
    at = F.col(left_ts)
    valid = (
        (F.col(key) == F.col("_key"))
        & (at >= F.col("_from"))
        & (F.col("_until").isNull() | (at < F.col("_until")))
    )
    joined = left.join(F.broadcast(intervals), valid, "left")
    return joined.select(*[F.col(c) for c in left.columns], *[F.col(f"_p_{c}").alias(c) for c in payload])


def _merge_join(left, right, payload, key, left_ts, right_ts, tie, direction, slices) -> DataFrame:
    backward = direction == "backward"
    hit = F.struct(_alive(right).alias("alive"), *payload)
    versions = _placed(right, key, right_ts).select(
        key, F.col(right_ts).alias(_TIME), F.lit(0).alias(_SIDE), hit.alias(_HIT), *_tie_columns(tie)
    )
    # Rows that can't match stand apart from all versions, spread over many partitions.
    nowhere = F.col(key).isNull() | F.col(left_ts).isNull()
    apart = F.when(nowhere, F.pmod(F.xxhash64(*[c for c in left.columns if _hashable(left, c)]), F.lit(APART_PARTS)))
    rows = left.withColumns({_TIME: F.col(left_ts), _SIDE: F.lit(1), _APART: apart})
    if slices is not None:
        rows, versions = slices.assign(rows, _TIME), slices.assign(versions, _TIME)
    merged = rows.unionByName(versions, allowMissingColumns=True)

    # Right rows sort first at equal time in either direction, so equality matches.
    # Looking forward is a running value over descending time: a frame reaching to
    # the partition's end would be recomputed for every row.
    time = F.col(_TIME).asc() if backward else F.col(_TIME).desc()
    running = (
        Window.partitionBy(*slice_key(key, slices), _APART)
        .orderBy(time, _SIDE, *[f"_tie_{i}" for i in range(len(tie))])
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    merged = merged.withColumn("_match", F.last(_HIT, ignorenulls=True).over(running)).filter(F.col(_SIDE) == 1)
    if slices is not None:
        carried = _carry_over(versions, slices, len(tie), backward)
        merged = merged.join(F.broadcast(carried), [key, SLICE], "left").withColumn(
            "_match", F.coalesce("_match", "_carried")
        )
    found = F.when(F.col("_match.alive") & F.col(_APART).isNull(), F.col("_match"))
    return merged.select(*[F.col(c) for c in left.columns], *[found.getField(c).alias(c) for c in payload])


@dataclass(frozen=True)
class VersionTable:
    """Versions that a reading may take: what they add, from when each holds, and which wins at equal times."""

    rows: DataFrame
    payload: Sequence[str]
    valid_ts: str = "valid_ts"
    tie: Sequence[str] = ()


Frames = Callable[[WindowSpec], dict[str, Column]]


def asof_join_all(
    left: DataFrame,
    tables: Sequence[VersionTable],
    *,
    key: str = "asset_id",
    order: Sequence[str] = ("ts",),
    slices: Slices | None = None,
    frames: Frames | None = None,
    halo: DataFrame | None = None,
) -> DataFrame:
    """LEFT backward as-of joins to several version tables in one exchange and one sort.

    All sides are put together once; a running value for each table gives the version in force.
    ``order`` is the left rows' own order, its first column their time. ``frames`` adds columns
    over the left rows alone, from the unbounded window of a key in that order: once the versions
    are filtered out, it has the partitioning and the order of the running values already. With
    ``slices``, ``halo`` holds rows that begin a slice's frames and are not given back.
    Semantics otherwise are those of ``asof_join``.
    """
    time, reading = order[0], len(tables)
    rows = left.withColumns({_TIME: F.col(time), _SIDE: F.lit(reading), _HALO: F.lit(False)})
    if halo is not None:
        rows = rows.unionByName(halo.withColumns({_TIME: F.col(time), _SIDE: F.lit(reading), _HALO: F.lit(True)}), allowMissingColumns=True)
    if slices is not None:
        # Rows of the halo have been given the slice that they begin.
        own = slices.assign(rows.filter(~F.col(_HALO)).drop(SLICE), _TIME)
        rows = own if halo is None else own.unionByName(rows.filter(_HALO), allowMissingColumns=True)
    placed, ties = [], []
    for n, table in enumerate(tables):
        named = [f"_tie_{n}_{i}" for i in range(len(table.tie))]
        hit = F.struct(_alive(table.rows).alias("alive"), *table.payload).alias(f"{_HIT}_{n}")
        versions = _placed(table.rows, key, table.valid_ts).select(
            key, F.col(table.valid_ts).alias(_TIME), F.lit(n).alias(_SIDE), hit, *[F.col(c).alias(t) for c, t in zip(table.tie, named, strict=True)]
        )
        versions = versions if slices is None else slices.assign(versions, _TIME)
        placed.append(versions)
        ties += named
        rows = rows.unionByName(versions, allowMissingColumns=True)

    in_order = Window.partitionBy(*slice_key(key, slices)).orderBy(_TIME, _SIDE, *ties, *order[1:])
    running = in_order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_match_{n}": F.last(f"{_HIT}_{n}", ignorenulls=True).over(running) for n in range(reading)})
    rows = rows.filter(F.col(_SIDE) == reading)
    added = frames(in_order) if frames is not None else {}
    rows = rows.withColumns(added).filter(~F.col(_HALO))
    out = [F.col(c) for c in (*left.columns, *added)]
    for n, table in enumerate(tables):
        match = F.col(f"_match_{n}")
        if slices is not None:
            named = [c for c in ties if c.startswith(f"_tie_{n}_")]
            renamed = placed[n].withColumnsRenamed({f"{_HIT}_{n}": _HIT} | {c: f"_tie_{i}" for i, c in enumerate(named)})
            carried = _carry_over(renamed, slices, len(named), True).withColumnsRenamed({"_carried": f"_carried_{n}", key: "_of", SLICE: "_in"})
            of = F.col(key).eqNullSafe(F.col("_of")) & (F.col(SLICE) == F.col("_in"))
            rows = rows.join(F.broadcast(carried), of, "left").drop("_of", "_in")
            match = F.coalesce(match, F.col(f"_carried_{n}"))
        # A NULL key or time has nothing in force: no version has one, and without a time a row stands first.
        found = F.when(match.alive & F.col(key).isNotNull() & F.col(_TIME).isNotNull(), match)
        out += [found.getField(c).alias(c) for c in table.payload]
    return rows.select(*out)


def _hashable(df: DataFrame, column: str) -> bool:
    return "map<" not in df.schema[column].dataType.simpleString()


def _tie_columns(tie: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"_tie_{i}") for i, c in enumerate(tie)]


def _carry_over(versions: DataFrame, slices: Slices, ties: int, backward: bool) -> DataFrame:
    """The match entering each slice of a hot key: one row per slice, so bounded like the cuts."""
    key = slices.key
    micros = event_micros(F.col(_TIME))
    rank = F.struct(micros if backward else -micros, *[F.col(f"_tie_{i}") for i in range(ties)])
    edges = slices.hot_rows(versions).groupBy(key, SLICE).agg(F.max_by(_HIT, rank).alias("_edge"))
    every = slices.cuts.select(key, F.explode(F.sequence(F.lit(0), F.size("_cuts"))).alias(SLICE))
    outward = F.col(SLICE).asc() if backward else F.col(SLICE).desc()
    before = Window.partitionBy(key).orderBy(outward).rowsBetween(Window.unboundedPreceding, -1)
    return every.join(edges, [key, SLICE], "left").select(
        key, SLICE, F.last("_edge", ignorenulls=True).over(before).alias("_carried")
    )
