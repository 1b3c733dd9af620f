"""Exact nearest-candidate join on a plane, through a quadtree that follows the candidates.

A square that holds all candidates is quartered until a quarter holds few of a bounded sample of them
(``SAMPLE``), so leaves are small where candidates are dense, however dense. A site meets, of the leaves of its
group, only those whose box can hold its nearest candidate: first the boxes, then the candidates of those leaves
are searched through a tree of boxes (``BoxTree``) in which a site descends, leaving out each box that is farther
than the farthest corner of another. No leaf, group or spot that holds many sites or candidates makes pairs of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import materialize

SAMPLE = 65_536
LEAF = 4096  # candidates, where the sample holds them all; else a 4096th of all at most, and some
LEAST_IN_SAMPLE = 16
DEPTH = 31
SITES = 16_384  # that a task takes for one leaf
FAN = 16
CHUNK = 2048


def squared_distance(ax: str, ay: str, bx: str, by: str) -> Column:
    dx, dy = F.col(ax) - F.col(bx), F.col(ay) - F.col(by)
    return dx * dx + dy * dy


def is_position(x: str, y: str) -> Column:
    """Both coordinates known and finite; NaN and infinity are no positions."""

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))

    return finite(x) & finite(y)


def _interleaved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cell numbers along the curve that finishes a quarter of a square before the next."""
    out = np.zeros(len(a), np.int64)
    for bit in range(DEPTH):
        out |= (a >> bit & 1) << 2 * bit + 1 | (b >> bit & 1) << 2 * bit
    return out


class Square:
    """The square that is quartered; ``cells`` numbers its smallest quarters."""

    def __init__(self, low_x: float, low_y: float, side: float) -> None:
        self.low_x, self.low_y, self.side = low_x, low_y, side

    def cells(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.side <= 0 or not math.isfinite(self.side):
            return np.zeros(len(x), np.int64)
        most = (1 << DEPTH) - 1
        a, b = (np.clip((v - low) / self.side * (most + 1), 0, most).astype(np.int64) for v, low in ((x, self.low_x), (y, self.low_y)))
        return _interleaved(a, b)


def quartered(cells: np.ndarray, most: int) -> np.ndarray:
    """First cells of the leaves: quarters are divided while they hold more than ``most`` of the given cells."""
    cells = np.sort(cells)
    starts, waiting = [], [(0, DEPTH, 0, len(cells))]
    while waiting:
        first, level, begin, end = waiting.pop()
        if end - begin <= most or level == 0:
            starts.append(first)
            continue
        size = 1 << 2 * (level - 1)
        edges = np.searchsorted(cells[begin:end], first + size * np.arange(1, 4)) + begin
        bounds = [begin, *edges.tolist(), end]
        waiting += [(first + size * n, level - 1, bounds[n], bounds[n + 1]) for n in range(4)]
    return np.sort(np.array(starts, np.int64))


class BoxTree:
    """Boxes, or points as boxes without extent, under boxes of ``FAN`` neighbours each, up to a single one."""

    def __init__(self, low_x: np.ndarray, low_y: np.ndarray, high_x: np.ndarray, high_y: np.ndarray) -> None:
        x, y = low_x / 2 + high_x / 2, low_y / 2 + high_y / 2
        side = max(np.ptp(x), np.ptp(y)) if len(x) else 0.0
        self.order = np.argsort(Square(x.min(), y.min(), side).cells(x, y), kind="stable") if len(x) else np.zeros(0, np.int64)
        self.levels = [tuple(v[self.order] for v in (low_x, low_y, high_x, high_y))]
        while len(self.levels[-1][0]) > FAN:
            at = np.arange(0, len(self.levels[-1][0]), FAN)
            below = self.levels[-1]
            self.levels.append(tuple(np.minimum.reduceat(v, at) for v in below[:2]) + tuple(np.maximum.reduceat(v, at) for v in below[2:]))
        self.compared = 0

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(site, box, squared distance) of every box that may hold the point nearest to a site; of points, the nearest ones."""
        parts = [self._chunk(x[at : at + CHUNK], y[at : at + CHUNK], at) for at in range(0, len(x), CHUNK)]
        return tuple(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0) for n in range(3))

    def _chunk(self, x: np.ndarray, y: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        top = len(self.levels[-1][0])
        site, box = np.repeat(np.arange(len(x)), top), np.tile(np.arange(top), len(x))
        with np.errstate(over="ignore"):
            for level in reversed(range(len(self.levels))):
                low_x, low_y, high_x, high_y = (v[box] for v in self.levels[level])
                to_low_x, to_high_x, to_low_y, to_high_y = low_x - x[site], x[site] - high_x, low_y - y[site], y[site] - high_y
                dx, dy = np.maximum(np.maximum(to_low_x, to_high_x), 0), np.maximum(np.maximum(to_low_y, to_high_y), 0)
                far_x, far_y = np.maximum(-to_low_x, -to_high_x), np.maximum(-to_low_y, -to_high_y)
                nearest = dx * dx + dy * dy
                bound = np.full(len(x), np.inf)
                np.minimum.at(bound, site, far_x * far_x + far_y * far_y)
                self.compared += len(site)
                kept = nearest <= bound[site]
                site, box, nearest = site[kept], box[kept], nearest[kept]
                if level:
                    below = len(self.levels[level - 1][0])
                    box = (box[:, None] * FAN + np.arange(FAN)).ravel()
                    site = np.repeat(site, FAN)
                    site, box = site[box < below], box[box < below]
        return site + first, self.order[box], nearest


def nearest(
    sites: DataFrame,
    candidates: DataFrame,
    *,
    group: Sequence[str],
    site_position: tuple[str, str],
    position: tuple[str, str],
    identity: str,
) -> DataFrame:
    """Per site its nearest candidate of the same group; equal distances go to the smallest identity.

    Sites are distinct rows. A NULL group is no group, and positions that are NULL, NaN or infinite are no positions:
    such candidates are not found, and such sites, like those whose group has no candidate, are absent from the result.
    """
    (sx, sy), (x, y) = site_position, position
    spark = sites.sparkSession
    group = list(group)
    place = [F.col(c).cast("double") for c in position]
    # Candidates at one spot differ only by identity: keep the smallest.
    grouped = reduce(and_, [F.col(c).isNotNull() for c in group], F.lit(True))
    known = candidates.filter(is_position(x, y) & grouped).select(*group, place[0].alias("_x"), place[1].alias("_y"), F.col(identity).alias("_id"))
    spots = materialize(known.groupBy(*group, "_x", "_y").agg(F.min("_id").alias("_id")))
    asked = sites.filter(is_position(sx, sy) & grouped).select(*group, F.col(sx).cast("double").alias("_sx"), F.col(sy).cast("double").alias("_sy"))
    total, low_x, low_y, high_x, high_y = spots.agg(F.count("*"), F.min("_x"), F.min("_y"), F.max("_x"), F.max("_y")).first()
    group_types = [sites.schema[c] for c in group]
    answered = T.StructType([*group_types, *[T.StructField(c, T.DoubleType()) for c in ("_sx", "_sy", "_dist")], T.StructField("_id", spots.schema["_id"].dataType)])
    if not total:
        return _named(spark.createDataFrame([], answered), group, sx, sy, identity)
    square = Square(low_x, low_y, max(high_x - low_x, high_y - low_y))
    sample = spots.orderBy(F.xxhash64("_x", "_y"), "_x", "_y").limit(SAMPLE).select("_x", "_y").toPandas()
    most = max(LEAST_IN_SAMPLE, LEAF * len(sample) // total)
    starts = quartered(square.cells(sample["_x"].to_numpy(), sample["_y"].to_numpy()), most)

    @F.arrow_udf("int")
    def leaf_of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        cells = square.cells(xs.to_numpy(zero_copy_only=False), ys.to_numpy(zero_copy_only=False))
        return pa.array((np.searchsorted(starts, cells, "right") - 1).astype(np.int32))

    placed = spots.withColumn("_leaf", leaf_of("_x", "_y"))
    edges = [F.min("_x").alias("_lx"), F.min("_y").alias("_ly"), F.max("_x").alias("_hx"), F.max("_y").alias("_hy")]
    boxes = placed.groupBy(*group, "_leaf").agg(*edges)

    # Which leaves: a group's sites, dealt over as many blocks as a shuffle has partitions, each with the group's boxes.
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    block = F.pmod(F.xxhash64("_sx", "_sy"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    routed_type = T.StructType([*group_types, *[T.StructField(c, T.DoubleType()) for c in ("_sx", "_sy")], T.StructField("_leaf", T.IntegerType())])
    routed_schema, answered_schema = _arrow(routed_type), _arrow(answered)

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return routed_schema.empty_table()
        tree = BoxTree(*(right.column(c).to_numpy() for c in ("_lx", "_ly", "_hx", "_hy")))
        site, box, _ = tree.near(left.column("_sx").to_numpy(), left.column("_sy").to_numpy())
        chosen = left.select([*group, "_sx", "_sy"]).take(pa.array(site))
        return chosen.append_column("_leaf", right.column("_leaf").take(pa.array(box))).cast(routed_schema)

    key = [*group, "_block"]
    sent = asked.withColumn("_block", block).groupBy(*key).cogroup(boxes.withColumn("_block", every).groupBy(*key))
    routed = materialize(sent.applyInArrow(route, routed_type))

    # Which candidates: a leaf's sites in blocks, each with the leaf's candidates.
    crowded = routed.groupBy(*group, "_leaf").agg(F.ceil(F.count("*") / SITES).cast("int").alias("_blocks"))
    copies = crowded.select(*group, "_leaf", (F.col("_blocks") - 1).alias("_last"))
    asked_leaves = placed.join(copies, [*group, "_leaf"]).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    asked_sites = routed.join(crowded, [*group, "_leaf"]).withColumn("_block", F.pmod(F.xxhash64("_sx", "_sy"), F.col("_blocks")).cast("int")).drop("_blocks")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return answered_schema.empty_table()
        right = right.sort_by("_id")  # so that the first of equal distances has the smallest identity
        xs, ys = right.column("_x").to_numpy(), right.column("_y").to_numpy()
        site, spot, distance = BoxTree(xs, ys, xs, ys).near(left.column("_sx").to_numpy(), left.column("_sy").to_numpy())
        first = np.lexsort((spot, distance, site))
        first = first[np.diff(site[first], prepend=-1) > 0]
        chosen = left.select([*group, "_sx", "_sy"]).take(pa.array(site[first]))
        chosen = chosen.append_column("_dist", pa.array(distance[first])).append_column("_id", right.column("_id").take(pa.array(spot[first])))
        return chosen.cast(answered_schema)

    key = [*group, "_leaf", "_block"]
    met = asked_sites.groupBy(*key).cogroup(asked_leaves.groupBy(*key)).applyInArrow(meet, answered)
    best = met.groupBy(*group, "_sx", "_sy").agg(F.min(F.struct("_dist", "_id")).alias("_best"))
    return _named(best.select(*group, "_sx", "_sy", "_best._dist", "_best._id"), group, sx, sy, identity)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _named(found: DataFrame, group: list[str], sx: str, sy: str, identity: str) -> DataFrame:
    return found.select(*group, F.col("_sx").alias(sx), F.col("_sy").alias(sy), F.col("_dist").alias("dist"), F.col("_id").alias(identity))
