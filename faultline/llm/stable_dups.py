"""Near copies of vectors inside a label by p-stable hashing, each link decided by an exact cosine.

Vectors are brought to length one, so that a cosine is a Euclidean distance. A projection on a normal direction,
shifted and cut into steps of ``WIDTH``, gives equal numbers to near vectors; ``projections`` of them make a
bucket, ``tables`` give many. Both numbers follow from the largest label's rows by one rule (``hash_plan``):
unrelated vectors share about one bucket a table, and vectors just at the threshold meet with probability
``RECALL`` (nearer ones more surely). That holds on average over groups: the pairs of one group lie alike to the
steps of a projection and are found or missed together. Every pair that meets is checked in double precision.

A group of copies is never written out as pairs:

1. Equal vectors of a label become one point that counts its copies.
2. Points of a coarse bucket are gathered, ``BLOCK`` at a time, into balls: a ball's points lie within half the
   threshold's angle of its centre, so they are all linked with each other, without a pair being formed.
3. Balls meet in the buckets of their points; a bucket of more than ``BLOCK`` balls is met block by block.
   By the angle between centres, less or more the radii, two balls are linked as a whole, not at all, or in
   part; only in the last case are their points compared, in one matrix product.
4. Links are counted with the weights of balls and points; components are found over balls.

Memory: a task holds two blocks. Defined results: a null label, and vectors that are null, empty, zero or that
hold null or non-finite components, link with nothing; neither do vectors of different length; repeated rows
link with each other and are counted each; rows that share an id but not a vector are vectors of their own;
a null id is the smallest of a component only if it has no other; an empty table gives no rows; other columns
are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.components import components
from faultline.llm.frames import stage
from faultline.llm.runs import by_length, matrix, unit_rows, whole_runs
from faultline.llm.shingles import mixed

COSINE = 0.93
RECALL = 0.9995
WIDTH = 2.0
BLOCK = 1024
SMALL_RUN = 48
#: Rounding of angles, far above that of doubles and far below any that matters: what lies within it is compared exactly.
SLACK = 1e-6
SEED = 20_250_113


def meeting_probability(distance: float, width: float = WIDTH) -> float:
    """That one projection gives two vectors at this distance the same step."""
    c = width / distance
    tail = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def hash_plan(points: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Projections a table, and tables, for a label of so many points."""
    near, far = meeting_probability(math.sqrt(2 - 2 * cosine)), meeting_probability(math.sqrt(2))
    projections = max(4, math.ceil(math.log(max(points, 1)) / -math.log(far)))
    return projections, math.ceil(math.log(1 - recall) / math.log1p(-(near**projections)))


class Hashes:
    """Bucket numbers of unit vectors, for one length of vectors at a time."""

    def __init__(self, projections: int, tables: int, salt: int = 0) -> None:
        self.projections, self.tables, self.salt = projections, tables, salt
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.odd = np.random.default_rng([SEED, 1]).integers(1, 1 << 62, projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, units: np.ndarray, family: np.ndarray) -> np.ndarray:
        """A row of bucket numbers for each vector; different families and tables share none."""
        dimension = units.shape[1]
        if dimension not in self.held:
            rng = np.random.default_rng([SEED, 2, self.salt, dimension])
            shape = (self.tables * self.projections,)
            self.held[dimension] = rng.normal(size=(dimension, *shape)), rng.uniform(0, WIDTH, shape)
        axes, shift = self.held[dimension]
        out = np.empty((len(units), self.tables), np.uint64)
        numbers = mixed(np.arange(1, self.tables + 1, dtype=np.uint64))
        for at in range(0, len(units), 256):
            steps = np.floor((units[at : at + 256] @ axes + shift) / WIDTH).astype(np.int64).view(np.uint64)
            coded = (steps.reshape(-1, self.tables, self.projections) * self.odd).sum(axis=2, dtype=np.uint64)
            out[at : at + 256] = mixed(coded + numbers) ^ mixed(family[at : at + 256].view(np.uint64))[:, None]
        return mixed(out).view(np.int64)


def gather_balls(units: np.ndarray, least: float) -> np.ndarray:
    """The ball of each vector, as the place of its centre: the first vector that no earlier ball holds opens one."""
    near = units @ units.T >= least
    ball = np.arange(len(units))
    free = np.ones(len(units), bool)
    for centre in np.flatnonzero(near.sum(axis=1) > 1):
        if free[centre]:
            taken = near[centre] & free
            taken[centre] = True
            ball[taken] = centre
            free[taken] = False
    return ball


def _balls(hashes: Hashes, least: float):
    """Points of sorted (cell, salt) runs with their ball; a ball's first point also carries what describes the ball."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, ["cell", "salt"]):
            size = table.num_rows
            key, weight, family = (table.column(c).to_numpy() for c in ("key", "w", "family"))
            ball, cosine = np.arange(size), np.ones(size)
            buckets: list = [None] * size
            for at, held in by_length(table.column("v")):
                units = unit_rows(held)
                number = hashes(units, family[at])
                run = np.searchsorted(bounds, at, "right")
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(run)) + 1):
                    if len(part) > 1:
                        # Runs of one cell can hold two families only if 64-bit hashes collide; they are kept apart all the same.
                        for kind in np.unique(family[at[part]]):
                            own = part[family[at[part]] == kind]
                            centre = own[gather_balls(units[own], least)]
                            ball[at[own]] = at[centre]
                            cosine[at[own]] = np.einsum("ij,ij->i", units[own], units[centre])
                order = np.argsort(ball[at], kind="stable")
                heads, starts = np.unique(ball[at][order], return_index=True)
                for head, members in zip(heads.tolist(), np.split(order, starts[1:]), strict=True):
                    buckets[head] = number[members[0]].tolist() if len(members) == 1 else np.unique(number[members]).tolist()
            total = np.bincount(ball, weight, size).astype(np.int64)
            points = np.bincount(ball, minlength=size)
            radius = np.ones(size)
            np.minimum.at(radius, ball, cosine)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[ball]), pa.array(key), table.column("low").combine_chunks(), pa.array(weight), pa.array(family),
                    table.column("v").combine_chunks(), pa.array(total), pa.array(points), pa.array(radius), pa.array(buckets, pa.list_(pa.int64())),
                ],
                ["ball", "key", "low", "w", "family", "v", "total", "points", "cosine", "buckets"],
            )

    return in_task


def _pairs_of_small_runs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in the same run, for all small runs together, a distance at a time."""
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    run = np.where(sizes[run] <= SMALL_RUN, run, -1)
    for step in range(1, int(sizes[sizes <= SMALL_RUN].max(initial=0))):
        left = np.flatnonzero((run[step:] == run[:-step]) & (run[step:] >= 0))
        if len(left):
            yield left, left + step


def _meet(cosine: float):
    """Pairs of balls that share a bucket and are linked, as a whole or perhaps in part."""
    angle = math.acos(cosine)

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, ["bucket", "low_block", "high_block"]):
            ball, family, total, points, block, low, high = (
                table.column(c).to_numpy() for c in ("ball", "family", "total", "points", "block", "low_block", "high_block")
            )
            radius = np.where(points > 1, np.arccos(np.clip(table.column("cosine").to_numpy(), -1, 1)), 0.0)
            for at, held in by_length(table.column("v")):
                units = unit_rows(held)
                own_bounds = np.unique(np.searchsorted(at, bounds))

                def linked(left: np.ndarray, right: np.ndarray, product: np.ndarray, at=at) -> pa.RecordBatch:
                    a, b = at[left], at[right]
                    met = (family[a] == family[b]) & ((low[a] == high[a]) | (block[a] != block[b])) & (ball[a] != ball[b])
                    apart, reach = np.arccos(np.clip(product, -1, 1)), radius[a] + radius[b]
                    single = reach == 0
                    whole = np.where(single, product >= cosine, apart + reach <= angle - SLACK)
                    keep = met & (whole | ~single & (apart - reach <= angle + SLACK))
                    a, b, whole = a[keep], b[keep], whole[keep]
                    a, b = np.where(ball[a] < ball[b], a, b), np.where(ball[a] < ball[b], b, a)
                    names = ["a", "b", "total_a", "total_b", "whole"]
                    return pa.RecordBatch.from_arrays([pa.array(x) for x in (ball[a], ball[b], total[a], total[b], whole)], names)

                for left, right in _pairs_of_small_runs(own_bounds):
                    yield linked(left, right, np.einsum("ij,ij->i", units[left], units[right]))
                for begin, end in zip(own_bounds[:-1], own_bounds[1:], strict=True):
                    if end - begin > SMALL_RUN:
                        product = units[begin:end] @ units[begin:end].T
                        left, right = np.nonzero(np.triu(product >= least_product(radius[at[begin:end]], angle), 1))
                        yield linked(left + begin, right + begin, product[left, right])

    return in_task


def least_product(radius: np.ndarray, angle: float) -> np.ndarray:
    """The least cosine of two centres at which any of their points can be linked."""
    reach = angle + SLACK + radius[:, None] + radius[None, :]
    return np.cos(np.minimum(reach, math.pi))


def _compare(cosine: float):
    """For pairs of balls linked in part: how much each point is linked with on the other side."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_runs(batches, ["a", "b"]):
            a, b, side, key, weight = (table.column(c).to_numpy() for c in ("a", "b", "side", "key", "w"))
            vectors = table.column("v")
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
                units = unit_rows(matrix(vectors.slice(begin, end - begin)))
                cut = begin + int(np.searchsorted(side[begin:end], 1))
                linked = units[: cut - begin] @ units[cut - begin :].T >= cosine
                found.append((np.arange(begin, end), np.concatenate([linked @ weight[cut:end], weight[begin:cut] @ linked])))
            at, add = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]).astype(np.int64)
            at, add = at[add > 0], add[add > 0]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a[at], b[at], key[at], add)], ["a", "b", "key", "add"])

    return in_task


def _blocked(rows: DataFrame, key: str, place: str, into: str) -> DataFrame:
    """Rows with the number of blocks of ``BLOCK`` rows that their key needs, as ``blocks``, and their own as ``into``."""
    hot = stage(rows.groupBy(key).count().where(F.col("count") > BLOCK).select(key, F.ceil(F.col("count") / BLOCK).alias("blocks")))
    placed = rows.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return placed.withColumn(into, F.pmod(F.xxhash64(place), F.col("blocks")))


def link(vectors: DataFrame, *, cosine: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = stage(chosen.withColumn("takes_part", F.coalesce(F.col("label").isNotNull() & usable_vector("v"), F.lit(False))))
    taking = rows.where("takes_part")
    family = F.xxhash64("label", F.size("v")).alias("family")
    points = taking.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count("*").alias("w"))
    points = stage(points.select(F.monotonically_increasing_id().alias("key"), "label", "v", "low", "w", family))
    most = points.groupBy("family").count().agg(F.max("count")).first()[0] or 0
    projections, tables = hash_plan(most, cosine, recall)
    coarse = Hashes(max(2, projections // 2), 1, salt=1)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            family, cell = batch.column("family").to_numpy(), np.empty(batch.num_rows, np.int64)
            for at, held in by_length(batch.column("v")):
                cell[at] = coarse(unit_rows(held), family[at])[:, 0]
            yield batch.append_column("cell", pa.array(cell))

    point = "key long, low {0}, w long, family long, v array<double>".format(points.schema["low"].dataType.simpleString())
    placed = stage(points.select("key", "low", "w", "family", "v").mapInArrow(cells, f"{point}, cell long"))
    placed = _blocked(placed, "cell", "key", "salt").drop("blocks")
    sorted_cells = placed.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "key")
    described = f"ball long, {point}, total long, points long, cosine double, buckets array<long>"
    half = math.sqrt((1 + cosine) / 2) + 1e-9
    balls = stage(sorted_cells.mapInArrow(_balls(Hashes(projections, tables), half), described))
    heads = balls.where("ball = key")

    entries = heads.select("ball", "family", "v", "total", "points", "cosine", F.explode("buckets").alias("bucket"))
    entries = _blocked(entries, "bucket", "ball", "block")
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    entries = entries.withColumns({"low_block": F.least("block", "other"), "high_block": F.greatest("block", "other")}).drop("other", "blocks")
    in_buckets = entries.repartition("bucket", "low_block", "high_block").sortWithinPartitions("bucket", "low_block", "high_block")
    met = in_buckets.mapInArrow(_meet(cosine), "a long, b long, total_a long, total_b long, whole boolean")
    met = stage(met.dropDuplicates(["a", "b"]))

    whole, part = met.where("whole"), met.where("not whole")
    member = balls.select("ball", "key", "w", "v")
    sides = [
        part.select("a", "b", F.col(end).alias("ball")).join(member, "ball").select("a", "b", F.lit(n).alias("side"), "key", "w", "v")
        for n, end in enumerate("ab")
    ]
    in_pairs = sides[0].unionByName(sides[1]).repartition("a", "b").sortWithinPartitions("a", "b", "side")
    compared = stage(in_pairs.mapInArrow(_compare(cosine), "a long, b long, key long, add long"))

    both = whole.select(F.col("a").alias("ball"), F.col("total_b").alias("more")).unionByName(whole.select(F.col("b").alias("ball"), F.col("total_a").alias("more")))
    of_ball = both.groupBy("ball").agg(F.sum("more").alias("more"))
    of_point = compared.groupBy("key").agg(F.sum("add").alias("add"))
    found = components(whole.select("a", "b").unionByName(compared.select("a", "b").distinct()))
    about = heads.select("ball", "total").join(of_ball, "ball", "left").join(found.withColumnRenamed("node", "ball"), "ball", "left")
    about = about.select("ball", (F.col("total") - 1 + F.coalesce("more", F.lit(0))).alias("near"), F.coalesce("component", "ball").alias("root"))
    each = balls.select("key", "ball", "low").join(about, "ball").join(of_point, "key", "left")
    each = stage(each.select("key", "low", "root", (F.col("near") + F.coalesce("add", F.lit(0))).alias("n_links")))
    lows = each.groupBy("root").agg(F.min("low").alias("component_id"))
    each = points.select("key", "label", "v").join(each.join(lows, "root").drop("low", "root"), "key").drop("key")
    linked = taking.join(each, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not takes_part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def usable_vector(column: str):
    """Not null, not empty, not zero, and every component a finite number."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)
