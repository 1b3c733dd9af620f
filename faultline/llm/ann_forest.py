"""Nearest neighbours from a forest of sorted hash strings.

Every row gets one 64-bit string a tree: signs of its projections on random directions, from the mean of all
rows. Rows are dealt into shards of about ``SHARD_ROWS``; a shard holds, for each tree, its strings in sorted
order. A query descends every tree to the rows that share its longest prefix and then ascends all trees
together, a bit at a time, until the shared ranges hold enough rows; a row's score is the sum of its prefix
lengths, and the best ``SHARE`` of the shard are measured exactly, in double precision. Each shard returns its
nearest, and the nearest of all shards are the answer. Every row is indexed; queries meet shards in blocks of
``QUERY_BLOCK``, so a task holds one shard and one block.

Equal vectors are indexed once with the smallest ids among them: k + 1 ids are all that any answer can use.

Defined results: vectors that are null, zero, of another length than ``dimension``, or that hold nulls or
non-finite components take no part, as query or candidate; ties go to the smaller id; a query with fewer
candidates than k gets them all; an empty table gives no rows; rows with a null id take no part; rows that
repeat an id count once for each distinct vector; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.frames import stage

TREES = 64
BITS = 64
SHARD_ROWS = 8192
QUERY_BLOCK = 2048
#: Share of a shard that is measured for each query, and the least number of rows.
SHARE = 0.25
LEAST = 256
SEED = 20_240_229


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) with v as doubles, of the vectors that take part."""
    chosen = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return chosen.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))


def directions(dimension: int, trees: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dimension, trees * BITS))


def hash_strings(points: np.ndarray, axes: np.ndarray, trees: int) -> np.ndarray:
    """One unsigned 64-bit string for each tree and point, first bit highest."""
    out = np.empty((trees, len(points)), np.uint64)
    for tree in range(trees):
        bits = points @ axes[:, tree * BITS : (tree + 1) * BITS] > 0
        out[tree] = np.packbits(bits, axis=1).view(">u8").reshape(-1)
    return out


def shared_prefix(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """Leading bits that strings have in common with b."""
    diff = a ^ b
    high, low = (diff >> np.uint64(32)).astype(np.float64), (diff & np.uint64(0xFFFFFFFF)).astype(np.float64)
    width = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1])
    return BITS - width


class Forest:
    """The sorted strings of one shard."""

    def __init__(self, points: np.ndarray, centre: np.ndarray, axes: np.ndarray, trees: int) -> None:
        self.points, self.centre, self.axes, self.trees = points, centre, axes, trees
        strings = hash_strings(points - centre, axes, trees)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)
        keep = np.arange(BITS + 1)
        self.masks = np.array([(1 << BITS - int(k)) - 1 for k in keep], np.uint64)

    def candidates(self, query: np.ndarray, wanted: int) -> np.ndarray:
        if len(self.points) <= wanted:
            return np.arange(len(self.points))
        strings = hash_strings((query - self.centre)[None, :], self.axes, self.trees)[:, 0]
        low, high = np.empty((self.trees, BITS + 1), np.int64), np.empty((self.trees, BITS + 1), np.int64)
        for tree, string in enumerate(strings):
            low[tree] = np.searchsorted(self.sorted[tree], string & ~self.masks, "left")
            high[tree] = np.searchsorted(self.sorted[tree], string | self.masks, "right")
        held = (high - low).sum(axis=0)
        level = int(np.flatnonzero(held >= 16 * wanted).max(initial=0))  # the longest prefix at which all trees hold enough
        while True:
            score = np.zeros(len(self.points), np.int32)
            for tree, string in enumerate(strings):
                span = slice(low[tree, level], high[tree, level])
                score[self.order[tree, span]] += shared_prefix(self.sorted[tree, span], string).astype(np.int32) + 1
            if level == 0 or np.count_nonzero(score) >= wanted:
                break
            level -= 1
        return np.argpartition(-score, wanted - 1)[:wanted]

    def nearest(self, query: np.ndarray, k: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest candidates, and of all that tie with the last."""
        at = self.candidates(query, wanted)
        distance = np.sqrt(((self.points[at] - query) ** 2).sum(axis=1))
        if len(at) > k:
            near = distance <= np.partition(distance, k - 1)[k - 1]
            at, distance = at[near], distance[near]
        return at, distance


def _matrix(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, trees: int = TREES, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query; both tables are (vec_id, v) as ``usable`` gives them."""
    spark = vectors.sparkSession
    vectors = stage(vectors)
    first = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return spark.createDataFrame([], schema)
    dimension = first.n
    vectors = vectors.where(F.size("v") == dimension)
    queries = queries.where(F.size("v") == dimension)
    means = vectors.select([F.avg(F.get("v", F.lit(n))) for n in range(dimension)]).first()
    centre = np.array(list(means), float)
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    ranked = vectors.dropDuplicates(["vec_id", "v"]).withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    distinct = stage(ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    shards = max(1, math.ceil(distinct.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    place = F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block")
    rows = distinct.select("v", "ids", place, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = queries.select("vec_id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))

    def in_shard(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "ids": [], "score": []}
        if left.num_rows and right.num_rows:
            ids = left.column("ids").to_pylist()
            forest = Forest(_matrix(left.column("v"), dimension), centre, directions(dimension, trees, seed), trees)
            wanted = max(LEAST, math.ceil(share * left.num_rows))
            for query_id, query in zip(right.column("vec_id").to_pylist(), _matrix(right.column("v"), dimension), strict=True):
                at, distance = forest.nearest(query, k + 1, wanted)
                found["query_id"] += [query_id] * len(at)
                found["ids"] += [ids[n] for n in at]
                found["score"] += distance.tolist()
        return pa.table([pa.array(found["query_id"], pa.int64()), pa.array(found["ids"], pa.list_(pa.int64())), pa.array(found["score"], pa.float64())], ["query_id", "ids", "score"])

    met = rows.withColumn("block", F.col("block").cast("long")).groupBy("shard", "block").cogroup(asked.withColumn("shard", F.col("shard").cast("long")).groupBy("shard", "block"))
    near = met.applyInArrow(in_shard, "query_id long, ids array<long>, score double")
    each = near.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id != query_id")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
