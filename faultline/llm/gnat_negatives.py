"""Hard negatives by exact search in a GNAT, a multiway hyperplane tree with distance ranges.

Rows are integer vectors; a score is an inner product. With one more component that makes all rows equally long
(the query's being 0) the squared distance of query and row is a constant less twice the score, so the rows of a
score window are those in an annulus round the query. Split points are chosen far apart; a row belongs to the
nearest one. For every pair of a split point and a sibling's subtree the node holds the least and the largest
distance, and a subtree is passed over if for any split point the range and the window's annulus don't meet.
Leaves are scored exactly, so nothing depends on how well the tree prunes.

The first level lies in Spark: its split points come from a bounded sample (``TOP_SAMPLE`` rows), every row is
dealt to its cell, a cell of more than ``SHARD_ROWS`` rows is salted into shards, and each shard's tree is built
once, in its own task, and stored. Queries go only to cells whose ranges they meet, in blocks of ``QUERY_BLOCK``.
Positives are first sought in the anchor's own cell, whose result bounds the search of the others. A window that
has its wanted rows goes on only for better ones.

Of equal vectors with equal labels only those with the smallest ids can be in an answer, one more than are
wanted; the others aren't indexed. Memory: a task holds one shard and one block of queries.

Defined results: rows with a null id, null label, null vector, null or non-finite component take no part, nor do
those of another length than most, or so long that scores would pass 2^61; repeated rows count once; rows that
share an id but not vector and label are rows of their own, and never each other's positives or negatives; a
positive score below zero has no window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.llm.frames import stage
from faultline.llm.runs import matrix

SPLITS = 16
LEAF_ROWS = 96
TOP_SPLITS = 16
TOP_SAMPLE = 2048
SHARD_ROWS = 8192
QUERY_BLOCK = 4096
EXACT = 2.0**53
LONGEST = 2.0**61
NO_SCORE = -(2**62)
ASKED = "ask long, own long, kind long, norm long, low long, high long, q array<long>"


def quantised(vectors: DataFrame, steps: int = 256, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """(vec_id, label, q) of the rows that can take part, q being floor(steps * x)."""
    chosen = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = chosen.where("vec_id is not null and label is not null and v is not null").where(finite)
    short = F.aggregate("v", F.lit(0.0), lambda n, x: n + steps * steps * (F.abs(x) + 1.0) * (F.abs(x) + 1.0)) < LONGEST
    return known.where(short).select("vec_id", "label", F.transform("v", lambda x: F.floor(F.lit(float(steps)) * x)).alias("q"))


def spread(points: np.ndarray, wanted: int) -> np.ndarray:
    """Places of points far from each other: the first one, and then always the one farthest from those chosen."""
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(wanted, len(points)) and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def lengthened(rows: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the component that makes them all equally long."""
    rows = rows.astype(np.float64)
    rest = np.sqrt(np.maximum(longest - (rows * rows).sum(axis=1), 0))
    return np.column_stack([rows, rest])


def distances(points: np.ndarray, splits: np.ndarray) -> np.ndarray:
    square = (points * points).sum(axis=1)[:, None] + (splits * splits).sum(axis=1)[None, :] - 2 * points @ splits.T
    return np.sqrt(np.maximum(square, 0))


def passable(to_split: np.ndarray, inner: np.ndarray, outer: np.ndarray, least: np.ndarray, most: np.ndarray, slack: float) -> np.ndarray:
    """Which subtrees (columns) can hold rows of each query's annulus, by its distances to all split points."""
    low = np.maximum(inner[:, None] - to_split, to_split - outer[:, None])[:, :, None] - slack
    high = (to_split + outer[:, None])[:, :, None] + slack
    return ((most[None] >= low) & (least[None] <= high)).all(axis=1)


def slack_of(longest: float) -> float:
    """Far above the rounding of a distance, a millionth of the greatest one."""
    return 1e-6 * math.sqrt(2 * longest) + 1e-9


class Gnat:
    """The tree of one shard, as flat arrays; the rows of a subtree stand together."""

    PARTS = ("rows", "ids", "kinds", "nodes", "pivots", "least", "most", "child", "leaves")

    def __init__(self, longest: float, **parts: np.ndarray) -> None:
        self.longest, self.slack = longest, slack_of(longest)
        for name in self.PARTS:
            setattr(self, name, parts[name])
        self.scored = self.rows.astype(np.float64) if longest < EXACT else self.rows.astype(np.int64)

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, kinds: np.ndarray, longest: float) -> Gnat:
        points = lengthened(rows, longest)
        order = np.arange(len(rows))
        pivots, least, most, child, leaves, nodes = [], [], [], [], [], 0
        waiting = [(0, len(rows), None)]
        while waiting:
            begin, end, parent = waiting.pop()
            held, splits = order[begin:end], np.zeros(0, int)
            if len(held) > LEAF_ROWS:
                sample = held[:: max(1, len(held) // (10 * SPLITS))]
                splits = sample[spread(points[sample], SPLITS)]
            if len(splits) < 2:
                if parent:
                    child[parent[0]][parent[1]] = -2 - len(leaves)
                leaves.append((begin, end))
                continue
            far = distances(points[held], points[splits])
            nearest = far.argmin(axis=1)
            by = np.argsort(nearest, kind="stable")
            order[begin:end] = held[by]
            node, nodes = nodes, nodes + 1
            if parent:
                child[parent[0]][parent[1]] = node
            low, high = np.full((SPLITS, SPLITS), np.inf), np.full((SPLITS, SPLITS), -np.inf)
            child.append([-1] * SPLITS)
            ends = np.cumsum(np.bincount(nearest, minlength=len(splits)))
            for n, stop in enumerate(ends):
                start = ends[n - 1] if n else 0
                if stop > start:
                    low[: len(splits), n] = far[by[start:stop]].min(axis=0)
                    high[: len(splits), n] = far[by[start:stop]].max(axis=0)
                    waiting.append((begin + start, begin + stop, (node, n)))
            # A place of the table without a split point is the first one again: it excludes nothing more.
            low[len(splits) :], high[len(splits) :] = low[0], high[0]
            pivots.append(np.concatenate([splits, np.full(SPLITS - len(splits), splits[0])]))
            least.append(low)
            most.append(high)
        square = (nodes, SPLITS, SPLITS)
        place = np.empty(len(rows), np.int64)
        place[order] = np.arange(len(rows))
        return cls(
            longest, rows=rows[order], ids=ids[order], kinds=kinds[order], nodes=np.array([nodes]),
            pivots=place[np.array(pivots, np.int64).reshape(nodes, SPLITS)], least=np.array(least, np.float32).reshape(square),
            most=np.array(most, np.float32).reshape(square), child=np.array(child, np.int64).reshape(nodes, SPLITS), leaves=np.array(leaves).reshape(-1, 2),
        )

    def stored(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, longest=np.array([self.longest]), **{name: getattr(self, name) for name in self.PARTS})
        return held.getvalue()

    @classmethod
    def read(cls, data: bytes) -> Gnat:
        with np.load(io.BytesIO(data), allow_pickle=False) as parts:
            return cls(float(parts["longest"][0]), **{name: parts[name] for name in cls.PARTS})

    def search(
        self, queries: np.ndarray, own: np.ndarray, kinds: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, wanted: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The ``wanted`` highest scores of each query within its window, as (query, id, score), and how many were computed.

        Only rows of the same label count, or only those of another; a query's own id never does.
        """
        asked = queries.astype(self.scored.dtype)
        norm = (asked * asked).sum(axis=1).astype(np.float64)
        low = low.copy()  # rises to the last wanted score found so far
        best = np.full((len(asked), wanted), NO_SCORE, np.int64)
        found, computed = [], 0

        def away(score: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norm + self.longest - 2.0 * np.maximum(score, -(2.0**62)), 0))

        inner = away(np.minimum(high, 2.0**61))
        waiting = [(0 if self.nodes[0] else -2, np.flatnonzero(low <= high))]
        while waiting:
            at, active = waiting.pop()
            if at <= -2:
                begin, end = self.leaves[-2 - at]
                scores = (asked[active] @ self.scored[begin:end].T).astype(np.int64)
                computed += scores.size
                allowed = (self.kinds[begin:end][None, :] == kinds[active][:, None]) == same
                allowed &= (self.ids[begin:end][None, :] != own[active][:, None]) & (scores >= low[active][:, None]) & (scores <= high[active][:, None])
                query, row = np.nonzero(allowed)
                if not len(query):
                    continue
                found.append((active[query], self.ids[begin:end][row], scores[query, row]))
                both = np.concatenate([best[active], np.where(allowed, scores, NO_SCORE)], axis=1)
                best[active] = np.partition(both, both.shape[1] - wanted, axis=1)[:, -wanted:]
                low[active] = np.maximum(low[active], best[active].min(axis=1))
                continue
            splits = self.scored[self.pivots[at]]
            to_split = np.sqrt(np.maximum(norm[active][:, None] + self.longest - 2.0 * (asked[active] @ splits.T), 0))
            reached = passable(to_split, inner[active], away(low)[active], self.least[at], self.most[at], self.slack)
            for n in np.argsort(-to_split.sum(axis=0), kind="stable"):
                rest = active[reached[:, n]]
                if self.child[at, n] != -1 and len(rest):
                    waiting.append((int(self.child[at, n]), rest))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), computed
        query, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        return query[rank < wanted], ids[rank < wanted], scores[rank < wanted], computed


class Top:
    """The first level: split points of all rows, and each cell's ranges once the shards are built."""

    def __init__(self, splits: np.ndarray, longest: float) -> None:
        self.splits, self.longest, self.slack = splits, longest, slack_of(longest)
        self.least = self.most = np.zeros((0, 0))

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(lengthened(rows, self.longest), lengthened(self.splits, self.longest))
        return far.argmin(axis=1), far

    def reached(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cell of each query and whether each cell can hold rows of its window."""
        asked = queries.astype(np.float64)
        norm = (asked * asked).sum(axis=1)

        def away(score: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norm + self.longest - 2.0 * np.clip(score.astype(np.float64), -(2.0**62), 2.0**61), 0))

        to_split = np.sqrt(np.maximum(norm[:, None] + self.longest - 2.0 * asked @ self.splits.astype(np.float64).T, 0))
        return to_split.argmin(axis=1), passable(to_split, away(high), away(low), self.least, self.most, self.slack) & (low <= high)[:, None]


class Index:
    """All shards' trees, stored, and the first level above them."""

    def __init__(self, rows: DataFrame, wanted: int) -> None:
        self.spark = rows.sparkSession
        longest, self.dimension = rows.agg(F.max("norm"), F.max(F.size("q"))).first()
        self.top = Top(self._splits(rows), float(longest))
        size = len(self.top.splits)
        self.shards = [0] * size
        self.trees = self._built(rows, wanted)
        self.top.least, self.top.most = np.full((size, size), np.inf), np.full((size, size), -np.inf)
        ranges = self.trees.select("cell", F.posexplode(F.arrays_zip("least", "most")))
        for row in ranges.groupBy("cell", "pos").agg(F.min("col.least").alias("least"), F.max("col.most").alias("most")).collect():
            self.top.least[row.pos, row.cell], self.top.most[row.pos, row.cell] = row.least, row.most

    def _splits(self, rows: DataFrame) -> np.ndarray:
        sample = rows.orderBy(F.xxhash64("q"), "vec_id").limit(TOP_SAMPLE).select("q").collect()
        held = np.unique(np.array([r.q for r in sample], np.int64).reshape(len(sample), -1), axis=0)
        return held[spread(held.astype(float), TOP_SPLITS)]

    def _built(self, rows: DataFrame, wanted: int) -> DataFrame:
        top, longest = self.top, self.top.longest
        by_vector = Window.partitionBy("kind", "q").orderBy("vec_id")
        few = rows.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= wanted + 1)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.append_column("cell", pa.array(top.cells(matrix(batch.column("q")))[0], pa.int32()))

        dealt = stage(few.select("vec_id", "kind", "q").mapInArrow(deal, "vec_id long, kind long, q array<long>, cell int"))
        for row in dealt.groupBy("cell").count().collect():  # at most TOP_SPLITS rows
            self.shards[row.cell] = math.ceil(row["count"] / SHARD_ROWS)
        shards = F.element_at(F.array([F.lit(n) for n in self.shards]), F.col("cell") + 1)
        salted = dealt.withColumn("salt", F.pmod(F.xxhash64("vec_id"), shards))

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            rows = matrix(table.column("q"))
            tree = Gnat.build(rows, table.column("vec_id").to_numpy(), table.column("kind").to_numpy(), longest)
            far = top.cells(rows)[1]
            cell, salt = (k.as_py() for k in key)
            held = {"shard": [cell << 32 | salt], "cell": [cell], "tree": [tree.stored()], "least": [far.min(axis=0).tolist()], "most": [far.max(axis=0).tolist()]}
            return pa.Table.from_pydict(held, schema=pa.schema({"shard": pa.int64(), "cell": pa.int32(), "tree": pa.binary(), "least": pa.list_(pa.float64()), "most": pa.list_(pa.float64())}))

        built = salted.groupBy("cell", "salt").applyInArrow(build, "shard long, cell int, tree binary, least array<double>, most array<double>")
        return stage(built)

    def send(self, asked: DataFrame, where: str) -> DataFrame:
        """Each query with the shards of the cells that it must see: its nearest (``home``), the ``rest``, or ``all``."""
        top, shards = self.top, self.shards

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    home, reached = top.reached(matrix(batch.column("q")), batch.column("low").to_numpy(), batch.column("high").to_numpy())
                    at_home = np.arange(reached.shape[1])[None, :] == home[:, None]
                    chosen = reached if where == "all" else reached & (at_home if where == "home" else ~at_home)
                    for cell, salts in enumerate(shards):
                        held = batch.filter(pa.array(chosen[:, cell]))
                        for salt in range(salts if held.num_rows else 0):
                            yield held.append_column("shard", pa.array([cell << 32 | salt] * held.num_rows, pa.int64()))

        return asked.mapInArrow(route, f"{ASKED}, shard long")

    def search(self, asked: DataFrame, where: str, same: bool, wanted: int) -> DataFrame:
        """(ask, found, score), the ``wanted`` best of each shard that a query sees; ``asked`` is stored."""
        blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
        sent = self.send(asked, where).withColumn("block", F.pmod(F.xxhash64("ask"), F.lit(blocks).cast("long")))
        met = self.trees.select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

        def in_shard(left: pa.Table, right: pa.Table) -> pa.Table:
            columns: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
            if left.num_rows and right.num_rows:
                tree = Gnat.read(right.column("tree")[0].as_py())
                own, kind, low, high = (left.column(c).to_numpy() for c in ("own", "kind", "low", "high"))
                query, *rest, _ = tree.search(matrix(left.column("q")), own, kind, low, high, same, wanted)
                columns = [left.column("ask").to_numpy()[query], *rest]
            return pa.table([pa.array(c, pa.int64()) for c in columns], ["ask", "found", "score"])

        return sent.groupBy("shard", "block").cogroup(met.groupBy("shard", "block")).applyInArrow(in_shard, "ask long, found long, score long")


def _best(found: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("ask").orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted)


def mine(
    rows: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` are (vec_id, label, q) as ``quantised`` gives them, ``anchors`` a condition on them. Of each anchor's
    nearest ``positives`` rows with its label, the nearest ``negatives`` rows with another label whose score is
    between ``low`` and ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    norm = F.aggregate("q", F.lit(0).cast("long"), lambda n, x: n + x * x)
    kind = F.col("label").cast("long") if dict(rows.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("label")
    rows = stage(rows.dropDuplicates(["vec_id", "label", "q"]).withColumns({"kind": kind, "norm": norm}))
    first = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if first is None or first.n == 0:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("q") == first.n)
    index = Index(rows, max(positives, negatives))
    chosen = rows.where(anchors).select(F.monotonically_increasing_id().alias("ask"), F.col("vec_id").alias("own"), "kind", "norm", "q")
    chosen = stage(chosen.withColumns({"low": F.lit(NO_SCORE).cast("long"), "high": F.lit(-NO_SCORE).cast("long")}))
    asked = chosen.select(*[c.split()[0] for c in ASKED.split(", ")])

    at_home = stage(index.search(asked, "home", True, positives))
    enough = _best(at_home, positives).where(F.col("rank") == positives).select("ask", F.col("score").alias("least"))
    bounded = asked.drop("low").join(enough, "ask", "left").withColumn("low", F.coalesce("least", F.lit(NO_SCORE)))
    bounded = stage(bounded.select(*asked.columns))
    near = _best(at_home.unionByName(index.search(bounded, "rest", True, positives)), positives)

    pairs = near.select("ask", F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    # Parted at hundreds, so that no product leaves 64 bits.
    score, whole = F.col("positive_score"), F.expr("positive_score div 100")
    rest = score - whole * 100
    bounds = {
        "low": whole * low + F.floor((rest * low + 99) / 100).cast("long"),
        "high": whole * high + F.floor((rest * high) / 100).cast("long"),
    }
    windows = pairs.where("positive_score >= 0").join(asked.drop("low", "high"), "ask").withColumns(bounds)
    windows = stage(windows.drop("ask").withColumn("ask", F.monotonically_increasing_id()))
    found = _best(index.search(windows.select(*asked.columns), "all", False, negatives), negatives)
    named = found.join(windows.select("ask", F.col("own").alias("anchor_id"), "positive_id", "positive_score"), "ask")
    return named.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
