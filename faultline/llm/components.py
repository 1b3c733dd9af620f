"""Connected components of a table of links, by contraction in blocks and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.frames import stage

#: Links that one task contracts at a time.
BLOCK = 1 << 20


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) links of whole numbers, the component being its smallest node.

    Each round first contracts blocks of links, each for itself: links that fit one block are done by that. Otherwise
    it points every larger neighbour, and then every smaller one, to the smallest neighbour of a node; the rounds end
    when the links no longer change. No node's neighbours are gathered: only minima are grouped.
    """
    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while (now := _mark(edges)) != seen:
        seen = now
        if now[0] <= BLOCK:
            edges = stage(contracted(edges, 1)) if now[0] else edges
            break
        edges = stage(contracted(edges, -(-now[0] // BLOCK)).distinct())
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        large = both.join(smallest, both.a == smallest.c).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a != b").distinct())
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        joined = large.join(smallest, large.a == smallest.c)
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select(F.col("c").alias("a"), F.col("m").alias("b")))
        edges = stage(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    leaves = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (open_links := root[a] != root[b]).any():
        a, b = root[a[open_links]], root[b[open_links]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def contracted(edges: DataFrame, blocks: int) -> DataFrame:
    """Links of equal reach: in each block every node points to the smallest that it reaches there."""

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            nodes, root = roots(*(np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in range(2)))
            far = nodes != root
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(blocks).mapInArrow(in_task, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(hashed)).first())
