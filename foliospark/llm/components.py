"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

_EDGE = "node long, root long"


def _forest(batches: Iterator[pa.RecordBatch], held: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's edges, about ``held`` nodes at a time; leaves one edge a node, to its smallest peer."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def edges() -> pa.RecordBatch:
        nodes = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((find(int(x)) for x in nodes), np.int64, len(parent))
        other = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(roots[other])], ["node", "root"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
        if len(parent) > held:
            yield edges()
            parent.clear()
    yield edges()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours are hung on the smallest node in reach."""
    both = edges.select("node", "root").union(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
    near = both if large else edges
    least = near.groupBy("node").agg(F.min("root").alias("low"))
    # Staged, so that both sides of the join are plain shuffles: Spark then splits the neighbours of a component's hub.
    least = stage(least.select("node", F.least("node", "low").alias("low")))
    wanted = both.where("root > node") if large else edges
    moved = wanted.join(least, "node").select(F.col("root").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.union(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
    return moved.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (two long columns, any names) with its component.

    Returns (node long, root long): each node that has an edge to another node and isn't the
    smallest of its component, with that smallest node. Self-loops and repeated edges are
    ignored; null ends are dropped; no edges give no rows. Every round contracts each partition
    with union-find, then runs a large-star and a small-star step; the number of rounds grows
    with the logarithm of the longest path. Nothing but one count reaches the driver.
    """
    a, b = edges.columns[:2]
    current = edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("root")).where("node != root")
    while True:
        current = stage(current.mapInArrow(_forest, _EDGE).distinct())
        tops = current.select(F.col("root").alias("node")).distinct()
        # A forest of stars: no node hangs on two roots, and no root hangs on another.
        twice = current.groupBy("node").count().where("count > 1").select("node")
        if twice.union(current.join(tops, "node", "left_semi").select("node")).limit(1).count() == 0:
            return current
        current = _star(_star(current, large=True), large=False)
