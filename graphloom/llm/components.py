"""Connected components: forests within tasks, contraction across them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import checkpoint, discard

#: Edges that one task joins at once.
TASK_EDGES = 1 << 18


def forest(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """Star edges (root, node) of the components that the edges make up."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        at = up.setdefault(x, x)
        while at != x:
            up[x] = up[at]
            x, at = at, up[at]
        return x

    for a, b in zip(u, v):
        a, b = root(a), root(b)
        if a != b:
            up[b] = a
    nodes = [x for x in up if up[x] != x]
    return [root(x) for x in nodes], nodes


def _forests(edges: DataFrame, parts: int) -> DataFrame:
    def run(batches):
        u, v = [], []
        for batch in batches:
            u.append(batch.column("u").to_numpy()), v.append(batch.column("v").to_numpy())
        if u:
            a, b = forest(np.concatenate(u).tolist(), np.concatenate(v).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return edges.select("u", "v").repartition(parts).mapInArrow(run, "u long, v long")


def components(edges: DataFrame, task_edges: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (u, v: long, any orientation, self-loops ignored).

    Each round deals the edges to tasks of at most task_edges, which keep a forest of theirs; if one task held all, its
    trees are the components. Else each node maps to the lowest of itself and its neighbours, in an order that a hash
    draws anew, and the edges are contracted by that map; what is left shrinks by a constant factor on average, for long
    chains too. Maps are composed. No node's neighbours are gathered: minima combine before the shuffle, and a hub only
    makes join keys that adaptive execution can split. The driver sees one count a round.
    """
    size = task_edges or TASK_EDGES
    left = checkpoint(edges.where("u <> v").select("u", "v"))
    total, turn = None, 0
    while n := left.count():
        turn += 1
        parts = math.ceil(n / size)
        stars = checkpoint(_forests(left, parts))
        discard(left)
        if parts == 1:
            low = stars.select(F.col("v").alias("u"), F.col("u").alias("l"))
        else:
            rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731  read at once
            both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
            low = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("m"))
            low = checkpoint(low.select("u", F.when(rank("m") < rank("u"), F.col("m")).otherwise(F.col("u")).alias("l")))
            a, b = low.select(F.col("u").alias("_a"), F.col("l").alias("_la")), low.select(F.col("u").alias("_b"), F.col("l").alias("_lb"))
            left = stars.join(a, F.col("u") == F.col("_a")).join(b, F.col("v") == F.col("_b"))
            left = checkpoint(left.where("_la <> _lb").select(F.col("_la").alias("u"), F.col("_lb").alias("v")))
        if total is None:
            roots = low.where("u = l").select("u") if parts > 1 else low.select(F.col("l").alias("u")).distinct()
            total = low.where("u <> l").select(F.col("u").alias("node"), F.col("l").alias("root")).unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("root")))
        else:
            total = total.join(low, F.col("root") == F.col("u"), "left").select("node", F.coalesce("l", "root").alias("root"))
        total = checkpoint(total)
        if parts == 1:
            break
    if total is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return total
