"""Connected components of an edge table: in one task where there are few edges, else by rounds of large-star and small-star."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: So many distinct edges, of 16 bytes, are one task's work. Rounds take many exchanges each, and
#: each of those is planning and threads in the driver.
FEW_EDGES = 1 << 20


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (r[0], r[1])


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One round over ``(u, v)``: each node's neighbours are tied to its least neighbour.

    The least neighbour is a min() that is combined before the shuffle, so a node with a third of
    all edges costs one row a task.
    """
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = pairs.join(least, "u")
    if large:
        out = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``u[i] - v[i]``, ascending, and the least node of each one's component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(x["u"].to_numpy(np.int64), x["v"].to_numpy(np.int64)) for x in batches]
        if held:
            node, component = least_nodes(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pd.DataFrame({"node": node, "component": component})

    return edges.coalesce(1).mapInPandas(run, "node bigint, component bigint")


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """``(node, component)`` for each node of ``edges(u, v)``; component: its least node.

    Up to ``few`` distinct edges are one task's work. More take rounds, which end when nothing changes, after O(log n) of them;
    ``max_rounds`` only guards against a bug and raises. Nodes without an edge are not in the result.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    mark = _mark(now)
    if mark[0] <= few:
        return materialise(_in_one_task(now), "components")
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        now = materialise(_star(large, False), "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
