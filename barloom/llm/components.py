"""Connected components by alternating star contractions, each round written to the shared folder.

A graph of at most ``FINISH`` edges is finished by union-find in one task, whose memory that bound limits (16 bytes an
edge); a larger one goes through rounds until nothing moves. Nodes with many edges are salted, so that no join task
gets a hub whole. Both ways give the same components.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, spread_join

#: Edges that one task may finish; a node with more than HUB edges, or than 1 in HUBS of all, is a hub.
FINISH, HUB, HUBS = 1 << 19, 4096, 8192


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges (a, b), sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while len(x):  # hook the larger root below the smaller, then shorten paths
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
        x, y = low[x], low[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[low]


def _finish(edges: DataFrame) -> DataFrame:
    def settle(group: pd.DataFrame) -> pd.DataFrame:
        node, component = roots(group["a"].to_numpy(), group["b"].to_numpy())
        return pd.DataFrame({"node": node, "component": component})

    return edges.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(settle, "node long, component long")


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Large star: larger neighbours move to the smallest; small star: a node and its smaller neighbours do."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("c"))
    met = spread_join(sides, least, "a", "c", "b", hub)  # at most 2 * HUBS hubs
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50, finish: int = FINISH) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``edges`` (a, b long). Nulls don't link."""
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    count = edges.count()
    if count <= finish:
        return materialize(_finish(edges), "components")
    mark = None
    for _ in range(rounds):
        hub = max(HUB, count // HUBS)
        edges = materialize(_star(_star(edges, True, hub), False, hub), "stars")
        count, now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, now) == mark:
            break
        mark = (count, now)
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
