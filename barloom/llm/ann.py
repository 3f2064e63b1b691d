"""Approximate nearest neighbours by inner product: a forest of random-projection trees, then exact reranking.

Trees are fitted on a bounded sample; every row is indexed. Their depth follows the number of rows, so that leaves keep
their size: the upper levels have a plane per node, cut at the sample's medians; below ``DEPTH`` the nodes of a level share
one plane per tree, cut at the sample's median. A query walks all trees through one priority queue, best margin first,
until it has opened its share of leaves. In each group of leaves the rows of opened ones are scored exactly, in double
precision, and only the group's best per query go on to the merge: rows are copied once per tree to where they are
scored, since fetching the vectors of all candidates by id would move far more. How many leaves are opened is chosen on
``TRIALS`` rows whose true neighbours among all rows are found by brute force, as the fewest that reach ``RECALL``.

Inner products become distances by one extra coordinate, sqrt(max norm^2 - norm^2), which is 0 for queries.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part;
vectors compare only with vectors of their length; ties go to the smaller id; rows that repeat one id count once, with the
least of their vectors; fewer candidates than k are all returned; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, materialize, small, spread_join
from .vectors import matrix, usable

K, TREES, RECALL = 20, 4, 0.97
#: Bounds of the fit: rows of the sample, trial queries, levels with own planes; rows a leaf aims at, and rows of a group and a block.
SAMPLE, TRIALS, DEPTH, LEAF, GROUP, BLOCK = 16_384, 96, 10, 512, 32_768, 8_192


@dataclass(frozen=True)
class Forest:
    """``planes``: trees x upper nodes x dimensions, complete binary trees in heap order; ``cuts``: their thresholds.

    ``deep`` and ``deep_cuts``: trees x lower levels (x dimensions), one plane for all nodes of a level.
    """

    planes: np.ndarray
    cuts: np.ndarray
    deep: np.ndarray
    deep_cuts: np.ndarray
    upper: int
    depth: int
    top: float  # the largest norm

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.top**2 - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def margins(self, lifted: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        return lifted @ self.planes[tree].T - self.cuts[tree], lifted @ self.deep[tree].T - self.deep_cuts[tree]

    def leaf_of(self, lifted: np.ndarray, tree: int) -> np.ndarray:
        (own, shared), node = self.margins(lifted, tree), np.zeros(len(lifted), np.int64)
        for level in range(self.depth):
            m = own[np.arange(len(node)), node] if level < self.upper else shared[:, level - self.upper]
            node = 2 * node + 1 + (m > 0)
        return node - (self.leaves - 1)

    def opening(self, lifted: np.ndarray) -> Iterator[int]:
        """Leaves, as tree * leaves + leaf, in the order in which one query's shared queue gives them."""
        margins = [tuple(m[0] for m in self.margins(lifted[None], t)) for t in range(len(self.planes))]
        queue, inner = [(-np.inf, t, 0) for t in range(len(self.planes))], self.leaves - 1
        while queue:
            cost, tree, node = heapq.heappop(queue)
            own, shared = margins[tree]
            while node < inner:
                m = own[node] if node < len(own) else shared[(node + 1).bit_length() - 1 - self.upper]
                near = 2 * node + 1 + int(m > 0)
                heapq.heappush(queue, (max(cost, abs(m)), tree, 4 * node + 3 - near))
                node = near
            yield tree * self.leaves + node - inner

    def search(self, lifted: np.ndarray, opened: int) -> list[int]:
        """The first ``opened`` leaves."""
        return list(islice(self.opening(lifted), opened))


def fit_forest(sample: np.ndarray, depth: int, top: float, trees: int = TREES, seed: int = 5) -> Forest:
    """Random planes cut at the sample's medians."""
    upper = min(depth, DEPTH)
    dice, inner, dim = np.random.default_rng(seed), (1 << upper) - 1, sample.shape[1] + 1
    forest = Forest(np.zeros((trees, inner, dim)), np.zeros((trees, inner)), np.zeros((trees, depth - upper, dim)), np.zeros((trees, depth - upper)), upper, depth, top)
    lifted = forest.lift(sample)
    for t in range(trees):
        rows = {0: np.arange(len(lifted))}
        for node in range(inner):
            mine, plane = rows.pop(node), dice.standard_normal(dim)
            plane /= np.linalg.norm(plane)
            side = lifted[mine] @ plane
            cut = float(np.median(side)) if len(mine) else 0.0
            forest.planes[t, node], forest.cuts[t, node] = plane, cut
            rows[2 * node + 1], rows[2 * node + 2] = mine[side <= cut], mine[side > cut]
        for level in range(depth - upper):
            plane = dice.standard_normal(dim)
            forest.deep[t, level] = plane / np.linalg.norm(plane)
            forest.deep_cuts[t, level] = np.median(lifted @ forest.deep[t, level])
    return forest


def true_neighbours(rows: DataFrame, ids: np.ndarray, trials: np.ndarray, k: int) -> DataFrame:
    """at (of the trial), best: its k nearest rows, as (far, vec_id, vec), found by scoring every row."""

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [[] for _ in ids]
        for frame in frames:
            x, own = matrix(frame["vec"]), frame["vec_id"].to_numpy()
            far = -(trials @ x.T) if len(frame) else np.zeros((len(ids), 0))
            for at in range(len(ids)):
                near = np.argsort(far[at], kind="stable")[: k + 1] if len(own) <= 4 * k else np.argpartition(far[at], k + 1)[: k + 1]
                held[at] = sorted(held[at] + [(far[at, j], own[j], x[j].tolist()) for j in near if own[j] != ids[at]])[:k]
        for at, best in enumerate(held):
            if best:
                yield pd.DataFrame({"at": at, "far": [b[0] for b in best], "vec_id": [b[1] for b in best], "vec": [b[2] for b in best]})

    each = rows.select("vec_id", "vec").mapInPandas(score, "at int, far double, vec_id long, vec array<double>")
    return each.groupBy("at").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id", "vec"))), 1, k).alias("best"))


def choose_opened(forest: Forest, rows: DataFrame, ids: np.ndarray, trials: np.ndarray, k: int = K, recall: float = RECALL) -> int:
    """The fewest leaves whose candidates hold ``recall`` of the trial rows' true neighbours."""
    trees, every = len(forest.planes), len(forest.planes) * forest.leaves

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at, best in zip(frame["at"], frame["best"], strict=True):
                lifted = forest.lift(np.stack([b["vec"] for b in best]).astype(np.float64))
                homes = np.stack([t * forest.leaves + forest.leaf_of(lifted, t) for t in range(trees)], axis=1)
                waiting, needed = {}, np.zeros(len(best), np.int64)
                for j, mine in enumerate(homes.tolist()):
                    for leaf in mine:
                        waiting.setdefault(leaf, []).append(j)
                left = len(best)
                for place, leaf in enumerate(forest.opening(forest.lift(trials[at][None], True)[0]), 1):
                    for j in waiting.get(leaf, ()):
                        if not needed[j]:
                            needed[j], left = place, left - 1
                    if not left:
                        break
                yield pd.DataFrame({"needed": needed})

    truth = materialize(true_neighbours(rows, ids, trials, k), "ann-truth")
    needed = truth.repartition(min(TRIALS, max(1, len(ids))), "at").mapInPandas(measure, "needed long").toPandas()["needed"].to_numpy()
    return int(np.quantile(needed, recall, method="higher")) if len(needed) else every


def search(vectors: DataFrame, queries: Column, k: int = K, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that ``queries`` selects. One search per vector length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"), queries.alias("asks"))
    rows = rows.where(usable("vec") & F.col("vec_id").isNotNull()).withColumn("norm", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)))
    rows = rows.groupBy("vec_id", F.size("vec").alias("dim")).agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"), F.max("norm").alias("norm"))
    rows = materialize(rows.groupBy("vec_id").agg(F.min_by(F.struct("dim", "vec", "asks", "norm"), "dim").alias("r")).select("vec_id", "r.*"), "ann-rows")
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("norm").alias("top"), F.max("asks").alias("asked")).where("asked").orderBy("dim").collect()  # a row per vector length
    found = [_search(rows.where(F.col("dim") == r["dim"]), r["n"], r["top"], k, trees, recall) for r in sizes]
    return reduce(DataFrame.unionByName, found) if found else vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _search(rows: DataFrame, n: int, top: float, k: int, trees: int, recall: float) -> DataFrame:
    """The search among vectors of one length: rows vec_id, vec, asks."""
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "vec").toPandas()
    sample = matrix(drawn["vec"])
    forest = fit_forest(sample, max(1, int(np.log2(max(2, n / LEAF)))), top, trees)
    opened = choose_opened(forest, rows, drawn["vec_id"].to_numpy()[:TRIALS], sample[:TRIALS], k, recall)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lifted = forest.lift(matrix(frame["vec"]))
            for t in range(trees) if len(frame) else ():
                yield pd.DataFrame({"leaf": t * forest.leaves + forest.leaf_of(lifted, t), "vec_id": frame["vec_id"], "vec": frame["vec"]})

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lifted = forest.lift(matrix(frame["vec"]), True)
            yield pd.DataFrame({"vec_id": frame["vec_id"], "vec": frame["vec"], "leaves": [forest.search(x, opened) for x in lifted] if len(frame) else []})

    placed = rows.select("vec_id", "vec").mapInPandas(index, "leaf long, vec_id long, vec array<double>")
    placed = materialize(placed.withColumn("vec", F.col("vec").cast("array<double>")), "ann-leaves")
    shares = materialize(placed.groupBy("leaf").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / F.lit(BLOCK)).cast("int")), "ann-shares")
    groups, leaves = max(1, -(-trees * n // GROUP)), shares.count()
    group = F.pmod(F.xxhash64("leaf", "block"), F.lit(groups)).cast("int")
    shared = placed.join(F.broadcast(shares), "leaf") if leaves <= BROADCAST_ROWS else spread_join(placed, shares, "leaf", "c", "vec_id", max(BLOCK, trees * n // BLOCK))
    members = shared.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).withColumn("g", group).select("g", "leaf", "vec_id", "vec")
    asking = rows.where("asks").select("vec_id", "vec").mapInPandas(ask, "vec_id long, vec array<double>, leaves array<long>")
    visits = asking.select("vec_id", F.explode("leaves").alias("leaf")).join(small(shares, leaves), "leaf").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = visits.withColumn("g", group).groupBy("g", "vec_id").agg(F.collect_set("leaf").alias("leaves")).join(rows.where("asks").select("vec_id", "vec"), "vec_id")

    def rerank(key: tuple, mine: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(mine) and len(asks):
            mine = mine.sort_values(["leaf", "vec_id"], kind="stable")
            leaf, ids, x = mine["leaf"].to_numpy(), mine["vec_id"].to_numpy(), matrix(mine["vec"])
            starts = {v: (np.searchsorted(leaf, v), np.searchsorted(leaf, v, "right")) for v in np.unique(leaf)}
            for query, vec, leaves in zip(asks["vec_id"], asks["vec"], asks["leaves"], strict=True):
                spans = [starts[v] for v in leaves if v in starts]
                if not spans:
                    continue
                found = np.concatenate([ids[a:b] for a, b in spans])
                score = np.concatenate([x[a:b] @ vec for a, b in spans])
                score[found == query] = -np.inf
                if len(score) > 4 * k * trees:  # enough for k distinct ids, and all ties of the last
                    least = -np.partition(-score, k * trees)[k * trees]
                    found, score = found[score >= least], score[score >= least]
                order = np.lexsort((found, -score))
                found, score = found[order], score[order]
                first = np.sort(np.unique(found, return_index=True)[1])[: k + 1]
                first = first[found[first] != query][:k]
                out["query_id"].append(np.full(len(first), query))
                out["vec_id"].append(found[first])
                out["score"].append(score[first])
        join = lambda c, t: np.concatenate(out[c]) if out[c] else np.zeros(0, t)
        return pd.DataFrame({"query_id": join("query_id", np.int64), "vec_id": join("vec_id", np.int64), "score": join("score", float)})

    best = members.groupBy("g").cogroup(visits.groupBy("g")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    nearest = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = nearest.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, k).alias("best"))
    return ranked.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
