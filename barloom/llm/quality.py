"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs set a good document against a poor one. The score of a document is linear in its features, the chance
that one beats another is the logistic function of their score difference, and the weights minimise the logistic loss on
feature differences. A quantile of the training scores then gives the threshold, and scores are mapped to (0, 1) so
that the threshold sits at ``CUT``.

Features see only the text: byte-class pairs, word and line statistics, repetition. Every labelled row trains: rows are dealt
by the hash of their ids into groups of some ``GROUP`` rows, and in a group each good document is set against each poor
one. Where one label is so rare that groups would go without it, its rows join several groups. Newton steps add up over
the groups in fixed point, and the threshold is the exact quantile of the scores of all labelled rows, so the model depends
neither on how files are split nor on the order of sums.

Defined cases: null and empty texts have all-zero features and are scored like any other; rows whose label is null or
not 0 or 1 don't train, nor do ids with labels of both kinds; an id with several texts trains with the one whose features
come first in byte order; without a label of each kind every score is 0.5; repeated rows score alike; columns other than
doc_id and text pass through (internal ones start with ``_q_``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, scan_cpu_partitions, small

#: Rows of a group that are set against each other; rows of the rarer label that a group expects at least.
GROUP, LEAST = 1024, 32
#: Newton steps, ridge; parts of one in which sums over groups count; rows in which they come to the driver.
ROUNDS, RIDGE, PARTS, SLOTS = 12, 1e-3, 1 << 16, 16
CUT = 0.3
BLOCK = 1 << 20

_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "'\"`", "()[]{}<>", "|", "#$%&*@^~+=/\\_", "-"]
KINDS = len(_CLASSES) + 2
_KIND = np.full(256, KINDS - 2, np.uint8)
_KIND[128:] = KINDS - 1
for _i, _chars in enumerate(_CLASSES):
    _KIND[[ord(c) for c in _chars]] = _i
WIDTH = KINDS * KINDS + 14


def features(text: str) -> np.ndarray:
    """A fixed number of features of the whole text."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(raw) == 0:
        return out
    pairs = np.zeros(KINDS * KINDS, np.int64)
    for at in range(0, len(raw), BLOCK):
        kind = _KIND[raw[at : at + BLOCK + 1]].astype(np.int32)
        pairs += np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS)
    out[: KINDS * KINDS] = np.sqrt(pairs / max(1, len(raw) - 1))
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    top = Counter(words).most_common(3) + [("", 0)] * 3
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    out[KINDS * KINDS :] = [
        np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), sizes.mean(), min(60, sizes.max()), sizes.std(),
        len(set(words)) / n, len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2),
        top[0][1] / n, top[1][1] / n, top[2][1] / n, len(set(lines)) / len(lines), sum(x.endswith((".", "!", "?")) for x in lines) / len(lines), (sizes <= 3).mean(),
    ]
    return out


@dataclass(frozen=True)
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0
    slope: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``CUT`` at the threshold, 0.5 everywhere if nothing could be learned."""
        shift = np.log(CUT / (1 - CUT)) if self.slope else 0.0
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.raw(x) - self.threshold) + shift, -30, 30)))


def pair_sums(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, gradient and Hessian of the logistic loss, summed over all pairs (a row labelled 1, a row labelled 0), in fixed point."""
    good, poor = z[y == 1], z[y == 0]
    p = 1 / (1 + np.exp(np.clip((good @ w)[:, None] - (poor @ w)[None, :], -30, 30)))
    q = p * (1 - p)
    gradient = poor.T @ p.sum(axis=0) - good.T @ p.sum(axis=1)
    cross = good.T @ (q @ poor)
    hessian = (good.T * q.sum(axis=1)) @ good + (poor.T * q.sum(axis=0)) @ poor - cross - cross.T
    return np.rint(np.concatenate([[p.size], gradient, hessian.ravel()]) * PARTS).astype(np.int64)


def newton(sums: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Weights that minimise the mean loss with ridge, from what ``sums`` gives for weights (see ``pair_sums``)."""
    w = np.zeros(WIDTH)
    for _ in range(ROUNDS):
        pairs, *rest = sums(w) / PARTS
        if not pairs:
            return w
        means = np.array(rest) / pairs
        step = np.linalg.solve(means[WIDTH:].reshape(WIDTH, WIDTH) + RIDGE * np.eye(WIDTH), means[:WIDTH] + RIDGE * w)
        w = w - step * min(1, 5 / (np.linalg.norm(step) + 1e-9))
        if np.linalg.norm(step) < 1e-4:
            break
    return w


def scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def calibrated(blank: Ranker, w: np.ndarray, good: int, poor: int, ranked: Callable[[float | None, list[int]], list[float]]) -> Ranker:
    """The ranker with the quantile at the share of poor rows as its threshold, and its slope.

    ``ranked`` gives the raw scores at places of their order, or with a centre their distances from it.
    """
    n = good + poor
    k = min(max(poor, 1), n - 1)
    threshold = float(sum(ranked(None, [k - 1, k]))) / 2
    spread = sum(ranked(threshold, [(n - 1) // 2, n // 2])) / 2 + 1e-6
    return Ranker(blank.mean, blank.scale, w, threshold, float(3 / spread))


def fit(x: np.ndarray, y: np.ndarray) -> Ranker:
    """Bradley-Terry weights from all pairs of rows in memory, then the quantile threshold and the slope."""
    good, poor = int((y == 1).sum()), int((y == 0).sum())
    if not good or not poor:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    x = x.astype(np.float64)
    blank = Ranker(x.mean(axis=0), x.std(axis=0) + 1e-3, np.zeros(WIDTH))
    z = scaled(x, blank.mean, blank.scale)
    w = newton(lambda w: pair_sums(z, y, w))
    ranked = lambda centre, at: np.sort(z @ w if centre is None else np.abs(z @ w - centre))[at].tolist()
    return calibrated(blank, w, good, poor, ranked)


def labelled(labels: DataFrame, docs: DataFrame, use: Column | None = None, label: str = "quality") -> DataFrame:
    """doc_id and _q_label of the documents that have one label, 0 or 1."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_q_label"), F.max(label).cast("int").alias("_q_other"))
    chosen = marked.where("_q_label = _q_other").select("doc_id", "_q_label")
    return materialize((chosen if use is None else chosen.where(use)).join(docs.select("doc_id"), "doc_id", "left_semi"), "quality-labels")


def grouped(chosen: DataFrame, docs: DataFrame, good: int, poor: int) -> DataFrame:
    """A row for each group: its labels, which rows are there first, and features, in order of the ids."""
    groups = -(-(good + poor) // GROUP)
    copies = min(groups, max(1, -(-LEAST * groups // min(good, poor))))
    known = small(chosen, good + poor, 1 << 20)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "y": frame["_q_label"], "x": [features(t or "").tobytes() for t in frame["text"]]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "x"]).drop_duplicates("doc_id")
        own = (rows["turn"] == 0).to_numpy()
        return pd.DataFrame({"slot": rows["slot"].iloc[:1].array, "y": [rows["y"].to_numpy(np.int8).tobytes()], "own": [own.tobytes()], "x": [b"".join(rows["x"])]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = docs.select("doc_id", "text").join(known, "doc_id").select("doc_id", "_q_label", "text").mapInPandas(measure, f"doc_id {kind}, y int, x binary")
    turns = F.sequence(F.lit(0), F.when(F.col("y") == int(good <= poor), F.lit(copies - 1)).otherwise(F.lit(0)))
    dealt = measured.select("*", F.explode(turns).alias("turn")).withColumn("slot", F.pmod(F.xxhash64("doc_id") + F.col("turn"), F.lit(groups)))
    parts = max(scan_cpu_partitions(docs.sparkSession), groups // 16)
    return materialize(dealt.repartition(parts, "slot").groupBy("slot").applyInPandas(pack, "slot long, y binary, own binary, x binary"), "quality-groups")


def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Group, labels, which rows are there first, and features as doubles, one group at a time."""
    for frame in frames:
        for slot, y, own, x in frame[["slot", "y", "own", "x"]].itertuples(index=False, name=None):
            yield slot, np.frombuffer(y, np.int8), np.frombuffer(own, bool), np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64)


def added(parts: DataFrame, kind: type) -> np.ndarray:
    """The sum of the arrays in ``sums``, in order of ``slot``; tasks add up first, ``SLOTS`` arrays come to the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(raw, kind) for raw in rows.sort_values("slot")["sums"])
        return pd.DataFrame({"slot": rows["slot"].iloc[:1] % SLOTS, "sums": [total.tobytes()]})

    met = parts.groupBy((F.col("slot") % SLOTS).alias("few")).applyInPandas(add, "slot long, sums binary")
    return sum(np.frombuffer(raw, kind) for raw in met.toPandas().sort_values("slot")["sums"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(labels: DataFrame, docs: DataFrame) -> Ranker:
    """The contract's model: rows whose crc32(doc_id) is a multiple of 5 never train, all other labelled ones do."""
    chosen = labelled(labels, docs, ~held_out())
    counts = dict(chosen.groupBy("_q_label").count().collect())
    good, poor = counts.get(1, 0), counts.get(0, 0)
    if not good or not poor:
        return Ranker(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH))
    groups = grouped(chosen, docs, good, poor)

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for slot, _, own, x in unpacked(frames):
            yield pd.DataFrame({"slot": [slot], "sums": [np.concatenate([x[own].sum(axis=0), (x[own] ** 2).sum(axis=0)]).tobytes()]})

    total = added(groups.mapInPandas(moments, "slot long, sums binary"), np.float64) / (good + poor)
    mean = total[:WIDTH]
    scale = np.sqrt(np.maximum(total[WIDTH:] - mean**2, 0)) + 1e-3

    def sums(w: np.ndarray) -> np.ndarray:
        def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros(1 + WIDTH + WIDTH * WIDTH, np.int64)
            for _, y, _, x in unpacked(frames):
                found += pair_sums(scaled(x, mean, scale), y, w)
            yield pd.DataFrame({"slot": [TaskContext.get().partitionId()], "sums": [found.tobytes()]})

        return added(groups.mapInPandas(part, "slot long, sums binary"), np.int64)

    w = newton(sums)

    def raw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, own, x in unpacked(frames):
            yield pd.DataFrame({"s": scaled(x[own], mean, scale) @ w})

    scores = materialize(groups.mapInPandas(raw, "s double"), "quality-scores")

    def ranked(centre: float | None, at: list[int]) -> list[float]:
        value = F.col("s") if centre is None else F.abs(F.col("s") - centre)
        placed = scores.select(value.alias("s"), F.monotonically_increasing_id().alias("at")).orderBy("s", "at").rdd.map(lambda r: r[0]).zipWithIndex()  # equal scores spread over tasks
        found = {i: v for v, i in placed.filter(lambda row: row[1] in at).collect()}
        return [found[i] for i in at]

    return calibrated(Ranker(mean, scale, np.zeros(WIDTH)), w, good, poor, ranked)


def score_documents(docs: DataFrame, model: Ranker, name: str = "score") -> DataFrame:
    """``docs`` with a score for every row."""

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in texts:
            yield pd.Series(model.score(np.stack([features(t or "") for t in text])) if len(text) else np.zeros(0))

    return docs.withColumn(name, score("text"))
