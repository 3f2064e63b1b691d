"""Near-duplicate documents by DartMinHash signatures over five-word shingles.

A document is a weighted set: its shingles, weighing as often as they occur. Darts are thrown at the plane of element
weight and rank; a dart's place depends only on hashes of its element, so documents that share a region see the same
darts. Each dart belongs to one coordinate of the signature, and a coordinate keeps the document's earliest dart. Two
documents agree in a coordinate with probability equal to their weighted Jaccard similarity.

Documents with the same weighted set become one representative. Representatives that share a band of coordinates are in
one bucket. First each is compared exactly with one member of its buckets, the smallest; then buckets whose members
aren't all linked by that are compared inside, large ones block against block, leaving out pairs that are linked
already. So chance collisions join no buckets, and each comparison gives only a spanning forest of its links: the
components are those of all candidate pairs, but no group ever emits all its pairs.

Defined cases: words are runs without ASCII white space; a text of fewer than five words is one shingle; a null, empty
or blank text has no shingle and stays alone, as does a row whose doc_id is null; rows that repeat a doc_id are one
document, which is near whatever one of its texts is near; an empty table gives an empty result; other columns than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small, spread_join
from .components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 5
#: Bytes of text handled together in a task; members and bytes of shingles of a block, bytes of a comparing group.
BATCH_BYTES, BLOCK, BLOCK_BYTES, GROUP_BYTES = 1 << 20, 384, 16 << 20, 8 << 20
#: A key with more rows than HOT, or than 1 in HOTS of all, is dealt over several tasks.
HOT, HOTS = 4096, 8192

_P, _GOLD = 0x9E3779B97F4A7C55, np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i mod 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << int(n - 1).bit_length()
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, a repeated one numbered by occurrence, and the text each is from; in text order."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers(len(raw) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[raw] * up[: len(raw)])])
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    word = mix((sums[ends] - sums[starts]) * down[starts])
    edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(edges, starts, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    place = np.arange(len(word)) - first[owner]
    width = np.minimum(count, words)[owner]
    take = np.flatnonzero(place + width <= count[owner])
    take = take[(count[owner[take]] >= words) | (place[take] == 0)]
    out, n = np.zeros(len(take), np.uint64), len(word)
    for k in range(words):
        step = word[np.minimum(take + k, n - 1)]
        step[width[take] <= k] = k
        out = out * _GOLD + step
    out, owner = mix(out), owner[take]
    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(owner, np.arange(len(texts) + 1))), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    number = np.arange(len(out)) - np.repeat(at, np.diff([*at, len(out)]))
    return mix(out + number.astype(np.uint64) * _GOLD), owner


def darts(cells: np.ndarray, owner: np.ndarray, width: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, rank and id of the darts below each owner's rank limit; a cell of less than full width keeps a part of its own.

    Over a cell of one element's unit of weight, ranks of darts are a Poisson process of rate 1.
    """
    found, live, time, thrown = [], np.arange(len(cells)), np.zeros(len(cells)), 0
    while len(live):
        many = 4 if len(live) > 20_000 else 32
        h = mix(cells[live][:, None] + _GOLD * np.arange(thrown + 1, thrown + many + 1, dtype=np.uint64))
        rank = time[live][:, None] + np.cumsum(-np.log1p(-(h >> np.uint64(11)).astype(float) / 2.0**53), axis=1)
        hit = rank <= limit[owner[live]][:, None]
        name = mix(h[hit] ^ _GOLD)
        who = np.repeat(live, hit.sum(axis=1))
        part = (mix(name) >> np.uint64(11)).astype(float) / 2.0**53 <= width[who]
        found.append((owner[who][part], rank[hit][part], name[part]))
        more = hit[:, -1]
        time[live[more]] = rank[more, -1]
        live, thrown = live[more], thrown + many
    join = lambda i, t: np.concatenate([f[i] for f in found]) if found else np.zeros(0, t)
    return join(0, np.int64), join(1, float), join(2, np.uint64)


def signatures(cells: np.ndarray, owner: np.ndarray, n: int, k: int, width: np.ndarray | None = None) -> np.ndarray:
    """n x k ids of each owner's earliest dart per coordinate; 0 for owners without weight.

    cells: hashes of (element, unit of its weight); width: how much of the last unit counts, 1 by default.
    """
    width = np.ones(len(cells)) if width is None else width
    weight = np.bincount(owner, width, minlength=n)
    out, todo, throws = np.zeros((n, k), np.uint64), np.flatnonzero(weight > 0), k * np.log(k) + 2 * k
    while len(todo):
        index = np.full(n, -1)
        index[todo] = np.arange(len(todo))
        mine = index[owner] >= 0
        who, rank, name = darts(cells[mine], index[owner[mine]], width[mine], throws / weight[todo])
        slot = who * k + (name % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, slot))
        slots, first = np.unique(slot[order], return_index=True)
        got = np.zeros(len(todo) * k, np.uint64)
        got[slots] = name[order[first]]
        full = np.ones(len(todo) * k, bool)
        full[slots] = False
        missing = full.reshape(-1, k).any(axis=1)
        out[todo[~missing]] = got.reshape(-1, k)[~missing]
        todo, throws = todo[missing], throws * 3
    return out


def band_keys(marks: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One key per band, different between bands."""
    keys = np.zeros((len(marks), bands), np.uint64)
    for r in range(rows):
        keys = mix(keys * _GOLD + marks[:, r : bands * rows : rows] + np.arange(bands, dtype=np.uint64))
    return keys.view(np.int64)


def _batches(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Consecutive rows of bounded text."""
    texts, at, held = [], 0, 0
    for i, text in enumerate(frame["text"]):
        texts.append((text or "").encode("utf-8", "replace"))
        held += len(texts[-1])
        if held >= BATCH_BYTES or i == len(frame) - 1:
            yield frame.iloc[at : i + 1], texts
            texts, at, held = [], i + 1, 0


def set_hashes(cells: np.ndarray, owner: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each weighted set."""
    sums = [np.zeros(count, np.uint64) for _ in range(2)]
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    for s, salt in zip(sums, (1, 2), strict=True):
        s[owner[starts]] = np.add.reduceat(mix(cells + np.uint64(salt)), starts) if len(starts) else 0
    return sums[0].view(np.int64), sums[1].view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, h1, h2 (a hash of the weighted set), n (its weight), keys (of the bands)."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, texts in _batches(frame):
                cells, owner = shingles(texts)
                keys = band_keys(signatures(cells, owner, len(texts), bands * rows), bands, rows)
                n = np.bincount(owner, minlength=len(texts))
                h1, h2 = set_hashes(cells, owner, len(texts))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "h1": h1, "h2": h2, "n": n, "keys": list(keys)})

    return docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(sign, "doc_id long, h1 long, h2 long, n long, keys array<long>").where("n > 0")


def forest(cells: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: float, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links among rows ``left`` x ``right`` whose Jaccard similarity reaches ``similarity``.

    Rows of one ``label`` count as linked beforehand; pairs that links already join are not compared.
    """
    label = np.arange(len(cells)) if label is None else np.unique(label, return_inverse=True)[1]
    sizes = np.array([len(c) for c in cells])
    values, codes = np.unique(np.concatenate([cells[i] for i in right]), return_inverse=True)
    edges = np.concatenate([[0], np.cumsum(sizes[right])])
    out, seen = [], np.zeros(len(values), np.int64)
    for i in left:
        apart = np.flatnonzero(label[right] != label[i])
        if not len(apart):
            continue
        at = np.searchsorted(values, cells[i])
        at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == cells[i])]
        seen[at] = 1
        if len(apart) * 4 > len(right):
            both = np.add.reduceat(seen[codes], edges[:-1])[apart]
        else:
            both = np.array([seen[codes[edges[j] : edges[j + 1]]].sum() for j in apart])
        seen[at] = 0
        total = sizes[i] + sizes[right[apart]] - both
        for j in right[apart[both >= similarity * total - 1e-9]]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), kept."""
    marks = materialize(signed(docs, bands, rows), "minhash-signed")
    reps = marks.groupBy("h1", "h2").agg(F.min_by(F.struct("n", "keys"), "doc_id").alias("s"), F.min("doc_id").alias("rep")).select("h1", "h2", "rep", "s.n", "s.keys")
    reps = materialize(reps, "minhash-reps")

    several = marks.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("doc_id")
    own = marks.select("doc_id", "h1", "h2").join(several, "doc_id").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps"))
    own = own.select("a", F.explode("reps").alias("b")).where("a <> b")

    shared = _shared_buckets(reps)
    near = materialize(shared.where("rep <> pivot").groupBy("rep").agg(F.min("pivot").alias("pivot")), "minhash-near")
    sets = reps.select("rep", "h1", "h2", "n")
    first = materialize(_verified(docs, _stars(near, sets), similarity), "minhash-first").unionByName(own)
    joined = components(first)
    links = first.unionByName(materialize(_verified(docs, _open_buckets(shared, near, joined, sets), similarity), "minhash-links"))
    classes = components(links).withColumnRenamed("node", "rep").withColumnRenamed("component", "class_id")
    of_set = reps.select("h1", "h2", "rep").join(classes, "rep", "left").select("h1", "h2", F.coalesce("class_id", "rep").alias("class_id"))
    of_doc = marks.select("doc_id", "h1", "h2").join(of_set, ["h1", "h2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = docs.selectExpr("cast(doc_id as long) doc_id").join(of_doc, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"))


def _shared_buckets(reps: DataFrame) -> DataFrame:
    """rep, key, pivot (the bucket's smallest rep), c (its size), for buckets of several representatives."""
    spots = reps.select("rep", F.explode("keys").alias("key"))
    buckets = materialize(spots.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("c")).where("c > 1"), "minhash-buckets")
    count, total = buckets.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    if count <= HOT:
        return materialize(spots.join(F.broadcast(buckets), "key"), "minhash-shared")
    return materialize(spread_join(spots, buckets, "key", "c", "rep", max(HOT, total // HOTS)), "minhash-shared")


def _parts(members: str, weight: str) -> Column:
    """Blocks that keep to BLOCK members and, about, BLOCK_BYTES of shingles."""
    return F.greatest(F.ceil(F.col(members) / F.lit(BLOCK)), F.ceil(F.col(weight) * 8 / F.lit(BLOCK_BYTES))).cast("long")


def _stars(near: DataFrame, sets: DataFrame) -> DataFrame:
    """Each representative beside its smallest bucket mate: rep, h1, h2, n, label, unit (compared together), side."""
    rows = materialize(near.join(sets, "rep"), "minhash-rows")
    fan = rows.groupBy("pivot").agg(F.count("*").alias("c"), F.sum("n").alias("held")).withColumn("parts", _parts("c", "held"))
    total = rows.count()
    leaves = spread_join(rows, fan, "pivot", "c", "rep", max(HOT, total // HOTS)).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    leaves = leaves.select("rep", "h1", "h2", "n", F.xxhash64("pivot", "part").alias("unit"), F.lit(1).alias("side"))
    centres = fan.select(F.col("pivot").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(sets, "rep")
    centres = centres.select("rep", "h1", "h2", "n", F.xxhash64("rep", "part").alias("unit"), F.lit(0).alias("side"))
    return leaves.unionByName(centres).withColumn("label", F.col("rep"))


def _open_buckets(shared: DataFrame, near: DataFrame, joined: DataFrame, sets: DataFrame) -> DataFrame:
    """Members of buckets that the first links don't join, once per pair of blocks; columns as of ``_stars``.

    Of buckets with the same members one stays; those of two members that were compared with each other are done.
    """
    rows = shared.join(near.withColumnRenamed("pivot", "first"), "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rows = rows.select("rep", "key", "c", F.coalesce("component", "rep").alias("label"), ((F.col("c") == 2) & (F.col("first") == F.col("pivot"))).alias("done"))
    rows = materialize(rows.join(sets, "rep"), "minhash-labelled")
    state = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("done").alias("done"), F.first("c").alias("c"), F.sum("n").alias("held"), F.sum(F.xxhash64("rep", "h1", "h2").cast("decimal(38,0)")).alias("mark"))
    left = state.where("low <> high and not coalesce(done, false)").groupBy("mark", "c").agg(F.min_by(F.struct("key", "held"), "key").alias("k"))
    left = materialize(left.select("k.key", "k.held", "c").withColumn("parts", _parts("c", "held")), "minhash-open")
    count, total = left.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    met = rows.drop("c").join(F.broadcast(left), "key") if count <= HOT else spread_join(rows.drop("c"), left, "key", "c", "rep", max(HOT, total // HOTS))
    met = met.withColumn("block", F.pmod(F.xxhash64("h1", "h2"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return met.select("rep", "h1", "h2", "n", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), side.alias("side"), "label")


def _verified(docs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Links of exact similarity between sides 0 and 1 of each unit, and among the rows of side 2."""
    members = materialize(members, "minhash-members")
    count, held = members.agg(F.count("*"), F.coalesce(F.sum(8 * F.col("n")), F.lit(0))).first()
    groups = max(1, -(-int(held) // GROUP_BYTES), -(-count // 4000))
    wanted = members.groupBy(F.col("rep").alias("doc_id"), "h1", "h2").agg(F.collect_list(F.struct("unit", "side", "label")).alias("places"))

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, texts in _batches(frame):
                cells, owner = shingles(texts)
                cuts = np.searchsorted(owner, np.arange(1, len(texts)))
                h1, h2 = set_hashes(cells, owner, len(texts))
                same = (part["h1"].to_numpy() == h1) & (part["h2"].to_numpy() == h2)
                yield part[["doc_id", "h1", "h2", "places"]].assign(cells=[np.sort(c).tobytes() for c in np.split(cells, cuts)])[same]

    def compare(mine: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, rows in mine.groupby("unit", sort=False):
            rows = rows.drop_duplicates(["h1", "h2", "side"]).sort_values(["doc_id", "h1", "h2", "side"])
            ids, side = rows["doc_id"].to_numpy(), rows["side"].to_numpy()
            left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            if len(left) and len(right):
                cells = [np.frombuffer(c, np.uint64) for c in rows["cells"]]
                for i, j in forest(cells, left, right, similarity, rows["label"].to_numpy()):
                    a.append(ids[i])
                    b.append(ids[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    text = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text").join(small(wanted, count), "doc_id")
    ready = text.mapInPandas(sets, "doc_id long, h1 long, h2 long, places array<struct<unit long, side int, label long>>, cells binary")
    pairs = ready.select("doc_id", "h1", "h2", F.explode("places").alias("p"), "cells").select("doc_id", "h1", "h2", "p.*", "cells")
    keyed = pairs.withColumn("g", F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("int"))
    return keyed.groupBy("g").applyInPandas(lambda mine: compare(mine), "a long, b long")


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that aren't the smallest id of their class."""
    gone = near_duplicates(docs, similarity).where("not kept").select(F.col("doc_id").alias("_mh_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_mh_doc"], "left_anti")
