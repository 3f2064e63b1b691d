from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, embed_dedup
from barloom.llm.components import components

VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [1.0] * 7 + [NAN], 1), (904, [1.0] * 7 + [None], 1), (905, [INF] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]


def made(n: int = 300, dim: int = 8) -> list[tuple]:
    dice = np.random.default_rng(3)
    x = dice.standard_normal((n, dim)).astype(np.float32)
    x[50:90] = x[10] + 0.05 * dice.standard_normal((40, dim))
    x[90:95] = x[11]
    return [(i, x[i].tolist(), None if i % 50 == 7 else i % 3) for i in range(n)]


def test_search_against_brute_force_with_odd_rows(spark):
    rows = made()
    frame = spark.createDataFrame(rows + ODD + [(20, rows[20][1], 1)], VECTORS).withColumns({"leaf": F.lit("x"), "norm": F.lit(None), "g": F.lit(0)})
    found = ann.search(frame, F.col("vec_id") % 20 == 0).collect()
    x = np.array([r[1] for r in rows], np.float64)
    hits = 0
    for q in range(0, 300, 20):
        score = x @ x[q]
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:20]
        mine = sorted((r for r in found if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], rel=1e-12) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len({r["vec_id"] for r in mine} & set(best))
    assert hits >= 0.9 * 20 * 15 and len(found) == 20 * 15


def test_recall_on_the_test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").toPandas()
    x, ids = np.stack(rows["embedding"]).astype(np.float64), rows["vec_id"].to_numpy()
    found = ann.search(table, F.col("vec_id") % 20 == 0).toPandas()
    hits = asked = 0
    for at in np.flatnonzero(ids % 20 == 0):
        score = x @ x[at]
        score[at] = -np.inf
        best = ids[np.lexsort((ids, -score))[:20]]
        hits, asked = hits + len(set(best) & set(found["vec_id"][found["query_id"] == ids[at]])), asked + 20
    assert len(found) == asked and hits >= 0.9 * asked


def test_search_of_few_rows(spark):
    assert ann.search(spark.createDataFrame([], VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(spark.createDataFrame(ODD, VECTORS), F.col("vec_id") % 20 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 1), (7, [-1.0, 0.5], 1)], VECTORS)
    assert [tuple(r) for r in ann.search(two, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 7, 0.0)]


def test_a_queue_opens_every_leaf_once():
    sample = np.random.default_rng(5).standard_normal((500, 6))
    forest = ann.fit_forest(sample, 4, float(np.linalg.norm(sample, axis=1).max()))
    opened = forest.search(forest.lift(sample[:1], True)[0], 10**6)
    assert sorted(opened) == list(range(ann.TREES * 16))


def test_deep_trees_open_few_leaves(spark, monkeypatch):
    monkeypatch.setattr(ann, "DEPTH", 4)
    monkeypatch.setattr(ann, "LEAF", 16)
    dice = np.random.default_rng(9)
    x = np.repeat(dice.standard_normal((400, 16)), 15, axis=0) + 0.2 * dice.standard_normal((6000, 16))  # depth 8
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found, hits = ann.search(frame, F.col("vec_id") % 100 == 0).toPandas(), 0
    for q in range(0, 6000, 100):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(found["vec_id"][found["query_id"] == q]))
    assert hits >= 0.9 * 60 * 20


def test_repeated_ids_and_other_lengths(spark):
    rows = [(i, [float(i), 1.0], 0) for i in range(1, 30)] + [(0, [5.0, 1.0], 0), (0, [-9.0, 1.0], 0), (40, [1.0, 2.0, 3.0], 0), (41, [1.0, 0.0, 1.0], 0)]
    found = ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 20 == 0).collect()
    assert [(r["vec_id"], r["score"]) for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 40] == [(41, 4.0)]
    assert [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0] == list(range(1, 21))  # the least vector, (-9, 1), asks


def test_settling_a_dense_group_counts_all_links():
    dice = np.random.default_rng(6)
    x = np.concatenate([dice.standard_normal((1, 12)) + 0.08 * dice.standard_normal((900, 12)), dice.standard_normal((900, 12))])[dice.permutation(1800)]
    x /= np.linalg.norm(x, axis=1)[:, None]
    weight = dice.integers(1, 4, 1800)
    linked, low = embed_dedup.settle(x, weight, 0.93, 256)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert (linked == near @ weight).all()
    reach = np.arange(1800)
    while (new := np.minimum(reach, np.where(near, reach[None, :], 1800).min(axis=1))).tolist() != reach.tolist():
        reach = new
    assert (low == reach).all()


def brute_links(rows: list[tuple]) -> dict[int, tuple[int, int, bool]]:
    ids = [r[0] for r in rows]
    x = {r[0]: np.array(r[1], np.float32).astype(np.float64) for r in rows if r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) and r[2] is not None}
    label, near = {r[0]: r[2] for r in rows}, {i: set() for i in ids}
    for a in x:
        for b in x:
            if a < b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93 * np.linalg.norm(x[a]) * np.linalg.norm(x[b]):
                near[a].add(b), near[b].add(a)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


def linked(frame) -> dict[int, tuple[int, int, bool]]:
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.dedup_embeddings(frame).collect()}


def test_embedding_dedup_against_brute_force(spark):
    rows = made() + ODD[:-1] + [(906, [0.0, 1.0], 0), (907, [0.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({"rep": F.lit("x"), "key": F.lit(1), "n": F.lit(None), "h1": F.lit(0)})
    assert linked(frame) == brute_links(rows)
    assert linked(spark.createDataFrame([], VECTORS)) == {}


def test_embedding_dedup_of_the_test_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    want = brute_links(rows)
    assert linked(table) == want


def planted(n: int, pairs: int, cosine: float, mean: float, dim: int = 64) -> np.ndarray:
    """``n`` unit rows with a mean cosine of ``mean``; each of the last ``pairs`` rows is near one of the first."""
    dice = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(np.sqrt(1 - mean) * unit(dice.standard_normal((n, dim))) + np.sqrt(mean) * unit(dice.standard_normal((1, dim))))
    own, aside = x[:pairs], dice.standard_normal((pairs, dim))
    x[n - pairs :] = cosine * own + np.sqrt(1 - cosine**2) * unit(aside - (aside * own).sum(axis=1)[:, None] * own)
    return x.astype(np.float32)


@pytest.mark.parametrize(("cosine", "mean"), [(0.94, 0.6), (0.931, 0.0)])
def test_planted_pairs_of_a_large_label_are_found(spark, tmp_path, cosine, mean):
    n, pairs = 120_000, 2000
    table = pa.table({"vec_id": np.arange(n), "embedding": list(planted(n, pairs, cosine, mean)), "label": np.ones(n, np.int32)})
    pq.write_table(table, tmp_path / "large.parquet", row_group_size=20_000)
    found = embed_dedup.dedup_embeddings(spark.read.parquet(f"file://{tmp_path}/large.parquet")).where("n_links > 0").select("vec_id", "component_id").toPandas()
    component = dict(zip(found["vec_id"], found["component_id"], strict=True))
    recall = np.mean([component.get(n - pairs + i, -1) == i for i in range(pairs)])
    print(f"recall {recall:.4f}")
    assert recall >= embed_dedup.RECALL - 0.001


def test_passes_with_range_edges_against_brute_force(spark):
    dice = np.random.default_rng(4)
    x = dice.standard_normal((1500, 16))
    x[750:] = x[:750] + 0.22 * dice.standard_normal((750, 16))
    rows = [(i, v.tolist(), i % 750 % 2) for i, v in enumerate(x.astype(np.float32))]
    found = embed_dedup.dedup_embeddings(spark.createDataFrame(rows, VECTORS), passes=1, window=64, exact=100)
    want, got = brute_links(rows), {r["vec_id"]: r["n_links"] for r in found.collect()}
    assert all(got[i] <= want[i][0] for i in want)
    plain = embed_dedup.dedup_embeddings(spark.createDataFrame(rows, VECTORS), passes=24, window=64, exact=100)
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in plain.collect()} == want


def test_repeated_ids_and_null_ids(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], VECTORS)
    found = sorted((tuple(r) for r in embed_dedup.dedup_embeddings(frame).collect()), key=str)
    assert found == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)], key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7), (None, 3)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_results_do_not_depend_on_a_size_that_switches(spark):
    dice = np.random.default_rng(8)
    x = dice.standard_normal((4000, 64))
    x[3940:] = x[:60] + 0.2 * dice.standard_normal((60, 64))
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x.astype(np.float32))], VECTORS)
    below, above = (sorted(map(tuple, embed_dedup.dedup_embeddings(frame, passes=1, window=64, exact=size).collect())) for size in (100, 16_384))
    assert below == above


def test_pairs_met_in_several_passes_and_tiles_count_once(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    dice = np.random.default_rng(14)
    x = dice.standard_normal((1200, 16))
    x[600:1000] = x[:400] + 0.22 * dice.standard_normal((400, 16))
    x[1000:] = x[7] + 0.1 * dice.standard_normal((200, 16))  # a dense group, wider than the window
    rows = [(i, v.tolist(), i % 600 % 2 if i < 1000 else 1) for i, v in enumerate(x.astype(np.float32))]
    want, frame = brute_links(rows), spark.createDataFrame(rows, VECTORS)
    for passes, window in ((40, 240), (1, 1200)):
        found = embed_dedup.dedup_embeddings(frame, passes=passes, window=window)
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found.collect()} == want


def test_a_dense_label_gets_a_reach_that_spans_it():
    dice = np.random.default_rng(15)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    near = unit(dice.standard_normal((1, 64)) + 0.05 * dice.standard_normal((16_384, 64)))
    assert embed_dedup.plan(near, 100_000) == (1, 100_000)
    passes, reach = embed_dedup.plan(unit(dice.standard_normal((16_384, 64))), 1_000_000)
    assert passes > 1 and reach < 100_000
