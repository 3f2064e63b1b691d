"""Each stage of the corpus pipeline, on what the stage before it kept, against plain Python or SQL."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from corpus_cases import by_sql
from test_dedup import brute_classes
from test_mixing_packing import round_trip

from barloom.llm import packing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before the first stage and after each stage but the last."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def pairs(df) -> Counter:
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_stages_return_the_columns_of_documents(kept):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(df.columns == kept[0].columns for df in kept)


def test_quality_stage_keeps_what_the_ranker_accepts(spark, kept):
    predicted = {r["doc_id"]: r["predicted"] for r in queries.op7_quality_rank(spark, SF).collect()}
    assert pairs(kept[1]) == Counter({k: n for k, n in pairs(kept[0]).items() if predicted[k[0]]})
    assert 0 < sum(predicted.values()) < len(predicted) and quality.CUT == 0.3


def test_line_stage_against_sql(kept):
    rows = by_sql(queries.ORACLE_SQL["op6_line_dedup"], documents=kept[1].toArrow())
    want = dict(zip(rows["doc_id"], rows["kept_sha256"], strict=True))
    assert {d: hashlib.sha256((t or "").encode()).hexdigest() for d, t in pairs(kept[2])} == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].where("n_chars is not null and text is not null").collect())


def test_near_dedup_stage_leaves_one_of_each_class(kept):
    classes = brute_classes([(r["doc_id"], r["text"]) for r in kept[2].collect()], 0.8)
    groups = defaultdict(set)
    for d, c in classes.items():
        groups[c].add(d)
    left = {d for d, _ in pairs(kept[3])}
    assert left == {min(g) for g in groups.values()}


def test_mixing_stage_against_sql(kept):
    rows = by_sql(queries.ORACLE_SQL["op1_mix_sources"], documents=kept[3].toArrow())
    want = {d: t // s for d, s, t in zip(rows["doc_id"], rows["size"], rows["taken"], strict=True) if t}
    found = Counter(d for d, t in pairs(kept[4]).elements() if t and t.split())
    assert dict(found) == want


def test_packing_stage_and_run(spark, kept):
    rows = corpus_pipeline.packing_stage(spark, kept[4], SF)
    round_trip(packing.pack_documents(kept[4], with_ids=True).collect(), pairs(kept[4]))
    key = lambda df: Counter((r["doc_id"], r["doc_tokens"]) for r in df.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).withColumnsRenamed({"max(doc_tokens)": "doc_tokens"}).collect())
    assert key(rows) == key(corpus_pipeline.run(spark, SF))
