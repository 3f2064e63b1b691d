from __future__ import annotations

import os
import zlib
from collections import defaultdict

import numpy as np
import pytest
from corpus_cases import by_sql, clashing, corpus, documents, plain
from pyspark.sql import functions as F

from barloom.llm import mixing, packing, queries


def test_mix_agrees_with_sql_on_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.mix_report(clashing(docs)).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    assert plain(rows) == plain(by_sql(queries.ORACLE_SQL["op1_mix_sources"], documents=docs.toArrow()))
    assert len(rows) == len(corpus())


def test_mix_takes_near_the_target_and_is_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, again = (mixing.mix_report(docs).toPandas().sort_values("doc_id", ignore_index=True) for _ in range(2))
    assert first.equals(again)
    assert (first["taken"] <= 3 * first["size"]).all()
    by = first.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), largest=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["largest"] + 0.05 * by["target"]).all()


def test_mixed_corpus_holds_the_copies_of_the_report(spark):
    docs = clashing(documents(spark))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    copies = {r[0]: r[1] for r in mixing.mix_report(docs).groupBy("doc_id").agg({"copies": "sum"}).collect()}
    found = defaultdict(int)
    for r in mixed.select("doc_id").collect():
        found[r[0]] += 1
    assert dict(found) == {k: v for k, v in copies.items() if v}


def test_ceilings_share_the_excess_by_weight(spark):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    target = {r["source"]: r["target"] for r in mixing.source_targets(totals).collect()}
    assert target["a"] == 30.0  # weight 1 of 6 would give 335
    assert target["b"] == pytest.approx(1980 * 2 / 5) and target[None] == pytest.approx(1980 * 3 / 5)


def test_empty_tables(spark):
    assert mixing.mix_report(documents(spark, [])).count() == 0
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    assert packing.pack_documents(documents(spark, [])).count() == 0


def round_trip(rows, docs: dict[tuple, int]) -> None:
    """Pieces put together are the documents' ids, and sequences are gapless and little padded."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = defaultdict(int)
    for (doc, text), n in docs.items():
        want[doc, (*tokenizer.encode(text or "", add_special_tokens=False).ids, 1)] += n
    cuts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) > 0
        assert r["ids_crc32"] == zlib.crc32(np.asarray(r["ids"], "<u4").tobytes())
        cuts[r["doc_id"], r["doc_tokens"]].append((r["start"], r["ids"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for (doc, total), pieces in cuts.items():
        mine = {ids: n for (d, ids), n in want.items() if d == doc and len(ids) == total}
        assert len(mine) == 1
        (ids, n), seen = *mine.items(), np.zeros(total, int)
        for start, part in pieces:
            assert tuple(part) == ids[start : start + len(part)]
            seen[start : start + len(part)] += 1
        assert (seen == n).all()
    assert {(d, len(i)) for d, i in want} == set(cuts)
    used = padded = 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and len(pieces) <= 2048
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 2048)
    assert padded <= 1.02 * used


def test_packing_round_trip(spark):
    docs = defaultdict(int)
    for doc_id, text, *_ in corpus():
        docs[doc_id, text] += 1
    round_trip(packing.pack_documents(clashing(documents(spark)), with_ids=True).collect(), docs)


def test_packing_round_trip_of_the_test_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(table, with_ids=True).collect()
    round_trip(rows, {(r["doc_id"], r["text"]): 1 for r in table.collect()})


@pytest.mark.parametrize("text", ["", " ", "A.b, c.", "a ,b..", "İstanbul ΣΑΣ ǅ", "é ẛ̣", "<|endoftext|> x", "don't 3,000.5", "　漢字。かな", "x" * 3000, "a b c\x85d", "👩‍👩‍👧 ﻿z\x00y", "\x1c\x1d a\x0bb"])
def test_chunks_give_the_tokenizers_ids(text):
    encoder = packing.encoder(packing.vocabulary_path())
    want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def test_examples_keep_every_limit(spark):
    dice = np.random.default_rng(1)
    need = [(i, int(dice.integers(1, 900)), 1 + i % 3, None if i % 7 == 0 else int(dice.integers(0, 400))) for i in range(400)] + [(400, 5000, 1, 1)]
    rows = spark.createDataFrame(need, "name long, tokens long, segments long, loss long").coalesce(1)
    limits = [1000.0, 6.0, 450.0]
    bins, found = defaultdict(lambda: np.zeros(3)), packing.pack_examples(rows, "name", ["tokens", "segments", "loss"], limits).collect()
    assert len(found) == 401 and {r["name"] for r in found if r["bin_id"] is None} == {400}
    for r in found:
        if r["bin_id"] is not None:
            bins[r["bin_id"]] += np.array([x or 0 for x in need[r["name"]][1:]])
    assert all((b <= limits).all() for b in bins.values())
    least = max(sum((x[k] or 0) for x in need[:400]) / limits[k - 1] for k in (1, 2, 3))
    assert len(bins) <= 1.25 * least



def packed(sizes, **limits):
    packer, out = packing.SequencePacker(**limits), []
    for i, n in enumerate(sizes):
        out += packer.add(i, np.full(n, i, "<u4").tobytes())
    out += packer.finish()
    seen = defaultdict(list)
    for pieces in out:
        for doc, start, ids, count in pieces:
            assert count == sizes[doc] and len(ids) > 0
            seen[doc].append((start, len(ids) // 4))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n
    return out


def padding(sequences, length: int = 2048) -> float:
    used = [packing.tokens(s) for s in sequences]
    assert max(used) <= length
    return sum(0 if n & (n - 1) == 0 else length - n for n in used) / sum(used)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [5], [1, 2, 3, 4, 5], [1, 700], [1500], [1030], [3, 2047], [64, 63]])
def test_short_documents_are_packed_with_little_padding(sizes):
    dice = np.random.default_rng(2)
    assert padding(packed(dice.choice(sizes, 20_000 if max(sizes) < 100 else 3000).tolist())) < 0.02


def test_a_million_short_documents_are_little_padded():
    assert padding(packed(np.random.default_rng(5).integers(1, 6, 1_000_000).tolist())) < 0.02


def test_segment_and_loss_limits_hold():
    sizes = np.random.default_rng(3).integers(1, 60, 4000).tolist()
    loss = lambda ids: int((np.frombuffer(ids, "<u4") % 3 > 0).sum())
    found = packed(sizes, segments=48, loss=loss, loss_limit=1200)
    assert all(len(s) <= 48 and sum(loss(p[2]) for p in s) <= 1200 for s in found)
    assert padding(found) < 0.02


def test_conversations_keep_tokens_turns_and_loss(spark):
    rows = [(i, t, ["system", "user", "assistant", None][(i + t) % 4], "word " * ((7 * i + t) % 90)) for i in range(300) for t in range(i % 6 + 1)]
    rows += [(None, 0, "user", None), (None, None, None, "x"), (900, 0, "assistant", "word " * 5000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"tokens": F.lit("x"), "bin_id": F.lit(1)})
    found, encode = packing.pack_conversations(turns).collect(), packing.encoder(packing.vocabulary_path()).encode
    want = defaultdict(lambda: [0, 0, 0])
    for conv, _, role, text in rows:
        n = len(encode(text or "")) // 4 + 1
        want[conv] = [a + b for a, b in zip(want[conv], (n, 1, n if role == "assistant" else 0), strict=True)]
    assert {r["conv_id"]: [r["tokens"], r["turns"], r["loss_tokens"]] for r in found} == want and len(found) == len(want)
    bins = defaultdict(lambda: np.zeros(3))
    for r in found:
        if r["bin_id"] is None:
            assert r["tokens"] > 2048 or r["turns"] > 16 or r["loss_tokens"] > 1536
        else:
            bins[r["bin_id"]] += [r["tokens"], r["turns"], r["loss_tokens"]]
    assert all((b <= [2048, 16, 1536]).all() for b in bins.values())
    assert packing.pack_conversations(turns.limit(0)).count() == 0


def test_encoding_stays_on_the_core_of_its_task():
    import subprocess
    import sys

    code = "import os; os.environ.pop('TOKENIZERS_PARALLELISM', None); from barloom.llm import packing; packing.ChunkEncoder(packing.vocabulary_path()).encode(' '.join(f'a{i}$$ b{i}%%' for i in range(20000))); print(len(os.listdir('/proc/self/task')))"
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path), "OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1", "ARROW_DEFAULT_MEMORY_POOL": "system"})
    assert int(run.stdout) <= 2
