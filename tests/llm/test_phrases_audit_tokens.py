from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from corpus_cases import by_sql, clashing, documents, plain, prose
from pyspark.sql import functions as F

from barloom.llm import collocations, filter_audit, queries, token_files

LABELS = "doc_id long, quality int, toxic int"


def phrase_corpus() -> list[tuple]:
    dice = random.Random(5)
    words = ["new", "york", "times", "of", "the", "ü", "a\x00b", "漢", "x"]
    rows = [(i, " ".join(dice.choice(words[: 3 + i % 7]) + dice.choice(["", "", ", ", "\n", "\t", "!"]) for _ in range(60)), [None, "en", "und", "", "a\tb"][i % 5], "s", 1) for i in range(60)]
    rows += [(100 + i, "New York Times, Of The; x x x x x x x x x x x x", "en", "s", 1) for i in range(12)]
    return rows + [(200, None, "en", "s", 1), (201, "", "de", "s", 1), (202, " \t..\n", None, None, None), rows[0], (None, "new york times", "en", "s", 1)]


def brute_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    import re

    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang in n:
        found = []
        for g, a in f.items():
            if g[0] != lang or len(g) < 3 or a < least:
                continue
            if any(len(h) == len(g) + 1 and h[0] == lang and b >= least and g[1:] in (h[1:-1], h[2:]) and 100 * b >= 50 * a for h, b in f.items()):
                continue
            cuts = [(1_000_000 * a * a // (f[g[: k + 1]] * f[(lang, *g[k + 1 :])]), k, f[g[: k + 1]], f[(lang, *g[k + 1 :])]) for k in range(1, len(g) - 1)]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(g[1:]).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "bits"), [(10, 2000, None), (10, 7, 3 + 13), (3, 40, 18)])
def test_phrases_against_brute_force(spark, least, top, bits):
    rows = phrase_corpus()
    got = collocations.collocations(clashing(documents(spark, rows).repartition(3)), least=least, top=top, bits=bits).collect()
    assert sorted(tuple(r) for r in got) == brute_phrases(rows, least, top)


def test_phrases_against_sql(spark):
    docs = documents(spark, [r for r in phrase_corpus() if r[1] is None or "\x00" not in r[1]])
    got = collocations.collocations(docs).toPandas()
    assert len(got) > 10 and plain(got) == plain(by_sql(queries.ORACLE_SQL["op11_collocations"], documents=docs.toArrow()))


def test_phrases_with_forgotten_words_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "WORDS", 5)
    monkeypatch.setattr(collocations, "CHUNK", 50)
    rows = phrase_corpus()
    docs = documents(spark, rows).coalesce(1)
    assert sorted(tuple(r) for r in collocations.collocations(docs).collect()) == brute_phrases(rows, 10, 2000)


def test_buckets_prune_and_never_miss():
    dice = np.random.default_rng(1)
    buckets = collocations.Buckets(16, 10)
    keys = dice.integers(0, 1 << 16, 40_000).astype(np.uint64) % 5000
    for part in np.array_split(keys, 9):
        buckets.add(part)
    assert (buckets.counts.astype(int) == np.minimum(np.bincount(keys.astype(int), minlength=1 << 16), 10)).all()
    bitmap = np.packbits(buckets.counts >= 10, bitorder="little").tobytes()
    asked = np.arange(1 << 16).astype(np.uint64)
    assert (collocations.frequent(bitmap, asked) == (buckets.counts >= 10)).all()


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(10**13 + 7, 10**13 + 9, 10**13 + 11)], "a long, l long, r long")
    a, left, right = 10**13 + 7, 10**13 + 9, 10**13 + 11
    assert rows.select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0] == 10**6 * a * a // (left * right)


def audit_corpus() -> list[tuple]:
    rows = [(i, [prose(i, 260), "short " * 250, "LOUD Words " + prose(i, 210), "cost $5 " + prose(i, 200), "", None, "\t\n x"][i % 7], "en", [None, "", "a", "b"][i % 4], 1) for i in range(40)]
    rows += [(100 + i, rows[0][1], "en", "a", 1) for i in range(30)] + [rows[3], rows[3], (None, rows[0][1], "en", "c", 1), (None, None, "en", None, 1)]
    return rows + [(300, prose(9, 9000), "en", "b", 1), (-5, rows[2][1], "en", "b", 1)]


@pytest.mark.parametrize("task_bytes", [filter_audit.TASK_BYTES, 2000])
def test_audit_against_sql(spark, monkeypatch, task_bytes):
    monkeypatch.setattr(filter_audit.duplicate_rows, "__defaults__", (task_bytes,))  # many ranges, so groups cross their edges
    docs = documents(spark, audit_corpus())
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or None) for i in range(0, 120, 3)] + [(3, 0, 1), (None, 1, 1)], LABELS)
    got = filter_audit.audit(clashing(docs), labels).toPandas()
    assert plain(got) == plain(by_sql(queries.ORACLE_SQL["op12_filter_audit"], documents=docs.toArrow(), labels=labels.toArrow()))
    assert len(got) == 600 * len({r[3] or "" for r in audit_corpus()})


def test_duplicates_across_edges_against_brute_force(spark):
    dice = random.Random(2)
    rows = [(dice.randrange(400), dice.choice(["same", "other", "", str(i)]), i) for i in range(900)] + [(None, "same", 901)]
    df = spark.createDataFrame(rows, "doc_id long, t string, row long").repartition(7)
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    for task_bytes in (200, 3000, 1 << 20):
        got = {r["row"]: r["duplicate"] for r in filter_audit.duplicate_rows(df, "t", "doc_id", {"row": F.col("row")}, task_bytes).collect()}
        assert got == {i: d is not None and d > least[t] for d, t, i in rows}


def test_shared_fingerprints_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    rows = [(i, f"text {i % 5}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, t string, row long")
    got = {r["row"]: r["duplicate"] for r in filter_audit.duplicate_rows(df, "t", "doc_id", {"row": F.col("row")}, 1500).collect()}
    assert got == {i: i >= 5 for i in range(300)}


def test_audit_of_own_filters_and_of_nothing(spark):
    docs, labels = documents(spark, audit_corpus()), spark.createDataFrame([], LABELS)
    rows = filter_audit.audit(docs, labels, {"A": F.length("text") < F.col("n_chars") + 4}, columns=("n_chars",)).collect()
    assert {r["filter_order"] for r in rows} == {"AB", "BA"}
    for part in {r["part"] for r in rows}:
        mine = [r for r in rows if r["part"] == part]
        assert sum(r["removed"] for r in mine) == sum(r["shapley"] for r in mine if r["filter_order"] == "AB")
    assert filter_audit.audit(documents(spark, []), labels).count() == 0


def token_corpus() -> list[tuple]:
    dice = random.Random(3)
    marks = list("ab1,.' \n\t\x0b\x1c\x85\xa0 　é漢😀!") + ["'s", "<|endoftext|>", "don't ", "ab, cd.", "ab\ncd", "ab cd ef", ". ", "²", "½"]
    rows = [(i, "".join(dice.choice(marks) for _ in range(dice.randrange(30))), "en", "s", 1) for i in range(400)]
    rows += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (None, "no id", "en", "s", 1), (None, None, "en", "s", 1), (502, prose(1, 9000), "en", "s", 1), (7, rows[7][1], "en", "s", 1), (7, "another", "en", "s", 1), (-3, "negative", "en", "s", 1)]
    return rows + [(1000 + i, "the same text again", "en", "s", 1) for i in range(300)]


def brute_tokens(rows: list[tuple]) -> list[tuple]:
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(token_files.vocabulary_path()), [], 0
    for doc, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    want = []
    for doc, n, crc, ids in out:
        want.append((doc, start, n, crc, ids))
        start += n
    return want


@pytest.mark.parametrize("sizes", [{}, {"task_bytes": 3000, "roll_bytes": 900, "block_ids": 64}])
def test_token_files_round_trip(spark, tmp_path, sizes):
    rows = token_corpus()
    folder = f"file://{tmp_path}/ids"
    manifest = token_files.write_token_files(clashing(documents(spark, rows).repartition(5)), folder, **sizes)
    assert len(manifest.collect()) > (5 if sizes else 0)
    assert sorted(p.name for p in (tmp_path / "ids").iterdir() if p.suffix == ".rvb") == sorted(r["name"] for r in manifest.collect())
    got = token_files.read_token_files(spark, folder, with_ids=True).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(brute_tokens(rows), key=key)


def test_common_ids_take_a_byte(spark, tmp_path):
    manifest = token_files.write_token_files(documents(spark, [(i, prose(3, 2000), "en", "s", 1) for i in range(20)]), f"file://{tmp_path}/ids")
    total = manifest.agg(F.sum("ids"), F.sum("bytes")).first()
    assert total[1] < 1.3 * total[0]


def test_no_documents_and_damaged_files(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    token_files.write_token_files(documents(spark, []), folder)
    assert token_files.read_token_files(spark, folder).count() == 0
    control, data = token_files.encode_ranks(np.array([1, 300, 70_000, 1 << 30, 5], np.uint32))
    assert token_files.decode_ranks(control, data, 5).tolist() == [1, 300, 70_000, 1 << 30, 5]
    assert (len(control), len(data)) == (2, 1 + 2 + 3 + 4 + 1)
    with pytest.raises(ValueError):
        token_files.decode_ranks(control, data[:-1], 5)


def test_every_order_of_the_audit_removes_the_same_documents(spark):
    rows = queries.op12_filter_audit(spark, "/root/testdata/sf0.001").collect()
    for _, mine in itertools.groupby(sorted(rows, key=lambda r: r["part"]), key=lambda r: r["part"]):
        mine = list(mine)
        assert len({sum(r["removed"] for r in mine if r["filter_order"] == o) for o in {r["filter_order"] for r in mine}}) == 1
