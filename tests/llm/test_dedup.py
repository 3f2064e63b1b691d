from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_cases import by_sql, clashing, corpus, documents, plain, prose
from pyspark.sql import functions as F

from barloom.llm import line_dedup, minhash, queries, suffix_dedup


def brute_repeats(rows: list[tuple], length: int) -> list[tuple]:
    least: dict[bytes, int] = {}
    raws = [(d, (t or "").encode()) for d, t in rows]
    for d, raw in raws:
        for i in range(len(raw) - length + 1) if d is not None else ():
            least[raw[i : i + length]] = min(d, least.get(raw[i : i + length], d))
    out = []
    for d, raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1) if d is not None else ():
            if least[raw[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-1]])[:-1]).sum()) if len(raw) else 0
        kept = bytes(b for b, g in zip(raw, gone[:-1], strict=True) if not g)
        out.append((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def suffix_rows(docs) -> list[tuple]:
    return sorted(map(tuple, suffix_dedup.remove_repeats(docs).collect()), key=str)


def test_suffix_dedup_against_brute_force(spark):
    docs = documents(spark)
    assert suffix_rows(clashing(docs)) == brute_repeats([r[:2] for r in corpus()], 50)


def test_suffix_dedup_of_periodic_and_overlapping_texts(spark):
    dice = np.random.default_rng(4)
    base = bytes(dice.integers(97, 99, 400)).decode()
    texts = ["ab" * 200, "ba" * 90 + "x" * 120, "x" * 60, base, base[37:260], base[:49], "q" + base[100:150], base[100:150] + "é" * 40, "é" * 70, "\x00" * 80, "\x00" * 55 + "ÿ", "ÿ" * 60]
    rows = [(7 * (k % 5) + k, t) for k, t in enumerate(texts * 2)] + [(3, None), (None, "x" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_rows(docs) == brute_repeats(rows, 50)


def test_suffix_dedup_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert suffix_rows(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows, 50)


def test_suffix_array_sorts_suffixes():
    dice = np.random.default_rng(0)
    for size, letters in ((1, 1), (2, 1), (50, 2), (300, 3), (1000, 200)):
        text = np.append(dice.integers(1, letters + 1, size), 0)
        raw = text.tolist()
        assert suffix_dedup.suffix_array(text, 10**6).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])  # noqa: B023


def test_line_dedup_agrees_with_sql_on_awkward_rows(spark):
    rows = [r for r in corpus() if r[0] is not None][:-2] + [(60, "x\n\n", "en", "a", 1), (61, "\n" + "é" * 20, "en", "a", 1), (62, "\t" + "é" * 20 + "\r", "en", "a", 1), (63, "é" * 20 + "\n" + "é" * 20, "en", "a", 1)]
    rows += [(70 + i, "A LINE OF LETTERS AND İ, some long ", "en", "a", 1) for i in range(3)]
    docs = documents(spark, rows)
    kept = line_dedup.dedup_lines(clashing(docs))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = kept.select("doc_id", F.col("_ld_lines").alias("n_lines"), F.col("_ld_dropped").alias("n_dropped"), digest.alias("kept_sha256")).toPandas()
    assert plain(found) == plain(by_sql(queries.ORACLE_SQL["op6_line_dedup"], documents=docs.toArrow()))
    assert found["n_dropped"].sum() >= 8


def test_counting_at_once_gives_the_index_result(spark):
    rows = lambda keep: sorted(map(tuple, line_dedup.dedup_lines(clashing(documents(spark)), keep_index=keep).select("doc_id", "text", "_ld_lines", "_ld_dropped").collect()), key=str)
    assert rows(True) == rows(False)


def test_line_dedup_of_repeated_rows_and_null_ids(spark):
    line = "a line that is long enough to count"
    docs = spark.createDataFrame([(1, line), (1, line), (None, line), (None, line), (2, line)], "doc_id long, text string")
    assert [r["_ld_dropped"] for r in line_dedup.dedup_lines(docs).collect()] == [0] * 5
    docs = docs.union(spark.createDataFrame([(9, line)], docs.schema))
    assert {(r["doc_id"], r["_ld_dropped"]) for r in line_dedup.dedup_lines(docs).collect()} == {(1, 1), (2, 1), (None, 0), (9, 0)}
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_cuckoo_filter_never_forgets_a_key_and_takes_deletions():
    dice = np.random.default_rng(2)
    keys = dice.integers(-(2**63), 2**63, (2, 30_000))
    found = line_dedup.CuckooFilter(capacity=2000)
    found.insert(keys[0, :20_000], keys[1, :20_000])
    assert found.contains(keys[0, :20_000], keys[1, :20_000]).all()
    assert found.contains(keys[0, 20_000:], keys[1, 20_000:]).mean() < 0.02
    found.delete(keys[0, :10_000], keys[1, :10_000])
    assert found.contains(keys[0, 10_000:20_000], keys[1, 10_000:20_000]).all()
    assert found.contains(keys[0, :10_000], keys[1, :10_000]).mean() < 0.02
    copy = line_dedup.CuckooFilter.from_rows(found.to_rows())
    assert copy.contains(keys[0, 10_000:20_000], keys[1, 10_000:20_000]).all()


def test_index_forgets_what_it_learned(spark):
    docs = documents(spark).where("doc_id is not null")
    old, new = docs.where("doc_id < 23"), docs.where("doc_id >= 23")
    index = line_dedup.LineIndex.build(line_dedup.lines_of(old))
    both = index.insert(line_dedup.lines_of(new))
    rows = lambda x: sorted(map(tuple, x.repeated().select("h1", "n_docs", "keeper").collect()))
    assert rows(both) == rows(line_dedup.LineIndex.build(line_dedup.lines_of(docs)))
    back = both.delete(new.select("doc_id"))
    assert rows(back) == rows(index)
    every = line_dedup.lines_of(old).select("h1", "h2").distinct()
    assert back.maybe(every).count() == every.count() == back.keys
    again = both.insert(line_dedup.lines_of(old))  # known documents change nothing
    assert rows(again) == rows(both) and again.keys == both.keys
    assert rows(back.insert(line_dedup.lines_of(new))) == rows(both)


def test_shards_follow_the_keys(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    lines = lambda a, b: line_dedup.lines_of(spark.createDataFrame([(i, f"a line of number {i} that is long enough") for i in range(a, b)], "doc_id long, text string"))
    index = line_dedup.LineIndex.build(lines(0, 60))
    grown = index.insert(lines(60, 300))
    assert (index.shards, grown.shards, grown.keys) == (3, 15, 300)
    assert grown.maybe(lines(0, 300).select("h1", "h2")).count() == 300
    less = grown.delete(spark.range(0, 250).withColumnRenamed("id", "doc_id"))
    assert less.keys == 50 and less.maybe(lines(250, 300).select("h1", "h2")).count() == 50
    assert less.maybe(lines(0, 250).select("h1", "h2")).count() < 10


def brute_classes(rows: list[tuple], similarity: float) -> dict:
    """Smallest doc_id reachable over pairs whose multisets of five-word shingles are similar."""
    sets = {}
    for d, t in rows:
        words = (t or "").encode()
        for blank in b"\t\n\x0b\x0c\r":
            words = words.replace(bytes([blank]), b" ")
        words = [w for w in words.split(b" ") if w]
        if d is not None and words and (d not in sets):
            sets[d] = Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    holders = defaultdict(list)
    for d in ids:
        for s in sets[d]:
            holders[s].append(d)
    for a in ids:
        shared = Counter(b for s in sets[a] for b in holders[s] if b > a)
        for b in shared:
            both = sum((sets[a] & sets[b]).values())
            if both >= similarity * (sum(sets[a].values()) + sum(sets[b].values()) - both) - 1e-9:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) if d in parent else d for d, _ in rows}


def minhash_rows(docs) -> dict:
    found = minhash.near_duplicates(docs).collect()
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["class_id"]) for r in found)
    return {r["doc_id"]: r["class_id"] for r in found}


def test_near_duplicates_against_brute_force(spark):
    rows = [r[:2] for r in corpus()]
    assert minhash_rows(clashing(documents(spark))) == brute_classes(rows, 0.8)
    kept = minhash.keep_one_of_each(clashing(documents(spark)))
    assert kept.columns == clashing(documents(spark)).columns
    assert kept.where("doc_id in (31, 32, 33)").count() == 0 and kept.where("doc_id is null or doc_id in (30, 40, 41, 42)").count() == 5
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_of_every_text_of_a_repeated_id(spark):
    one, two, three = prose(700, 120), prose(701, 120), prose(702, 120)
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, prose(703, 120)), (5, three), (6, two), (6, three), (7, three + " more")]
    for dealt in (rows, rows[::-1]):
        found = minhash_rows(spark.createDataFrame(dealt, "doc_id long, text string").repartition(3))
        assert found == {i: 4 if i == 4 else 1 for i in range(1, 8)}


def test_near_duplicates_of_the_test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, found = brute_classes([tuple(r) for r in docs.collect()], 0.8), minhash_rows(docs)
    assert len(set(want.values())) < len(want)
    assert sum(want[d] != found[d] for d in want) <= 1  # a pair at exactly 0.8 is missed once in 3,000


def test_large_groups_compare_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = " ".join(f"w{i}" for i in range(120))
    rows = [(i, base + f" end{i}") for i in range(40)] + [(100, "w " * 30)]
    found = minhash_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == {i: 0 for i in range(40)} | {100: 100}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_signatures_agree_as_often_as_sets_do(share):
    dice, n, k = np.random.default_rng(8), 400, 1500
    every = dice.integers(0, 2**63, 2 * n).astype(np.uint64)
    shift = round(n * (1 - share) / (1 + share))
    cells = np.concatenate([every[:n], every[shift : shift + n]])
    marks = minhash.signatures(cells, np.repeat([0, 1], n), 2, k)
    assert abs((marks[0] == marks[1]).mean() - share) < 0.05


def test_a_line_in_every_document_sends_few_rows_to_its_bucket():
    dice = np.random.default_rng(1)
    line = "this line stands in every document of the corpus, word by word and without any change at all. "
    texts = ["".join(map(chr, dice.integers(97, 123, 60))) + line for _ in range(500)]
    frame = suffix_dedup.pd.DataFrame({"rk": np.arange(500), "doc_id": np.arange(500), "text": texts})
    sent = suffix_dedup.pd.concat(suffix_dedup._send_anchors(iter([frame]), 1, 50, 16))
    kept = [suffix_dedup._unpack(b) for b in sent["blob"][sent["bucket"] == 0]]
    mark = np.concatenate([k[2] for k in [(0, 0, np.frombuffer(x[2], np.uint8).reshape(-1, 6).copy().view("S6").ravel()) for x in kept]])
    assert np.unique(mark, return_counts=True)[1].max() <= 2
    shared = sum(len(suffix_dedup._unpack(b)[0]) for b in sent["blob"][sent["bucket"] < 0])
    assert shared >= 500
