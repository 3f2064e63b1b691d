"""The line source against the permissive reader, whatever the splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from barloom.sources import lines, news

SCHEMA = "id string, n long, t string"


def folder(tmp_path, seed=1):
    dice = random.Random(seed)
    for f in range(3):
        out = []
        for i in range(200):
            row = json.dumps({"id": f"{f}-{i}", "n": i, "t": "漢é\n" * dice.randrange(9), "more": [1]}, ensure_ascii=dice.random() < 0.5)
            out.append(dice.choice([row, row, row, row[:-3], "", "   ", "no json", "\t" + row + " "]))
        (tmp_path / f"part-{f}.json").write_text("\n".join(out) + "\n" * (f % 2), encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    return str(tmp_path)


def plain(path):
    """Read in order, as one would without splits."""
    good, bad = [], []
    for f in range(3):
        for line in open(f"{path}/part-{f}.json", encoding="utf-8").read().split("\n"):
            if line.strip():
                try:
                    good.append(json.loads(line))
                except ValueError:
                    bad.append(line.strip())
    return good, bad


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_every_line_is_read_once(spark, tmp_path, split):
    path = folder(tmp_path)
    good, bad = plain(path)
    reader = lines.LinesReader({"path": f"file://{path}", "splitBytes": split})
    if split < 100:  # many splits: without Spark
        found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        assert [json.loads(r["line"]) for r in found if r["good"]] == good and [r["line"] for r in found if not r["good"]] == bad
        return
    rows = lines.tolerant_rows(spark, f"file://{path}", SCHEMA, split_bytes=split).collect()
    assert sorted(r["id"] for r in rows if r["_corrupt"] is None) == sorted(g["id"] for g in good)
    assert sorted(r["_corrupt"] for r in rows if r["_corrupt"] is not None) == sorted(bad)


def test_same_as_the_permissive_reader(spark, tmp_path):
    path = folder(tmp_path, 2)
    ours = lines.tolerant_rows(spark, path, SCHEMA, split_bytes=500)
    theirs = news.read_jsonl(spark, path, SCHEMA)
    key = lambda df: sorted(map(tuple, df.where("_corrupt is null").select("id", "n", "t").collect()))
    assert key(ours) == key(theirs.cache())
    assert lines.line_counts(lines.json_lines(spark, path)).first()["bad_lines"] == theirs.where("_corrupt is not null").count()


@pytest.mark.parametrize("limit", [1, 5, 170, 10_000])
def test_first_rows_in_order(spark, tmp_path, limit):
    path = folder(tmp_path, 3)
    good, _ = plain(path)
    got = lines.tolerant_rows(spark, path, SCHEMA, limit=limit, split_bytes=3000)
    assert [r["id"] for r in got.collect()] == [g["id"] for g in good][:limit] and got.where("_corrupt is not null").count() == 0


def test_splits_stop_early(spark, tmp_path):
    path = folder(tmp_path, 4)
    reader = lines.LinesReader({"path": path, "most": 2})
    assert all(sum(r["good"] for b in reader.read(p) for r in b.to_pylist()) == 2 for p in reader.partitions())


def test_odd_input(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b'{"id": "\xff"}\r\n{"id": "b"}\r\n5\n' + b'{"id": "' + b"x" * 3_000_000 + b'"}')
    rows = lines.tolerant_rows(spark, str(tmp_path), SCHEMA, split_bytes=1 << 20).select(F.length("id").alias("n"), "_corrupt").collect()
    assert sorted((r["n"] or 0) for r in rows) == [0, 0, 1, 3_000_000] and sum(r["_corrupt"] is not None for r in rows) == 1
    (tmp_path / "none").mkdir()
    assert lines.json_lines(spark, str(tmp_path / "none")).count() == 0 and lines.json_lines(spark, str(tmp_path / "gone")).count() == 0
    with pytest.raises(ValueError):
        lines.LinesReader({"path": "x", "splitBytes": 0})
