"""Versions are current only once they are whole; differences between them."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from barloom.sources import snapshots

ROWS = "code string, name string, n int"


def test_a_killed_publication_leaves_the_old_version(spark, tmp_path):
    folder = f"file://{tmp_path}/d"
    with pytest.raises(ValueError):
        snapshots.read(spark, folder)
    df = spark.createDataFrame([("a", "A", 1), ("b", None, 2)], ROWS)
    first = snapshots.publish(df, folder, datetime(2024, 1, 1))
    broken = df.withColumn("name", F.udf(lambda x: 1 / 0)("name"))
    with pytest.raises(Exception):  # noqa: B017 whatever Spark makes of it
        snapshots.publish(broken, folder, datetime(2024, 1, 2))
    df.write.parquet(f"{folder}/versions/20240103T000000-nopointer")  # killed between data and pointer
    now = snapshots.read(spark, folder)
    assert now.count() == 2 and now.first()["updated_at"] == datetime(2024, 1, 1) and snapshots.versions(spark, folder).count() == 1
    snapshots.publish(df.where("false"), folder, datetime(2024, 1, 4))
    assert snapshots.read(spark, folder).count() == 0 and snapshots.read(spark, folder, first).count() == 2


def test_changes(spark):
    old = spark.createDataFrame([("a", "A", 1), ("b", None, 2), ("c", "C", 3), (None, "N", 4), ("e", None, None)], ROWS)
    new = spark.createDataFrame([("a", "A", 1, "x"), ("b", "B", 3, "x"), ("d", "D", 3, "x"), (None, "M", 4, "x"), ("e", None, None, "x")], f"{ROWS}, more string")
    got = {r["code"]: (r["change"], r["fields"]) for r in snapshots.changes(old, new, ["code"]).collect()}
    assert got == {"b": ("changed", ["n", "name"]), "c": ("removed", []), "d": ("added", []), None: ("changed", ["name"])}
    assert snapshots.changes(old, old, ["code"]).count() == 0 and snapshots.changes(old.where("false"), old, ["code", "name"]).count() == 5
