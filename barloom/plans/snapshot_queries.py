"""Registered queries of published directory versions: the parts as instruments, and a later version of them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import snapshots
from .queries import query, t


def published(spark, sf) -> str:
    """Two versions in a folder, and a third whose pointer was never written."""
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    folder = shared_folder(spark, "directory")
    first = p.where(k % 10 != 3).select(k.cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    later = p.where(k % 11 != 5).select(k.cast("string").alias("code"), F.when(k % 7 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), F.when(k % 13 != 0, F.col("p_brand")).alias("brand"), F.col("p_size").alias("size"))
    snapshots.publish(first, folder, datetime(2024, 1, 1))
    snapshots.publish(later, folder, datetime(2024, 1, 8, 6, 30))
    first.write.parquet(f"{folder}/versions/20240115T000000-unfinished")
    return folder


@query("""SELECT p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 10 = 3 THEN 'added' WHEN p_partkey % 11 = 5 THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN p_partkey % 10 = 3 OR p_partkey % 11 = 5 THEN '' ELSE concat_ws(',', CASE WHEN p_partkey % 13 = 0 THEN 'brand' END, CASE WHEN p_partkey % 7 = 0 AND upper(p_name) <> p_name THEN 'name' END) END AS fields
FROM part WHERE (p_partkey % 10 = 3) <> (p_partkey % 11 = 5) OR (p_partkey % 10 <> 3 AND p_partkey % 11 <> 5 AND (p_partkey % 13 = 0 OR (p_partkey % 7 = 0 AND upper(p_name) <> p_name)))""")
def directory_changes(spark, sf):
    folder = published(spark, sf)
    first = snapshots.versions(spark, folder).orderBy("updated_at").first()["version"]
    found = snapshots.changes(snapshots.read(spark, folder, first), snapshots.read(spark, folder), ["code"])
    return found.select("code", "change", F.array_join("fields", ",").alias("fields"))


@query("""SELECT '2024-01-08 06:30' AS updated_at, count(*) AS entries, count(*) FILTER (WHERE p_partkey % 13 <> 0) AS brands, 2::BIGINT AS versions FROM part WHERE p_partkey % 11 <> 5""")
def directory_current(spark, sf):
    folder = published(spark, sf)
    n = snapshots.versions(spark, folder).count()
    return snapshots.read(spark, folder).agg(F.date_format(F.max("updated_at"), "yyyy-MM-dd HH:mm").alias("updated_at"), F.count("*").alias("entries"), F.count("brand").alias("brands"), F.lit(n).cast("long").alias("versions"))
