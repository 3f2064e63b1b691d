"""Helpers that the corpus operators share: scratch tables, guarded broadcasts, stable hashes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows may be broadcast (rows here are tens of bytes).
BROADCAST_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; executors must be able to reach it, so there is no default."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and spark.sparkContext.master.startswith("local"):
        path = "file://" + tempfile.mkdtemp(prefix="barloom-")  # one machine, so its own folder is shared
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def materialize(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast when its counted ``rows`` stay within ``limit``; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def spread_join(rows: DataFrame, facts: DataFrame, key: str, count: str, by: str, hot: int) -> DataFrame:
    """Inner join of many ``rows`` with the one row of ``facts`` of their ``key``, whose ``count`` says how many they are.

    Keys with more than ``hot`` rows are dealt over several tasks by the hash of ``by``. The caller chooses ``hot`` so that
    few keys can exceed it (all rows / ``hot`` at most), since these are broadcast.
    """
    salts = F.when(F.col(count) > hot, F.ceil(F.col(count) / F.lit(hot))).otherwise(F.lit(1)).cast("long")
    heavy = facts.where(F.col(count) > hot).select(key, salts.alias("_salts"))
    left = rows.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(by), F.col("_salts"))).cast("long")).drop("_salts")
    right = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left.join(right, [key, "_salt"]).drop("_salt")


def scan_cpu_partitions(spark: SparkSession, at_least: int = 12) -> int:
    """Shuffle partitions of the session, which the deployment sizes with the data."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def hash128(col: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: a 128-bit key for tables that must not confuse two texts."""
    return F.xxhash64(col), F.xxhash64(F.lit(0x5BD1E995), col)


def null_safe_key(col: str | Column) -> Column:
    """A string that is never null and tells null from every value, for plain equi-joins."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))
