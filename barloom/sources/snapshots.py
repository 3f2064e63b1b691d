"""Versions of a directory, published whole: data first, then a pointer row; the difference between two versions.

A version's rows are written to a folder of their own. Only when that write has been committed does a row naming the version,
its time and its number of entries join the pointer table, and readers follow pointers alone, so a publication that
dies on the way leaves the version before it current. Pointer rows are one per publication.

Defined cases: a folder without publications has no current version (ValueError); of two publications at one time the
larger version name is current; an empty directory can be published.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "version string, updated_at timestamp, entries long"


def publish(df: DataFrame, folder: str, updated_at: datetime) -> str:
    """Write ``df`` as a new version and make it current; gives the version's name."""
    version = f"{updated_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(f"{folder}/versions/{version}")
    spark = df.sparkSession
    whole = spark.read.schema(df.schema).parquet(f"{folder}/versions/{version}")
    pointer = whole.agg(F.lit(version).alias("version"), F.lit(updated_at).alias("updated_at"), F.count("*").alias("entries"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointers")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """Published versions: version, updated_at, entries."""
    try:
        return spark.read.schema(POINTER).parquet(f"{folder}/pointers")
    except AnalysisException as absent:
        if absent.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def read(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """The rows of a published version, by default the current one, with its updated_at."""
    found = versions(spark, folder)
    found = found if version is None else found.where(F.col("version") == version)
    row = found.orderBy(F.desc("updated_at"), F.desc("version")).first()
    if row is None:
        raise ValueError(f"no published version in {folder}")
    return spark.read.parquet(f"{folder}/versions/{row['version']}").withColumn("updated_at", F.lit(row["updated_at"]))


def changes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The key of each row that differs, change (added, removed, changed) and the names of the columns that do, sorted.

    Columns are those of both versions besides updated_at; nulls equal nulls, in keys too. Keys must be unique in a version.
    """
    fields = sorted((set(old.columns) & set(new.columns)) - {*key, "updated_at"})
    side = lambda df, name: df.select(*key, F.struct(F.lit(1).alias("_in"), *fields).alias(name))
    a, b = side(old, "_old"), side(new, "_new")
    both = a.alias("a").join(b.alias("b"), _same(key), "full_outer")
    was, now = F.col("_old"), F.col("_new")
    differs = F.filter(F.array(*(F.when(~was[c].eqNullSafe(now[c]), F.lit(c)) for c in fields)), lambda c: c.isNotNull()) if fields else F.array().cast("array<string>")
    rows = both.select(*(F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key), F.when(was.isNull(), "added").when(now.isNull(), "removed").otherwise("changed").alias("change"), F.when(was.isNotNull() & now.isNotNull(), differs).otherwise(F.array().cast("array<string>")).alias("fields"))
    return rows.where((F.col("change") != "changed") | (F.size("fields") > 0))


def _same(key: list[str]) -> Column:
    on = F.lit(True)
    for k in key:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on
