"""Structured Streaming forms of the news pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from .. import schemas
from ..functions.dates import iso
from ..operators.features import aggregates


def landing(spark: SparkSession, folder: str, schema: str = schemas.NEWS, files: int = 100) -> DataFrame:
    """New files of a landing folder, with the record's time as ``ts``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)
    return rows.withColumn("ts", iso(F.col("published_at")))


def deduplicated(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each id once within the watermark, so that state stays bounded."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def bucket_stream(stream: DataFrame, span: str = "15 minutes", late: str = "1 hour", watermarked: bool = False) -> DataFrame:
    """Sentiment features per ticker and tumbling window."""
    timed = stream if watermarked else stream.withWatermark("ts", late)
    f = timed.groupBy("ticker", F.window("ts", span).alias("w")).agg(*aggregates())
    return f.select("ticker", F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"), *f.columns[2:])


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, append it as Parquet and stop."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
