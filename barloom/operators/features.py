"""Sentiment per ticker and time bucket, and summaries of news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import bucket, bucket_end, offset_label

_KINDS = ("positive", "neutral", "negative")


def aggregates(digits: int | None = 6) -> list[Column]:
    """count, mean, population deviation, extremes and label shares of sentiment_score and sentiment_label."""
    out = {"news_count": F.count("*"), "score_mean": F.avg("sentiment_score"), "score_std": F.stddev_pop("sentiment_score"), "score_min": F.min("sentiment_score"), "score_max": F.max("sentiment_score")}
    out |= {f"{k}_ratio": F.avg(F.coalesce(F.col("sentiment_label") == k, F.lit(False)).cast("double")) for k in _KINDS}
    return [(v if k == "news_count" or digits is None else F.round(v, digits)).alias(k) for k, v in out.items()]


def bucket_features(news: DataFrame, frame: str, zone: str = "UTC") -> DataFrame:
    """One row per ticker and local bucket of ``ts``; rows without a time are left out."""
    timed = news.where("ts is not null").withColumn("_b", bucket(F.col("ts"), frame, zone))
    f = timed.groupBy("ticker", "_b").agg(*aggregates())
    return f.select("ticker", F.lit(frame).alias("timeframe"), F.lit(zone).alias("timezone"), offset_label(F.col("_b"), zone).alias("bucket_start"), offset_label(bucket_end(F.col("_b"), frame), zone).alias("bucket_end"), *f.columns[2:])


def news_summary(news: DataFrame, *by: str) -> DataFrame:
    """Mean score, label shares, polarity balance and the dominant label."""
    n = F.greatest(F.count("*"), F.lit(1))
    share = lambda k: F.count_if(F.col("sentiment_label") == k) / n
    s = news.groupBy(*by).agg(F.count("*").alias("records"), F.round(F.coalesce(F.avg("sentiment_score"), F.lit(0.0)), 2).alias("score_mean"), *(F.round(share(k), 4).alias(f"{k}_ratio") for k in _KINDS))
    p, g, u = (F.col(f"{k}_ratio") for k in ("positive", "negative", "neutral"))
    dominant = F.when((p > g) & (p >= u), "positive").when((g > p) & (g >= u), "negative").otherwise("neutral")
    return s.withColumns({"polarity_balance": F.round(p - g, 4), "dominant_label": dominant})


def dashboard_summary(news: DataFrame, *by: str) -> DataFrame:
    """Unrounded shares; any label that isn't positive or negative counts as neutral."""
    known = F.when(F.col("sentiment_label").isin("positive", "negative"), F.col("sentiment_label")).otherwise("neutral")
    return news.withColumn("_l", known).groupBy(*by).agg(F.count("*").alias("records"), F.avg("sentiment_score").alias("score_mean"), *(F.avg((F.col("_l") == k).cast("double")).alias(f"{k}_ratio") for k in _KINDS))
