"""News from line-delimited JSON, feeds and source configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import rfc822
from ..functions.text import filled


def read_jsonl(spark: SparkSession, path: str, schema: str = schemas.NEWS) -> DataFrame:
    """Every line as a row; what isn't JSON keeps its text in _corrupt. Blank lines give no row."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.where("_corrupt is null").drop("_corrupt")


def bad_lines(rows: DataFrame) -> DataFrame:
    """Count of malformed lines; the rows are read whole, since a corrupt-only scan would parse nothing."""
    return rows.select(F.when(F.col("_corrupt").isNotNull(), 1).otherwise(0).alias("bad"), *[c for c in rows.columns if c != "_corrupt"]).agg(F.sum("bad").alias("bad_lines"))


def read_feed(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Items of RSS files: headline, url, published time; items without title or link are left out."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, pubDate string, description string").load(path)
    rows = items.where("title is not null and trim(title) <> '' and link is not null and trim(link) <> ''")
    return rows.select(F.lit(source).alias("source"), F.trim("title").alias("headline"), F.coalesce("description", F.lit("")).alias("content"), F.trim("link").alias("url"), rfc822(F.col("pubDate")).alias("ts"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature files, with what isn't a number as 0."""
    text = spark.read.option("header", True).csv(path)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c)
    return text.select(*(F.col(c) for c in text.columns[:5]), F.coalesce(F.col("news_count").try_cast("double").cast("bigint"), F.lit(0).cast("bigint")).alias("news_count"), *(number(c) for c in text.columns[6:]))


#: What a source's entry needn't say.
SOURCE_DEFAULTS = {
    "name": "unknown_source", "type": "rss", "enabled": False, "list_url": "", "language": "zh-TW", "timezone": "Asia/Taipei", "max_items": 100,
    "timeout_seconds": 15, "retry_count": 2, "rate_limit_seconds": 1.0, "article_link_selector": "a", "title_selector": "h1", "time_selector": "time",
    "content_selector": "p", "rss_use_article_content": False, "content_extract_mode": "auto", "content_extract_fallback": True, "content_extract_timeout_seconds": 25,
}


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Source configurations with defaults, from a list or an object with ``sources``; those without a list page are left out."""
    whole = spark.read.text(path, wholetext=True).select(F.when(F.ltrim("value").startswith("["), F.concat(F.lit('{"sources":'), "value", F.lit("}"))).otherwise(F.col("value")).alias("v"))
    s = whole.select(F.explode(F.from_json("v", schemas.SOURCE_CONFIG)["sources"]).alias("s")).select("s.*")
    s = s.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in SOURCE_DEFAULTS.items()}).withColumn("type", F.lower("type"))
    return s.where("list_url <> ''")


def runtime_sources(sources: DataFrame, ticker: str = "", query: str = "", most: int = 0, keywords: list[str] | None = None, mode: str = "source", fallback: bool = True, timeout: int = 0) -> DataFrame:
    """Sources for one run: templates filled in, those disabled that need a ticker or query which isn't given.

    ``most`` above 0 lowers max_items, ``keywords`` join a source's own, ``mode`` other than "source" and a ``timeout``
    above 0 replace the source's, and ``fallback`` can only be switched off.
    """
    templates = F.concat_ws(" ", "name", "list_url", "base_url")
    lacks = (F.contains(templates, F.lit("{ticker}")) if not ticker else F.lit(False)) | (templates.rlike(r"\{query(_encoded)?\}") if not query else F.lit(False))
    fill = lambda c: filled(c, F.lit(ticker), F.lit(query))
    own = {c: fill(F.col(c)) for c in ("name", "list_url", "base_url")} | {c: F.transform(c, fill) for c in ("ticker_keywords", "article_link_include", "article_link_exclude")}
    out = sources.withColumn("enabled", F.col("enabled") & ~lacks).withColumns(own)
    extra = [k.strip() for k in keywords or [] if k.strip()]
    if extra:
        out = out.withColumn("ticker_keywords", F.array_distinct(F.concat(F.coalesce("ticker_keywords", F.array().cast("array<string>")), F.array(*map(F.lit, extra)))))
    out = out.withColumn("max_items", F.least("max_items", F.lit(most))) if most > 0 else out
    out = out if mode == "source" else out.withColumn("content_extract_mode", F.lit(mode))
    out = out if fallback else out.withColumn("content_extract_fallback", F.lit(False))
    return out.withColumn("content_extract_timeout_seconds", F.lit(timeout)) if timeout > 0 else out


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_features(df: DataFrame, path: str) -> None:
    """One header per part, rows in order of ticker and bucket."""
    df.orderBy("ticker", "bucket_start").write.mode("overwrite").option("header", True).csv(path)
