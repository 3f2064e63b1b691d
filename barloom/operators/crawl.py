"""From fetched pages and feeds to distinct, meaningful news records, with counts per source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import absolute_link, any_keyword, html_links, html_paragraphs, html_title, link_allowed, meaningful, record_id

#: Titles that say an article wasn't there.
JUNK_TITLES = ["google news", "access denied", "just a moment...", "404 not found", "untitled"]


def list_links(pages: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Distinct absolute links of list pages (source, url, html), in page order; at most ``most`` per source."""
    links = pages.select("source", "url", F.posexplode(html_links(F.col("html"))).alias("pos", "href"))
    links = links.select("source", "url", "pos", absolute_link(F.col("url"), F.col("href")).alias("link")).where(link_allowed(F.col("link"), include or [], exclude or []))
    first = links.groupBy("source", "link").agg(F.min(F.struct("url", "pos")).alias("at"))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("at", "link")))
    return (ranked if most is None else ranked.where(F.col("n") <= most)).select("source", "link", "n")


def articles(pages: DataFrame) -> DataFrame:
    """Title and paragraphs of article pages (source, url, html)."""
    return pages.select("source", "url", html_title(F.col("html")).alias("headline"), html_paragraphs(F.col("html")).alias("content"))


def with_status(records: DataFrame, keywords: list[str] | None = None, least: int = 40, junk: list[str] | None = None) -> DataFrame:
    """Records with id and status: kept, filtered or duplicate (the same id seen in an earlier source or url)."""
    published = F.col("published_at") if "published_at" in records.columns else F.lit(None).cast("string")
    df = records.withColumn("id", record_id(F.col("url"), F.col("headline"), published))
    good = meaningful(F.col("headline"), F.col("content"), junk or JUNK_TITLES, least) & any_keyword(F.concat_ws(" ", "headline", "content"), keywords or [])
    nth = F.row_number().over(Window.partitionBy("id", "_good").orderBy("source", "url"))
    df = df.withColumn("_good", good).withColumn("_n", nth)
    return df.withColumn("status", F.when(~F.col("_good"), "filtered").when(F.col("_n") > 1, "duplicate").otherwise("kept")).drop("_good", "_n")


def source_counts(records: DataFrame) -> DataFrame:
    """fetched, filtered, deduped and kept per source."""
    count = lambda s: F.count_if(F.col("status") == s)
    return records.groupBy("source").agg(F.count("*").alias("fetched"), count("filtered").alias("filtered"), count("duplicate").alias("deduped"), count("kept").alias("kept"))


def ticker_news(news: DataFrame, ticker: str, most: int = 20) -> DataFrame:
    """News of a ticker whatever its market suffix, newest first."""
    root = ticker.upper().split(".")[0]
    return news.where(F.split(F.upper("ticker"), r"\.").getItem(0) == root).orderBy(F.desc("published_at"), "id").limit(most)


def newest_news(news: DataFrame, most: int = 20) -> DataFrame:
    """The newest news of every ticker, market suffixes aside, with their place; null dates are the oldest, ties go to the
    smaller id.

    Spark cuts each task's rows to ``most`` a ticker before they are shuffled (up to 1,000, the default of
    spark.sql.optimizer.windowGroupLimitThreshold), so a ticker with most of the news sends no more than others.
    """
    root = F.split(F.upper("ticker"), r"\.").getItem(0)
    place = F.row_number().over(Window.partitionBy("root").orderBy(F.desc_nulls_last("published_at"), "id"))
    return news.withColumn("root", root).withColumn("place", place).where(F.col("place") <= most)
