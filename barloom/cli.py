"""Batch entry points: features, scoring, directory refresh and export."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions.dates import iso
from .functions.text import record_id
from .operators import features, indicators, sentiment
from .session import session
from .sources import bars, directories, news

EXPORT = ["date", "open", "high", "low", "close", "volume", "sma5", "sma20", "sma60", "rsi14", "macd", "macd_signal", "macd_hist", "k", "d", "bias20"]


def export_frame(price_bars):
    """Bars with indicators, the sixteen columns of the export."""
    return indicators.indicators(bars.clean(price_bars)).withColumn("date", F.date_format("ts", "yyyy-MM-dd")).select("symbol", *EXPORT)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="barloom")
    what = parser.add_subparsers(dest="what", required=True)
    for name in ("score", "features", "directory", "export"):
        p = what.add_parser(name)
        p.add_argument("--input", required=True)
        p.add_argument("--output", required=True)
        if name == "score":
            p.add_argument("--high", type=float, default=20.0)
            p.add_argument("--low", type=float, default=-20.0)
            p.add_argument("--ab-ratio", type=float, default=None)
            p.add_argument("--ab-salt", default="ab")
            p.add_argument("--append", action="store_true")
        if name == "features":
            p.add_argument("--frame", choices=["day", "hour", "30min", "15min"], default="day")
            p.add_argument("--zone", default="UTC")
        if name == "directory":
            p.add_argument("--exchange", default="NASDAQ")
    args = parser.parse_args(argv)
    spark = session()
    if args.what == "score":
        rows = news.good_rows(news.read_jsonl(spark, args.input)).withColumn("id", F.coalesce("id", record_id(F.col("url"), F.col("headline"), F.col("published_at"))))
        rows = rows.withColumn("_text", sentiment.news_text(F.col("headline"), F.col("content")))
        scored = sentiment.with_lexicon(rows, "_text", sentiment.Lexicon(high=args.high, low=args.low)).drop("_text")
        scored = scored.withColumns({"sentiment_score": F.col("lexicon_score"), "sentiment_label": F.col("lexicon_label"), "sentiment_model": F.lit("lexicon")})
        if args.ab_ratio is not None:
            scored = sentiment.split_arms(scored, F.coalesce("id", "url", "headline"), args.ab_ratio, args.ab_salt)
        news.write_jsonl(scored, args.output, args.append)
    elif args.what == "features":
        rows = news.good_rows(news.read_jsonl(spark, args.input)).withColumn("ts", iso(F.col("published_at")))
        news.write_features(features.bucket_features(rows, args.frame, args.zone), args.output)
    elif args.what == "directory":
        directories.merged_files(directories.symbol_file(spark.read.text(args.input), args.exchange)).write.mode("overwrite").parquet(args.output)
    else:
        export_frame(spark.read.parquet(args.input)).orderBy("symbol", "date").write.mode("overwrite").option("header", True).csv(args.output)


if __name__ == "__main__":
    main()
