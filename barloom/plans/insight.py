"""The stock insight: indicators, signals, risk, forecast, news and actions of all symbols in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import actions, forecast, indicators, risk, signals
from ..operators.features import news_summary
from ..session import stored

#: The market index that a market's symbols are compared with.
BENCHMARKS = {"TW": "^TWII", "TWO": "^TWII", "US": "^GSPC"}


def benchmark_of(market: Column) -> Column:
    """The benchmark's symbol; null for other markets."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in BENCHMARKS.items() for x in pair)), market)


def insight(bars: DataFrame, news: DataFrame | None = None, benchmark: DataFrame | None = None, dividends: DataFrame | None = None, horizon: int = 7, with_forecast: bool = True) -> DataFrame:
    """One row per symbol. Parts that aren't asked for are not computed. news: symbol, sentiment_score, sentiment_label.

    Bars, benchmark and dividends are computed once and stored, since each part reads the bars anew.
    """
    bars = stored(bars, "insight-bars")
    snap = indicators.latest(indicators.snapshots(indicators.indicators(bars)))
    if news is not None:
        mood = news_summary(news, "symbol").select("symbol", F.col("records").alias("sentiment_records"), F.col("score_mean").alias("sentiment_score"), F.col("dominant_label").alias("sentiment_label"))
        snap = snap.join(mood, "symbol", "left")
    if with_forecast:
        f = forecast.forecast(bars, horizon).select("symbol", F.col("change_pct").alias("forecast_change_pct"), F.col("accuracy_pct").alias("forecast_accuracy"), F.col("ensemble").alias("forecast_path"))
        snap = snap.join(f, "symbol", "left")
    read = signals.headline(signals.market_read(signals.with_signals(snap)))
    out = read.join(risk.risk_metrics(bars), "symbol").join(risk.drawdowns(bars), "symbol").join(risk.monthly_win_rate(bars), "symbol").join(risk.price_changes(bars), "symbol")
    if benchmark is not None:
        out = out.join(risk.beta(bars, stored(benchmark, "insight-benchmark")).drop("n"), "symbol", "left")
    if dividends is not None:
        as_of = F.lit(bars.agg(F.max(F.to_date("ts"))).first()[0])
        out = out.join(actions.dividend_summary(stored(dividends, "insight-dividends"), as_of, indicators.latest(bars)).drop("close"), "symbol", "left")
    return out


def payload(rows: DataFrame) -> DataFrame:
    """Each row as a JSON document, the form in which the service answers."""
    return rows.select("symbol", F.to_json(F.struct(*rows.columns)).alias("json"))


def compare(bars: DataFrame, symbols: list[str], interval: str = "1d") -> DataFrame:
    """Up to four symbols ranked by total return, each with its own rebased series."""
    mine = bars.where(F.col("symbol").isin(symbols[:4]))
    path = risk.rebased(mine).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("series"))
    return risk.ranking(risk.risk_metrics(mine, interval)).join(path, "symbol", "left")


def compare_requests(requests: DataFrame, bars: DataFrame, interval: str = "1d", most: int = 4) -> DataFrame:
    """Comparisons asked for as text (request, tickers): the first ``most`` tickers between commas of either width.

    One row a request: status, count of tickers with bars, the best by total return (ties to the one named first), each
    one's return and last close in the order asked, and the tickers that failed. Null and blank requests and those whose
    tickers all fail have the status error. A ticker named twice counts twice. Symbols' figures are computed once for all
    requests.
    """
    names = F.filter(F.transform(F.split(F.coalesce("tickers", F.lit("")), "[,\uff0c]"), lambda x: F.trim(x)), lambda x: x != "")
    asked = requests.select("request", F.posexplode_outer(F.slice(names, 1, most)).alias("pos", "ticker"))
    figures = risk.risk_metrics(bars, interval).select("symbol", "total_return_pct")
    last = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("latest_price"))
    known = last.join(figures, "symbol", "left").withColumnRenamed("symbol", "ticker").withColumn("found", F.lit(True))
    rows = asked.join(known, "ticker", "left")
    entry = F.struct("pos", "ticker", "total_return_pct", "latest_price")
    nested = rows.groupBy("request").agg(
        F.count("found").alias("count"),
        F.max_by("ticker", F.when(F.col("total_return_pct").isNotNull(), F.struct("total_return_pct", -F.col("pos")))).alias("best"),
        F.array_sort(F.collect_list(F.when(F.col("found"), entry))).alias("series"),
        F.array_sort(F.collect_list(F.when(F.col("found").isNull() & F.col("ticker").isNotNull(), F.struct("pos", "ticker")))).alias("lost"),
    )
    return nested.select("request", F.when(F.col("count") > 0, "success").otherwise("error").alias("status"), "count", "best", "series", F.col("lost.ticker").alias("failed"))
