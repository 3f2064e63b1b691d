"""Price bars from trade rows, and their cleaning and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OHLC = ["open", "high", "low", "close"]
#: The longest period that an interval can be asked for, shortest periods first.
PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max"]
LONGEST = {"1m": "5d", "2m": "1mo", "5m": "1mo", "15m": "1mo", "30m": "1mo", "60m": "2y", "90m": "1mo", "1h": "2y"}


def to_bars(trades: DataFrame, symbol: Column, ts: Column, price: Column, size: Column, order: Column) -> DataFrame:
    """One bar per symbol and time; ``order`` (unique) tells the first and the last trade."""
    t = trades.select(symbol.alias("symbol"), ts.alias("ts"), price.alias("p"), size.alias("v"), order.alias("k"))
    aggs = [F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.sum("v").cast("bigint").alias("volume")]
    return t.groupBy("symbol", "ts").agg(*aggs)


def lineitem_bars(lineitem: DataFrame) -> DataFrame:
    """Daily bars per return flag, priced per unit."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return to_bars(lineitem, F.col("l_returnflag"), F.to_date("l_shipdate").cast("timestamp"), F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), key)


def event_bars(events: DataFrame, frame: str = "hour") -> DataFrame:
    """Bars of event values per event type."""
    return to_bars(events, F.col("event_type"), F.date_trunc(frame, F.col("ts").cast("timestamp")), F.col("value"), F.lit(1), F.col("event_id"))


def resample(bars: DataFrame, frame: str) -> DataFrame:
    """Bars of a longer frame (week, month, ...); a bar is dated by the start of its frame."""
    return bars.groupBy("symbol", F.date_trunc(frame, "ts").alias("bucket")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume")
    ).withColumnRenamed("bucket", "ts")


def clean(bars: DataFrame, intraday: bool = False) -> DataFrame:
    """Rows with a time and all four prices, rounded to cents, volume 0 where unknown, and the public date label."""
    label = "yyyy-MM-dd HH:mm" if intraday else "yyyy-MM-dd"
    good = bars.na.drop(subset=["ts", *OHLC])
    return good.withColumns({c: F.round(c, 2) for c in OHLC} | {"volume": F.coalesce(F.col("volume").try_cast("bigint"), F.lit(0).cast("bigint")), "date": F.date_format("ts", label)})


def clamp_period(period: Column, interval: Column) -> Column:
    """The period, or the longest that the interval allows."""
    rank = F.create_map(*(x for i, p in enumerate(PERIODS) for x in (F.lit(p), F.lit(i))))
    longest = F.create_map(*(F.lit(x) for kv in LONGEST.items() for x in kv))
    most = F.try_element_at(longest, interval)
    return F.when(F.try_element_at(rank, period) > F.try_element_at(rank, most), most).otherwise(period)


def first_available(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """For each request (query, candidates), the first candidate symbol that has bars, and how many were tried."""
    have = bars.select("symbol").distinct()
    tried = requests.select("query", F.posexplode("candidates").alias("pos", "symbol"))
    found = tried.join(have, "symbol").groupBy("query").agg(F.min(F.struct("pos", "symbol")).alias("m"))
    return requests.join(found, "query", "left").select("query", F.col("m.symbol").alias("symbol"), F.coalesce(F.col("m.pos") + 1, F.size("candidates")).alias("tried"))


def by_symbol(*, backwards: bool = False) -> Window:
    return Window.partitionBy("symbol").orderBy(F.desc("ts") if backwards else "ts")
