"""Registered queries of the analytics operators over the test tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import actions, crawl, features, forecast, indicators, risk, sentiment, signals, symbols, windows
from ..session import stored
from ..sources import bars as bar_source
from ..sources import directories
from . import insight

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bar_source.lineitem_bars(t(spark, sf, "lineitem"))


def r(df: DataFrame, *skip: str, digits: int = 4) -> DataFrame:
    """Doubles rounded, so that order of summation doesn't show; dates in place of midnight timestamps."""
    out = {c: F.round(c, digits) for c, k in df.dtypes if k == "double" and c not in skip} | {c: F.to_date(c) for c, k in df.dtypes if k == "timestamp"}
    return df.withColumns(out)


BARS = """WITH RECURSIVE bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS ts, arg_min(px, k) AS open, max(px) AS high, min(px) AS low,
    arg_max(px, k) AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS px, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem)
  GROUP BY 1, 2)"""
W = "(PARTITION BY symbol ORDER BY ts)"


@query(BARS + " SELECT symbol, ts, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, round(close, 8) AS close, volume FROM bars")
def bars_daily(spark, sf):
    return r(bars(spark, sf), digits=8)


@query(BARS + """ SELECT symbol, CAST(date_trunc('week', ts) AS DATE) AS ts, round(arg_min(open, ts), 8) AS open, round(max(high), 8) AS high,
  round(min(low), 8) AS low, round(arg_max(close, ts), 8) AS close, CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY 1, 2""")
def bars_weekly(spark, sf):
    return r(bar_source.resample(bars(spark, sf), "week"), digits=8)


@query("""SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS label, round(arg_min(value, event_id), 4) AS open,
  round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, event_id), 4) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def bars_hourly_events(spark, sf):
    b = bar_source.event_bars(t(spark, sf, "events"))
    return r(b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"), "open", "high", "low", "close", "volume"))


@query(BARS + " SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN abs(close * 100 - floor(close * 100) - 0.5) > 1e-6 THEN round(close, 2) END AS close, volume FROM bars")
def clean_bars(spark, sf):
    raw = bars(spark, sf).withColumn("tie", F.abs(F.col("close") * 100 - F.floor(F.col("close") * 100) - 0.5) <= 1e-6)  # engines round ties differently
    return bar_source.clean(raw).select("symbol", "date", F.when(~F.col("tie"), F.col("close")).alias("close"), "volume")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN i = '15m' AND p IN ('3mo', '6mo', '1y') THEN '1mo' WHEN i = '1m' AND p <> '1d' THEN '5d' ELSE p END AS period FROM (
  SELECT *, CASE l_linenumber % 3 WHEN 0 THEN '15m' WHEN 1 THEN '1m' ELSE '1d' END AS i, CASE l_orderkey % 4 WHEN 0 THEN '1d' WHEN 1 THEN '3mo' WHEN 2 THEN '1y' ELSE '6mo' END AS p FROM lineitem)""")
def clamp_period(spark, sf):
    i = F.when(F.col("l_linenumber") % 3 == 0, "15m").when(F.col("l_linenumber") % 3 == 1, "1m").otherwise("1d")
    p = F.when(F.col("l_orderkey") % 4 == 0, "1d").when(F.col("l_orderkey") % 4 == 1, "3mo").when(F.col("l_orderkey") % 4 == 2, "1y").otherwise("6mo")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", bar_source.clamp_period(p, i).alias("period"))


@query("""SELECT p_partkey AS query, CASE WHEN p_partkey % 3 = 0 THEN 'A' WHEN p_partkey % 3 = 1 THEN 'N' END AS symbol,
  CASE p_partkey % 3 WHEN 0 THEN 1 ELSE 2 END AS tried FROM part""")
def first_available(spark, sf):
    k = F.col("p_partkey")
    asks = t(spark, sf, "part").select(k.alias("query"), F.when(k % 3 == 0, F.array(F.lit("A"), F.lit("N"))).when(k % 3 == 1, F.array(F.lit("X"), F.lit("N"))).otherwise(F.array(F.lit("X"), F.lit("Y"))).alias("candidates"))
    return bar_source.first_available(asks, bars(spark, sf))


def sma(n: int, col: str = "close", least: int | None = None) -> str:
    f = f"PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN count({col}) OVER ({f}) >= {least or n} THEN avg({col}) OVER ({f}) END"


def sd(n: int) -> str:
    f = f"PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW"
    return f"CASE WHEN count(close) OVER ({f}) >= {n} THEN stddev_samp(close) OVER ({f}) END"


def windowed(spark, sf, *cols: str, digits: int = 4) -> DataFrame:
    return r(indicators.windowed(bars(spark, sf), digits).select("symbol", "ts", *cols), digits=digits)


@query(BARS + " SELECT symbol, ts, " + ", ".join(f"round({sma(n)}, 4) AS sma{n}" for n in indicators.SMA) + " FROM bars")
def sma_all(spark, sf):
    return windowed(spark, sf, *(f"sma{n}" for n in indicators.SMA))


@query(BARS + f" SELECT symbol, ts, round({sma(20, 'volume', 5)}, 4) AS volume_ma20 FROM bars")
def volume_ma20(spark, sf):
    return windowed(spark, sf, "volume_ma20")


@query(BARS + f""", b AS (SELECT symbol, ts, {sma(20)} AS m, {sd(20)} AS s FROM bars)
SELECT symbol, ts, round(m, 3) AS bb_mid, round(m + 2 * s, 3) AS bb_upper, round(m - 2 * s, 3) AS bb_lower, round(4 * s / nullif(m, 0) * 100, 3) AS bb_width FROM b""")
def bollinger(spark, sf):
    return windowed(spark, sf, "bb_mid", "bb_upper", "bb_lower", "bb_width", digits=3)


@query(BARS + f" SELECT symbol, ts, round((close - m) / nullif(m, 0) * 100, 4) AS bias20 FROM (SELECT *, {sma(20)} AS m FROM bars)")
def bias20(spark, sf):
    return windowed(spark, sf, "bias20")


@query(BARS + f""" SELECT symbol, ts, round(sum(CASE WHEN high = low THEN 0.0::DOUBLE ELSE ((close - low) - (high - close)) / (high - low) * volume END) OVER {W}, 2) AS ad FROM bars""")
def ad_line(spark, sf):
    return windowed(spark, sf, "ad", digits=2)


@query(BARS + f""" SELECT symbol, ts, sum(coalesce(sign(close - p), 0) * volume) OVER {W} AS obv FROM (SELECT *, lag(close) OVER {W} AS p FROM bars)""")
def obv(spark, sf):
    return windowed(spark, sf, "obv", digits=2)


@query(BARS + f""" SELECT symbol, ts, round(greatest(high - low, coalesce(abs(high - p), 0), coalesce(abs(low - p), 0)), 8) AS tr FROM (SELECT *, lag(close) OVER {W} AS p FROM bars)""")
def true_range(spark, sf):
    return r(bars(spark, sf).select("symbol", "ts", indicators.true_range().alias("tr")), digits=8)


# Every recursive indicator in one pass over the bars in order.
EWM = BARS + f""",
q AS MATERIALIZED (SELECT symbol, ts, close AS c, row_number() OVER {W} AS rn, close - lag(close) OVER {W} AS mv,
  greatest(high - low, coalesce(abs(high - lag(close) OVER {W}), 0), coalesce(abs(low - lag(close) OVER {W}), 0)) AS tr,
  CASE WHEN row_number() OVER {W} >= 9 THEN (close - min(low) OVER n) / nullif(max(high) OVER n - min(low) OVER n, 0) * 100 END AS rsv
  FROM bars WINDOW n AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)),
e AS (
  SELECT symbol, rn, c AS e12, c AS e26, 0.0::DOUBLE AS sg, NULL::DOUBLE AS g, NULL::DOUBLE AS l, tr AS a, NULL::DOUBLE AS k, NULL::DOUBLE AS d FROM q WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, e12, e26, sg + (e12 - e26 - sg) * 0.2::DOUBLE, g, l, a, k, CASE WHEN rn = 17 THEN k WHEN rn > 17 THEN d + (k - d) / 3.0::DOUBLE END FROM (
    SELECT q.symbol, q.rn, e.e12 + (c - e.e12) * 2.0::DOUBLE / 13 AS e12, e.e26 + (c - e.e26) * 2.0::DOUBLE / 27 AS e26, e.sg, e.d,
      CASE WHEN e.g IS NULL THEN greatest(mv, 0) ELSE e.g + (greatest(mv, 0) - e.g) / 14.0::DOUBLE END AS g,
      CASE WHEN e.l IS NULL THEN greatest(-mv, 0) ELSE e.l + (greatest(-mv, 0) - e.l) / 14.0::DOUBLE END AS l,
      e.a + (tr - e.a) / 14.0::DOUBLE AS a, CASE WHEN e.k IS NULL THEN rsv ELSE e.k + (rsv - e.k) / 3.0::DOUBLE END AS k
    FROM e JOIN q ON q.symbol = e.symbol AND q.rn = e.rn + 1)),
x AS (SELECT q.symbol, q.ts, q.rn, e12, e26, e12 - e26 AS macd, sg, e12 - e26 - sg AS hist,
  CASE WHEN q.rn >= 15 THEN CASE WHEN l = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + g / l) END END AS rsi,
  CASE WHEN q.rn >= 17 THEN k END AS k, CASE WHEN q.rn >= 25 THEN d END AS d, CASE WHEN q.rn >= 14 THEN a END AS atr FROM e JOIN q ON q.symbol = e.symbol AND q.rn = e.rn)"""


def recursive(spark, sf, *cols: str) -> DataFrame:
    return r(indicators.recursive(bars(spark, sf), 3).select("symbol", "ts", *cols), digits=3)


@query(EWM + " SELECT symbol, ts, round(e12, 3) AS ema12, round(e26, 3) AS ema26 FROM x")
def ema_12_26(spark, sf):
    return recursive(spark, sf, "ema12", "ema26")


@query(EWM + " SELECT symbol, ts, round(macd, 3) AS macd, round(sg, 3) AS macd_signal, round(hist, 3) AS macd_hist FROM x")
def macd(spark, sf):
    return recursive(spark, sf, "macd", "macd_signal", "macd_hist")


@query(EWM + " SELECT symbol, ts, round(rsi, 3) AS rsi14 FROM x")
def rsi14(spark, sf):
    return recursive(spark, sf, "rsi14")


@query(EWM + " SELECT symbol, ts, round(k, 3) AS k, round(d, 3) AS d FROM x")
def kd(spark, sf):
    return recursive(spark, sf, "k", "d")


@query(EWM + " SELECT symbol, ts, round(atr, 3) AS atr14 FROM x")
def atr14(spark, sf):
    return recursive(spark, sf, "atr14")


SNAP = EWM + f""",
v AS (SELECT *, close / nullif(lag(close) OVER {W}, 0) - 1 AS mv, sum(coalesce(sign(close - p), 0) * volume) OVER {W} AS obv0,
  {sma(5)} AS m5, {sma(20)} AS m20, {sma(60)} AS m60, {sd(20)} AS s20, {sma(20, 'volume', 5)} AS v20 FROM (SELECT *, lag(close) OVER {W} AS p FROM bars)),
w AS (SELECT v.symbol, v.ts, close, volume, round(m5, 2) AS sma5, round(m20, 2) AS sma20, round(m60, 2) AS sma60, round(m20 + 2 * s20, 2) AS bb_upper, round(m20 - 2 * s20, 2) AS bb_lower,
  round(4 * s20 / nullif(m20, 0) * 100, 2) AS bb_width, round((close - m20) / nullif(m20, 0) * 100, 2) AS bias20, round(obv0, 2) AS obv, round(v20, 2) AS volume_ma20, round(mv * 100, 2) AS change_pct,
  round(rsi, 2) AS rsi14, round(hist, 4) AS hist, round(k, 2) AS k, round(d, 2) AS d, max(close) OVER y AS hi, min(close) OVER y AS lo,
  CASE WHEN count(mv) OVER z >= 5 THEN round(stddev_samp(mv) OVER z * sqrt(252.0) * 100, 2) END AS volatility, row_number() OVER (PARTITION BY v.symbol ORDER BY v.ts) AS sample
  FROM v JOIN x ON v.symbol = x.symbol AND v.ts = x.ts
  WINDOW y AS (PARTITION BY v.symbol ORDER BY v.ts ROWS BETWEEN 249 PRECEDING AND CURRENT ROW), z AS (PARTITION BY v.symbol ORDER BY v.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, lag(sma20) OVER {W} AS sma20_prev, lag(hist) OVER {W} AS hist_prev, lag(k) OVER {W} AS k_prev, lag(d) OVER {W} AS d_prev, lag(obv, 5) OVER {W} AS obv_5ago,
  round(CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END, 2) AS position_52w FROM w)"""


def snaps(spark, sf) -> DataFrame:
    return indicators.snapshots(indicators.indicators(bars(spark, sf)))


@query(SNAP + """ SELECT symbol, ts, round(close, 4) AS close, volume, sma5, sma20, sma60, bb_upper, bb_lower, bias20, volume_ma20, change_pct, rsi14, k, d, volatility, position_52w, sample
  FROM s QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""")
def snapshot(spark, sf):
    cols = "symbol ts close volume sma5 sma20 sma60 bb_upper bb_lower bias20 volume_ma20 change_pct rsi14 k d volatility position_52w sample".split()
    return r(indicators.latest(snaps(spark, sf)).select(*cols))


@query(SNAP + " SELECT symbol, ts, sma20_prev, k_prev, d_prev, obv_5ago, round(hi, 2) AS high_52w, round(lo, 2) AS low_52w FROM s")
def snapshot_history(spark, sf):
    return r(snaps(spark, sf).select("symbol", "ts", "sma20_prev", "k_prev", "d_prev", "obv_5ago", "high_52w", "low_52w"))


CASES = {
    "trend": "CASE WHEN sma20 IS NULL THEN NULL WHEN sma5 > sma20 AND sma20 > sma60 AND close > sma20 THEN 88 WHEN sma5 < sma20 AND sma20 < sma60 AND close <= sma20 THEN -88 WHEN close > sma20 AND coalesce(sma20 > sma20_prev, false) THEN 65 WHEN close <= sma20 AND NOT coalesce(sma20 > sma20_prev, false) THEN -65 ELSE 1040 END",
    "rsi": "CASE WHEN rsi14 IS NULL THEN NULL WHEN rsi14 >= 80 THEN -75 WHEN rsi14 >= 70 THEN -55 WHEN rsi14 <= 20 THEN 75 WHEN rsi14 <= 30 THEN 55 WHEN rsi14 >= 55 THEN 45 WHEN rsi14 <= 45 THEN -45 ELSE 1030 END",
    "macd": "CASE WHEN hist IS NULL THEN NULL WHEN hist_prev <= 0 AND hist > 0 THEN 85 WHEN hist_prev >= 0 AND hist < 0 THEN -85 WHEN hist > 0 THEN CASE WHEN hist > hist_prev THEN 70 ELSE 50 END ELSE CASE WHEN hist < hist_prev THEN -70 ELSE -50 END END",
    "kd": "CASE WHEN k IS NULL OR d IS NULL THEN NULL WHEN k_prev <= d_prev AND k > d AND k < 50 THEN 80 WHEN k_prev >= d_prev AND k < d AND k > 50 THEN -80 WHEN k >= 80 AND d >= 80 THEN -60 WHEN k <= 20 AND d <= 20 THEN 60 WHEN k > d THEN 45 ELSE -45 END",
    "bollinger": "CASE WHEN bb_upper > bb_lower THEN CASE WHEN (close - bb_lower) / (bb_upper - bb_lower) * 100 >= 100 THEN -65 WHEN (close - bb_lower) / (bb_upper - bb_lower) * 100 <= 0 THEN 65 WHEN bb_width < 8 THEN 1055 WHEN (close - bb_lower) / (bb_upper - bb_lower) * 100 >= 70 THEN 50 WHEN (close - bb_lower) / (bb_upper - bb_lower) * 100 <= 30 THEN -50 ELSE 1030 END END",
    "bias": "CASE WHEN bias20 IS NULL THEN NULL WHEN bias20 >= 12 THEN -70 WHEN bias20 <= -12 THEN 70 WHEN bias20 >= 3 THEN 40 WHEN bias20 <= -3 THEN -40 ELSE 1025 END",
    "volume": "CASE WHEN volume <> 0 AND volume_ma20 <> 0 THEN CASE WHEN volume / volume_ma20 >= 1.8 AND coalesce(change_pct, 0) >= 0 THEN 80 WHEN volume / volume_ma20 >= 1.8 THEN -75 WHEN volume / volume_ma20 <= 0.6 THEN 1045 WHEN obv > obv_5ago THEN 45 ELSE 1030 END END",
    "position_52w": "CASE WHEN position_52w >= 90 THEN 65 WHEN position_52w <= 10 THEN -65 WHEN position_52w >= 65 THEN 45 WHEN position_52w <= 35 THEN -45 ELSE 1025 END",
    "volatility": "CASE WHEN volatility IS NULL THEN NULL WHEN volatility >= 45 THEN -60 WHEN volatility <= 15 THEN 1035 ELSE 1025 END",
}


def _signal(key: str) -> None:
    """One query per rule: signed strength, with 1000 added where it is neutral."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        s = signals.rules()[key]
        code = F.when(s["dir"] == 0, 1000 + s["strength"]).otherwise(s["dir"] * s["strength"])
        return r(snaps(spark, sf).select("symbol", "ts", code.cast("double").alias("signal")))

    query(SNAP + f" SELECT symbol, ts, CAST({CASES[key]} AS DOUBLE) AS signal FROM s", f"sig_{key}")(run)


for _key in CASES:
    _signal(_key)

READ = SNAP + ", c AS (SELECT symbol, ts, " + ", ".join(f"{sql} AS {k}" for k, sql in CASES.items()) + " FROM s), m AS (SELECT symbol, ts, [" + ", ".join(f"{{'w': {signals.WEIGHTS[k]}::DOUBLE, 'v': {k}}}" for k in CASES) + "] AS all_s FROM c), n AS (SELECT symbol, ts, list_filter(all_s, lambda z: z.v IS NOT NULL) AS p FROM m), o AS (SELECT symbol, ts, list_sum(list_transform(p, lambda z: CASE WHEN z.v >= 1000 THEN 0 ELSE z.v / 100.0::DOUBLE * z.w END)) / list_sum(list_transform(p, lambda z: z.w)) * 100 AS score, len(list_filter(p, lambda z: z.v > 0 AND z.v < 1000)) AS bullish, len(list_filter(p, lambda z: z.v < 0)) AS bearish, len(list_filter(p, lambda z: z.v >= 1000)) AS neutral, len(p) AS n FROM n)"


@query(READ + """ SELECT symbol, ts, round(score, 1) AS score, bullish, bearish, neutral,
  CASE WHEN score >= 35 THEN 'bullish' WHEN score >= 12 THEN 'slightly_bullish' WHEN score <= -35 THEN 'bearish' WHEN score <= -12 THEN 'slightly_bearish' ELSE 'neutral' END AS stance,
  CAST(round_even(least(90.0, 30 + coalesce(abs(bullish - bearish)::DOUBLE / nullif(bullish + bearish, 0), 0) * 45 + least(n, 10) * 1.2::DOUBLE), 0) AS INTEGER) AS confidence FROM o""")
def market_read(spark, sf):
    m = signals.market_read(signals.with_signals(snaps(spark, sf)))
    return r(m.select("symbol", "ts", "score", "bullish", "bearish", "neutral", "stance", "confidence"))


@query()
def market_headline(spark, sf):
    return r(signals.headline(signals.market_read(signals.with_signals(indicators.latest(snaps(spark, sf))))).select("symbol", "ts", "headline", "risk_note"))


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN p = 0 THEN 50 + CAST(round_even(least(35.0, abs(s)), 0) AS INTEGER) WHEN p = 1 THEN -50 - CAST(round_even(least(35.0, abs(s)), 0) AS INTEGER) ELSE 1030 END AS DOUBLE) AS signal
  FROM (SELECT o_orderkey, o_orderkey % 4 AS p, CAST(o_orderkey % 97 - 48 AS DOUBLE) AS s FROM orders)""")
def sig_sentiment(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select("o_orderkey", (k % 97 - 48).cast("double").alias("sentiment_score"), F.when(k % 4 == 0, "positive").when(k % 4 == 1, "negative").otherwise("neutral").alias("sentiment_label"), F.when(k % 3 == 0, 0).otherwise(5).alias("sentiment_records"))
    s = signals.rules()["sentiment"]
    return o.select("o_orderkey", F.when(s["dir"] == 0, 1000 + s["strength"]).otherwise(s["dir"] * s["strength"]).cast("double").alias("signal"))


@query("""SELECT o_orderkey, CAST(CASE WHEN c >= 1 THEN z WHEN c <= -1 THEN -z ELSE 1030 END AS DOUBLE) AS signal FROM (SELECT o_orderkey, c, CAST(round_even(least(100.0::DOUBLE, least(90.0::DOUBLE, abs(c) * 12 + 30) * CASE WHEN a IS NULL THEN 0.5::DOUBLE ELSE greatest(0.2::DOUBLE, least(1.0::DOUBLE, a / 100)) END + 15), 0) AS INTEGER) AS z
  FROM (SELECT o_orderkey, (o_orderkey % 41 - 20) / 4.0::DOUBLE AS c, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 101)::DOUBLE END AS a FROM orders))""")
def sig_forecast(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select("o_orderkey", ((k % 41 - 20) / 4.0).alias("forecast_change_pct"), F.when(k % 5 > 0, (k % 101).cast("double")).alias("forecast_accuracy"))
    s = signals.rules()["forecast"]
    return o.select("o_orderkey", F.when(s["dir"] == 0, 1000 + s["strength"]).otherwise(s["dir"] * s["strength"]).cast("double").alias("signal"))


@query(BARS + """, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) - 1 AS i FROM bars),
p AS (SELECT symbol, max(close) FILTER (WHERE i = 0) AS c, max(open) FILTER (WHERE i = 0) AS o, max(close) FILTER (WHERE i = 1) AS c1, max(close) FILTER (WHERE i = 5) AS c5, max(close) FILTER (WHERE i = 20) AS c20, max(close) FILTER (WHERE i = 62) AS c62 FROM b GROUP BY 1)
SELECT symbol, round((c / o - 1) * 100, 2) AS intraday, round(coalesce((c / c1 - 1) * 100, 0), 2) AS d1, round(coalesce((c / c5 - 1) * 100, 0), 2) AS w1, round(coalesce((c / c20 - 1) * 100, 0), 2) AS m1, round(coalesce((c / c62 - 1) * 100, 0), 2) AS m3 FROM p""")
def price_change_table(spark, sf):
    return risk.price_changes(bars(spark, sf))


@query(BARS + f" SELECT symbol, ts, round(close / first_value(close) OVER {W} * 100, 4) AS value FROM bars")
def rebase_100(spark, sf):
    return r(risk.rebased(bars(spark, sf), digits=4))


RISK = BARS + f""", rt AS (SELECT symbol, ts, close, close / nullif(lag(close) OVER {W}, 0) - 1 AS r FROM bars),
g AS (SELECT symbol, count(*) AS n, arg_max(close, ts) / arg_min(close, ts) AS f, stddev_samp(r) * sqrt(252.0::DOUBLE) AS vol, stddev_samp(r) FILTER (WHERE r < 0) * sqrt(252.0::DOUBLE) AS dn, avg((r > 0)::INT) AS up, max(r) AS best, min(r) AS worst FROM rt GROUP BY 1),
h AS (SELECT *, pow(f, 1 / (n / 252.0::DOUBLE)) - 1 AS ann FROM g)"""


@query(RISK + " SELECT symbol, n, round((f - 1) * 100, 4) AS total_return_pct, round(ann * 100, 4) AS annualized_return_pct, round(vol * 100, 4) AS volatility_pct, round(best * 100, 4) AS best_pct, round(worst * 100, 4) AS worst_pct, round(up * 100, 1) AS positive_ratio FROM h")
def returns_stats(spark, sf):
    return risk.risk_metrics(bars(spark, sf), digits=4).select("symbol", "n", "total_return_pct", "annualized_return_pct", "volatility_pct", "best_pct", "worst_pct", "positive_ratio")


@query(RISK + " SELECT symbol, 'ready' AS status, round((ann - 0.015::DOUBLE) / vol, 6) AS sharpe, round((ann - 0.015::DOUBLE) / dn, 6) AS sortino FROM h")
def sharpe_sortino(spark, sf):
    return risk.risk_metrics(bars(spark, sf), digits=6).select("symbol", "status", "sharpe", "sortino")


@query(RISK + " SELECT symbol, row_number() OVER (ORDER BY round((f - 1) * 100, 4) DESC, symbol) AS rank FROM h")
def compare_rank(spark, sf):
    return risk.ranking(risk.risk_metrics(bars(spark, sf), digits=4)).select("symbol", F.col("rank").cast("long").alias("rank"))


@query(BARS + f""", p AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts) AS pk FROM bars), d AS (SELECT symbol, arg_min((ts, pk, (close - pk) / pk), ((close - pk) / pk, ts)) AS m FROM p GROUP BY 1)
SELECT d.symbol, round(any_value(m[3]) * 100, 2) AS max_drawdown_pct, min(p.ts) AS peak_ts, any_value(m[1]) AS trough_ts FROM d JOIN p ON p.symbol = d.symbol AND p.close = m[2] AND p.ts <= m[1] GROUP BY 1""")
def max_drawdown(spark, sf):
    return r(risk.drawdowns(bars(spark, sf)))


@query(BARS + """, e AS (SELECT symbol, date_trunc('month', ts) AS m, arg_max(close, ts) AS c FROM bars GROUP BY 1, 2),
sp AS (SELECT symbol, unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM e GROUP BY 1),
f AS (SELECT sp.symbol, sp.m, last_value(c IGNORE NULLS) OVER (PARTITION BY sp.symbol ORDER BY sp.m) AS c FROM sp LEFT JOIN e ON e.symbol = sp.symbol AND e.m = sp.m),
g AS (SELECT symbol, c / lag(c) OVER (PARTITION BY symbol ORDER BY m) - 1 AS r FROM f)
SELECT symbol, count(r) AS months, round(avg((r > 0)::INT) * 100, 1) AS monthly_win_rate FROM g GROUP BY 1""")
def monthly_win_rate(spark, sf):
    return risk.monthly_win_rate(bars(spark, sf))


def market(spark, sf) -> DataFrame:
    """All symbols' volume-weighted price per day."""
    li = t(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").cast("timestamp").alias("ts"))
    return li.agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))


@query(BARS + f""", mk AS (SELECT CAST(l_shipdate AS DATE) AS ts, sum(l_extendedprice) / sum(l_quantity) AS market FROM lineitem GROUP BY 1),
j AS (SELECT symbol, close / lag(close) OVER {W} - 1 AS r, market / lag(market) OVER {W} - 1 AS m FROM bars JOIN mk USING (ts))
SELECT symbol, count(*) AS n, round(covar_samp(r, m) / var_samp(m), 4) AS beta, round(corr(r, m), 4) AS correlation FROM j WHERE r IS NOT NULL GROUP BY 1""")
def beta(spark, sf):
    return risk.beta(bars(spark, sf), market(spark, sf))


def dividends(spark, sf) -> DataFrame:
    """Per priority as symbol: one payment a quarter, a share of that quarter's order values."""
    o = t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("ex_date"))
    return o.agg(F.round(F.avg("o_totalprice") / 10000, 4).alias("amount"))


DIV = "dv AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS ex_date, round(avg(o_totalprice) / 10000, 4) AS amount FROM orders GROUP BY 1, 2)"
AS_OF = "DATE '2001-03-01'"


def as_of():
    return F.to_date(F.lit("2001-03-01"))


def lineitem_dividends(spark, sf) -> DataFrame:
    li = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("symbol"), F.date_add(F.to_date(F.date_trunc("quarter", "l_shipdate")), 20).alias("ex_date"))
    return li.agg(F.round(F.avg("l_discount") * 100, 4).alias("amount"))


LDIV = "ld AS (SELECT l_returnflag AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) + 20 AS ex_date, round(avg(l_discount) * 100, 4) AS amount FROM lineitem GROUP BY 1, 2)"
DCA = BARS + ", " + LDIV + """,
bu AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS i, ts, p, lag(ts) OVER (PARTITION BY symbol ORDER BY ts) AS before FROM (SELECT symbol, min(ts) AS ts, arg_min(close, ts) AS p FROM bars GROUP BY symbol, date_trunc('month', ts))),
gr AS (SELECT bu.symbol, i, bu.ts, p, coalesce(product(1 + amount / p), 1) AS g FROM bu LEFT JOIN ld ON ld.symbol = bu.symbol AND ld.ex_date <= bu.ts AND (before IS NULL OR ld.ex_date > before) GROUP BY ALL),
st AS (SELECT symbol, i, ts, p, 1000.0::DOUBLE / p AS sh, 0.0::DOUBLE AS paid FROM gr WHERE i = 1 UNION ALL
  SELECT gr.symbol, gr.i, gr.ts, gr.p, st.sh * gr.g + 1000 / gr.p, st.paid + st.sh * (gr.g - 1) * gr.p FROM st JOIN gr ON gr.symbol = st.symbol AND gr.i = st.i + 1)"""


@query(DCA + " SELECT symbol, ts AS date, CAST(i * 1000 AS DOUBLE) AS invested, round(sh * p, 3) AS value FROM st")
def dca_history(spark, sf):
    steps = risk.saving_steps(bars(spark, sf), lineitem_dividends(spark, sf))
    return steps.select("symbol", F.to_date("ts").alias("date"), "invested", F.round(F.col("shares") * F.col("price") + F.col("cash"), 3).alias("value"))


@query(DCA + """, fi AS (SELECT symbol, arg_max(close, ts) AS fp, max(ts) AS ed FROM bars GROUP BY 1),
la AS (SELECT symbol, max(i) AS n, max(ts) AS lb, arg_max(sh, i) AS sh, max(paid) AS paid, arg_min(p, i) AS p0, min(ts) AS sd FROM st GROUP BY 1),
re AS (SELECT la.symbol, product(1 + amount / fp) AS g FROM la JOIN fi USING (symbol) JOIN ld ON ld.symbol = la.symbol AND ex_date > lb GROUP BY 1),
z AS (SELECT la.*, fp, ed, sh * coalesce(g, 1) AS s2, paid + sh * (coalesce(g, 1) - 1) * fp AS dv FROM la JOIN fi USING (symbol) LEFT JOIN re USING (symbol))
SELECT symbol, 'ready' AS status, n AS months, sd AS start_date, ed AS end_date, round(s2 * fp, 1) AS final_value, round((s2 * fp / (n * 1000) - 1) * 100, 2) AS total_return_pct, round(dv, 1) AS dividend_total, round(n * 1000 / s2, 2) AS average_cost, round(n * 1000 / p0 * fp, 1) AS lump_sum_value FROM z""")
def dca_summary(spark, sf):
    s = risk.saving_plan(bars(spark, sf), lineitem_dividends(spark, sf))
    one = {c: F.round(c, 1) for c in ("final_value", "dividend_total", "lump_sum_value")}
    return s.withColumns(one).select("symbol", "status", "months", "start_date", "end_date", "final_value", "total_return_pct", "dividend_total", "average_cost", "lump_sum_value")


@query(BARS + f""", lg AS (SELECT symbol, ts, ln(close) AS l, ln(close) - lag(ln(close)) OVER {W} AS r, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS i FROM bars),
d AS (SELECT symbol, max(l) FILTER (WHERE i = 1) AS l, avg(r) AS mu FROM lg WHERE i <= 60 GROUP BY 1)
SELECT symbol, CAST(k AS INTEGER) AS step, round(exp(l + mu * k), 4) AS price FROM d, range(1, 8) x(k)""")
def fc_drift(spark, sf):
    return r(forecast.drift_paths(bars(spark, sf)))


@query(EWM + """, z AS (SELECT symbol, arg_max(e12, rn) AS f, arg_max(e26, rn) AS s FROM x GROUP BY 1)
SELECT symbol, CAST(k AS INTEGER) AS step, round(f + (f - s) * (1 - pow(0.85::DOUBLE, k)) / 0.15::DOUBLE * 0.12::DOUBLE, 3) AS price FROM z, range(1, 8) y(k)""")
def fc_ema_momentum(spark, sf):
    p = forecast.fitted(bars(spark, sf), 7, {"ema_momentum": forecast.momentum}).where("origin = n")
    return r(p.select("symbol", F.posexplode("path").alias("at", "price")).select("symbol", (F.col("at") + 1).alias("step"), "price"), digits=3)


@query(BARS + f""", y AS (SELECT symbol, close AS y, row_number() OVER {W} AS rn FROM bars),
e AS (SELECT symbol, rn, y AS l FROM y WHERE rn = 1 UNION ALL SELECT y.symbol, y.rn, e.l + (y.y - e.l) * 0.3::DOUBLE FROM e JOIN y ON y.symbol = e.symbol AND y.rn = e.rn + 1),
g AS (SELECT symbol, regr_slope(y, rn - 1) AS b, regr_intercept(y, rn - 1) AS a, max(rn) AS n FROM y GROUP BY 1),
l AS (SELECT symbol, arg_max(l, rn) AS l FROM e GROUP BY 1)
SELECT symbol, CAST(k AS INTEGER) AS step, round(0.5::DOUBLE * (a + b * (n - 1 + k)) + 0.5::DOUBLE * (l + b * k * 0.5::DOUBLE), 3) AS price FROM g JOIN l USING (symbol), range(1, 8) z(k)""")
def fc_theta(spark, sf):
    p = forecast.fitted(bars(spark, sf), 7, {"theta": forecast.theta}).where("origin = n")
    return r(p.select("symbol", F.posexplode("path").alias("at", "price")).select("symbol", (F.col("at") + 1).alias("step"), "price"), digits=3)


WALK = BARS + f""", lg AS (SELECT symbol, close, ln(close) - lag(ln(close)) OVER {W} AS r, row_number() OVER {W} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
og AS (SELECT DISTINCT symbol, n, n - 7 - i * 3 AS origin FROM lg, range(0, 8) z(i) WHERE n - 7 - i * 3 >= 30),
mu AS (SELECT og.symbol, og.origin, avg(r) AS mu, arg_max(close, rn) AS last FROM og JOIN lg ON lg.symbol = og.symbol AND lg.rn <= og.origin AND lg.rn > og.origin - 60 GROUP BY 1, 2),
tr AS (SELECT mu.*, lg.close AS truth, last * exp(mu * 7) AS endpoint FROM mu JOIN lg ON lg.symbol = mu.symbol AND lg.rn = mu.origin + 7)"""


@query(WALK + " SELECT symbol, origin, round(endpoint, 3) AS endpoint, round(abs(endpoint - truth) / abs(truth) * 100, 4) AS error, CASE WHEN sign(endpoint - last) = sign(truth - last) THEN 1.0 ELSE 0.0 END AS hit FROM tr")
def fc_walkforward_drift(spark, sf):
    s = forecast.scored(forecast.fitted(bars(spark, sf), 7, {"drift": forecast.drift}).where("origin < n"))
    return s.select("symbol", "origin", F.round("endpoint", 3).alias("endpoint"), F.round("error", 4).alias("error"), "hit")


@query("""WITH s AS (SELECT p_brand AS symbol, p_type AS model, avg(p_retailprice / 100) AS mape, avg((p_size % 2)::DOUBLE) AS hit, count(*) AS runs FROM part GROUP BY 1, 2),
c AS (SELECT *, mape * (1.35::DOUBLE - 0.7::DOUBLE * hit) AS cost FROM s), m AS (SELECT *, -cost / (median(cost) OVER (PARTITION BY symbol) * 0.55::DOUBLE) AS lo FROM c),
e AS (SELECT *, exp(lo - max(lo) OVER (PARTITION BY symbol)) AS e FROM m), p AS (SELECT *, greatest(e / sum(e) OVER (PARTITION BY symbol), 0.03::DOUBLE) AS p FROM e)
SELECT symbol, model, runs, round(p / sum(p) OVER (PARTITION BY symbol), 6) AS weight FROM p""")
def fc_weights(spark, sf):
    s = t(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("model"), (F.col("p_retailprice") / 100).alias("error"), (F.col("p_size") % 2).cast("double").alias("hit"))
    return forecast.weights(s).select("symbol", "model", "runs", F.round("weight", 6).alias("weight"))


@query()
def fc_full(spark, sf):
    return forecast.forecast(stored(bars(spark, sf), "forecast-bars"))


@query()
def stock_insight(spark, sf):
    news = t(spark, sf, "events").select(F.when(F.col("event_id") % 3 == 0, "A").when(F.col("event_id") % 3 == 1, "N").otherwise("R").alias("symbol"), F.least(F.lit(100.0), F.col("value") - 50).alias("sentiment_score"))
    news = news.withColumn("sentiment_label", sentiment.label(F.col("sentiment_score")))
    return insight.insight(bars(spark, sf), news, market(spark, sf), lineitem_dividends(spark, sf))


# News: events as a timeline of scored items.
NEWS = """nw AS (SELECT event_id, ts, event_type AS ticker, least(100.0, value - 50) AS s, CASE WHEN least(100.0, value - 50) >= 20 THEN 'positive' WHEN least(100.0, value - 50) <= -20 THEN 'negative' ELSE 'neutral' END AS lab FROM events)"""


def news(spark, sf) -> DataFrame:
    e = t(spark, sf, "events").select("event_id", dates.utc(F.col("ts")).alias("ts"), F.col("event_type").alias("ticker"), F.least(F.lit(100.0), F.col("value") - 50).alias("sentiment_score"))
    return e.withColumn("sentiment_label", sentiment.label(F.col("sentiment_score")))


def _buckets(frame: str, start: str, span: str, offset: str, zone: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return features.bucket_features(news(spark, sf), frame, zone).drop("timezone", "timeframe")

    aggs = "count(*) AS news_count, round(avg(s), 6) AS score_mean, round(stddev_pop(s), 6) AS score_std, round(min(s), 6) AS score_min, round(max(s), 6) AS score_max, " + ", ".join(f"round(avg((lab = '{k}')::INT), 6) AS {k}_ratio" for k in ("positive", "neutral", "negative"))
    label = lambda x: f"strftime({x}, '%Y-%m-%dT%H:%M:%S') || '{offset}'"
    query(f"WITH {NEWS}, b AS (SELECT *, {start} AS st FROM (SELECT * REPLACE (ts + INTERVAL {int(offset[1:3])} HOUR AS ts) FROM nw)) SELECT ticker, {label('st')} AS bucket_start, {label(f'st + INTERVAL {span}')} AS bucket_end, {aggs} FROM b GROUP BY ticker, st", f"feat_{frame}")(run)


_buckets("day", "date_trunc('day', ts)", "1 DAY", "+08:00", "Asia/Taipei")
_buckets("hour", "date_trunc('hour', ts)", "1 HOUR", "+00:00", "UTC")
_buckets("30min", "time_bucket(INTERVAL 30 MINUTE, ts)", "30 MINUTE", "+08:00", "Asia/Taipei")
_buckets("15min", "time_bucket(INTERVAL 15 MINUTE, ts)", "15 MINUTE", "+00:00", "UTC")


@query(f"""WITH {NEWS}, g AS (SELECT ticker, count(*) AS records, round(avg(s), 2) AS score_mean, round(avg((lab = 'positive')::INT), 4) AS p, round(avg((lab = 'negative')::INT), 4) AS g, round(avg((lab = 'neutral')::INT), 4) AS u FROM nw GROUP BY 1)
SELECT ticker, records, score_mean, p AS positive_ratio, u AS neutral_ratio, g AS negative_ratio, round(p - g, 4) AS polarity_balance, CASE WHEN p > g AND p >= u THEN 'positive' WHEN g > p AND g >= u THEN 'negative' ELSE 'neutral' END AS dominant_label FROM g""")
def news_summary(spark, sf):
    return features.news_summary(news(spark, sf), "ticker")


@query(f"WITH {NEWS} SELECT ticker, count(*) AS records, round(avg(s), 6) AS score_mean, round(avg((lab = 'positive')::INT), 6) AS positive_ratio, round(avg((lab = 'neutral')::INT), 6) AS neutral_ratio, round(avg((lab = 'negative')::INT), 6) AS negative_ratio FROM nw GROUP BY 1")
def dashboard_summary(spark, sf):
    return r(features.dashboard_summary(news(spark, sf), "ticker"), digits=6)


@query(f"WITH {NEWS} SELECT ticker, count(*) FILTER (WHERE lab = 'positive') AS positive, count(*) FILTER (WHERE lab = 'neutral') AS neutral, count(*) FILTER (WHERE lab = 'negative') AS negative FROM nw GROUP BY 1")
def label_distribution(spark, sf):
    return sentiment.distribution(news(spark, sf), "ticker")


ARM = f"{NEWS}, ar AS (SELECT *, CASE WHEN ('0x' || substr(md5('ab:' || event_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.4 THEN 'rnn' ELSE 'lexicon' END AS arm FROM nw)"


def arms(spark, sf) -> DataFrame:
    return sentiment.split_arms(news(spark, sf), F.col("event_id").cast("string"), 0.4)


@query(f"WITH {ARM} SELECT event_id, arm FROM ar")
def ab_split(spark, sf):
    return arms(spark, sf).select("event_id", "arm")


@query(f"WITH {ARM} SELECT arm, count(*) AS records, 0::BIGINT AS errors, count(*) FILTER (WHERE lab = 'negative') AS negative, count(*) FILTER (WHERE lab = 'neutral') AS neutral, count(*) FILTER (WHERE lab = 'positive') AS positive, round(count(*) / CASE arm WHEN 'rnn' THEN 2.5::DOUBLE ELSE 0.5::DOUBLE END, 4) AS records_per_second FROM ar GROUP BY arm")
def ab_report(spark, sf):
    seconds = spark.createDataFrame([("rnn", 2.5), ("lexicon", 0.5)], "arm string, seconds double")
    return r(sentiment.arm_report(arms(spark, sf), seconds).drop("seconds"))


def runs(spark, sf) -> DataFrame:
    return arms(spark, sf).groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("h"), "arm").agg(F.count("*").alias("records"), F.round(F.sum(F.abs("sentiment_score")) / 1000, 6).alias("seconds"))


ROLL = ARM + """, ru AS (SELECT CAST(ts AS DATE) AS day, arm, count(*) AS records, round(sum(abs(s)) / 1000, 6) AS seconds FROM ar GROUP BY CAST(ts AS DATE), hour(ts), arm),
ro AS (SELECT day, arm, count(*) AS runs, CAST(sum(records) AS BIGINT) AS records, sum(seconds) AS seconds, sum(records) / greatest(sum(seconds), 1e-9) AS rps FROM ru GROUP BY 1, 2)"""


@query(f"WITH {ROLL} SELECT day, arm, runs, records, round(seconds, 6) AS seconds, round(rps, 6) AS rps FROM ro")
def ab_daily_rollup(spark, sf):
    return r(sentiment.daily_rollup(runs(spark, sf)), digits=6)


@query(f"""WITH {ROLL}, cal AS (SELECT day, arm FROM (SELECT unnest(generate_series(max(day) - 6, max(day), INTERVAL 1 DAY))::DATE AS day FROM ro), (SELECT DISTINCT arm FROM ro))
SELECT day, arm, coalesce(runs, 0) AS runs, coalesce(records, 0) AS records, round(coalesce(seconds, 0), 6) AS seconds, round(coalesce(rps, 0), 6) AS rps FROM cal LEFT JOIN ro USING (day, arm)""")
def ab_calendar_7d(spark, sf):
    return r(sentiment.calendar(sentiment.daily_rollup(runs(spark, sf)), F.max("day"), 7), digits=6)


@query("""SELECT o_orderkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, c + greatest(-0.08::DOUBLE, least(0.08::DOUBLE, 0.25::DOUBLE * (0.75::DOUBLE * a + 0.25::DOUBLE * (x - y) / greatest(x, y)))))), 9) AS ratio
FROM (SELECT o_orderkey, (o_orderkey % 11) / 10.0::DOUBLE AS c, (o_orderkey % 21 - 10) / 10.0::DOUBLE AS a, 1.0::DOUBLE + o_orderkey % 13 AS x, 1.0::DOUBLE + o_orderkey % 17 AS y FROM orders)""")
def adaptive_ratio(spark, sf):
    k = F.col("o_orderkey")
    return t(spark, sf, "orders").select("o_orderkey", F.round(sentiment.adaptive_ratio((k % 11) / 10.0, (k % 21 - 10) / 10.0, 1.0 + k % 13, 1.0 + k % 17), 9).alias("ratio"))


#: A lexicon that occurs in the test documents.
LEXICON = sentiment.Lexicon(positive=["thble", "erble", "thing"], negative=["trash", "idiot", "clown", "scum", "worthless", "moron", "pathetic", "loser", "disgusting", "stupid"], positive_weights={"thing": 1.5}, negative_weights={"idiot": 1.5, "scum": 2.0}, negations=["non", "not"], intensifiers=["ously"], uncertain=["ander", "but"])


def _lexicon_sql(L: sentiment.Lexicon) -> str:
    cnt = lambda w: f"((length(s) - length(replace(s, '{w}', ''))) / {len(w)})"
    hits = lambda ws, k: " + ".join(f"{cnt(w)} * {float(k.get(w, 1.0))}::DOUBLE" for w in ws)
    flips = lambda ws: " + ".join(f"len(regexp_extract_all(s, '{n}\\s*{w}'))" for n in L.negations for w in ws)
    seen = lambda ws: " + ".join(f"contains(s, '{w}')::INT" for w in ws)
    return f"""WITH a AS (SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS s FROM documents),
b AS (SELECT doc_id, {hits(L.positive, L.positive_weights)} AS p, {hits(L.negative, L.negative_weights)} AS n, {flips(L.positive)} AS pn, {flips(L.negative)} AS np,
  least(1.25::DOUBLE, 1 + 0.05::DOUBLE * ({' + '.join(map(cnt, L.intensifiers))})) AS boost, greatest(0.75::DOUBLE, 1 - 0.04::DOUBLE * ({' + '.join(map(cnt, L.uncertain))})) AS doubt,
  {seen(L.uncertain)} AS u, {seen(L.positive)} AS pp, {seen(L.negative)} AS nn FROM a),
c AS (SELECT *, greatest(0, p - pn + np) * boost AS p2, greatest(0, n - np + pn) * boost AS n2 FROM b),
d AS (SELECT *, CASE WHEN p2 > 0 AND n2 > 0 THEN greatest(0.7::DOUBLE, 1 - 0.3::DOUBLE * least(p2, n2) / greatest(p2, n2)) ELSE 1 END AS clash FROM c),
e AS (SELECT *, CASE WHEN p2 + n2 > 0 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (p2 - n2) / sqrt(p2 + n2) * doubt * clash)) ELSE 0 END AS raw FROM d),
f AS (SELECT doc_id, pn, np, round(raw * CASE WHEN pp > 0 AND nn > 0 AND u > 0 THEN 0.35::DOUBLE WHEN pp > 0 AND nn > 0 AND abs(raw) < 0.55 THEN 0.65::DOUBLE WHEN NOT (pp > 0 AND nn > 0) AND u >= 2 AND abs(raw) < 0.7 THEN 0.6::DOUBLE ELSE 1 END * 100, 2) AS score FROM e)"""


_LABELLED = " SELECT doc_id, score AS lexicon_score, CASE WHEN score >= 20 THEN 'positive' WHEN score <= -20 THEN 'negative' ELSE 'neutral' END AS lexicon_label FROM f"


@query(_lexicon_sql(LEXICON) + _LABELLED)
def lexicon_score(spark, sf):
    return sentiment.with_lexicon(t(spark, sf, "documents").select("doc_id", "text"), "text", LEXICON).drop("text")


@query(_lexicon_sql(sentiment.Lexicon()) + _LABELLED)
def lexicon_default(spark, sf):
    return sentiment.with_lexicon(t(spark, sf, "documents").select("doc_id", "text"), "text").drop("text")


@query(f"""WITH {NEWS}, z AS (SELECT event_id, floor(s * 5) / 5 AS ms, CASE WHEN event_id % 7 = 0 THEN 'neutral' ELSE lab END AS ml, CAST(event_id % 201 - 100 AS DOUBLE) AS ls FROM nw),
y AS (SELECT *, CASE WHEN ls >= 12 THEN 'positive' WHEN ls <= -12 THEN 'negative' ELSE 'neutral' END AS ll FROM z),
x AS (SELECT *, CASE WHEN ll <> 'neutral' AND abs(ls) >= 12 AND (ml = 'neutral' OR abs(ms) < 12) THEN 'lexicon_override' WHEN ll <> 'neutral' AND ml = ll THEN 'lexicon_confirmed' ELSE 'rnn' END AS how FROM y)
SELECT event_id, round(CASE how WHEN 'lexicon_override' THEN 0.35::DOUBLE * ms + 0.65::DOUBLE * ls WHEN 'lexicon_confirmed' THEN 0.7::DOUBLE * ms + 0.3::DOUBLE * ls ELSE ms END, 2) AS score, CASE how WHEN 'lexicon_override' THEN ll ELSE ml END AS label, how FROM x""")
def calibrate(spark, sf):
    n = news(spark, sf).withColumn("ls", (F.col("event_id") % 201 - 100).cast("double"))
    own = F.when(F.col("event_id") % 7 == 0, "neutral").otherwise(F.col("sentiment_label"))
    fifths = F.floor(F.col("sentiment_score") * 5) / 5  # mixed scores then have two decimals, so rounding has no ties
    score, label, how = sentiment.calibrated(fifths, own, F.col("ls"), sentiment.label(F.col("ls"), 12.0, -12.0))
    return n.select("event_id", score.alias("score"), label.alias("label"), how.alias("how"))


@query("SELECT sha256(text || '|' || coalesce(lang, '') || '|') AS id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def record_id_dedup(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", text.record_id(F.col("text"), F.col("lang"), F.lit(None).cast("string")).alias("id"))
    return d.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT page_id, regexp_matches(url, '/en/|/de/') AND NOT regexp_matches(url, 'utm_|session') AS allowed FROM pages")
def link_filter(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.link_allowed(F.col("url"), ["/en/|/de/"], ["utm_|session"]).alias("allowed"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'thing')")
def keyword_filter(spark, sf):
    return t(spark, sf, "documents").where(text.any_keyword(F.col("text"), ["Idiot", "THING"])).select("doc_id")


@query("SELECT doc_id, trim(h) <> '' AND lower(trim(h)) NOT IN ('untitled', 'of.') AND length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) >= 200 AS meaningful FROM (SELECT *, regexp_replace(split_part(text, chr(10), 1), '\\s+', ' ', 'g') AS h FROM documents)")
def meaningful_filter(spark, sf):
    return t(spark, sf, "documents").select("doc_id", text.meaningful(F.split("text", "\n")[0], F.col("text"), ["Untitled", "Of."], 200).alias("meaningful"))


MARKDOWN = r"""md AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '## A ' || doc_id || chr(10) WHEN doc_id % 3 = 1 THEN '   #head ' || chr(10) || '# other' || chr(10) ELSE '' END || text || ' [a-b](c) [](d) ![i](j) ~x|y~ z' AS md FROM documents)"""


def markdown_docs(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    head = F.when(k % 3 == 0, F.concat(F.lit("## A "), k.cast("string"), F.lit("\n"))).when(k % 3 == 1, F.lit("   #head \n# other\n")).otherwise("")
    return t(spark, sf, "documents").select("doc_id", F.concat(head, "text", F.lit(" [a-b](c) [](d) ![i](j) ~x|y~ z")).alias("md"))


@query(rf"""WITH {MARKDOWN} SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '```[\s\S]*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '[`*_>#\-]', ' ', 'g'), '\s+', ' ', 'g'))) AS plain FROM md""")
def markdown_clean(spark, sf):
    return markdown_docs(spark, sf).select("doc_id", F.sha2(text.markdown_text(F.col("md")).cast("binary"), 256).alias("plain"))


@query(rf"""WITH {MARKDOWN} SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(list_filter(list_transform(string_split_regex(md, '[\n\r]+'), lambda x: trim(x)), lambda x: starts_with(x, '#'))[1], '^[# ]+', ''), '\s+', ' ', 'g')), '') AS title FROM md""")
def markdown_title(spark, sf):
    return markdown_docs(spark, sf).select("doc_id", text.markdown_title(F.col("md")).alias("title"))


@query(r"SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages")
def html_title(spark, sf):
    return t(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, len(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1))) AS links, regexp_extract(html, '(?i)<a\s[^>]*href=\"([^\"]*)\"', 1) AS first_link FROM pages")
def html_links(spark, sf):
    links = text.html_links(F.col("html"))
    return t(spark, sf, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")).alias("first_link"))


@query(r"""WITH p AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS source, url, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS h, length(html) > 1500 AS good FROM pages),
q AS (SELECT *, sha256(url || '|' || coalesce(h, '') || '|') AS id, coalesce(h, '') <> '' AND good AS ok FROM p),
s AS (SELECT *, CASE WHEN NOT ok THEN 'filtered' WHEN row_number() OVER (PARTITION BY id, ok ORDER BY source, url) > 1 THEN 'duplicate' ELSE 'kept' END AS st FROM q)
SELECT source, count(*) AS fetched, count(*) FILTER (WHERE st = 'filtered') AS filtered, count(*) FILTER (WHERE st = 'duplicate') AS deduped, count(*) FILTER (WHERE st = 'kept') AS kept FROM s GROUP BY 1""")
def crawl_counts(spark, sf):
    p = t(spark, sf, "pages").select(F.split(F.split("url", "://")[1], "/")[0].alias("source"), "url", text.html_title(F.col("html")).alias("headline"), F.when(F.length("html") > 1500, F.lit("x" * 50)).alias("content"))
    return crawl.source_counts(crawl.with_status(p))


# Directory: parts as instruments.
CATALOG = """ca AS (SELECT CAST(p_partkey AS VARCHAR) AS code, p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.TW' ELSE '' END AS symbol, upper(p_name) AS name_en, CASE WHEN p_partkey % 5 = 0 THEN 'etf' ELSE 'stock' END AS kind, [upper(p_brand), upper(p_type)] AS tags, p_partkey % 3 AS m FROM part)"""


def catalog(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, sf, "part").select(k.cast("string").alias("code"), F.concat(k.cast("string"), F.when(k % 2 == 0, ".TW").otherwise("")).alias("symbol"), F.lit(None).cast("string").alias("name_zh"), F.upper("p_name").alias("name_en"), F.when(k % 2 == 0, "TW").otherwise("US").alias("market"), F.when(k % 5 == 0, "etf").otherwise("stock").alias("kind"), F.array("p_brand", "p_type").alias("tags"), (k % 3).alias("m"))


@query(f"WITH {CATALOG} SELECT code, CASE WHEN m = 0 THEN 0 ELSE 1 END AS tier FROM ca WHERE m = 0 OR (m = 1) UNION ALL SELECT code, 1 FROM ca WHERE m = 2")
def directory_merge(spark, sf):
    c = catalog(spark, sf)
    return symbols.merged_directory(c.where("m = 0").drop("m"), c.drop("m", "tags")).select("code", "tier")


SCORE = """CASE WHEN code = q OR upper(symbol) = q THEN 1000 WHEN starts_with(code, q) OR starts_with(upper(symbol), q) THEN 900 - length(code) WHEN starts_with(name_en, q) THEN 780 - length(name_en) WHEN contains(name_en, q) THEN 560
  WHEN list_contains(tags, q) THEN 540 WHEN len(list_filter(tags, lambda x: contains(x, q))) > 0 THEN 480 WHEN contains(code, q) OR contains(upper(symbol), q) THEN 400 ELSE 0 END"""


@query(f"""WITH {CATALOG}, qs AS (SELECT unnest(['１２', 'brand#13', 'TW:150', '7.tw']) AS query, unnest(['12', 'BRAND#13', '150', '7.TW']) AS q),
h AS (SELECT query, code, {SCORE} - CASE WHEN m = 0 THEN 0 ELSE 5 END AS score, {SCORE} AS raw, CASE WHEN m = 0 THEN 0 ELSE 1 END AS tier FROM ca, qs),
o AS (SELECT *, count(*) FILTER (WHERE tier = 0) OVER (PARTITION BY query) AS own FROM h WHERE raw > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, code) AS rank FROM o WHERE tier = 0 OR own < 10)
SELECT query, CAST(rank AS INTEGER) AS rank, CAST(score AS INTEGER) AS score, code FROM r WHERE rank <= 10""")
def symbol_search(spark, sf):
    c = catalog(spark, sf)
    entries = symbols.merged_directory(c.where("m = 0").drop("m"), c.where("m <> 0").drop("m"))
    asked = spark.createDataFrame([("１２",), ("brand#13",), ("TW:150",), ("7.tw",)], "query string")
    return symbols.search(asked, entries).select("query", "rank", "score", "code")


@query(f"""WITH {CATALOG}, qs AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '9' || lpad((p_partkey % 1000)::VARCHAR, 4, '0') WHEN 2 THEN 'X' || (p_partkey % 7)::VARCHAR WHEN 3 THEN '^IX' || p_partkey ELSE (p_partkey - 1) || ' STEEL' END AS q FROM part),
e AS (SELECT code AS k, code, symbol, kind, CASE WHEN CAST(code AS BIGINT) % 2 = 0 THEN 'TW' ELSE 'US' END AS market FROM ca),
j AS (SELECT q, split_part(q, ' ', 1) AS head FROM qs),
f AS (SELECT j.*, own.symbol AS s1, CASE WHEN head <> q THEN h.symbol END AS s2, own.market AS m1, own.code AS c1, own.kind AS k1 FROM j LEFT JOIN e own ON own.k = q LEFT JOIN e h ON h.k = head),
g AS (SELECT *, CASE WHEN q LIKE '^%' THEN [q] WHEN regexp_full_match(q, '\\d{{4,6}}[A-Z]?') THEN [q || '.TW', q || '.TWO'] WHEN regexp_full_match(head, '\\d{{4,6}}[A-Z]?') THEN [head || '.TW', head || '.TWO'] WHEN regexp_full_match(q, '[A-Z0-9\\-]{{1,10}}') THEN [q] ELSE [] END AS shape FROM f),
x AS (SELECT *, list_concat(list_filter([s1, s2], lambda y: y IS NOT NULL), list_filter(shape, lambda y: y IS DISTINCT FROM s1 AND y IS DISTINCT FROM s2)) AS cs FROM g),
z AS (SELECT x.*, coalesce(m1, by_s.market) AS m2, coalesce(c1, by_s.code) AS c2, coalesce(k1, by_s.kind) AS k2 FROM x LEFT JOIN e by_s ON by_s.symbol = cs[1])
SELECT q AS query, array_to_string(cs, ',') AS candidates, coalesce(m2, CASE WHEN cs[1] LIKE '%.TW' THEN 'TW' WHEN cs[1] LIKE '%.TWO' THEN 'TWO' WHEN len(cs) > 0 THEN 'US' END) AS market, c2 IS NOT NULL AS catalog, coalesce(c2, q) AS display_code, k2 AS kind FROM z""")
def symbol_resolve(spark, sf):
    k = F.col("p_partkey")
    q = F.when(k % 5 == 0, k.cast("string")).when(k % 5 == 1, F.concat(F.lit("9"), F.lpad((k % 1000).cast("string"), 4, "0"))).when(k % 5 == 2, F.concat(F.lit("X"), (k % 7).cast("string"))).when(k % 5 == 3, F.concat(F.lit("^IX"), k.cast("string"))).otherwise(F.concat((k - 1).cast("string"), F.lit(" STEEL")))
    asked = t(spark, sf, "part").select(q.alias("query")).distinct()
    found = symbols.resolve(asked, catalog(spark, sf).withColumn("tier", F.lit(0)))
    return found.select("query", F.array_join("candidates", ",").alias("candidates"), "market", "catalog", "display_code", "kind")


NAMES = """nm AS (SELECT p_partkey, p_name || [' - Common Stock', ' Ordinary Shares', ' - Class A Common Stock', ' - Unitedx', ' - Warrants', ' 5% Notes', ' Notes', ' - Preferred, each 1/1000', ' Rights', '- units - x'][p_partkey % 10 + 1] AS name FROM part)"""


def security_names(spark, sf) -> DataFrame:
    ends = [" - Common Stock", " Ordinary Shares", " - Class A Common Stock", " - Unitedx", " - Warrants", " 5% Notes", " Notes", " - Preferred, each 1/1000", " Rights", "- units - x"]
    return t(spark, sf, "part").select("p_partkey", F.concat("p_name", F.element_at(F.array(*map(F.lit, ends)), (F.col("p_partkey") % 10 + 1).cast("int"))).alias("name"))


_CLASS_SQL = r"(?i)\s*-\s*(Common Stock.*|Class [A-Z].*|Ordinary Shares.*|American Depositary Shares.*|Depositary Shares.*|Warrant.*|Unit.*|Preferred.*|Right.*)$"
_OTHER_SQL = r"(?i)(\bwarrants?\b|\brights?\b|\bunits?\b|%\s*notes\b|depositary share, each)"


@query(f"WITH {NAMES} SELECT p_partkey, trim(regexp_replace(name, '{_CLASS_SQL}', ''), ' -') AS trimmed, NOT regexp_matches(name, '{_OTHER_SQL}') AS share FROM nm")
def name_suffix_trim(spark, sf):
    return security_names(spark, sf).select("p_partkey", text.trimmed_name(F.col("name")).alias("trimmed"), text.is_share(F.col("name")).alias("share"))


@query(f"""WITH {NAMES}, ln AS (SELECT *, 'S' || p_partkey || CASE WHEN p_partkey % 6 = 0 THEN '.A' ELSE '' END AS sym FROM nm)
SELECT replace(sym, '.', '-') AS code, trim(regexp_replace(name, '{_CLASS_SQL}', ''), ' -') AS name_en, CASE WHEN p_partkey % 4 = 0 THEN 'etf' ELSE 'stock' END AS kind FROM ln WHERE p_partkey % 9 <> 0 AND NOT regexp_matches(name, '{_OTHER_SQL}')""")
def symbol_file(spark, sf):
    k = F.col("p_partkey")
    code = F.concat(F.lit("s"), k.cast("string"), F.when(k % 6 == 0, ".a").otherwise(""))
    line = F.concat_ws("|", code, "name", F.lit("Q"), F.when(k % 9 == 0, "y").otherwise("N"), F.lit("N"), F.lit("100"), F.when(k % 4 == 0, "Y").otherwise("N"), F.lit("N"))
    lines = security_names(spark, sf).select(line.alias("value")).unionByName(spark.createDataFrame([("Symbol|Security Name|C|Test Issue|F|L|ETF|N",), ("File Creation Time: 0101202400:00|||||||",)], "value string"))
    return directories.symbol_file(lines, "NASDAQ").select("code", "name_en", "kind")


@query(f"""WITH {DIV}, y AS (SELECT symbol, CAST(year(ex_date) AS INTEGER) AS year, round(sum(amount), 4) AS total, count(*) AS payments FROM dv GROUP BY 1, 2) SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 15""")
def div_yearly(spark, sf):
    return actions.yearly(dividends(spark, sf))


@query(f"""WITH {DIV}, y AS (SELECT symbol, year(ex_date) AS year, round(sum(amount), 4) AS total FROM dv GROUP BY 1, 2), a AS (SELECT symbol, round(avg(total), 4) AS avg3 FROM (SELECT * FROM y WHERE year < 2001 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 3) GROUP BY 1)
SELECT dv.symbol, round(coalesce(sum(amount) FILTER (WHERE {AS_OF} - ex_date <= 365), 0), 4) AS ttm, any_value(avg3) AS avg3 FROM dv LEFT JOIN a ON a.symbol = dv.symbol GROUP BY 1""")
def div_ttm(spark, sf):
    return actions.trailing(dividends(spark, sf), as_of())


@query(f"""WITH {DIV}, y AS (SELECT symbol, year(ex_date) AS year, count(*) AS n FROM dv GROUP BY 1, 2), m AS (SELECT symbol, avg(n) AS m FROM (SELECT * FROM y WHERE year < 2001 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 3) GROUP BY 1)
SELECT DISTINCT y.symbol, CASE WHEN m IS NULL THEN 'unknown' WHEN m >= 10 THEN 'monthly' WHEN m >= 3.4 THEN 'quarterly' WHEN m >= 1.6 THEN 'semiannual' WHEN m >= 0.8 THEN 'annual' ELSE 'irregular' END AS frequency FROM y LEFT JOIN m ON m.symbol = y.symbol""")
def div_frequency(spark, sf):
    return actions.frequency(actions.yearly(dividends(spark, sf)), as_of())


@query("""WITH y AS (SELECT DISTINCT c_nationkey::VARCHAR AS symbol, CAST(1980 + c_custkey % 37 AS INTEGER) AS year FROM customer), k AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year DESC) <= 15), g AS (SELECT *, year + row_number() OVER (PARTITION BY symbol ORDER BY year DESC) AS g FROM k)
SELECT symbol, count(*) FILTER (WHERE g = top) AS streak, count(*) AS years_paid FROM (SELECT *, max(g) OVER (PARTITION BY symbol) AS top FROM g) GROUP BY 1""")
def div_streak(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("symbol"), F.make_date((1980 + F.col("c_custkey") % 37).cast("int"), F.lit(6), F.lit(1)).alias("ex_date"), F.lit(1.0).alias("amount"))
    return actions.streaks(actions.yearly(c))


@query(BARS + ", " + LDIV + """, c AS (SELECT symbol, arg_max(close, ts) AS close FROM bars GROUP BY 1), s AS (SELECT symbol, round(coalesce(sum(amount) FILTER (WHERE DATE '2001-03-01' - ex_date <= 365), 0), 4) AS ttm FROM ld GROUP BY 1)
SELECT symbol, ttm, round(ttm / close * 100, 2) AS ttm_yield FROM s JOIN c USING (symbol)""")
def div_yield(spark, sf):
    return actions.dividend_summary(lineitem_dividends(spark, sf), as_of(), indicators.latest(bars(spark, sf))).select("symbol", "ttm", "ttm_yield")


def split_events(spark, sf) -> DataFrame:
    li = t(spark, sf, "lineitem")
    tw = F.when(F.col("l_suppkey") % 2 == 0, ".TW").otherwise("")
    ratio = F.when(F.col("l_orderkey") % 3 == 0, 1 + F.col("l_discount")).when(F.col("l_orderkey") % 3 == 1, 2.0 + F.col("l_orderkey") % 4).otherwise(0.25)
    li = li.select(F.concat(F.col("l_suppkey").cast("string"), tw).alias("symbol"), F.to_date("l_shipdate").alias("date"), F.round(ratio, 2).alias("ratio"))
    return li.groupBy("symbol", "date").agg(F.max("ratio").alias("ratio"))


SPLIT = """sp AS (SELECT symbol, date, max(ratio) AS ratio FROM (SELECT l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN '.TW' ELSE '' END AS symbol, CAST(l_shipdate AS DATE) AS date,
  round(CASE l_orderkey % 3 WHEN 0 THEN 1 + l_discount WHEN 1 THEN 2.0 + l_orderkey % 4 ELSE 0.25 END, 2) AS ratio FROM lineitem) GROUP BY 1, 2)"""


@query(f"""WITH {SPLIT} SELECT symbol, date, ratio, CASE WHEN ratio >= 1 THEN 'split' ELSE 'reverse_split' END AS kind,
  CASE WHEN ratio >= 1 THEN '1:' || CASE WHEN ratio = round(ratio) THEN format('{{:.0f}}', ratio) ELSE format('{{:.2f}}', ratio) END ELSE format('{{:.0f}}', 1 / ratio) || ':1' END AS text
FROM sp WHERE NOT (symbol LIKE '%.TW' AND ratio > 1 AND ratio <= 1.5) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 20""")
def splits_labels(spark, sf):
    return actions.splits(split_events(spark, sf))


@query(f"WITH {SPLIT} SELECT symbol, date, ratio, round((ratio - 1) * 1000, 2) AS shares_per_1000 FROM sp WHERE symbol LIKE '%.TW' AND ratio > 1 AND ratio <= 1.5")
def rights_ratio(spark, sf):
    return actions.rights_from_splits(split_events(spark, sf))


EXCHANGE = """ex AS (SELECT l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN '.TW' ELSE '' END AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice) AS b, min(l_extendedprice * (1 - l_discount)) AS f FROM lineitem GROUP BY 1, 2)"""


@query(f"""WITH {SPLIT}, {EXCHANGE}, rr AS (SELECT symbol, date, ratio, round((ratio - 1) * 1000, 2) AS n FROM sp WHERE symbol LIKE '%.TW' AND ratio > 1 AND ratio <= 1.5)
SELECT coalesce(ex.symbol, rr.symbol) AS symbol, coalesce(ex.date, rr.date) AS date, round((b - f) / b * 100, 2) AS drop_pct, ratio, n AS shares_per_1000, CASE WHEN ex.symbol IS NULL THEN 'splits' WHEN rr.symbol IS NULL THEN 'exchange' ELSE 'exchange+splits' END AS source
FROM ex FULL JOIN rr ON ex.symbol = rr.symbol AND ex.date = rr.date QUALIFY row_number() OVER (PARTITION BY coalesce(ex.symbol, rr.symbol) ORDER BY coalesce(ex.date, rr.date) DESC) <= 30""")
def rights_merge(spark, sf):
    li = t(spark, sf, "lineitem")
    tw = F.when(F.col("l_suppkey") % 2 == 0, ".TW").otherwise("")
    ex = li.groupBy(F.concat(F.col("l_suppkey").cast("string"), tw).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("before_price"), F.min(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("reference_price"))
    ex = ex.withColumns({"kind": F.lit("rights"), "kind_label": F.lit("權")})
    return actions.merged_rights(ex, actions.rights_from_splits(split_events(spark, sf))).select("symbol", "date", "drop_pct", "ratio", "shares_per_1000", "source")


@query(f"WITH {SPLIT} SELECT symbol, count(*) AS records, round(sum(round((ratio - 1) * 1000, 2)), 2) AS total_shares, false AS has_exchange, max(date) AS latest FROM sp WHERE symbol LIKE '%.TW' AND ratio > 1 AND ratio <= 1.5 GROUP BY 1")
def rights_summary(spark, sf):
    rr = actions.rights_from_splits(split_events(spark, sf)).withColumn("source", F.lit("splits"))
    return actions.rights_summary(rr).drop("sources")


HOLD = """ho AS (SELECT s_nationkey AS fund, p_brand AS symbol, sum(l_extendedprice) AS rev FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
hw AS (SELECT fund, symbol, round(rev / sum(rev) OVER (PARTITION BY fund) * CASE WHEN fund % 2 = 0 THEN 1 ELSE 100 END, 6) AS weight FROM ho),
hs AS (SELECT *, round(CASE WHEN sum(abs(weight)) OVER (PARTITION BY fund) <= 1.5 THEN weight * 100 ELSE weight END, 2) AS weight_pct FROM hw)"""


def holdings(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    j = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy(F.col("s_nationkey").alias("fund"), F.col("p_brand").alias("symbol")).agg(F.sum("l_extendedprice").alias("rev"))
    w = F.col("rev") / F.sum("rev").over(Window.partitionBy("fund")) * F.when(F.col("fund") % 2 == 0, 1).otherwise(100)
    return g.select("fund", "symbol", numbers.rounded(w, 6).cast("string").alias("weight"))


@query(f"WITH {HOLD} SELECT fund, symbol, round(weight_pct, 1) AS weight_pct FROM hs")
def holdings_scale(spark, sf):
    return actions.shared_scale(holdings(spark, sf), "fund").select("fund", "symbol", numbers.rounded(F.col("weight_pct"), 1).alias("weight_pct"))


@query(f"WITH {HOLD} SELECT fund, symbol, CAST(row_number() OVER (PARTITION BY fund ORDER BY abs(weight_pct) DESC, symbol) AS INTEGER) AS rank FROM hs QUALIFY rank <= 10")
def sectors_top10(spark, sf):
    s = actions.shared_scale(holdings(spark, sf), "fund")
    return actions.top_weights(s, "fund", [F.desc(F.abs("weight_pct")), F.col("symbol")]).select("fund", "symbol", "rank")


@query("""WITH i AS (SELECT * FROM (VALUES (0, 'STEEL', 'Steelworks'), (1, 'BRASS', 'Brassmen'), (2, 'ECONOMY', 'Thrift')) v(pos, keyword, issuer))
SELECT p_partkey AS fund, arg_min(issuer, pos) AS issuer FROM part LEFT JOIN i ON contains(upper(p_type || ' ' || p_name), keyword) GROUP BY 1""")
def issuer_match(spark, sf):
    table = spark.createDataFrame([(0, "steel", "Steelworks"), (1, "brass", "Brassmen"), (2, "economy", "Thrift")], "pos int, keyword string, issuer string")
    f = t(spark, sf, "part").select(F.col("p_partkey").alias("fund"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return actions.issuer(f, table).select("fund", "issuer")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day FROM orders""")
def roc_dates(spark, sf):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    roc = F.format_string("%d", F.year(d) - 1911)
    raw = F.when(k % 5 == 0, F.concat(roc, F.lit("/"), F.date_format(d, "MM/dd"))).when(k % 5 == 1, F.concat(F.lpad(roc, 3, "0"), F.date_format(d, "MMdd"))).when(k % 5 == 2, F.date_format(d, "yyyyMMdd")).when(k % 5 == 3, F.date_format(d, "yyyy-M-d")).otherwise(F.lit("99/13/45"))
    return t(spark, sf, "orders").select("o_orderkey", dates.minguo_date(raw).alias("day"))


@query("""SELECT o_orderkey, list_filter(list_transform(range(1, 15), lambda i: CAST(o_orderdate AS DATE) + CAST(i AS INTEGER)), lambda x: dayofweek(x) NOT IN (0, 6))[5]::DATE AS fifth FROM orders""")
def business_days(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.element_at(dates.next_business_days(F.to_date("o_orderdate"), 5), 5).alias("fifth"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN round(o_totalprice, 2) WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE floor(o_totalprice) END AS value FROM orders""")
def number_parse(spark, sf):
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, F.format_number("o_totalprice", 2)).when(k % 4 == 1, "--").when(k % 4 == 2, "n/a").otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return t(spark, sf, "orders").select("o_orderkey", numbers.parsed(raw).alias("value"))


@query(f"WITH {NEWS} SELECT event_id FROM nw WHERE ticker = 'click'")
def ticker_filter(spark, sf):
    n = news(spark, sf).withColumn("ticker", F.concat("ticker", F.when(F.col("event_id") % 2 == 0, ".TW").otherwise("")))
    return n.where(text.ticker_root(F.col("ticker")) == "CLICK").select("event_id")


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)::DOUBLE AS last_user FROM conversations")
def last_valid(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    return t(spark, sf, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).cast("double").alias("last_user"))


@query(SNAP + " SELECT symbol, strftime(ts, '%Y-%m-%d') AS date, volume, sma5, sma20, rsi14, k, d, bias20 FROM s")
def csv_export(spark, sf):
    return indicators.indicators(bars(spark, sf)).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("date"), "volume", "sma5", "sma20", "rsi14", "k", "d", "bias20")


#: Result columns that are dates; queries and SQL give them as text, so that engines' date types don't matter.
DATE_COLUMNS = {
    "ts": "bars_daily bars_weekly sma_all volume_ma20 bollinger bias20 ad_line obv true_range ema_12_26 macd rsi14 kd atr14 snapshot snapshot_history market_read rebase_100 " + " ".join(f"sig_{k}" for k in CASES),
    "peak_ts": "max_drawdown", "trough_ts": "max_drawdown", "date": "dca_history splits_labels rights_ratio rights_merge", "start_date": "dca_summary", "end_date": "dca_summary",
    "day": "ab_daily_rollup ab_calendar_7d roc_dates", "latest": "rights_summary", "fifth": "business_days",
}


def _dates_as_text(f: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = f(spark, sf)
        return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c, k in df.dtypes if k in ("date", "timestamp")})

    return run


for _name in QUERIES:
    QUERIES[_name] = _dates_as_text(QUERIES[_name])
    if _cols := [c for c, names in DATE_COLUMNS.items() if _name in names.split()]:
        ORACLE_SQL[_name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in _cols)}) FROM ({ORACLE_SQL[_name]})"
