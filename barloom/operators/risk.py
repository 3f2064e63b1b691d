"""Return and risk metrics, beta, rebasing, regular saving plans and comparison, for all symbols in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from .windows import running, series

#: Bars a year per interval; others count as daily.
PER_YEAR = {"1d": 252, "5d": 50, "1wk": 52, "1mo": 12, "3mo": 4, "1h": 1_512, "60m": 1_512, "90m": 1_008, "30m": 3_276, "15m": 6_552, "5m": 19_656, "1m": 98_280}
RISK_FREE = 0.015


def periods_per_year(interval: Column) -> Column:
    """Bars a year for a column of intervals; 252 for those not listed."""
    table = F.create_map(*(F.lit(x) for pair in PER_YEAR.items() for x in pair))
    return F.coalesce(F.try_element_at(table, interval), F.lit(PER_YEAR["1d"]))


def closes(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "ts", "close").where("close is not null")


def returns(bars: DataFrame) -> DataFrame:
    """symbol, ts, close, r: the change since the bar before."""
    return closes(bars).withColumn("r", ratio(F.col("close"), F.lag("close").over(series())) - 1)


def drawdowns(bars: DataFrame) -> DataFrame:
    """The deepest fall from a running peak: percent, first trough, and the first peak before it."""
    peaks = closes(bars).withColumn("peak", running(F.max, F.col("close"))).withColumn("dd", (F.col("close") - F.col("peak")) / F.nullif(F.col("peak"), F.lit(0.0)))
    deepest = peaks.groupBy("symbol").agg(F.min(F.struct("dd", "ts", "peak")).alias("m")).select("symbol", F.col("m.dd").alias("dd"), F.col("m.ts").alias("trough_ts"), F.col("m.peak").alias("peak"))
    top = peaks.select("symbol", "ts", "close").join(deepest.select("symbol", "peak", "trough_ts"), "symbol").where("close = peak and ts <= trough_ts").groupBy("symbol").agg(F.min("ts").alias("peak_ts"))
    return deepest.join(top, "symbol").select("symbol", F.round(F.col("dd") * 100, 2).alias("max_drawdown_pct"), "peak_ts", "trough_ts")


def risk_metrics(bars: DataFrame, interval: str = "1d", digits: int = 2) -> DataFrame:
    """Total and yearly return, volatility, Sharpe and Sortino ratios, share of gains, best and worst bar."""
    per_year = float(PER_YEAR.get(interval, 252))
    s = returns(bars).groupBy("symbol").agg(
        F.count("*").alias("n"), F.min_by("close", "ts").alias("first"), F.max_by("close", "ts").alias("last"),
        F.stddev_samp("r").alias("dev"), F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))).alias("down"),
        F.avg((F.col("r") > 0).cast("double")).alias("up"), F.max("r").alias("best"), F.min("r").alias("worst"),
    )
    years = F.greatest(F.col("n") / per_year, F.lit(1e-6))
    growth = ratio(F.col("last"), F.col("first"))
    yearly = F.pow(growth, 1 / years) - 1
    vol, down = F.col("dev") * per_year**0.5, F.col("down") * per_year**0.5
    enough = lambda x: F.when(F.col("n") >= 5, x)
    out = {"total_return_pct": (growth - 1) * 100, "annualized_return_pct": yearly * 100, "volatility_pct": vol * 100, "sharpe": ratio(yearly - RISK_FREE, vol), "sortino": ratio(yearly - RISK_FREE, down), "best_pct": F.col("best") * 100, "worst_pct": F.col("worst") * 100}
    return s.select("symbol", F.when(F.col("n") >= 5, "ready").otherwise("insufficient_data").alias("status"), "n", *(F.round(enough(v), digits).alias(k) for k, v in out.items()), F.round(enough(F.col("up") * 100), 1).alias("positive_ratio"))


def monthly_win_rate(bars: DataFrame) -> DataFrame:
    """Share of months with a gain; a month without bars counts as one without change."""
    c = closes(bars)
    ends = c.groupBy("symbol", F.trunc("ts", "month").alias("month")).agg(F.max_by("close", "ts").alias("close"), F.count("*").alias("n"))
    spine = ends.groupBy("symbol").agg(F.min("month").alias("a"), F.max("month").alias("b"), F.sum("n").alias("bars")).select("symbol", "bars", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    w = Window.partitionBy("symbol").orderBy("month")
    filled = spine.join(ends.select("symbol", "month", "close"), ["symbol", "month"], "left").withColumn("close", F.last("close", ignorenulls=True).over(w))
    moves = filled.withColumn("r", ratio(F.col("close"), F.lag("close").over(w)) - 1)
    s = moves.groupBy("symbol").agg(F.first("bars").alias("bars"), F.count("r").alias("months"), F.avg((F.col("r") > 0).cast("double")).alias("share"))
    return s.select("symbol", "months", F.when((F.col("bars") > 40) & (F.col("months") >= 3), F.round(F.col("share") * 100, 1)).alias("monthly_win_rate"))


def beta(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Beta and correlation of returns on the days that both series have; needs 20 returns."""
    both = closes(bars).join(benchmark.select("ts", F.col("close").alias("market")).where("market is not null"), "ts")
    moved = both.withColumns({"r": ratio(F.col("close"), F.lag("close").over(series())) - 1, "m": ratio(F.col("market"), F.lag("market").over(series())) - 1}).where("r is not null and m is not null")
    s = moved.groupBy("symbol").agg(F.count("*").alias("n"), F.covar_samp("r", "m").alias("cov"), F.var_samp("m").alias("var"), F.corr("r", "m").alias("corr"))
    good = (F.col("n") >= 20) & (F.col("var") > 0)
    return s.select("symbol", "n", F.round(F.when(good, F.col("cov") / F.nullif(F.col("var"), F.lit(0.0))), 4).alias("beta"), F.round(F.when(good, F.col("corr")), 4).alias("correlation"))


def rebased(bars: DataFrame, base: float = 100.0, digits: int = 2) -> DataFrame:
    """Closes as a share of the symbol's own first close; none where that isn't positive."""
    first = F.first("close").over(series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return closes(bars).withColumn("first", first).where("first > 0").select("symbol", "ts", F.round(F.col("close") / F.col("first") * base, digits).alias("value"))


def ranking(metrics: DataFrame) -> DataFrame:
    """Symbols by total return, best first, ties by symbol."""
    return metrics.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("total_return_pct"), "symbol")))


def price_changes(bars: DataFrame) -> DataFrame:
    """Change of the last close over today's open and 1, 5, 20 and 62 bars back, in percent; 0 without a reference."""
    back = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    tail = bars.withColumn("at", F.row_number().over(back) - 1).where("at <= 62")
    pick = lambda n, c="close": F.max(F.when(F.col("at") == n, F.col(c)))
    s = tail.groupBy("symbol").agg(pick(0).alias("c0"), pick(0, "open").alias("open"), *(pick(n).alias(f"c{n}") for n in (1, 5, 20, 62)))
    change = lambda ref: F.round(F.coalesce((F.col("c0") / F.nullif(ref, F.lit(0.0)) - 1) * 100, F.lit(0.0)), 2)
    opened = F.when(F.coalesce(F.col("open"), F.lit(0.0)) == 0, F.col("c0")).otherwise(F.col("open"))
    return s.select("symbol", change(opened).alias("intraday"), *(change(F.col(f"c{n}")).alias(k) for n, k in ((1, "d1"), (5, "w1"), (20, "m1"), (62, "m3"))))


def saving_steps(bars: DataFrame, dividends: DataFrame | None = None, amount: float = 1000.0, reinvest: bool = True) -> DataFrame:
    """Monthly purchases: symbol, ts, price, bought, dividend per share due before the purchase, shares after it.

    Dividends up to a purchase's day are paid on the shares held before it. With reinvestment the shares follow a linear
    recurrence, s' = s * (1 + d / p) + amount / p, which running products solve without a loop over months.
    """
    month = closes(bars).where("ts is not null").groupBy("symbol", F.trunc("ts", "month").alias("month"))
    buys = month.agg(F.min_by("close", "ts").alias("price"), F.min("ts").alias("ts")).where("price > 0")
    w = Window.partitionBy("symbol").orderBy("ts")
    if dividends is None:
        due = buys.withColumn("events", F.array().cast("array<double>"))
    else:
        paid = dividends.where("amount > 0").select("symbol", F.col("ex_date").cast("timestamp").alias("ts"), "amount")
        both = buys.select("symbol", "ts", "price", F.lit(None).cast("double").alias("amount")).unionByName(paid.withColumn("price", F.lit(None).cast("double")))
        ahead = Window.partitionBy("symbol").orderBy(F.asc("ts"), F.col("price").isNotNull()).rowsBetween(0, Window.unboundedFollowing)
        slot = both.withColumn("buy_ts", F.first(F.when(F.col("price").isNotNull(), F.col("ts")), ignorenulls=True).over(ahead))
        events = slot.where("amount is not null and buy_ts is not null").groupBy("symbol", F.col("buy_ts").alias("ts")).agg(F.transform(F.array_sort(F.collect_list(F.struct(slot["ts"].alias("at"), "amount"))), lambda e: e["amount"]).alias("events"))
        due = buys.join(events, ["symbol", "ts"], "left").withColumn("events", F.coalesce("events", F.array().cast("array<double>")))
    per_share = F.aggregate("events", F.lit(0.0), lambda a, x: a + x)
    grow = F.aggregate("events", F.lit(1.0), lambda a, x: a * (1 + x / F.col("price"))) if reinvest else F.lit(1.0)
    df = due.withColumns({"bought": F.lit(amount) / F.col("price"), "per_share": per_share, "grow": grow})
    df = df.withColumn("log_grow", F.sum(F.log("grow")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("shares", F.exp("log_grow") * F.sum(F.col("bought") * F.exp(-F.col("log_grow"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    held = F.coalesce(F.lag("shares").over(w), F.lit(0.0))
    payout = held * (F.col("grow") - 1) * F.col("price") if reinvest else held * F.col("per_share")
    df = df.withColumn("payout", payout).withColumn("cash", F.lit(0.0) if reinvest else F.sum("payout").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumns({"nth": F.row_number().over(w), "invested": F.row_number().over(w) * F.lit(amount)})


def saving_history(steps: DataFrame) -> DataFrame:
    return steps.select("symbol", F.to_date("ts").alias("date"), F.round("invested", 2).alias("invested"), F.round(F.col("shares") * F.col("price") + F.col("cash"), 2).alias("value"))


def saving_plan(bars: DataFrame, dividends: DataFrame | None = None, amount: float = 1000.0, reinvest: bool = True) -> DataFrame:
    """Result of buying for a fixed amount on each month's first trading day. Dividends after the last purchase are
    settled at the final price."""
    steps = saving_steps(bars, dividends, amount, reinvest)
    total = closes(bars).groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("final_price"), F.max("ts").alias("end_ts"))
    s = steps.groupBy("symbol").agg(F.count("*").alias("months"), F.min("ts").alias("start_ts"), F.max("ts").alias("last_buy"), F.max_by("shares", "ts").alias("shares"), F.max_by("cash", "ts").alias("cash"), F.max("invested").alias("invested"), F.sum("payout").alias("dividends"), F.min_by("price", "ts").alias("first_price"))
    s = s.join(total, "symbol")
    if dividends is not None:
        rest = dividends.where("amount > 0").join(s.select("symbol", "last_buy", "final_price"), "symbol").where("cast(ex_date as timestamp) > last_buy").groupBy("symbol").agg(F.sum("amount").alias("rest"), F.sum(F.log(1 + F.col("amount") / F.col("final_price"))).alias("rest_log"))
        s = s.join(rest, "symbol", "left").fillna(0.0, ["rest", "rest_log"])
        more = F.col("shares") * (F.exp("rest_log") - 1) if reinvest else F.lit(0.0)
        paid = more * F.col("final_price") if reinvest else F.col("shares") * F.col("rest")
        s = s.withColumns({"dividends": F.col("dividends") + paid, "cash": F.col("cash") + (F.lit(0.0) if reinvest else paid), "shares": F.col("shares") + more})
    value = F.col("shares") * F.col("final_price") + F.col("cash")
    growth, years = value / F.col("invested"), F.greatest(F.col("months") / 12.0, F.lit(1e-6))
    ready = (F.col("n") >= 20) & (F.col("months") >= 2)
    out = {"final_value": value, "profit": value - F.col("invested"), "total_return_pct": (growth - 1) * 100, "annualized_return_pct": (F.pow(growth, 1 / years) - 1) * 100, "dividend_total": F.col("dividends"), "average_cost": ratio(F.col("invested"), F.col("shares")), "lump_sum_value": F.col("invested") / F.col("first_price") * F.col("final_price")}
    keep = s.select("symbol", F.when(ready, "ready").otherwise("insufficient_data").alias("status"), F.when(ready, F.col("months")).alias("months"), F.when(ready, F.to_date("start_ts")).alias("start_date"), F.when(ready, F.to_date("end_ts")).alias("end_date"), F.when(ready, F.round("invested", 2)).alias("invested"), *(F.when(ready, F.round(v, 2)).alias(k) for k, v in out.items()), F.when(ready, F.round("shares", 4)).alias("shares"))
    return keep
