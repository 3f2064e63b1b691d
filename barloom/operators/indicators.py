"""Technical indicators for every bar of every symbol, and the snapshot of each bar.

Windowed indicators are native window expressions over one ``symbol`` partitioning. Recursive ones share grouped-map
passes over chunks of a symbol's bars, because no built-in function carries a value from row to row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio
from . import recurrence
from .recurrence import CHUNK
from .windows import previous, rolling, running, series

SMA = (5, 20, 60, 120, 240)
#: Decimals of each recursive column.
RECURSIVE = {"ema12": 2, "ema26": 2, "macd": 4, "macd_signal": 4, "macd_hist": 4, "rsi14": 2, "k": 2, "d": 2, "atr14": 2}


def windowed(bars: DataFrame, digits: int | None = None) -> DataFrame:
    """SMA, Bollinger bands, bias, A/D line, OBV, volume mean; rounded as published, or to ``digits``."""
    c, two = F.col("close"), 2 if digits is None else digits
    mid, dev = rolling(F.avg, c, 20), rolling(F.stddev_samp, c, 20)
    spread = F.col("high") - F.col("low")
    flow = F.when(spread == 0, 0.0).otherwise(((c - F.col("low")) - (F.col("high") - c)) / F.nullif(spread, F.lit(0.0))) * F.col("volume")
    step = F.coalesce(F.signum(c - F.lag(c).over(series())), F.lit(0.0)) * F.col("volume")
    first = bars.withColumns({"_flow": F.coalesce(flow, F.lit(0.0)), "_step": F.coalesce(step, F.lit(0.0))})
    out = {f"sma{n}": rolling(F.avg, c, n) for n in SMA}
    out |= {"bb_mid": mid, "bb_upper": mid + 2 * dev, "bb_lower": mid - 2 * dev, "bb_width": ratio(4 * dev, mid) * 100, "bias20": ratio(c - mid, mid) * 100}
    out |= {"ad": running(F.sum, F.col("_flow")), "obv": running(F.sum, F.col("_step")), "volume_ma20": rolling(F.avg, F.col("volume"), 20, 5)}
    return first.withColumns({k: F.round(v, two) for k, v in out.items()}).drop("_flow", "_step")


def true_range() -> Column:
    """The widest of high - low and both distances from the previous close; nulls don't count."""
    before = F.lag("close").over(series())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def recursive(bars: DataFrame, digits: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """EMA, MACD, RSI, KD and ATR: symbol, ts and the columns of ``RECURSIVE``. Missing values are null.

    Symbols of more than ``chunk`` bars are computed in several tasks, see ``recurrence``.
    """
    found = recurrence.values(bars, list(RECURSIVE), chunk)
    clean = {c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), n if digits is None else digits) for c, n in RECURSIVE.items()}
    return found.withColumns(clean)


def indicators(bars: DataFrame) -> DataFrame:
    """All indicators next to the bars."""
    return windowed(bars).join(recursive(bars), ["symbol", "ts"])


def snapshots(ind: DataFrame) -> DataFrame:
    """What a reader of each bar sees: current and previous values, 52-week range, yearly volatility, change."""
    c, w = F.col("close"), series()
    year = w.rowsBetween(-249, 0)
    high, low = F.max("close").over(year), F.min("close").over(year)
    back = F.lag(c).over(w)
    moves = ind.withColumn("_move", ratio(c, back) - 1)
    last20 = w.rowsBetween(-19, 0)
    vol = F.when(F.count("_move").over(last20) >= 5, F.stddev_samp("_move").over(last20) * F.sqrt(F.lit(252.0)) * 100)
    fields = {f"{x}_prev": previous(x) for x in ("sma20", "macd_hist", "k", "d")}
    fields |= {"obv_5ago": previous("obv", 5), "ad_5ago": previous("ad", 5),"change_pct": F.round((ratio(c, back) - 1) * 100, 2), "high_52w": F.round(high, 2), "low_52w": F.round(low, 2)}
    fields |= {"position_52w": F.round(F.when(high > low, (c - low) / F.nullif(high - low, F.lit(0.0)) * 100).otherwise(50.0), 2), "volatility": F.round(vol, 2), "sample": F.count("close").over(w.rowsBetween(Window.unboundedPreceding, 0))}
    return moves.withColumns(fields).drop("_move")


def latest(df: DataFrame) -> DataFrame:
    """The last row of each symbol."""
    return df.withColumn("_r", F.row_number().over(series(backwards=True))).where("_r = 1").drop("_r")


def arrays(ind: DataFrame, columns: list[str]) -> DataFrame:
    """One row per symbol with each column as an array in time order."""
    packed = ind.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", *columns))).alias("s"))
    return packed.select("symbol", *(F.col(f"s.{c}").alias(c) for c in ["ts", *columns]))
