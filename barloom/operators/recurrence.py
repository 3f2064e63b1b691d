"""Recursive indicators of long histories, split over tasks.

A recursive mean is an affine map of the mean before it, so what a chunk of bars does to any mean is a handful of
numbers. Each chunk sums itself up, the sums of a symbol are folded in order into what each chunk starts from, and a last
pass computes the chunks side by side. The signal line and D are means of such means and take one more round. Symbols of
one chunk skip all that: they meet in the last pass only, which is the only pass if no symbol is longer.

Bars with equal ``ts`` come in the order of close, high and low; bars without ``ts`` come last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import ewm, ewm_after, ewm_step

#: Bars of a symbol after which the next hour begins another chunk.
CHUNK = 65_536
#: Bars that the widest window looks back.
BACK = 8
#: Weight of a new value and values needed, of the means over bars and of the means over those.
FIRST = {"fast": (2 / 13, 0), "slow": (2 / 27, 0), "gain": (1 / 14, 14), "loss": (1 / 14, 14), "k": (1 / 3, 9), "tr": (1 / 14, 14)}
SECOND = {"signal": (2 / 10, 0), "d": (1 / 3, 9)}
START = (np.nan, 0.0, 0.0)
_KEYS = "symbol string, chunk long"


def chunked(bars: DataFrame, size: int) -> DataFrame:
    """Bars with the number of their chunk and whether their symbol has several.

    Chunks are cut between hours at multiples of ``size`` bars, by the counts of bars an hour.
    """
    hour = F.coalesce(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000), F.lit(2**62))
    rows = bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")), hour.alias("hour"))
    before = F.sum("n").over(Window.partitionBy("symbol").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours = rows.groupBy("symbol", "hour").agg(F.count("*").alias("n")).withColumn("chunk", F.floor(F.coalesce(before, F.lit(0)) / size))
    cuts = hours.withColumn("_last", F.max("chunk").over(Window.partitionBy("symbol"))).where("_last > 0")
    cuts = cuts.select(F.col("symbol").alias("_symbol"), F.col("hour").alias("_hour"), "chunk")
    joined = rows.join(cuts, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("hour").eqNullSafe(F.col("_hour")), "left")  # null-safe, so that no pass filters the bars and exchanges can be reused
    return joined.select("symbol", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.col("chunk").isNotNull().alias("long"), "ts", "high", "low", "close")


def in_order(frame: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A chunk's bars by time, and their high, low and close."""
    frame = frame.sort_values(["ts", "close", "high", "low"], kind="stable")
    return frame, frame[["high", "low", "close"]].to_numpy(float)


def inputs(prices: np.ndarray, tail: np.ndarray) -> dict[str, np.ndarray]:
    """What the first means run over, for bars that follow those of ``tail``."""
    high, low, close = np.concatenate([tail, prices]).T
    before = np.concatenate([[np.nan], close[:-1]])[: len(close)]
    move = close - before
    top, bottom = (getattr(pd.Series(x).rolling(BACK + 1), f)().to_numpy() for x, f in ((high, "max"), (low, "min")))
    with np.errstate(divide="ignore", invalid="ignore"):
        rsv = np.where(top > bottom, (close - bottom) / (top - bottom) * 100, np.nan)
        wide = np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))
    # np.maximum keeps a missing move missing
    found = {"fast": close, "slow": close, "gain": np.maximum(move, 0), "loss": np.maximum(-move, 0), "k": rsv, "tr": wide}
    return {name: x[len(tail):] for name, x in found.items()}


def means(x: dict[str, np.ndarray], kinds: dict, carries: list[tuple]) -> dict[str, np.ndarray]:
    return {name: ewm(x[name], *kinds[name], carry) for name, carry in zip(kinds, carries)}


def steps(x: dict[str, np.ndarray], kinds: dict) -> np.ndarray:
    return np.array([ewm_step(x[name], alpha) for name, (alpha, _) in kinds.items()])


def after(carries: list[tuple], found: np.ndarray, kinds: dict) -> list[tuple]:
    return [ewm_after(c, s, alpha) for c, s, (alpha, _) in zip(carries, found, kinds.values())]


def second_inputs(first: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {"signal": first["fast"] - first["slow"], "d": first["k"]}


def _numbers(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw).reshape(-1, width)


def _carries(raw: bytes) -> list[tuple]:
    return [tuple(c) for c in _numbers(raw, 3)]


def _sum_up(frame: pd.DataFrame) -> pd.DataFrame:
    """A chunk's first and last bars, and the steps of the bars whose windows lie inside it."""
    _, prices = in_order(frame)
    inner = steps(inputs(prices[BACK:], prices[:BACK]), FIRST)
    return pd.DataFrame({"symbol": frame["symbol"].iloc[:1].array, "chunk": frame["chunk"].iloc[:1].array, "head": [prices[:BACK].tobytes()], "tail": [prices[-BACK:].tobytes()], "inner": [inner.tobytes()]})


def _fold_first(chunks: pd.DataFrame) -> pd.DataFrame:
    """The bars before each chunk of a symbol and the carries into it."""
    chunks = chunks.sort_values("chunk")
    tail, carries, tails, into = np.empty((0, 3)), [START] * len(FIRST), [], []
    for head, last, inner in zip(chunks["head"], chunks["tail"], chunks["inner"]):
        tails.append(tail.tobytes())
        into.append(np.array(carries).tobytes())
        carries = after(carries, steps(inputs(_numbers(head, 3), tail), FIRST), FIRST)
        carries = after(carries, _numbers(inner, 7), FIRST)
        tail = np.concatenate([tail, _numbers(last, 3)])[-BACK:]
    return chunks[["symbol", "chunk"]].assign(tail=tails, first=into)


def _sum_up_second(frame: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    _, prices = in_order(frame)
    first = means(inputs(prices, _numbers(carry["tail"].iloc[0], 3)), FIRST, _carries(carry["first"].iloc[0]))
    return carry.assign(inner=[steps(second_inputs(first), SECOND).tobytes()])


def _fold_second(chunks: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values("chunk")
    carries, into = [START] * len(SECOND), []
    for inner in chunks["inner"]:
        into.append(np.array(carries).tobytes())
        carries = after(carries, _numbers(inner, 7), SECOND)
    return chunks[["symbol", "chunk", "tail", "first"]].assign(second=into)


def _values(frame: pd.DataFrame, carry: pd.DataFrame) -> pd.DataFrame:
    """All indicators of a chunk; one without a carry is a symbol's only one."""
    frame, prices = in_order(frame)
    tail, into, again = np.empty((0, 3)), [START] * len(FIRST), [START] * len(SECOND)
    if len(carry):
        tail, into, again = _numbers(carry["tail"].iloc[0], 3), _carries(carry["first"].iloc[0]), _carries(carry["second"].iloc[0])
    m = means(inputs(prices, tail), FIRST, into)
    two = second_inputs(m)
    n = means(two, SECOND, again)
    with np.errstate(divide="ignore", invalid="ignore"):
        rsi = np.where(m["gain"] == m["gain"], np.where(m["loss"] == 0, 100.0, 100 - 100 / (1 + m["gain"] / m["loss"])), np.nan)
    out = {"ema12": m["fast"], "ema26": m["slow"], "macd": two["signal"], "macd_signal": n["signal"], "macd_hist": two["signal"] - n["signal"], "rsi14": rsi, "k": m["k"], "d": n["d"], "atr14": m["tr"]}
    return frame[["symbol", "ts"]].assign(**out)


def _whole(frame: pd.DataFrame) -> pd.DataFrame:
    return _values(frame, frame.iloc[:0])


def any_longer(bars: DataFrame, size: int) -> bool:
    """Whether some symbol has more bars; only that one bit comes to the driver."""
    return not bars.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") > size).isEmpty()


def values(bars: DataFrame, columns: list[str], size: int = CHUNK) -> DataFrame:
    """symbol, ts and the recursive indicators of every bar; NaN where there is none yet.

    Bars are counted by symbol first, since the passes between chunks cost more than the values where none has several.
    """
    kinds, keys = f"symbol string, ts timestamp, {', '.join(f'{c} double' for c in columns)}", ("symbol", "chunk")
    if not any_longer(bars, size):
        whole = bars.select("symbol", "ts", *(F.col(c).cast("double").alias(c) for c in ("high", "low", "close")))
        return whole.groupBy("symbol").applyInPandas(_whole, kinds)
    rows = chunked(bars, size)
    pieces = rows.where("long").groupBy(*keys)
    sums = pieces.applyInPandas(_sum_up, f"{_KEYS}, head binary, tail binary, inner binary")
    first = sums.groupBy("symbol").applyInPandas(_fold_first, f"{_KEYS}, tail binary, first binary")
    sums = pieces.cogroup(first.groupBy(*keys)).applyInPandas(_sum_up_second, f"{_KEYS}, tail binary, first binary, inner binary")
    carries = sums.groupBy("symbol").applyInPandas(_fold_second, f"{_KEYS}, tail binary, first binary, second binary")
    return rows.groupBy(*keys).cogroup(carries.groupBy(*keys)).applyInPandas(_values, kinds)
