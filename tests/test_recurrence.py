"""Recurrences split into chunks equal those of whole histories."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.operators import indicators, recurrence
from barloom.operators.windows import ewm, ewm_after, ewm_step

COLUMNS = list(indicators.RECURSIVE)


def by_pandas(frame: pd.DataFrame) -> pd.DataFrame:
    """The same indicators over one whole history, written plainly."""
    h, low, c = frame["high"], frame["low"], frame["close"]
    mean = lambda s, alpha, least=0: s.ewm(alpha=alpha, adjust=False, min_periods=least).mean()
    macd = mean(c, 2 / 13) - mean(c, 2 / 27)
    gain, loss = mean(c.diff().clip(lower=0), 1 / 14, 14), mean((-c.diff()).clip(lower=0), 1 / 14, 14)
    top, bottom = h.rolling(9).max(), low.rolling(9).min()
    k = mean((c - bottom) / (top - bottom).where(top > bottom) * 100, 1 / 3, 9)
    tr = pd.concat([h - low, (h - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    signal = mean(macd, 0.2)
    rsi = (100 - 100 / (1 + gain / loss.where(loss != 0))).where(loss != 0, 100).where(gain.notna())
    out = [mean(c, 2 / 13), mean(c, 2 / 27), macd, signal, macd - signal, rsi, k, mean(k, 1 / 3, 9), mean(tr, 1 / 14, 14)]
    return pd.DataFrame(dict(zip(COLUMNS, out)))


def history(n, seed, gaps=0.0, freq="1min"):
    rng = np.random.default_rng(seed)
    close = 100 + np.cumsum(rng.normal(0, 0.1, n))
    close[rng.random(n) < gaps] = np.nan
    return pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=n, freq=freq), "high": np.nan_to_num(close, nan=100) + rng.random(n), "low": np.nan_to_num(close, nan=100) - rng.random(n), "close": close})


def split(frame, symbol, spark, size):
    df = spark.createDataFrame(frame.assign(symbol=symbol)).withColumns({c: F.nanvl(c, F.lit(None)) for c in ("high", "low", "close")})
    return recurrence.values(df, COLUMNS, size).orderBy("ts").toPandas()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100).map(lambda x: round(x, 3))), max_size=60), st.lists(st.integers(0, 60), max_size=6), st.sampled_from([(1 / 14, 14), (2 / 13, 0), (1 / 3, 9)]))
def test_steps_compose_at_any_cut(raw, cuts, kind):
    x = np.array([np.nan if v is None else v for v in raw], float)
    alpha, least = kind
    expected = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
    carry, found = recurrence.START, []
    for part in np.split(x, sorted(cuts)):
        found.append(ewm(part, alpha, least, carry))
        carry = ewm_after(carry, ewm_step(part, alpha), alpha)
    np.testing.assert_allclose(np.concatenate(found), expected, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize(("n", "size", "gaps", "freq"), [(700, 60, 0.0, "1min"), (700, 60, 0.3, "1min"), (60, 1, 0.1, "1h"), (40, 2, 0.9, "1D"), (300, 7, 0.0, "9min")])
def test_chunks_equal_whole_histories(spark, n, size, gaps, freq):
    frame = history(n, n, gaps, freq)
    got, expected = split(frame, "T", spark, size), by_pandas(frame)
    for c in COLUMNS:
        np.testing.assert_allclose(got[c].to_numpy(float), expected[c].to_numpy(float), rtol=1e-8, atol=1e-8, err_msg=c)


def test_a_million_bars_of_one_symbol_in_many_chunks(spark, tmp_path):
    frame = history(1_000_000, 7, 0.01)
    frame.assign(symbol="HOT").to_parquet(tmp_path / "hot.parquet", coerce_timestamps="us")
    df = spark.read.parquet(f"file://{tmp_path}/hot.parquet").withColumns({c: F.nanvl(c, F.lit(None)) for c in ("high", "low", "close")})
    chunks = recurrence.chunked(df, recurrence.CHUNK).groupBy("chunk").count().toPandas()
    assert len(chunks) == 16 and chunks["count"].max() <= recurrence.CHUNK + 60 and chunks["count"].sum() == 1_000_000
    got, expected = recurrence.values(df, COLUMNS).toPandas().sort_values("ts"), by_pandas(frame)
    for c in COLUMNS:
        np.testing.assert_allclose(got[c].to_numpy(float), expected[c].to_numpy(float), rtol=1e-7, atol=1e-7, err_msg=c)


def test_nulls_ties_empty_and_mixed_lengths(spark):
    long, short = history(200, 1), history(20, 2)
    df = spark.createDataFrame(pd.concat([long.assign(symbol="L"), short.assign(symbol="S"), short.assign(symbol=None)]))
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, "S")], df.schema)).withColumn("chunk", F.lit("clash"))
    got = indicators.recursive(df, 6, chunk=50).toPandas()
    assert len(got) == 241 and got["symbol"].isna().sum() == 20 and got["ts"].isna().sum() == 1
    same = indicators.recursive(df, 6).toPandas()
    order = ["symbol", "ts"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), same.sort_values(order, ignore_index=True), atol=2e-6)
    assert indicators.recursive(df.where("false")).count() == 0
    tied = df.where("symbol = 'L'").unionByName(df.where("symbol = 'L'"))
    assert indicators.recursive(tied, chunk=50).count() == 400
