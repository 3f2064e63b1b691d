"""Properties and closed-form checks of the market operators on generated bars."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.operators import actions, forecast, indicators, risk, signals
from barloom.operators.windows import ewm, previous
from barloom.plans import insight
from barloom.sources import bars as source


def make(spark, closes, symbol="T", start=datetime(2022, 1, 3)):
    days, day = [], start
    while len(days) < len(closes):
        if day.weekday() < 5:
            days.append(day)
        day += timedelta(days=1)
    closes = [float(c) for c in closes]
    rows = [(symbol, d, round(c * 0.995, 2), round(c * 1.01, 2), round(c * 0.99, 2), round(float(c), 2), 1_000_000 + 1000 * i) for i, (d, c) in enumerate(zip(days, closes))]
    return spark.createDataFrame(rows, schemas.BARS)


def trend(n=300, slope=0.3, base=100.0, noise=1.0, seed=42):
    return np.maximum(1, base + slope * np.arange(n) + np.random.default_rng(seed).normal(0, noise, n))


@pytest.mark.parametrize("gaps", [[], [3, 4, 9], [0, 1, 20]])
def test_ewm_matches_pandas(gaps):
    x = np.random.default_rng(1).normal(size=60)
    x[gaps] = np.nan
    for alpha, least in ((1 / 14, 14), (2 / 13, 0), (1 / 3, 9)):
        expected = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy()
        np.testing.assert_allclose(ewm(x, alpha, least), expected, rtol=1e-12, equal_nan=True)


def test_indicator_warm_up_and_bounds(spark):
    df = indicators.indicators(make(spark, trend())).orderBy("ts").toPandas()
    assert df["sma20"].isna().sum() == 19 and df["sma240"].isna().sum() == 239
    assert df["rsi14"].isna().sum() == 14 and df["k"].isna().sum() == 16 and df["d"].isna().sum() == 24 and df["atr14"].isna().sum() == 13
    assert df["rsi14"].dropna().between(0, 100).all() and df["rsi14"].iloc[-1] > 50
    assert (df["bb_upper"].dropna() >= df["bb_lower"].dropna()).all()


def test_rsi_of_flat_series_is_100(spark):
    df = indicators.recursive(make(spark, [100.0] * 40)).toPandas()
    assert (df["rsi14"].dropna() == 100).all()


@pytest.mark.parametrize(("slope", "base", "sign"), [(0.35, 100, 1), (-0.35, 250, -1)])
def test_market_read_follows_the_trend(spark, slope, base, sign):
    snap = indicators.latest(indicators.snapshots(indicators.indicators(make(spark, trend(slope=slope, base=base)))))
    row = signals.headline(signals.market_read(signals.with_signals(snap))).first()
    assert row["score"] * sign > 0 and -100 <= row["score"] <= 100 and row["sig_trend"]["dir"] == sign and row["headline"]


def test_short_and_empty_series(spark):
    short = make(spark, trend(10))
    assert risk.risk_metrics(short.limit(3)).first()["status"] == "insufficient_data"
    assert forecast.forecast(short).first()["status"] == "insufficient_history"
    none = short.where("false")
    assert risk.risk_metrics(none).count() == 0 and forecast.forecast(none).count() == 0 and indicators.indicators(none).count() == 0


def test_drawdown_golden(spark):
    row = risk.drawdowns(make(spark, [100, 120, 90, 110])).first()
    assert row["max_drawdown_pct"] == -25.0 and row["peak_ts"] < row["trough_ts"]


def test_beta_against_itself_is_one(spark):
    b = make(spark, trend(500))
    row = risk.beta(b, b.select("ts", "close")).first()
    assert row["beta"] == pytest.approx(1.0) and row["correlation"] == pytest.approx(1.0)
    assert risk.beta(b.limit(5), b.select("ts", "close")).first()["beta"] is None


def loop(closes, days, dividends, amount, reinvest):
    months, shares, cash, total, seen = {}, 0.0, 0.0, 0.0, list(dividends)
    for d, c in zip(days, closes):
        months.setdefault((d.year, d.month), (d, c))
    for d, c in sorted(months.values()):
        while seen and seen[0][0] <= d:
            pay = shares * seen.pop(0)[1]
            total += pay
            if reinvest:
                shares += pay / c
            else:
                cash += pay
        shares += amount / c
    for _, a in seen:
        pay = shares * a
        total += pay
        if reinvest:
            shares += pay / closes[-1]
        else:
            cash += pay
    return shares * closes[-1] + cash, total


@pytest.mark.parametrize("reinvest", [True, False])
def test_saving_plan_matches_a_loop(spark, reinvest):
    b = make(spark, trend(520, 0.15))
    pdf = b.orderBy("ts").toPandas()
    days = [t.date() for t in pdf["ts"]]
    divs = [(days[i], 0.5 + i / 1000) for i in range(10, 515, 21)]
    frame = spark.createDataFrame([("T", d, a) for d, a in divs], schemas.DIVIDENDS)
    row = risk.saving_plan(b, frame, 1000.0, reinvest).first()
    value, total = loop(list(pdf["close"]), days, divs, 1000.0, reinvest)
    assert row["final_value"] == pytest.approx(value, abs=0.02) and row["dividend_total"] == pytest.approx(total, abs=0.02)
    assert risk.saving_plan(b, frame, 2000.0, reinvest).first()["final_value"] == pytest.approx(2 * value, abs=0.05)


def test_flat_saving_plan_breaks_even(spark):
    row = risk.saving_plan(make(spark, [50.0] * 400)).first()
    assert row["total_return_pct"] == 0 and row["average_cost"] == 50


def test_forecast_shape(spark):
    for closes in (trend(), [100.0] * 200):
        row = forecast.forecast(make(spark, closes), 14).first()
        assert row["status"] == "ready" and len(row["ensemble"]) == 14
        assert all(lo <= p <= hi for lo, p, hi in zip(row["lower"], row["ensemble"], row["upper"]))
        assert sum(m["weight_pct"] for m in row["models"]) == pytest.approx(100, abs=0.6)
        assert all(abs(p / row["last"] - 1) <= 0.351 for p in row["ensemble"])


def test_vectorised_trend_fit_equals_a_plain_one():
    y, best = trend(120), None
    for a in (0.2, 0.4, 0.6, 0.8):
        for b in (0.05, 0.1, 0.2, 0.3):
            for phi in (0.85, 0.92, 0.98):
                level, slope, loss = y[0], y[1] - y[0], 0.0
                for v in y[1:]:
                    f = level + phi * slope
                    loss += (v - f) ** 2
                    new = a * v + (1 - a) * f
                    slope, level = b * (new - level) + (1 - b) * phi * slope, new
                if best is None or loss < best[0]:
                    best = loss, level + sum(phi**k for k in range(1, 6)) * slope
    assert forecast.holt(y, 5)[-1] == pytest.approx(best[1])
    assert np.allclose(forecast.holt(trend(3000, 0.05), 5), forecast.holt(trend(3000, 0.05)[-750:], 5))


def test_clean_drops_bad_rows_and_fills_volume(spark):
    rows = [("A", datetime(2024, 1, 2, 9, 30), 1.0, 2.0, 0.5, 1.234, None), ("A", None, 1.0, 2.0, 0.5, 1.0, 5), ("A", datetime(2024, 1, 3), 1.0, None, 0.5, 1.0, 5)]
    out = source.clean(spark.createDataFrame(rows, schemas.BARS), intraday=True).collect()
    assert len(out) == 1 and out[0]["volume"] == 0 and out[0]["close"] == 1.23 and out[0]["date"] == "2024-01-02 09:30"


def test_dividend_goldens(spark):
    quarterly = [("Q", date(y, m, 15), 2.5) for y in (2022, 2023, 2024) for m in (3, 6, 9, 12)]
    monthly = [("M", date(2023 + i // 12, i % 12 + 1, 28), 0.1) for i in range(24)]
    yearly = [("Y", date(y, 7, 20), a) for y, a in ((2021, 2.0), (2022, 2.5), (2023, 3.0), (2024, 3.2))]
    df = spark.createDataFrame(quarterly + monthly + yearly + [("Q", date(2024, 1, 1), -1.0)], schemas.DIVIDENDS)
    prices = spark.createDataFrame([("Y", 100.0)], "symbol string, close double")
    got = {r["symbol"]: r for r in actions.dividend_summary(df, F.lit(date(2025, 1, 5)), prices).collect()}
    assert got["Q"]["frequency"] == "quarterly" and got["M"]["frequency"] == "monthly" and got["Y"]["frequency"] == "annual"
    assert got["Y"]["streak"] == 4 and got["Y"]["years_paid"] == 4 and got["Y"]["ttm_yield"] == 3.2


def test_split_and_rights_goldens(spark):
    day = date(2024, 1, 2)
    df = spark.createDataFrame([("A", day, 4.0), ("B", day, 0.2), ("C.TW", day, 1.1), ("D.TW", day, 2.0), ("E", day, 1.1)], schemas.SPLITS)
    s = {r["symbol"]: (r["kind"], r["text"]) for r in actions.splits(df).collect()}
    assert s == {"A": ("split", "1:4"), "B": ("reverse_split", "5:1"), "D.TW": ("split", "1:2"), "E": ("split", "1:1.10")}
    assert [(r["symbol"], r["shares_per_1000"]) for r in actions.rights_from_splits(df).collect()] == [("C.TW", 100.0)]


def test_holdings_share_one_scale(spark):
    df = spark.createDataFrame([("a", "x", "0.5712"), ("a", "y", "0.0421"), ("b", "x", "7.12"), ("b", "y", "6.05"), ("b", "z", "n/a"), ("c", "x", "40.0"), ("c", "y", "0.9")], "fund string, symbol string, weight string")
    got = {(r["fund"], r["symbol"]): r["weight_pct"] for r in actions.shared_scale(df, "fund").collect()}
    assert got == {("a", "x"): 57.12, ("a", "y"): 4.21, ("b", "x"): 7.12, ("b", "y"): 6.05, ("c", "x"): 40.0, ("c", "y"): 0.9}


def test_insight_composes(spark):
    b = make(spark, trend(), "A").unionByName(make(spark, trend(slope=-0.2, base=200), "B"))
    rows = insight.payload(insight.insight(b, benchmark=b.where("symbol = 'A'").select("ts", "close"))).collect()
    assert {r["symbol"] for r in rows} == {"A", "B"} and all("score" in r["json"] for r in rows)
    assert [r["symbol"] for r in insight.compare(b, ["A", "B"]).orderBy("rank").collect()] == ["A", "B"]


def test_insight_computes_its_bars_once(spark):
    b, read = make(spark, trend(), "A"), spark.sparkContext.accumulator(0)

    def seen(frames):
        for frame in frames:
            read.add(len(frame))
            yield frame

    assert len(insight.insight(b.mapInPandas(seen, b.schema)).collect()) == 1
    assert read.value == b.count()


@pytest.mark.parametrize("back", [1, 5])
def test_previous_skips_nulls(spark, back):
    rng = np.random.default_rng(3)
    values = [None if rng.random() < 0.4 else float(i) for i in range(60)]
    rows = [("T", datetime(2024, 1, 1) + timedelta(days=i), v) for i, v in enumerate(values)] + [("U", datetime(2024, 1, 1), None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double").withColumn("p", previous("x", back))
    found = [r["p"] for r in df.where("symbol = 'T'").orderBy("ts").collect()]
    valid = [[v for v in values[: i + 1] if v is not None] for i in range(60)]
    assert found == [v[-1 - back] if len(v) > back else None for v in valid]
    assert df.where("symbol = 'U'").first()["p"] is None


def test_band_of_one_walk_forward_run(spark):
    row = forecast.forecast(make(spark, trend(38))).first()
    assert row["upper"][-1] / row["ensemble"][-1] - 1 == pytest.approx(0.005 * 1.2816, abs=3e-4)


def test_band_without_walk_forward_run(spark):
    row = forecast.forecast(make(spark, trend(33))).first()
    assert row["upper"][-1] / row["ensemble"][-1] - 1 == pytest.approx(0.05 * 1.2816, abs=3e-4) and row["accuracy_pct"] == 50.0


@pytest.mark.parametrize("name", ["sectors_top10", "holdings_scale"])
def test_weights_between_two_decimals_are_ranked_as_in_sql(spark, tmp_path, name):
    import duckdb

    import __spark_entry__ as registry

    revenue = {"A": 1000.0, "B": 1005.0, "C": 1004.0, "D": 8575.0, "E": 28.5, "F": 29.0, "G": 4350.0, "H": 84008.5}
    lines = [(i, 10 * fund + i, fund, rev) for fund in (1, 2) for i, rev in enumerate(revenue.values())]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10 * fund + i, brand) for fund in (1, 2) for i, brand in enumerate(revenue)], "p_partkey long, p_brand string").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, 1), (2, 2)], "s_suppkey long, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    with duckdb.connect() as db:
        for table in ("lineitem", "part", "supplier"):
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        want = db.execute(registry.oracle_sql()[name]).fetchall()
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert len(want) == 2 * len(revenue) and sorted(map(tuple, got)) == sorted(want)
