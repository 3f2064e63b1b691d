"""Rule-based readings of a snapshot and their fusion into a score.

Each rule gives a stance (1 bullish, -1 bearish, 0 neutral) and a strength from 0 to 100, or nothing where its inputs
are missing. Rules are CASE chains, so all of them run in one projection over any number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weight of each rule in the score.
WEIGHTS = {"trend": 1.6, "rsi": 1.0, "macd": 1.3, "kd": 0.9, "bollinger": 0.9, "bias": 0.7, "volume": 0.9, "position_52w": 0.7, "volatility": 0.5, "sentiment": 1.1, "forecast": 1.2}
LABELS = {1: "bullish", 0: "neutral", -1: "bearish"}


def _rule(cases: list[tuple[Column | None, int, Column | float]], *needs: Column) -> Column:
    """The first case that holds, as struct(dir, strength); null if any needed input is."""
    out = None
    for when, way, strength in cases:
        level = F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), strength if isinstance(strength, Column) else F.lit(float(strength))))).cast("int")
        value = F.struct(F.lit(way).alias("dir"), level.alias("strength"))
        out = value if when is None and out is None else out.otherwise(value) if when is None else (F if out is None else out).when(when, value)
    known = F.lit(True)
    for n in needs:
        known = known & n.isNotNull()
    return F.when(known, out)


def rules() -> dict[str, Column]:
    """Expressions over a snapshot's columns; sentiment and forecast fields may be null."""
    c = F.col
    px, s5, s20, s60 = c("close"), c("sma5"), c("sma20"), c("sma60")
    rising = F.coalesce(s20 > c("sma20_prev"), F.lit(False))
    stacked = lambda up: F.coalesce((s5 > s20) & (s20 > s60) & (px > s20) if up else (s5 < s20) & (s20 < s60) & (px <= s20), F.lit(False))
    r, h, h0 = c("rsi14"), c("macd_hist"), c("macd_hist_prev")
    k, d, k0, d0 = c("k"), c("d"), c("k_prev"), c("d_prev")
    golden, dead = F.coalesce((k0 <= d0) & (k > d), F.lit(False)), F.coalesce((k0 >= d0) & (k < d), F.lit(False))
    up, lo, width = c("bb_upper"), c("bb_lower"), c("bb_width")
    b = (px - lo) / F.nullif(up - lo, F.lit(0.0)) * 100
    bias, v, vm = c("bias20"), c("volume"), c("volume_ma20")
    surge, gain = v / F.nullif(vm, F.lit(0.0)), F.coalesce(c("change_pct"), F.lit(0.0)) >= 0
    obv_up = F.coalesce(c("obv") > c("obv_5ago"), F.lit(False))
    p, vol = c("position_52w"), c("volatility")
    mood, label, n = c("sentiment_score"), c("sentiment_label"), c("sentiment_records")
    change, trust = c("forecast_change_pct"), F.when(c("forecast_accuracy").isNull(), 0.5).otherwise(F.greatest(F.lit(0.2), F.least(F.lit(1.0), c("forecast_accuracy") / 100)))
    reach = F.least(F.lit(90.0), F.abs(change) * 12 + 30) * trust + 15
    return {
        "trend": _rule([(stacked(True), 1, 88), (stacked(False), -1, 88), ((px > s20) & rising, 1, 65), ((px <= s20) & ~rising, -1, 65), (None, 0, 40)], px, s20),
        "rsi": _rule([(r >= 80, -1, 75), (r >= 70, -1, 55), (r <= 20, 1, 75), (r <= 30, 1, 55), (r >= 55, 1, 45), (r <= 45, -1, 45), (None, 0, 30)], r),
        "macd": _rule([(F.coalesce((h0 <= 0) & (h > 0), F.lit(False)), 1, 85), (F.coalesce((h0 >= 0) & (h < 0), F.lit(False)), -1, 85), (h > 0, 1, F.when(h > h0, 70.0).otherwise(50.0)), (None, -1, F.when(h < h0, 70.0).otherwise(50.0))], h),
        "kd": _rule([(golden & (k < 50), 1, 80), (dead & (k > 50), -1, 80), ((k >= 80) & (d >= 80), -1, 60), ((k <= 20) & (d <= 20), 1, 60), (k > d, 1, 45), (None, -1, 45)], k, d),
        "bollinger": F.when(up > lo, _rule([(b >= 100, -1, 65), (b <= 0, 1, 65), (width < 8, 0, 55), (b >= 70, 1, 50), (b <= 30, -1, 50), (None, 0, 30)], px, up, lo)),
        "bias": _rule([(bias >= 12, -1, 70), (bias <= -12, 1, 70), (bias >= 3, 1, 40), (bias <= -3, -1, 40), (None, 0, 25)], bias),
        "volume": F.when((v != 0) & (vm != 0), _rule([((surge >= 1.8) & gain, 1, 80), (surge >= 1.8, -1, 75), (surge <= 0.6, 0, 45), (obv_up, 1, 45), (None, 0, 30)], v, vm)),
        "position_52w": _rule([(p >= 90, 1, 65), (p <= 10, -1, 65), (p >= 65, 1, 45), (p <= 35, -1, 45), (None, 0, 25)], p),
        "volatility": _rule([(vol >= 45, -1, 60), (vol <= 15, 0, 35), (None, 0, 25)], vol),
        "sentiment": F.when(n > 0, _rule([(label == "positive", 1, 50 + F.least(F.lit(35.0), F.abs(mood))), (label == "negative", -1, 50 + F.least(F.lit(35.0), F.abs(mood))), (None, 0, 30)], mood)),
        "forecast": _rule([(change >= 1, 1, reach), (change <= -1, -1, reach), (None, 0, 30)], change),
    }


def with_signals(snap: DataFrame) -> DataFrame:
    """Snapshots with one struct per rule in ``signals``, a map from the rule's name."""
    missing = {"sentiment_score": "double", "sentiment_label": "string", "sentiment_records": "long", "forecast_change_pct": "double", "forecast_accuracy": "double"}
    full = snap.withColumns({k: F.lit(None).cast(t) for k, t in missing.items() if k not in snap.columns})
    return full.withColumns({f"sig_{k}": v for k, v in rules().items()})


def stance(score: Column) -> Column:
    return F.when(score >= 35, "bullish").when(score >= 12, "slightly_bullish").when(score <= -35, "bearish").when(score <= -12, "slightly_bearish").otherwise("neutral")


def market_read(signals: DataFrame) -> DataFrame:
    """Score, stance, counts and confidence of each row of ``with_signals``."""
    every = F.array(*(F.when(F.col(f"sig_{k}").isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"sig_{k}.dir").alias("dir"), F.col(f"sig_{k}.strength").alias("strength"), F.lit(w).alias("weight"))) for k, w in WEIGHTS.items()))
    df = signals.withColumn("signals", F.filter(every, lambda s: s.isNotNull()))
    total = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["weight"])
    force = F.aggregate("signals", F.lit(0.0), lambda a, s: a + s["dir"] * s["strength"] / 100.0 * s["weight"])
    raw = F.coalesce(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), force / F.nullif(total, F.lit(0.0)) * 100)), F.lit(0.0))
    count = lambda way: F.size(F.filter("signals", lambda s: s["dir"] == way))
    df = df.withColumns({"_raw": raw, "bullish": count(1), "bearish": count(-1), "neutral": count(0)})
    sure = F.coalesce(F.abs(F.col("bullish") - F.col("bearish")) / F.nullif((F.col("bullish") + F.col("bearish")).cast("double"), F.lit(0.0)), F.lit(0.0))
    confidence = F.bround(F.least(F.lit(90.0), 30 + sure * 45 + F.least(F.size("signals"), F.lit(10)) * 1.2)).cast("int")
    return df.withColumns({"score": F.round("_raw", 1), "stance": stance(F.col("_raw")), "confidence": confidence, "risk_note": risk_note()}).drop("_raw")


# The sentences of the risk note and of a reading without data.
_NO_RISK = "目前沒有偵測到特別突出的風險項目，但市場仍可能受突發消息影響"
_NO_DATA = ("資料不足，無法判讀", "目前沒有足夠的歷史價格資料可以計算技術指標，請改用較長的時間區間再試一次。")


def risk_note() -> Column:
    """What speaks against relying on a reading; signals conflict as soon as both directions occur."""
    sample = F.coalesce("sample", F.lit(0))
    notes = [
        (F.col("volatility") >= 40, F.format_string("年化波動度高達 %.0f%%，單日跳動幅度大", F.bround("volatility"))),
        (F.col("rsi14") >= 75, F.lit("RSI 已進入超買區，追價風險偏高")),
        (F.col("rsi14") <= 25, F.lit("RSI 已進入超賣區，不宜貿然摸底")),
        (sample < 60, F.concat(F.lit("歷史資料僅 "), sample.cast("string"), F.lit(" 筆，指標與預測的穩定度較低"))),
        ((F.col("bullish") > 0) & (F.col("bearish") > 0), F.lit("指標之間存在分歧，代表盤勢處於轉折或整理階段")),
    ]
    said = F.concat_ws("；", *(F.when(when, text) for when, text in notes))
    return F.concat(F.when(said == "", _NO_RISK).otherwise(said), F.lit("。"))


def with_no_data(wanted: DataFrame, read: DataFrame) -> DataFrame:
    """A reading for each of the ``wanted`` symbols: status ready, or no_data with a neutral reading where there is none."""
    blank = {"score": F.lit(0.0), "stance": F.lit("neutral"), "bullish": F.lit(0), "bearish": F.lit(0), "neutral": F.lit(0)}
    df = wanted.select("symbol").distinct().join(read.withColumn("status", F.lit("ready")), "symbol", "left")
    df = df.withColumns({k: F.coalesce(F.col(k), v) for k, v in blank.items()} | {"status": F.coalesce("status", F.lit("no_data"))})
    texts = {"no_data_headline": _NO_DATA[0], "no_data_summary": _NO_DATA[1]}
    return df.withColumns({k: F.when(F.col("status") == "no_data", v) for k, v in texts.items()})


def headline(read: DataFrame, top: int = 3) -> DataFrame:
    """The strongest signals on each side, by strength and then in order of the rules, as a sentence."""
    def side(way: int) -> Column:
        mine = F.filter(F.transform("signals", lambda s, i: F.struct((-s["strength"]).alias("rank"), i.alias("at"), s["key"].alias("key"), s["dir"].alias("dir"))), lambda s: s["dir"] == way)
        return F.transform(F.slice(F.array_sort(mine), 1, top), lambda s: s["key"])

    df = read.withColumns({"bull_keys": side(1), "bear_keys": side(-1)})
    says = F.concat_ws("; ", F.when(F.size("bull_keys") > 0, F.concat(F.lit("for: "), F.array_join("bull_keys", ", "))), F.when(F.size("bear_keys") > 0, F.concat(F.lit("against: "), F.array_join("bear_keys", ", "))))
    return df.withColumn("headline", F.concat(F.col("stance"), F.lit(" ("), F.format_string("%+.1f", "score"), F.lit(")"), F.when(says != "", F.concat(F.lit(" - "), says)).otherwise(F.lit(""))))
