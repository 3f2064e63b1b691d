"""Lexicon sentiment, calibration between models, and the A/B split and report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hash_ratio

# Terms and weights of the default lexicon. Weights of terms that aren't listed count once a caller adds them.
POSITIVE = [
    "樂觀", "上漲", "利多", "創高", "成長", "看好", "回升", "擴產", "突破", "獲利", "增持", "買進", "強勁", "飆升", "彈升", "勁揚", "收紅", "翻紅", "續強", "站上", "攻上", "躍升", "新高", "bullish", "beat", "surge",
    "漲停", "走強", "大漲", "轉強", "優於預期", "超預期", "營收成長", "毛利提升", "淨利提升", "訂單回溫", "接單強勁", "需求回溫", "庫存去化", "調升", "上修", "加碼", "回購", "配息", "創新高", "利潤擴大", "outperform", "upgrade", "strong buy", "guidance raised", "record high", "growth",
]
NEGATIVE = [
    "下跌", "利空", "重挫", "衰退", "看壞", "虧損", "破底", "減持", "賣出", "風險", "疲弱", "悲觀", "裁員", "下修", "跌破", "翻黑", "跳水", "下挫", "殺低", "摜破", "失守", "爆量下跌", "震盪下跌", "bearish", "miss", "plunge",
    "跌停", "走弱", "大跌", "重跌", "轉弱", "低於預期", "不如預期", "下修財測", "財測下修", "營收衰退", "毛利下滑", "淨利下滑", "需求疲軟", "庫存壓力", "砍單", "調降", "降評", "減碼", "破產", "違約", "虧損擴大", "創新低", "downgrade", "underperform", "guidance cut", "warning", "decline",
]
NEGATIONS = ["不", "未", "沒有", "無", "並非", "non", "not", "never"]
INTENSIFIERS = ["非常", "明顯", "大幅", "強烈", "顯著", "greatly", "strongly", "significantly"]
UNCERTAIN = ["但", "然而", "不過", "仍", "觀望", "中性", "持平", "尚待", "可能", "potentially", "however", "but", "uncertain"]
POSITIVE_WEIGHTS = {
    "漲停": 1.9, "暴漲": 1.8, "飆漲": 1.85, "大漲": 1.7, "historic high": 1.8, "all-time high": 1.85, "record breaking": 1.75,
    "創新高": 1.6, "創高": 1.55, "超預期": 1.5, "大幅超越": 1.55, "上修": 1.45, "獲利創高": 1.6, "guidance raised": 1.5, "beat estimates": 1.5, "earnings beat": 1.55, "raised outlook": 1.5, "upgrade": 1.45,
    "新高": 1.35, "record high": 1.35, "勁揚": 1.3, "飆升": 1.35, "站上": 1.25, "突破": 1.3, "強彈": 1.3, "回升": 1.2, "bullish": 1.25, "breakout": 1.3, "outperform": 1.3,
    "買超": 1.15, "強勁": 1.2, "樂觀": 1.1, "看好": 1.1, "買進": 1.1, "accumulate": 1.1, "positive": 1.05, "optimistic": 1.1, "momentum": 1.1,
}
NEGATIVE_WEIGHTS = {
    "破產": 2.0, "倒閉": 2.0, "下市": 1.9, "違約": 1.9, "debt default": 1.9, "bankruptcy": 2.0, "insolvency": 1.9, "liquidation": 1.9,
    "跌停": 1.7, "重挫": 1.6, "暴跌": 1.6, "崩跌": 1.65, "大幅下修": 1.6, "下修": 1.4, "虧損擴大": 1.5, "獲利預警": 1.55, "guidance cut": 1.5, "profit warning": 1.55, "downgrade": 1.5, "earnings miss": 1.45,
    "跌破": 1.35, "跳水": 1.35, "下挫": 1.3, "回落": 1.2, "失守": 1.25, "翻黑": 1.25, "warning": 1.3, "sell-off": 1.35, "bearish": 1.2,
    "觀望": 1.1, "不確定": 1.1, "審慎": 1.05, "疲軟": 1.15, "承壓": 1.15, "cautious": 1.1, "uncertainty": 1.1, "headwinds": 1.15,
}

#: label codec of the classifiers
LABEL_IDS = {"negative": 0, "neutral": 1, "positive": 2}


@dataclass(frozen=True)
class Lexicon:
    """Terms, weights and thresholds; every part can be replaced."""

    positive: list[str] = field(default_factory=lambda: POSITIVE)
    negative: list[str] = field(default_factory=lambda: NEGATIVE)
    positive_weights: dict[str, float] = field(default_factory=lambda: POSITIVE_WEIGHTS)
    negative_weights: dict[str, float] = field(default_factory=lambda: NEGATIVE_WEIGHTS)
    negations: list[str] = field(default_factory=lambda: NEGATIONS)
    intensifiers: list[str] = field(default_factory=lambda: INTENSIFIERS)
    uncertain: list[str] = field(default_factory=lambda: UNCERTAIN)
    high: float = 20.0
    low: float = -20.0


def _flips(text: str, negations: list[str], by_first: dict[str, list[str]]) -> int:
    """How often a negation stands right before a term or one blank before it; matches of one pair don't overlap."""
    flips, ends = 0, {}
    for n in negations:
        at = text.find(n)
        while at >= 0:
            start = at + len(n)
            start += text[start : start + 1] == " "
            for term in by_first.get(text[start : start + 1], ()):
                if text.startswith(term, start) and at >= ends.get((n, term), 0):
                    flips, ends[n, term] = flips + 1, start + len(term)
            at = text.find(n, at + 1)
    return flips


def _counts(lx: Lexicon) -> Callable[[str], tuple]:
    """Counts that scoring needs from one text: substring searches in C, which beat as many JVM ``replace`` scans."""
    low = lambda terms: [t.lower() for t in terms]
    weights = lambda terms, w: [(t.lower(), float({k.lower(): v for k, v in w.items()}.get(t.lower(), 1.0))) for t in terms]
    positive, negative = weights(lx.positive, lx.positive_weights), weights(lx.negative, lx.negative_weights)
    negations, boosts, doubts = low(lx.negations), low(lx.intensifiers), low(lx.uncertain)
    first = [{c: [t for t, _ in side if t[:1] == c] for c in {t[:1] for t, _ in side}} for side in (positive, negative)]

    def count(raw: str | None) -> tuple:
        text = " ".join((raw or "").split()).lower()
        p = [text.count(t) * w for t, w in positive if t in text]
        n = [text.count(t) * w for t, w in negative if t in text]
        doubt = [c for t in doubts if (c := text.count(t))]
        flips = [float(_flips(text, negations, by)) if p or n else 0.0 for by in first]
        return sum(p), sum(n), *flips, float(sum(map(text.count, boosts))), float(sum(doubt)), float(len(doubt)), float(len(p)), float(len(n))

    return count


def with_lexicon(df: DataFrame, text: str, lexicon: Lexicon | None = None) -> DataFrame:
    """``df`` with lexicon_score (-100..100) and lexicon_label; empty text is neutral."""
    lx, names = lexicon or Lexicon(), ["_p", "_n", "_pn", "_np", "_boost", "_doubt", "_u", "_pp", "_nn"]
    count = _counts(lx)

    @F.arrow_udf(", ".join(f"{n} double" for n in names))
    def counted(texts: pa.Array) -> pa.Array:  # one text at a time is a Python string
        found = np.fromiter((count(x.as_py()) for x in texts), np.dtype((float, len(names))), len(texts))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in found.T], names)

    df = df.withColumn("_c", counted(text)).select("*", "_c.*").drop("_c")
    boost = F.least(F.lit(1.25), 1 + 0.05 * F.col("_boost"))
    df = df.withColumns({"_p2": F.greatest(F.lit(0.0), F.col("_p") - F.col("_pn") + F.col("_np")) * boost, "_n2": F.greatest(F.lit(0.0), F.col("_n") - F.col("_np") + F.col("_pn")) * boost, "_doubt": F.greatest(F.lit(0.75), 1 - 0.04 * F.col("_doubt"))})
    clash = F.when((F.col("_p2") > 0) & (F.col("_n2") > 0), F.greatest(F.lit(0.7), 1 - 0.3 * F.least("_p2", "_n2") / F.greatest("_p2", "_n2", F.lit(1e-9)))).otherwise(1.0)
    total = F.col("_p2") + F.col("_n2")
    raw = F.when(total > 0, (F.col("_p2") - F.col("_n2")) / F.sqrt(F.nullif(total, F.lit(0.0))) * F.col("_doubt") * clash).otherwise(0.0)
    df = df.withColumn("_raw", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    both, size = (F.col("_pp") > 0) & (F.col("_nn") > 0), F.abs("_raw")
    calm = F.when(both & (F.col("_u") > 0), 0.35).when(both & (size < 0.55), 0.65).when(~both & (F.col("_u") >= 2) & (size < 0.7), 0.6).otherwise(1.0)
    df = df.withColumn("lexicon_score", F.round(F.col("_raw") * calm * 100, 2))
    df = df.withColumn("lexicon_label", label(F.col("lexicon_score"), lx.high, lx.low))
    return df.drop(*names, "_p2", "_n2", "_raw")


def label(score: Column, high: float = 20.0, low: float = -20.0) -> Column:
    return F.when(score >= high, "positive").when(score <= low, "negative").otherwise("neutral")


def news_text(headline: Column, content: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.coalesce(content, F.lit(""))))


def calibrated(model_score: Column, model_label: Column, lex_score: Column, lex_label: Column, clear: float = 12.0) -> tuple[Column, Column, Column]:
    """Score, label and how they came about. A clear lexicon overrides a model that is neutral or weak; equal labels that
    aren't neutral confirm; else the model stays. Unknown model labels count as neutral."""
    own = F.when(model_label.isin(*LABEL_IDS), model_label).otherwise("neutral")
    score = F.round(F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.coalesce(model_score, F.lit(0.0)))), 2)
    override = (lex_label != "neutral") & (F.abs(lex_score) >= clear) & ((own == "neutral") | (F.abs(score) < clear))
    confirm = (own == lex_label) & (lex_label != "neutral")
    mixed = F.when(override, F.round(0.35 * score + 0.65 * lex_score, 2)).when(confirm, F.round(0.7 * score + 0.3 * lex_score, 2)).otherwise(score)
    return mixed, F.when(override, lex_label).otherwise(own), F.when(override, "lexicon_override").when(confirm, "lexicon_confirmed").otherwise("rnn")


def with_fallback(model_score: Column, model_label: Column, lex_score: Column, lex_label: Column, model_type: str = "rnn") -> dict[str, Column]:
    """Score, label, status and error: the model's where it gave a score, else the lexicon's."""
    lost = F.lit(model_type == "rnn") & model_score.isNull()
    use = F.lit(model_type == "rnn") & model_score.isNotNull()
    return {
        "sentiment_score": F.when(use, model_score).otherwise(lex_score),
        "sentiment_label": F.when(use, model_label).otherwise(lex_label),
        "model_status": F.when(lost, "rnn_unavailable_fallback_lexicon").otherwise("ok"),
        "model_error": F.when(lost, "rnn_model_unavailable"),
    }


def run_summary(scored: DataFrame, bad_lines: int, seconds: float, workers: int = 1, mode: str = "single", model: str = "lexicon_baseline_v2", model_type: str = "lexicon", high: float = 20.0, low: float = -20.0) -> DataFrame:
    """One JSON document on a scoring run: records, errors, label distribution, thresholds and throughput."""
    s = distribution(scored.withColumn("_all", F.lit(1)), "_all").join(scored.agg(F.count("*").alias("records"), F.count_if(F.col("sentiment_label").isNull()).alias("errors")), F.lit(True))
    elapsed = max(1e-9, seconds)
    runtime = F.struct(F.lit(mode).alias("execution_mode"), F.lit(workers).alias("workers"), F.lit(round(elapsed, 4)).alias("seconds"), F.round(F.col("records") / elapsed, 2).alias("records_per_second"), F.lit(model).alias("model"), F.lit(model_type == "rnn").alias("is_rnn"))
    body = F.struct("records", F.lit(bad_lines).alias("bad_lines_skipped"), "errors", F.struct("positive", "neutral", "negative").alias("distribution"), F.struct(F.lit(high).alias("positive"), F.lit(low).alias("negative")).alias("thresholds"), runtime.alias("runtime"), F.lit(model_type).alias("model_type"))
    return s.select(F.to_json(body).alias("json"))


def ab_report_json(report: DataFrame) -> DataFrame:
    """The arms of ``arm_report`` as one JSON document."""
    names = [c for c in report.columns if c not in ("arm", *LABEL_IDS)]
    arm = F.struct(*names, F.struct(*LABEL_IDS).alias("distribution"))
    return report.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("arm", arm.alias("facts"))))).alias("arms")).select(F.to_json(F.struct("arms")).alias("json"))


def split_arms(df: DataFrame, key: Column, ratio: float = 0.5, salt: str = "ab", a: str = "rnn", b: str = "lexicon") -> DataFrame:
    """``df`` with arm: a where the key's hash falls below the ratio."""
    share = min(1.0, max(0.0, ratio))
    return df.withColumn("arm", F.when(hash_ratio(salt, key) < share, a).otherwise(b))


def distribution(df: DataFrame, *by: str, name: str = "sentiment_label") -> DataFrame:
    """Counts of the three labels, 0 where there are none."""
    return df.groupBy(*by).agg(*(F.count_if(F.col(name) == k).alias(k) for k in ("positive", "neutral", "negative")))


def arm_report(scored: DataFrame, seconds: DataFrame | None = None) -> DataFrame:
    """Records, errors and labels per arm, and records per second where ``seconds`` (arm, seconds) is given."""
    r = scored.groupBy("arm").agg(F.count("*").alias("records"), F.count_if(F.col("sentiment_label").isNull()).alias("errors"), *(F.count_if(F.col("sentiment_label") == k).alias(k) for k in LABEL_IDS))
    return r if seconds is None else r.join(seconds, "arm", "left").withColumn("records_per_second", F.col("records") / F.greatest("seconds", F.lit(1e-9)))


def daily_rollup(runs: DataFrame) -> DataFrame:
    """Per day and arm: runs, records, seconds and pooled throughput. runs: day, arm, records, seconds."""
    return runs.groupBy("day", "arm").agg(F.count("*").alias("runs"), F.sum("records").alias("records"), F.sum("seconds").alias("seconds")).withColumn("rps", F.col("records") / F.greatest("seconds", F.lit(1e-9)))


def calendar(rollup: DataFrame, last_day: Column, days: int) -> DataFrame:
    """The last ``days`` days for each arm, zero where nothing ran."""
    spine = rollup.agg(last_day.alias("d")).select(F.explode(F.sequence(F.date_sub("d", days - 1), "d")).alias("day")).crossJoin(F.broadcast(rollup.select("arm").distinct()))
    return spine.join(rollup, ["day", "arm"], "left").fillna(0, ["runs", "records"]).fillna(0.0, ["seconds", "rps"])


def adaptive_ratio(current: Column, accuracy_gap: Column, a_rps: Column, b_rps: Column, most: float = 0.08) -> Column:
    """The next share of arm a, moved by accuracy (3/4) and throughput (1/4), at most so far at a time."""
    speed = F.coalesce((a_rps - b_rps) / F.nullif(F.greatest(a_rps, b_rps), F.lit(0.0)), F.lit(0.0))
    target = current + 0.25 * (0.75 * accuracy_gap + 0.25 * speed)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), current + F.greatest(F.lit(-most), F.least(F.lit(most), target - current))))
