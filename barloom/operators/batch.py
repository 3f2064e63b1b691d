"""Scoring runs as one plan: the mode picks which scores each row takes, the share of model traffic and where it comes from.

Model scores are a table's columns, since the model runs elsewhere; lexicon scores are computed for rows that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import hash_ratio
from .sentiment import Lexicon, with_lexicon

#: Modes of a run as reports name them, and the models' names.
MODES = ("single_batch", "thread_pool", "rnn_batch", "ab_hybrid")
LEXICON_MODEL, MODEL = "lexicon_baseline_v2", "bilstm_sentiment_v1"
LABELS = ("positive", "neutral", "negative")


def mode_of(ab: bool, model_type: str, workers: int) -> str:
    if ab:
        return "ab_hybrid"
    return "rnn_batch" if model_type == "rnn" else "thread_pool" if workers > 1 else "single_batch"


def traffic_key(df: DataFrame, field: str = "id") -> Column:
    """The field as text, or the url, or the headline, whichever first isn't empty; else the row's whole content."""
    said = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    return F.coalesce(said(field), said("url"), said("headline"), F.to_json(F.struct(*df.columns)))


def resolve_ratio(spark: SparkSession, given: float | None, policy: DataFrame | None) -> DataFrame:
    """ratio and ratio_source, one row: the given share, else the policy's text (column value, rows are files), else a half.

    A policy that isn't a JSON object, or whose rnn_ratio is no number, falls back to a half; one without rnn_ratio says a half itself.
    """
    if given is not None:
        return spark.range(1).select(F.lit(min(1.0, max(0.0, float(given)))).alias("ratio"), F.lit("cli").alias("ratio_source"))
    if policy is None:
        return spark.range(1).select(F.lit(0.5).alias("ratio"), F.lit("default").alias("ratio_source"))
    text = policy.agg(F.min("value").alias("v"))
    raw = F.get_json_object("v", "$.rnn_ratio")
    whole = F.from_json("v", "map<string,string>")
    said = F.when(F.map_contains_key(whole, F.lit("rnn_ratio")), raw.try_cast("double")).otherwise(F.lit(0.5))
    ok = whole.isNotNull() & said.isNotNull()
    return text.select(
        F.when(F.col("v").isNull() | ~ok, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), said))).alias("ratio"),
        F.when(F.col("v").isNull(), "default").when(ok, "config").otherwise("fallback").alias("ratio_source"),
    )


def score(rows: DataFrame, text: str, mode: str, ratio: DataFrame | None = None, key: Column | None = None, salt: str = "ab", lexicon: Lexicon | None = None) -> DataFrame:
    """``rows`` with sentiment_score, sentiment_label and sentiment_model; rows have model_score and model_label where a model ran.

    In the mode ab_hybrid a row whose key hashes below the ratio takes the model's score. Rows that should but have none are
    neutral with score 0 and count as errors. Texts that the model scores don't reach the lexicon.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r}")
    if mode == "ab_hybrid":
        key = traffic_key(rows) if key is None else key
        rows = rows.withColumn("_key", key).crossJoin(F.broadcast(ratio.select(F.col("ratio").alias("_ratio"))))  # one row
        rows = rows.withColumn("_rnn", hash_ratio(salt, F.col("_key")) < F.col("_ratio")).drop("_key", "_ratio")
    else:
        rows = rows.withColumn("_rnn", F.lit(mode == "rnn_batch"))
    rows = rows.withColumn("_text", F.when(~F.col("_rnn"), F.col(text)))
    rows = with_lexicon(rows, "_text", lexicon) if mode != "rnn_batch" else rows.withColumns({"lexicon_score": F.lit(0.0), "lexicon_label": F.lit("neutral")})
    has = F.col("model_label").isin(*LABELS) & F.col("model_score").isNotNull()
    out = {
        "sentiment_score": F.when(~F.col("_rnn"), F.col("lexicon_score")).when(has, F.col("model_score")).otherwise(0.0),
        "sentiment_label": F.when(~F.col("_rnn"), F.col("lexicon_label")).when(has, F.col("model_label")).otherwise("neutral"),
        "sentiment_model": F.when(F.col("_rnn"), "rnn").otherwise("lexicon"),
        "sentiment_error": F.col("_rnn") & ~F.coalesce(has, F.lit(False)),
    }
    return rows.withColumns(out).drop("_rnn", "_text", "lexicon_score", "lexicon_label")


def arms(scored: DataFrame, seconds: dict[str, float]) -> DataFrame:
    """arm, model, records, errors, seconds, records_per_second and the three labels; both arms, zeros included."""
    counts = scored.groupBy(F.col("sentiment_model").alias("arm")).agg(F.count("*").alias("records"), F.count_if("sentiment_error").alias("errors"), *(F.count_if(F.col("sentiment_label") == x).alias(x) for x in LABELS))
    every = scored.sparkSession.createDataFrame([("rnn", MODEL, float(seconds.get("rnn", 0.0))), ("lexicon", LEXICON_MODEL, float(seconds.get("lexicon", 0.0)))], "arm string, model string, seconds double")
    both = every.join(counts, "arm", "left").fillna(0, ["records", "errors", *LABELS])
    return both.withColumn("records_per_second", F.round(F.col("records") / F.greatest("seconds", F.lit(1e-9)), 2))


def ab_report(scored: DataFrame, ratio: DataFrame, seconds: dict[str, float], source: str = "", salt: str = "ab", key_field: str = "id") -> DataFrame:
    """One JSON document on a split run: its configuration and both arms."""
    a = arms(scored, seconds)
    arm = F.struct("model", "records", "errors", F.round("seconds", 4).alias("seconds"), "records_per_second", F.struct(*LABELS).alias("distribution"))
    both = a.agg(F.sum("records").alias("records"), F.sum("errors").alias("errors"), *(F.max(F.when(F.col("arm") == n, arm)).alias(n) for n in ("rnn", "lexicon")))
    config = F.struct(F.lit(True).alias("enabled"), F.col("ratio").alias("rnn_ratio"), "ratio_source", F.lit(key_field).alias("key_field"), F.lit(salt).alias("salt"))
    whole = both.crossJoin(F.broadcast(ratio))  # one row each
    return whole.select(F.to_json(F.struct(F.lit(source).alias("input"), "records", "errors", config.alias("ab_config"), F.struct("rnn", "lexicon").alias("arms"))).alias("json"))
