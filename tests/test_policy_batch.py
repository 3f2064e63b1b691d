"""Ratios carried by a stream against the fold and a plain loop; modes and shares of a scoring run."""

import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import batch, sentiment
from barloom.streaming import policy

REPORT = "policy string, at timestamp, accuracy_gap double, a_rps double, b_rps double"


def rows():
    day = datetime(2024, 1, 1)
    out = [(p, day + timedelta(days=i), (i * 7 % 11 - 5) / 3, float(i % 4), float(i % 3)) for p in ("a", "b") for i in range(20)]
    return out + [("a", day + timedelta(days=3), 9.0, 1.0, 1.0), ("c", day, None, None, None), (None, day, 1.0, 1.0, 1.0), ("c", None, 1.0, 1.0, 1.0)]


def looped(reports):
    out, now = [], {}
    for p, at, gap, a, b in reports:
        ratio, last = now.get(p, (0.5, None))
        late = last is not None and at <= last
        new = ratio if late else policy.next_ratio(ratio, gap or 0.0, a or 0.0, b or 0.0)
        out.append((p, at, ratio, new, late))
        now[p] = (ratio, last) if late else (new, at)
    return sorted(out)


def rounded(df):
    return sorted((r["policy"], r["at"], r["before"], r["ratio"], r["late"]) for r in df.collect())


def same(got, want):
    return [(g[0], g[1], g[4], pytest.approx(g[2]), pytest.approx(g[3])) for g in got] == [(w[0], w[1], w[4], w[2], w[3]) for w in want]


def test_history_against_a_loop(spark):
    whole = [r for r in rows() if r[0] and r[1]]
    got = rounded(policy.ratio_history(spark.createDataFrame(rows(), REPORT)))
    assert same(got, looped(sorted(whole, key=lambda r: (r[0], r[1], r[2] or 0.0))))
    assert policy.ratio_history(spark.createDataFrame([], REPORT)).count() == 0


def test_state_outlives_triggers_and_late_reports_change_nothing(spark, tmp_path):
    policy.use_rocks(spark)
    whole = [r for r in rows() if r[0] and r[1]]
    regular, late = [r for r in whole if r[2] != 9.0], [r for r in whole if r[2] == 9.0]
    spans = [[r for r in regular if r[1].day <= 8], [r for r in regular if r[1].day > 8], late]
    for span in spans:
        spark.createDataFrame(span, REPORT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(REPORT).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    run = policy.ratio_stream(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination()
    got = rounded(spark.read.parquet(f"file://{tmp_path}/out"))
    assert same(got, looped([r for s in spans for r in sorted(s, key=lambda r: (r[0], r[1]))])) and sum(r[4] for r in got) == 1


def test_one_step_is_that_of_the_column_form(spark):
    cases = [(0.5, 1.0, 2.0, 1.0), (0.0, -1.0, 1.0, 3.0), (0.97, 1.0, 9.0, 1.0), (0.3, 0.1, 0.0, 0.0)]
    got = spark.createDataFrame(cases, "c double, g double, a double, b double").select(sentiment.adaptive_ratio(F.col("c"), F.col("g"), F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in got] == [pytest.approx(policy.next_ratio(*c)) for c in cases]


@pytest.mark.parametrize(("given", "text", "want"), [
    (1.7, None, (1.0, "cli")), (-1, '{"rnn_ratio": 0.2}', (0.0, "cli")), (None, None, (0.5, "default")), (None, '{"rnn_ratio": 0.2}', (0.2, "config")), (None, '{"rnn_ratio": "0.3"}', (0.3, "config")),
    (None, '{"rnn_ratio": 9}', (1.0, "config")), (None, '{"other": 1}', (0.5, "config")), (None, '{"rnn_ratio": "x"}', (0.5, "fallback")), (None, "not json", (0.5, "fallback")),
])
def test_where_the_share_comes_from(spark, given, text, want):
    files = None if text is None else spark.createDataFrame([(text,)], "value string")
    assert tuple(batch.resolve_ratio(spark, given, files).first()) == want


def test_modes(spark):
    rows = [("1", "u", "bullish", 50.0, "positive"), ("2", None, "bearish", None, None), ("", "url", "x", -3.0, "odd"), (None, None, None, 1.0, "neutral")]
    df = spark.createDataFrame(rows, "id string, url string, headline string, model_score double, model_label string")
    for mode in batch.MODES:
        ratio = batch.resolve_ratio(spark, 0.5, None)
        got = batch.score(df, "headline", mode, ratio, salt="s").collect()
        assert len(got) == 4 and set(got[0].asDict()) == {*df.columns, "sentiment_score", "sentiment_label", "sentiment_model", "sentiment_error"}
        models = {r["sentiment_model"] for r in got}
        assert models == {"single_batch": {"lexicon"}, "thread_pool": {"lexicon"}, "rnn_batch": {"rnn"}}.get(mode, models)
        for r in got:
            if r["sentiment_model"] == "rnn":
                fine = r["model_label"] in batch.LABELS and r["model_score"] is not None
                assert (r["sentiment_score"], r["sentiment_label"], r["sentiment_error"]) == ((r["model_score"], r["model_label"], False) if fine else (0.0, "neutral", True))
        if mode == "ab_hybrid":
            by = {r["id"]: r for r in got}
            for r, key in ((by[""], "url"), (by["1"], "1"), (by["2"], "2")):
                low = int(hashlib.md5(f"s:{key}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.5
                assert (r["sentiment_model"] == "rnn") == low
            arms = {r["arm"]: r["records"] for r in batch.arms(batch.score(df, "headline", mode, batch.resolve_ratio(spark, 1.0, None)), {"rnn": 2.0}).collect()}
            assert arms == {"rnn": 4, "lexicon": 0}
    assert [batch.mode_of(*x) for x in ((True, "rnn", 0), (False, "rnn", 3), (False, "lexicon", 4), (False, "lexicon", 1))] == ["ab_hybrid", "rnn_batch", "thread_pool", "single_batch"]
    with pytest.raises(ValueError):
        batch.score(df, "headline", "other")
