"""Registered queries that stream the events table from files and end when all is read, each with SQL over the table itself."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..operators import batch, sentiment
from ..session import shared_folder
from ..streaming import news as news_stream
from ..streaming import policy
from .queries import LEXICON, NEWS, news, query, t

EPOCHS = 4


def in_order(spark, df, at: str, folder: str, files: int) -> None:
    """Write ``df`` in spans of time, one after another, each in at most ``files`` files: what comes in one trigger each."""
    first, last = df.agg(F.min(at), F.max(at)).first()
    if first is None:
        df.write.mode("append").parquet(folder)
        return
    step = (last - first) / EPOCHS + datetime.timedelta(microseconds=1)
    for i in range(EPOCHS):
        span = df.where((F.col(at) >= F.lit(first + i * step)) & (F.col(at) < F.lit(first + (i + 1) * step)))
        span.repartition(files).write.mode("append").parquet(folder)


REPORTS = f"""WITH RECURSIVE {NEWS}, ar AS (SELECT *, CASE WHEN ('0x' || substr(md5('ab:' || event_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.4 THEN 1 ELSE 0 END AS a FROM nw),
re AS (SELECT ticker AS policy, date_trunc('hour', ts) AS hh, sum(a)::DOUBLE AS x, (count(*) - sum(a))::DOUBLE AS y FROM ar GROUP BY 1, 2),
rn AS (SELECT policy, hh, (x - y) / (x + y) AS gap, x AS ar, 1.5::DOUBLE * y AS br, row_number() OVER (PARTITION BY policy ORDER BY hh) AS n FROM re),
rr AS (SELECT policy, hh, n, 0.5::DOUBLE AS before, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + greatest(-0.08::DOUBLE, least(0.08::DOUBLE, 0.25::DOUBLE * (0.75::DOUBLE * gap + 0.25::DOUBLE * coalesce((ar - br) / nullif(greatest(ar, br), 0), 0)))))) AS ratio FROM rn WHERE n = 1
  UNION ALL SELECT rn.policy, rn.hh, rn.n, rr.ratio, greatest(0.0::DOUBLE, least(1.0::DOUBLE, rr.ratio + greatest(-0.08::DOUBLE, least(0.08::DOUBLE, 0.25::DOUBLE * (0.75::DOUBLE * gap + 0.25::DOUBLE * coalesce((ar - br) / nullif(greatest(ar, br), 0), 0))))))
  FROM rr JOIN rn ON rn.policy = rr.policy AND rn.n = rr.n + 1)
SELECT policy, strftime(hh, '%Y-%m-%d %H:00') AS "at", round(before, 6) AS before, round(ratio, 6) AS ratio, false AS late FROM rr"""


def reports(spark, sf):
    """One report per ticker and hour: the arms' counts as throughput, their difference as the accuracy gap."""
    split = sentiment.split_arms(news(spark, sf), F.col("event_id").cast("string"), 0.4)
    counts = split.groupBy(F.col("ticker").alias("policy"), F.date_trunc("hour", "ts").alias("at")).agg(F.count_if(F.col("arm") == "rnn").cast("double").alias("a"), F.count_if(F.col("arm") != "rnn").cast("double").alias("b"))
    return counts.select("policy", "at", ((F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))).alias("accuracy_gap"), F.col("a").alias("a_rps"), (1.5 * F.col("b")).alias("b_rps"))


def shown(df):
    return df.select("policy", F.date_format("at", "yyyy-MM-dd HH:00").alias("at"), F.round("before", 6).alias("before"), F.round("ratio", 6).alias("ratio"), "late")


@query(REPORTS)
def ratio_history(spark, sf):
    return shown(policy.ratio_history(reports(spark, sf)))


@query(REPORTS)
def ratio_stream(spark, sf):
    """The reports come in four triggers; state carries each policy's ratio from one to the next."""
    here = shared_folder(spark, "ratio-stream")
    in_order(spark, reports(spark, sf), "at", f"{here}/in", 1)
    policy.use_rocks(spark)
    rows = spark.readStream.schema("policy string, at timestamp, accuracy_gap double, a_rps double, b_rps double").option("maxFilesPerTrigger", 1).parquet(f"{here}/in")
    news_stream.write_available(policy.ratio_stream(rows), f"{here}/out", f"{here}/state").awaitTermination()
    return shown(spark.read.parquet(f"{here}/out"))


def streamed(spark, sf):
    """Buckets of the events as they come in four triggers, some twice, and last a row that closes all windows and rows from
    the first span that are late by then. Gives the folder of results and the number of rows that came late."""
    here, sent = shared_folder(spark, "bucket-stream"), news(spark, sf).withColumn("id", F.col("event_id").cast("string"))
    again = sent.where(F.col("event_id") % 10 == 0)
    in_order(spark, sent.unionAll(again).drop("event_id"), "ts", f"{here}/in", 2)
    first, last = sent.agg(F.min("ts"), F.max("ts")).first()
    if last is not None:
        closing = sent.limit(1).select(F.lit("none").alias("ticker"), F.lit(last + datetime.timedelta(days=2)).alias("ts"), F.lit(0.0).alias("sentiment_score"), F.lit("neutral").alias("sentiment_label"), F.lit("closing").alias("id"))
        late = sent.where(F.col("ts") < F.lit(first + datetime.timedelta(hours=1))).withColumn("id", F.concat("id", F.lit("-late")))
        closing.unionByName(late.drop("event_id")).repartition(2).write.mode("append").parquet(f"{here}/in")
    rows = spark.readStream.schema("ts timestamp, ticker string, sentiment_score double, sentiment_label string, id string").option("maxFilesPerTrigger", 2).parquet(f"{here}/in")
    run = news_stream.write_available(news_stream.bucket_stream(news_stream.deduplicated(rows), watermarked=True), f"{here}/out", f"{here}/state")
    run.awaitTermination()
    return f"{here}/out", sum(op["numRowsDroppedByWatermark"] for p in run.recentProgress for op in p["stateOperators"])


@query(f"WITH {NEWS} SELECT ticker, strftime(time_bucket(INTERVAL 15 MINUTE, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS news_count, round(avg(s), 6) AS score_mean FROM nw GROUP BY 1, 2")
def stream_buckets(spark, sf):
    out, _ = streamed(spark, sf)
    return spark.read.parquet(out).select("ticker", F.date_format("bucket_start", "yyyy-MM-dd HH:mm").alias("bucket"), "news_count", F.round("score_mean", 6).alias("score_mean"))


@query(f"WITH {NEWS} SELECT count(*) AS late_rows FROM nw WHERE ts < (SELECT min(ts) + INTERVAL 1 HOUR FROM nw)")
def stream_late_rows(spark, sf):
    return spark.createDataFrame([(streamed(spark, sf)[1],)], "late_rows long")


MODEL = "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE ((doc_id * 7) % 201 - 100)::DOUBLE END"


def run_rows(spark, sf):
    k = F.col("doc_id")
    s = F.when(k % 13 != 0, ((k * 7) % 201 - 100).cast("double"))
    return t(spark, sf, "documents").select("doc_id", k.cast("string").alias("id"), "text", s.alias("model_score"), F.when(s.isNotNull(), sentiment.label(s)).alias("model_label"))


@query(f"""WITH d AS (SELECT doc_id, {MODEL} AS m FROM documents), p AS (SELECT *, ('0x' || substr(md5('own:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.35::DOUBLE AS hit FROM d)
SELECT doc_id, mode, CASE WHEN rnn THEN 'rnn' ELSE 'lexicon' END AS sentiment_model, CASE WHEN rnn THEN coalesce(m, 0.0) END AS model_part,
  CASE WHEN rnn THEN CASE WHEN m >= 20 THEN 'positive' WHEN m <= -20 THEN 'negative' ELSE 'neutral' END END AS model_label_used, rnn AND m IS NULL AS failed
FROM (SELECT *, CASE mode WHEN 'ab_hybrid' THEN hit ELSE mode = 'rnn_batch' END AS rnn FROM p, (SELECT unnest(['single_batch', 'rnn_batch', 'ab_hybrid']) AS mode))""")
def batch_modes(spark, sf):
    rows, out = run_rows(spark, sf), []
    ratio = batch.resolve_ratio(spark, None, t(spark, sf, "region").select(F.lit('{"rnn_ratio": 0.35}').alias("value")))
    for mode in ("single_batch", "rnn_batch", "ab_hybrid"):
        s = batch.score(rows, "text", mode, ratio, salt="own", lexicon=LEXICON)
        rnn = F.col("sentiment_model") == "rnn"
        out.append(s.select("doc_id", F.lit(mode).alias("mode"), "sentiment_model", F.when(rnn, F.col("sentiment_score")).alias("model_part"), F.when(rnn, F.col("sentiment_label")).alias("model_label_used"), F.col("sentiment_error").alias("failed")))
    return out[0].unionAll(out[1]).unionAll(out[2])


@query(f"""WITH d AS (SELECT doc_id, {MODEL} AS m FROM documents), p AS (SELECT m FROM d WHERE ('0x' || substr(md5('own:' || doc_id), 1, 8))::BIGINT / 4294967295.0::DOUBLE < 0.35::DOUBLE)
SELECT 0.35::DOUBLE AS rnn_ratio, 'config' AS ratio_source, (SELECT count(*) FROM d) AS records, count(*) FILTER (WHERE m IS NULL) AS errors, count(*) AS rnn_records, round(count(*) / 2.5::DOUBLE, 2) AS rnn_rps,
  count(*) FILTER (WHERE m >= 20) AS rnn_positive, count(*) FILTER (WHERE m <= -20) AS rnn_negative FROM p""")
def ab_run_report(spark, sf):
    ratio = batch.resolve_ratio(spark, None, t(spark, sf, "region").select(F.lit('{"rnn_ratio": 0.35}').alias("value")))
    doc = batch.ab_report(batch.score(run_rows(spark, sf), "text", "ab_hybrid", ratio, salt="own", lexicon=LEXICON), ratio, {"rnn": 2.5, "lexicon": 0.5}, salt="own")
    get = lambda path, kind: F.get_json_object("json", f"$.{path}").cast(kind)
    return doc.select(get("ab_config.rnn_ratio", "double").alias("rnn_ratio"), get("ab_config.ratio_source", "string").alias("ratio_source"), get("records", "long").alias("records"), get("errors", "long").alias("errors"), get("arms.rnn.records", "long").alias("rnn_records"), get("arms.rnn.records_per_second", "double").alias("rnn_rps"), get("arms.rnn.distribution.positive", "long").alias("rnn_positive"), get("arms.rnn.distribution.negative", "long").alias("rnn_negative"))
