"""Registered queries of the newest news per ticker, and of names in compatibility forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crawl
from .queries import query, t

#: Beginnings in compatibility forms or with loose marks, and what they fold to.
FORMS = {"ＴＷ：２３３０　": "2330 ", "ﬁ": "fi", "A\u030a": "\u00c5", "①㈱": "1(株)", "US: ": "", "\u1100\u1161": "가", "ｶﾞ": "ガ", "": ""}


@query("""SELECT root, place, id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published_at FROM (
  SELECT upper(event_type) AS root, event_id AS id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS LAST, event_id) AS place FROM events) WHERE place <= 20""")
def newest_news(spark, sf):
    e = t(spark, sf, "events")
    suffix = F.when(F.col("event_id") % 2 == 0, ".tw").otherwise("")
    news = e.select(F.col("event_id").alias("id"), F.concat("event_type", suffix).alias("ticker"), F.col("ts").alias("published_at"))
    return crawl.newest_news(news).select("root", "place", "id", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published_at"))


@query("SELECT p_partkey, upper(CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN '{to}'" for i, to in enumerate(FORMS.values())) + " END || p_name) AS q FROM part")
def composed_names(spark, sf):
    start = F.element_at(F.array(*map(F.lit, FORMS)), (F.col("p_partkey") % len(FORMS) + 1).cast("int"))
    return t(spark, sf, "part").select("p_partkey", text.normal_query(F.concat(start, F.regexp_replace("p_name", " ", "\u3000 "))).alias("q"))
