"""Registered query of dates in free form: the orders' dates as sixteen kinds of writers put them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import dates
from .queries import query, t

WAYS = ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'+08:00'", "yyyyMMdd", "yyyyMMdd'T'HHmmss", "EEE, d MMM yyyy HH:mm:ss 'GMT'", "EEE, dd MMM yyyy HH:mm:ss '-0530'", "MMMM d, yyyy", "MMM d, yyyy 'at' h:mm a", "MM/dd/yy", "dd-MMM-yy HH:mm", "dd.MM.yyyy HH:mm", "EEE MMM dd HH:mm:ss 'EST' yyyy", "MMM yyyy", "'three days ago'"]


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 16 AS way, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(o_orderkey * 7919 % 86400) AS moment FROM orders)
SELECT o_orderkey, strftime(CASE
  WHEN way IN (0, 2, 5, 6, 13) THEN moment
  WHEN way IN (1, 9, 11) THEN date_trunc('minute', moment)
  WHEN way = 3 THEN moment - INTERVAL 8 HOUR
  WHEN way = 7 THEN moment + INTERVAL 330 MINUTE
  WHEN way IN (4, 8, 10) THEN CAST(d AS TIMESTAMP)
  WHEN way = 12 AND day(d) <= 12 THEN make_timestamp(year(d), day(d), month(d), hour(moment), minute(moment), 0.0)
  WHEN way = 12 THEN date_trunc('minute', moment)
  WHEN way = 14 THEN CAST(last_day(d) AS TIMESTAMP) END, '%Y-%m-%d %H:%M:%S') AS published FROM o""")
def free_dates(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select(k, (F.to_date("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=(k * 7919 % 86400))).alias("at"))
    raw = F.coalesce(*(F.when(k % len(WAYS) == i, F.date_format("at", way)) for i, way in enumerate(WAYS)))
    return o.select("o_orderkey", F.date_format(dates.any_date(raw, F.lit(date(2024, 8, 31))), "yyyy-MM-dd HH:mm:ss").alias("published"))
