"""Registered query of comparisons asked for as text, one by each customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import insight
from .queries import RISK, bars, query, t

#: What customers ask for, by their key.
ASKED = ["A,N,R", " R ，N", "N,2330,,A", "0050, 006208", " ,", "R,A,R,N,X", None]
#: The same as lists of tickers.
LISTS = [["A", "N", "R"], ["R", "N"], ["N", "2330", "A"], ["0050", "006208"], [], ["R", "A", "R", "N"], []]


@query(RISK + ", k AS (SELECT c_custkey AS request, (c_custkey % 7) + 1 AS way FROM customer), w(way, pos, ticker) AS (VALUES " + ", ".join(f"({i}, {p}, '{x}')" for i, asked in enumerate(LISTS, 1) for p, x in enumerate(asked)) + """),
m AS (SELECT k.request, w.pos, w.ticker, h.symbol IS NOT NULL AS found, round((h.f - 1) * 100, 2) AS ret FROM k LEFT JOIN w ON w.way = k.way LEFT JOIN h ON h.symbol = w.ticker)
SELECT request, CASE WHEN count(*) FILTER (WHERE found) > 0 THEN 'success' ELSE 'error' END AS status, count(*) FILTER (WHERE found) AS count,
  first(ticker ORDER BY ret DESC, pos) FILTER (WHERE ret IS NOT NULL) AS best,
  coalesce(string_agg(ticker || '=' || ret::DECIMAL(18, 2)::VARCHAR, ' ' ORDER BY pos) FILTER (WHERE found), '') AS returns,
  coalesce(string_agg(ticker, ' ' ORDER BY pos) FILTER (WHERE NOT found AND ticker IS NOT NULL), '') AS failed FROM m GROUP BY 1""")
def compare_requests(spark, sf):
    k = F.col("c_custkey")
    asked = t(spark, sf, "customer").select(k.alias("request"), F.element_at(F.array(*map(F.lit, ASKED)), (k % len(ASKED) + 1).cast("int")).alias("tickers"))
    found = insight.compare_requests(asked, bars(spark, sf))
    one = lambda x: F.concat(x["ticker"], F.lit("="), x["total_return_pct"].cast("decimal(18,2)").cast("string"))
    return found.select("request", "status", "count", "best", F.array_join(F.transform("series", one), " ").alias("returns"), F.array_join("failed", " ").alias("failed"))
