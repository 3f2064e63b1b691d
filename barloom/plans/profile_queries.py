"""Registered queries of the built-in catalog and of profiles, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import symbols
from ..sources import catalog, directories, profiles
from .queries import query, t


@query("SELECT * FROM (VALUES ('TW', 'etf', 25), ('TW', 'stock', 40), ('TWO', 'stock', 7), ('TW', 'index', 1), ('US', 'etf', 29), ('US', 'stock', 55)) v(market, kind, entries)")
def catalog_entries(spark, sf):
    return catalog.built_in(spark).groupBy("market", "kind").agg(F.count("*").cast("int").alias("entries"))


@query("""SELECT * FROM (VALUES ('', 1, '2330.TW'), ('', 2, '0050.TW'), ('', 3, '00878.TW'), ('', 4, '006208.TW'), ('', 5, '2454.TW'), ('', 6, 'SPY'), ('', 7, 'QQQ'), ('', 8, 'NVDA'),
  ('nvda', 1, 'NVDA'), ('護國神山', 1, '2330.TW'), ('台積電', 1, '2330.TW'), ('台積電', 2, 'TSM'), ('富士康', 1, '2317.TW'), ('矽晶圓', 1, '5483.TWO'), ('矽晶圓', 2, '6488.TWO'), ('^twii', 1, '^TWII'), ('費半', 1, '00830.TW'), ('費半', 2, 'SOXX')) v(query, rank, symbol)""")
def catalog_search(spark, sf):
    asked = spark.createDataFrame([("",), ("nvda",), ("護國神山",), ("台積電",), ("富士康",), ("矽晶圓",), ("^twii",), ("費半",)], "query string")
    return symbols.search(asked, catalog.built_in(spark).withColumn("tier", F.lit(0))).select("query", "rank", "symbol")



def quotes(spark, sf):
    """Quote JSON of all parts; a sixth say no kind, which the directory then gives for some."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ["ETF", "EQUITY", "INDEX", "MUTUALFUND", "CRYPTOCURRENCY", None])), (k % 6 + 1).cast("int"))
    info = F.struct(
        kind.alias("quoteType"), F.when(k % 4 > 0, F.col("p_name")).alias("longName"), F.when(k % 2 == 0, "short").alias("shortName"), F.when(k % 5 == 0, "EUR").alias("currency"),
        F.when(k % 3 == 0, 0.0).otherwise(F.col("p_size") / 64).alias("dividendYield"), F.lit(0.5).alias("yield"), (F.col("p_size") / 128).alias("52WeekChange"),
        F.lit(2.0).alias("beta3Year"), F.lit(1.5).alias("beta"), F.col("p_brand").alias("fundFamily"), F.col("p_type").alias("sector"), (k * 86400).alias("exDividendDate"), F.lit(1.25).alias("navPrice"), F.lit(3.5).alias("trailingEps"),
    )
    symbol = F.concat(k.cast("string"), F.when(k % 7 == 0, ".TW").otherwise(""))
    rows = t(spark, sf, "part").select(symbol.alias("symbol"), F.to_json(info).alias("info"))
    entries = t(spark, sf, "part").where(k % 2 == 0).select(symbol.alias("symbol"), F.concat(F.lit("名"), k.cast("string")).alias("name_zh"), F.lit("stock").alias("kind"))
    return rows, entries


@query("""WITH q AS (SELECT p_partkey AS k, p_partkey || CASE WHEN p_partkey % 7 = 0 THEN '.TW' ELSE '' END AS symbol, p_name, p_size, p_brand, p_type,
  ['etf', 'stock', 'index', 'fund', 'crypto', CASE WHEN p_partkey % 2 = 0 THEN 'stock' ELSE 'unknown' END][p_partkey % 6 + 1] AS kind FROM part)
SELECT symbol, CASE WHEN k % 4 > 0 THEN p_name ELSE 'short' END AS name, CASE WHEN k % 2 = 0 THEN '名' || k END AS name_zh, kind,
  CASE kind WHEN 'etf' THEN 'ETF' WHEN 'stock' THEN '股票' WHEN 'index' THEN '指數' WHEN 'fund' THEN '基金' WHEN 'crypto' THEN '加密貨幣' ELSE '標的' END AS kind_label,
  CASE WHEN k % 5 = 0 THEN 'EUR' WHEN k % 7 = 0 THEN 'TWD' ELSE 'USD' END AS currency, CASE WHEN k % 3 = 0 OR p_size = 0 THEN 0.5::DOUBLE ELSE p_size / 64.0::DOUBLE END AS dividend_yield,
  round(p_size / 128.0::DOUBLE * 100, 1) AS change_pct, CASE WHEN kind = 'etf' THEN 2.0::DOUBLE ELSE 1.5::DOUBLE END AS beta, CASE WHEN kind = 'etf' THEN p_brand END AS fund_family, CASE WHEN kind <> 'etf' THEN p_type END AS sector,
  CASE WHEN k > 0 THEN strftime(DATE '1970-01-01' + CAST(k AS INTEGER), '%Y-%m-%d') END AS ex_dividend_date, CASE WHEN kind = 'etf' THEN 1.25::DOUBLE END AS nav_price, CASE WHEN kind <> 'etf' THEN 3.5::DOUBLE END AS eps
FROM q""")
def instrument_profile(spark, sf):
    rows, entries = quotes(spark, sf)
    p = profiles.instrument_profiles(rows, entries)
    return p.select("symbol", "name", "name_zh", "kind", "kind_label", "currency", "dividend_yield", F.round("fifty_two_week_change_pct", 1).alias("change_pct"), "beta", "fund_family", "sector", "ex_dividend_date", "nav_price", "eps")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 2 = 0 THEN l_quantity / 512.0::DOUBLE ELSE l_quantity END AS w,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
h AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY l_orderkey) <= 1.5 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM l WHERE n <= 10 AND l_partkey % 9 > 0)
SELECT l_orderkey || CASE WHEN l_orderkey % 3 = 0 THEN '.TW' ELSE '' END AS symbol, count(h.n) AS holdings, coalesce(round(sum(round(w * scale, 2)), 2), 0) AS total_pct,
  CASE WHEN count(h.n) = 0 AND l_orderkey % 3 = 0 THEN '元大投信' END AS issuer
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN h USING (l_orderkey) GROUP BY l_orderkey HAVING count(h.n) > 0 OR l_orderkey % 3 = 0""")
def fund_profile(spark, sf):
    k = F.col("l_orderkey")
    symbol = F.concat(k.cast("string"), F.when(k % 3 == 0, ".TW").otherwise(""))
    weight = F.when(k % 2 == 0, F.col("l_quantity") / 512).otherwise(F.col("l_quantity"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_partkey") % 9 > 0, F.col("l_partkey").cast("string")).otherwise("").alias("holdingSymbol"), weight.alias("holdingPercent"))
    lists = t(spark, sf, "lineitem").groupBy(symbol.alias("symbol")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    holdings = F.to_json(F.transform("rows", lambda r: F.struct(r["holdingSymbol"].alias("holdingSymbol"), r["holdingPercent"].alias("holdingPercent"))))
    none = F.lit(None).cast("string")
    funds = lists.select("symbol", none.alias("description"), none.alias("overview"), none.alias("sectors"), holdings.alias("holdings"))
    entries = lists.select("symbol", F.lit("元大基金").alias("name_zh"), F.lit("etf").alias("kind"))
    total = F.aggregate(F.transform("top_holdings", lambda h: h["weight_pct"]), F.lit(0.0), lambda s, w: s + w)
    return profiles.fund_profiles(funds, entries).select("symbol", F.size("top_holdings").cast("long").alias("holdings"), F.round(total, 2).alias("total_pct"), F.col("holdings_reference.issuer").alias("issuer"))


@query("SELECT r_name AS name FROM region")
def source_fallback(spark, sf):
    none = t(spark, sf, "customer").where("c_custkey < 0").select(F.col("c_name").alias("name"))
    return directories.first_answering(none, t(spark, sf, "region").select(F.col("r_name").alias("name")), t(spark, sf, "nation").select(F.col("n_name").alias("name")))
