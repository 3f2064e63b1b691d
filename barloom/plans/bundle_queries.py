"""The registered query of the corporate-action bundle, nested arrays as text, and SQL that builds it from separate parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bundle
from .queries import SPLIT, as_of, query, split_events, t

SYMBOL = "l_suppkey || CASE WHEN l_suppkey % 2 = 0 THEN '.TW' ELSE '' END"
BUNDLE = f"""WITH {SPLIT}, ins AS (SELECT s_suppkey AS k, s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.TW' ELSE '' END AS symbol, 37.0::DOUBLE + s_suppkey % 5 AS close, s_suppkey % 5 <> 0 AS answered, s_suppkey % 4 = 0 AS loading FROM supplier),
dv AS (SELECT {SYMBOL} AS symbol, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS d, max(l_quantity) / 8.0::DOUBLE AS a FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1, 2),
ev AS (SELECT * FROM sp WHERE split_part(symbol, '.', 1)::INT % 3 = 2),
ex AS (SELECT {SYMBOL} AS symbol, CAST(l_shipdate AS DATE) AS date, 100.0::DOUBLE + max(l_orderkey) % 50 AS b, 90.0::DOUBLE + min(l_linenumber) AS f FROM lineitem WHERE l_suppkey % 5 = 2 GROUP BY 1, 2),
e2 AS (SELECT * FROM ex WHERE day(date) % 3 <> 2),
yr AS (SELECT symbol, year(d) AS y, sum(a) AS total, count(*) AS n FROM dv GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY year(d) DESC) <= 15),
gr AS (SELECT *, y + row_number() OVER (PARTITION BY symbol ORDER BY y DESC) AS g FROM yr),
st AS (SELECT symbol, count(*) AS years_paid, count(*) FILTER (WHERE g = top) AS streak, string_agg(y || ':' || round(total * 1000)::BIGINT || ':' || n, ',' ORDER BY y) AS yearly FROM (SELECT *, max(g) OVER (PARTITION BY symbol) AS top FROM gr) GROUP BY 1),
w3 AS (SELECT symbol, avg(n) AS m, avg(total) AS average FROM (SELECT * FROM yr WHERE y < 2001 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY y DESC) <= 3) GROUP BY 1),
dd AS (SELECT symbol, count(*) AS n, coalesce(sum(a) FILTER (WHERE DATE '2001-03-01' - d <= 365), 0) AS ttm, min(d) AS first, max(d) AS last, sha256(string_agg(d || ':' || round(a * 1000)::BIGINT, ',' ORDER BY d DESC)) AS records FROM dv GROUP BY 1),
sr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i, count(*) OVER (PARTITION BY symbol) AS c FROM ev WHERE NOT (symbol LIKE '%.TW' AND ratio > 1 AND ratio <= 1.5)),
ss AS (SELECT symbol, any_value(c) AS splits, string_agg(date || ':' || round(ratio * 100)::BIGINT || ':' || CASE WHEN ratio >= 1 THEN 'split' ELSE 'reverse_split' END, ',' ORDER BY date DESC) AS split_records FROM sr WHERE i <= 20 GROUP BY 1),
rm AS (SELECT coalesce(e2.symbol, r.symbol) AS symbol, coalesce(e2.date, r.date) AS date, b, f, r.ratio, CASE WHEN e2.symbol IS NULL THEN 'splits' WHEN r.symbol IS NULL THEN 'exchange' ELSE 'exchange+splits' END AS source
  FROM e2 FULL JOIN (SELECT * FROM ev WHERE ratio > 1 AND ratio <= 1.5) r ON e2.symbol = r.symbol AND e2.date = r.date),
ri AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM rm WHERE symbol LIKE '%.TW'),
rs AS (SELECT symbol, count(*) AS rights, round(sum(round((ratio - 1) * 1000, 2)), 2) AS shares, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
  string_agg(date || ':' || source || ':' || coalesce(round((b - f) / b * 10000)::BIGINT::VARCHAR, '') || ':' || coalesce(round((ratio - 1) * 1000)::BIGINT::VARCHAR, ''), ',' ORDER BY date DESC) FILTER (WHERE i <= 30) AS right_records FROM ri GROUP BY 1)
SELECT ins.symbol, CASE WHEN dd.n > 0 OR splits > 0 OR rights > 0 THEN 'ok' WHEN answered THEN 'empty' ELSE 'unavailable' END AS status, ins.symbol LIKE '%.TW' AND loading AS rights_pending,
  dd.n AS payments, records, yearly, ttm, round(average, 4) AS average_3y, CASE WHEN dd.n IS NULL THEN NULL WHEN m IS NULL THEN 'unknown' WHEN m >= 10 THEN 'monthly' WHEN m >= 3.4 THEN 'quarterly' WHEN m >= 1.6 THEN 'semiannual' WHEN m >= 0.8 THEN 'annual' ELSE 'irregular' END AS frequency,
  years_paid, streak, strftime(dd.first, '%Y-%m-%d') AS first_date, strftime(dd.last, '%Y-%m-%d') AS last_date, round(ttm / close * 100, 2) AS ttm_yield, splits, split_records, rights, shares, sources, right_records
FROM ins LEFT JOIN dd ON dd.symbol = ins.symbol LEFT JOIN st ON st.symbol = ins.symbol LEFT JOIN w3 ON w3.symbol = ins.symbol LEFT JOIN ss ON ss.symbol = ins.symbol LEFT JOIN rs ON rs.symbol = ins.symbol"""


@query(BUNDLE)
def corporate_actions(spark, sf):
    li, k = t(spark, sf, "lineitem"), F.col("l_suppkey")
    name = lambda key: F.concat(key.cast("string"), F.when(key % 2 == 0, ".TW").otherwise(""))
    s = F.col("s_suppkey")
    instruments = t(spark, sf, "supplier").select(name(s).alias("symbol"), (37.0 + s % 5).alias("close"), (s % 5 != 0).alias("answered"), (s % 4 == 0).alias("loading"))
    dividends = li.where(k % 3 == 0).groupBy(name(k).alias("symbol"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("ex_date")).agg((F.max("l_quantity") / 8.0).alias("amount"))
    splits = split_events(spark, sf).where(F.split("symbol", r"\.")[0].cast("int") % 3 == 2)
    records = li.where(k % 5 == 2).groupBy(name(k).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg((100.0 + F.max("l_orderkey") % 50).alias("before_price"), (90.0 + F.min("l_linenumber")).alias("reference_price"))
    records = records.withColumn("kind", F.element_at(F.array(F.lit("rights"), F.lit("both"), F.lit("dividend")), F.day("date") % 3 + 1)).withColumn("kind_label", F.lit("權"))
    b = bundle.corporate_actions(dividends, splits, records, instruments, as_of())
    text = lambda items, one: F.when(items.isNotNull(), F.array_join(F.transform(items, one), ","))
    whole = lambda x, by: F.round(x * by).cast("long").cast("string")
    or_blank = lambda x: F.coalesce(x, F.lit(""))
    colon = lambda *parts: F.concat_ws(":", *parts)
    d, sp, r = (F.col(c) for c in ("dividends", "splits", "rights"))
    day = lambda x: F.date_format(x, "yyyy-MM-dd")
    return b.select(
        "symbol", "status", "rights_pending", d["total_records"].cast("long").alias("payments"),
        F.sha2(text(d["records"], lambda p: colon(day(p["date"]), whole(p["amount"], 1000))).cast("binary"), 256).alias("records"),
        text(d["yearly"], lambda y: colon(y["year"].cast("string"), whole(y["total"], 1000), y["count"].cast("string"))).alias("yearly"),
        d["ttm_total"].alias("ttm"), d["average_3y"].alias("average_3y"), d["frequency"].alias("frequency"), d["years_paid"].cast("long").alias("years_paid"), d["consecutive_years"].cast("long").alias("streak"),
        day(d["first_date"]).alias("first_date"), day(d["latest"]["date"]).alias("last_date"), d["ttm_yield_pct"].alias("ttm_yield"), sp["count"].cast("long").alias("splits"),
        text(sp["records"], lambda x: colon(day(x["date"]), whole(x["ratio"], 100), x["kind"])).alias("split_records"), r["count"].cast("long").alias("rights"), r["total_shares_per_1000"].alias("shares"), F.array_join(r["sources"], ",").alias("sources"),
        text(r["records"], lambda x: colon(day(x["date"]), x["source"], or_blank(whole(x["drop_pct"], 100)), or_blank(whole(x["shares_per_1000"], 1)))).alias("right_records"),
    )
