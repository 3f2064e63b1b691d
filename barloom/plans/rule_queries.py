"""Registered queries of parsers, formats and rules, each with SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, numbers, params, text
from ..operators import actions, indicators, risk, sentiment, signals, symbols
from ..sources import directories
from . import insight
from .queries import CATALOG, NEWS, READ, SCORE, SNAP, bars, catalog, news, query, r, snaps, t


def choice(values: list, key=None):
    """One of the values by the order's key."""
    k = F.col("o_orderkey") if key is None else key
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def orders(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("k"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL WHEN 2 THEN strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') END AS at
FROM orders""")
def iso_dates(spark, sf):
    o, d = orders(spark, sf), F.date_format("d", "yyyy-MM-dd")
    raw = F.when(F.col("k") % 5 == 0, F.concat(d, F.lit("T01:30:00Z"))).when(F.col("k") % 5 == 1, F.concat(d, F.lit("T01:30:00+00:00"))).when(F.col("k") % 5 == 2, F.concat(d, F.lit("T01:30:00+08:00"))).when(F.col("k") % 5 == 3, F.concat(d, F.lit("T01:30:00"))).otherwise("soon")
    return o.select("o_orderkey", F.date_format(dates.iso(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') ELSE strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S') END AS at FROM orders""")
def feed_dates(spark, sf):
    o, d = orders(spark, sf), F.date_format("d", "EEE, dd MMM yyyy")
    raw = F.when(F.col("k") % 4 == 0, F.concat(d, F.lit(" 09:00:00 GMT"))).when(F.col("k") % 4 == 1, F.concat(d, F.lit(" 09:00:00 +0000"))).when(F.col("k") % 4 == 2, F.concat(d, F.lit(" 09:00:00 +0800"))).otherwise("yesterday")
    return o.select("o_orderkey", F.date_format(dates.rfc822(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS day FROM orders")
def epoch_dates(spark, sf):
    o, k = orders(spark, sf), F.col("k")
    raw = F.when(k % 5 == 0, F.unix_timestamp(F.col("d").cast("timestamp")).cast("string")).when(k % 5 == 1, F.date_format("d", "yyyy-MM-dd")).when(k % 5 == 2, F.concat(F.date_format("d", "yyyy-MM-dd"), F.lit(" 10:00:00"))).when(k % 5 == 3, "0").otherwise("")
    return o.select("o_orderkey", dates.epoch_or_date(raw).alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '--' ELSE format('{:+.2f}%', (o_orderkey % 401 - 200) / 8.0::DOUBLE) END AS change FROM orders")
def signed_change(spark, sf):
    k = F.col("k")
    x = F.when(k % 7 != 0, (k % 401 - 200) / 8.0)
    return orders(spark, sf).select("o_orderkey", numbers.signed_percent(x).alias("change"))


@query("SELECT o_orderkey, 'https://h.example/s?q=a%20b%26c/' || o_orderkey || '&t=T' || o_orderkey % 9 || '&raw=a b&c/' || o_orderkey AS url FROM orders")
def feed_template(spark, sf):
    q = F.concat(F.lit("a b&c/"), F.col("k").cast("string"))
    return orders(spark, sf).select("o_orderkey", text.filled("https://h.example/s?q={query_encoded}&t={ticker}&raw={query}", F.concat(F.lit("T"), (F.col("k") % 9).cast("string")), q).alias("url"))


LINKS = ["/a/b", "//cdn.example/x", "https://o.example/y?z", "c.html", "d/e"]


@query("""SELECT o_orderkey, ['https://h.example/a/b', 'https://cdn.example/x', 'https://o.example/y?z', 'https://h.example/p' || o_orderkey % 3 || '/c.html', 'https://h.example/p' || o_orderkey % 3 || '/d/e'][o_orderkey % 5 + 1] AS link FROM orders""")
def absolute_links(spark, sf):
    base = F.concat(F.lit("https://h.example/p"), (F.col("k") % 3).cast("string"), F.lit("/index.html?x=1"))
    return orders(spark, sf).select("o_orderkey", text.absolute_link(base, choice(LINKS)).alias("link"))


@query(SNAP + """ SELECT symbol, count(*)::BIGINT AS bars, count(sma20)::BIGINT AS sma20, count(rsi14)::BIGINT AS rsi14, round(sum(sma20), 0) AS sma20_sum, round(arg_max(k, ts), 2) AS last_k FROM s GROUP BY 1""")
def nested_indicators(spark, sf):
    a = indicators.arrays(indicators.indicators(bars(spark, sf)), ["sma20", "rsi14", "k"])
    known = lambda c: F.filter(c, lambda x: x.isNotNull())
    total = F.aggregate(known("sma20"), F.lit(0.0), lambda s, x: s + x)
    return a.select("symbol", F.size("ts").cast("long").alias("bars"), F.size(known("sma20")).cast("long").alias("sma20"), F.size(known("rsi14")).cast("long").alias("rsi14"), F.round(total, 0).alias("sma20_sum"), F.round(F.element_at("k", -1), 2).alias("last_k"))


@query("""SELECT o_orderkey, upper('brk.b-' || o_orderkey) AS ticker, substr('q ' || o_orderkey || repeat(' word', 40), 1, 120) AS query FROM orders""")
def safe_inputs(spark, sf):
    k = F.col("k").cast("string")
    return orders(spark, sf).select("o_orderkey", text.safe_ticker(F.concat(F.lit(" br<k>.b-;"), k)).alias("ticker"), text.safe_query(F.concat(F.lit("--q   "), k, F.lit(" word" * 40))).alias("query"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'both' WHEN 1 THEN 'rights' WHEN 2 THEN 'dividend' ELSE 'unknown' END AS kind, CASE WHEN o_orderkey % 3 > 0 THEN 'ok' WHEN o_orderkey % 2 = 0 THEN 'empty' ELSE 'unavailable' END AS status,
  o_orderkey % 5 < 2 AND o_orderkey % 2 = 1 AS pending, CASE WHEN o_orderkey % 5 < 2 THEN 'TWD' ELSE 'USD' END AS currency FROM orders""")
def action_labels(spark, sf):
    k = F.col("k")
    symbol = choice(["2330.TW", "6488.TWO", "AAPL", "TW", "X.TWX"])
    return orders(spark, sf).select("o_orderkey", actions.kind_of(choice(["權息", "除權", "息值", "-"])).alias("kind"), actions.action_status(k % 2 == 0, (k % 3).cast("int")).alias("status"), actions.rights_pending(symbol, k % 2 == 1).alias("pending"), actions.currency(symbol).alias("currency"))


@query("SELECT doc_id, sha256(trim(coalesce(lang, '') || ' ' || coalesce(text, ''), ' ')) AS text FROM documents")
def news_text(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.sha2(sentiment.news_text(F.col("lang"), F.col("text")).cast("binary"), 256).alias("text"))


@query("SELECT o_orderkey, round_even((o_orderkey % 65 - o_orderkey % 33) / 64.0::DOUBLE * 100, 2) AS score FROM orders")
def probability_score(spark, sf):
    return orders(spark, sf).select("o_orderkey", sentiment_score(F.col("k")).alias("score"))


def sentiment_score(k):
    return numbers.score_from_probabilities((k % 65) / 64.0, (k % 33) / 64.0)


@query(f"""WITH {NEWS} SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN event_id % 201 - 100 ELSE s END, 2) AS score, CASE WHEN event_id % 3 > 0 THEN lab WHEN event_id % 201 - 100 >= 12 THEN 'positive' WHEN event_id % 201 - 100 <= -12 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN event_id % 3 = 0 THEN 'rnn_unavailable_fallback_lexicon' ELSE 'ok' END AS status, CASE WHEN event_id % 3 = 0 THEN 'rnn_model_unavailable' END AS error FROM nw""")
def model_fallback(spark, sf):
    n, lex = news(spark, sf), (F.col("event_id") % 201 - 100).cast("double")
    own = F.when(F.col("event_id") % 3 != 0, F.col("sentiment_score"))
    c = sentiment.with_fallback(own, F.col("sentiment_label"), lex, sentiment.label(lex, 12.0, -12.0))
    return n.select("event_id", F.round(c["sentiment_score"], 2).alias("score"), c["sentiment_label"].alias("label"), c["model_status"].alias("status"), c["model_error"].alias("error"))


@query(READ + """, l AS (SELECT symbol, round(score, 1) AS score, bullish, bearish FROM o QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1), wanted AS (SELECT unnest(['A', 'N', 'R', 'ZZ', 'YY']) AS symbol)
SELECT symbol, coalesce(score, 0) AS score, coalesce(bullish, 0) AS bullish, coalesce(bearish, 0) AS bearish, CASE WHEN score IS NULL THEN 'no_data' ELSE 'ready' END AS status, CASE WHEN score IS NULL THEN '資料不足，無法判讀' END AS no_data_headline FROM wanted LEFT JOIN l USING (symbol)""")
def reading_without_data(spark, sf):
    read = signals.market_read(signals.with_signals(indicators.latest(snaps(spark, sf))))
    wanted = spark.createDataFrame([(s,) for s in ("A", "N", "R", "ZZ", "YY")], "symbol string")
    return r(signals.with_no_data(wanted, read).select("symbol", "score", "bullish", "bearish", "status", "no_data_headline"))


@query(READ + """ SELECT s.symbol, strftime(s.ts, '%Y-%m-%d') AS day, concat_ws('；',
  CASE WHEN volatility >= 40 THEN '年化波動度高達 ' || CAST(round_even(volatility, 0) AS BIGINT) || '%，單日跳動幅度大' END, CASE WHEN rsi14 >= 75 THEN 'RSI 已進入超買區，追價風險偏高' END, CASE WHEN rsi14 <= 25 THEN 'RSI 已進入超賣區，不宜貿然摸底' END,
  CASE WHEN sample < 60 THEN '歷史資料僅 ' || sample || ' 筆，指標與預測的穩定度較低' END, CASE WHEN bullish > 0 AND bearish > 0 THEN '指標之間存在分歧，代表盤勢處於轉折或整理階段' END,
  CASE WHEN NOT (coalesce(volatility >= 40, false) OR coalesce(rsi14 >= 75 OR rsi14 <= 25, false) OR sample < 60 OR (bullish > 0 AND bearish > 0)) THEN '目前沒有偵測到特別突出的風險項目，但市場仍可能受突發消息影響' END) || '。' AS risk_note
FROM s JOIN o ON s.symbol = o.symbol AND s.ts = o.ts""")
def risk_note(spark, sf):
    m = signals.market_read(signals.with_signals(snaps(spark, sf)))
    return m.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "risk_note")


INTERVALS = ["1d", "5d", "1wk", "1mo", "3mo", "1h", "60m", "90m", "30m", "15m", "5m", "1m", "2m", None]


@query("""SELECT o_orderkey, [252, 50, 52, 12, 4, 1512, 1512, 1008, 3276, 6552, 19656, 98280, 252, 252][o_orderkey % 14 + 1] AS periods FROM orders""")
def periods_per_year(spark, sf):
    return orders(spark, sf).select("o_orderkey", risk.periods_per_year(choice(INTERVALS)).alias("periods"))


@query("""SELECT o_orderkey, ['^TWII', '^TWII', '^GSPC', NULL][o_orderkey % 4 + 1] AS benchmark FROM orders""")
def benchmark_of_market(spark, sf):
    return orders(spark, sf).select("o_orderkey", insight.benchmark_of(choice(["TW", "TWO", "US", "XX"])).alias("benchmark"))


@query("""SELECT o_orderkey, ['etf', 'fund', 'fund', 'index', 'crypto', 'crypto', 'stock', 'unknown', 'unknown'][o_orderkey % 9 + 1] AS kind FROM orders""")
def quote_kinds(spark, sf):
    return orders(spark, sf).select("o_orderkey", symbols.quote_kind(choice(["etf", "MUTUALFUND", "MoneyMarket", "INDEX", "CRYPTOCURRENCY", "currency", "EQUITY", "FUTURE", None])).alias("kind"))


@query("""SELECT o_orderkey, o_orderkey % 4 < 3 AS period_ok, o_orderkey % 5 < 4 AS interval_ok, [5, 7, 14, 30, 7, 7, 7][o_orderkey % 7 + 1] AS horizon, o_orderkey % 6 < 2 AS flag FROM orders""")
def request_parameters(spark, sf):
    return orders(spark, sf).select("o_orderkey", params.period_known(choice(["1y", "max", "ytd", "7y"])).alias("period_ok"), params.interval_known(choice(["2m", "1h", "3mo", "5d", "4h"])).alias("interval_ok"), params.horizon(choice(["5", "7", "14", "30", "60", "x", None])).alias("horizon"), params.flag(choice(["yes", None, " 0", "FALSE", "no", "Off "])).alias("flag"))


@query(f"WITH {CATALOG} SELECT count(*) AS total, count(*) FILTER (WHERE kind = 'stock') AS stocks, count(*) FILTER (WHERE kind = 'etf') AS etfs FROM ca")
def directory_counts(spark, sf):
    return symbols.directory_counts(catalog(spark, sf))


@query(f"""WITH {CATALOG}, qs AS (SELECT unnest(['12', 'BRAND#13']) AS q), h AS (SELECT q AS query, code, {SCORE} AS score FROM ca, qs WHERE kind = 'etf')
SELECT query, code, CAST(score AS INTEGER) AS score FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, code) <= 8""")
def symbol_search_of_a_kind(spark, sf):
    asked = spark.createDataFrame([("12",), ("BRAND#13",)], "query string")
    return symbols.search(asked, catalog(spark, sf).drop("m").withColumn("tier", F.lit(0)), 8, "etf").select("query", "code", "score")


@query(f"""WITH {CATALOG}, pk AS (SELECT unnest(['7', '12', '3', '999999999999', '9']) AS code, unnest([1, 2, 3, 4, 5]) AS pos)
SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS rank, code, symbol FROM pk JOIN ca USING (code) WHERE m = 0""")
def symbol_quick_picks(spark, sf):
    c = catalog(spark, sf)
    entries = symbols.merged_directory(c.where("m = 0").drop("m"), c.where("m <> 0").drop("m"))
    asked = spark.createDataFrame([("  ",)], "query string")
    return symbols.search(asked, entries, picks=["7", "12", "3", "999999999999", "9"]).select("rank", "code", "symbol")


@query(f"""WITH {NEWS} SELECT '{{"records":' || count(*) || ',"bad_lines_skipped":3,"errors":0,"distribution":{{"positive":' || count(*) FILTER (WHERE lab = 'positive') || ',"neutral":' || count(*) FILTER (WHERE lab = 'neutral') || ',"negative":' || count(*) FILTER (WHERE lab = 'negative') || '}}}}' AS json FROM nw""")
def run_summary(spark, sf):
    whole = sentiment.run_summary(news(spark, sf), 3, 2.0)
    kind = "records long, bad_lines_skipped int, errors long, distribution struct<positive:long, neutral:long, negative:long>"
    return whole.select(F.to_json(F.from_json("json", kind)).alias("json"))


@query("""SELECT (p_partkey % 1000000)::VARCHAR AS c, lpad((p_partkey % 1000000)::VARCHAR, 6, '0') || CASE WHEN p_partkey % 3 = 0 THEN '.TWO' ELSE '.TW' END AS symbol, p_name AS name_zh, CASE WHEN p_partkey % 4 = 0 THEN 'etf' ELSE 'stock' END AS kind  FROM part WHERE p_partkey % 5 > 0""")
def isin_table(spark, sf):
    k = F.col("p_partkey")
    cell = lambda x: F.concat(F.lit("<td bgcolor=#FAFAD2>"), x, F.lit("</td>"))
    cfi = F.when(k % 5 == 0, "RWSCCE").when(k % 4 == 0, "CEOGEU").otherwise("ESVUFR")
    row = F.concat(F.lit("<tr>"), cell(F.concat(F.lpad((k % 1_000_000).cast("string"), 6, "0"), F.lit("　<b>"), F.col("p_name"), F.lit("</b>"))), cell(F.lit("TW00")), cell(F.lit("2001/01/01")), cell(F.when(k % 3 == 0, "上櫃").otherwise("上市")), cell(F.lit("&nbsp;x")), cell(cfi), F.lit("</tr>"))
    pages = t(spark, sf, "part").groupBy(F.floor(k / 500).alias("g")).agg(F.concat(F.lit("<table><tr><td colspan=7>Stocks</td></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    return directories.isin_table(pages).select(F.col("code").cast("long").cast("string").alias("c"), "symbol", "name_zh", "kind")


@query("""SELECT o_orderkey::VARCHAR AS code, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS day, ['rights', 'dividend', 'both'][o_orderkey % 3 + 1] AS kind, round(o_totalprice, 2) AS before_price, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice / 2, 1) END AS reference_price FROM orders""")
def ex_rights_notices(spark, sf):
    o, k = orders(spark, sf), F.col("k")
    label = choice(["權", "息", "權息"])
    before, after = F.format_number("o_totalprice", 2), F.when(k % 4 == 0, "--").otherwise(F.format_string("%.1f", F.round(F.col("o_totalprice") / 2, 1)))
    keyed = F.to_json(F.struct(F.array(F.struct(F.date_format("d", "yyyyMMdd").alias("Date"), k.cast("string").alias("Code"), label.alias("Type"), before.alias("BeforePrice"), after.alias("ReferencePrice"))).alias("data")))
    minguo = F.concat((F.year("d") - 1911).cast("string"), F.lit("/"), F.date_format("d", "MM/dd"))
    table = F.to_json(F.struct(F.array(*map(F.lit, ["資料日期", "股票代號", "權/息", "除權息前收盤價", "除權息參考價"])).alias("fields"), F.array(F.array(minguo, k.cast("string"), label, before, after)).alias("data")))
    found = directories.ex_rights(o.select(F.when(k % 2 == 0, keyed).otherwise(table).alias("json")))
    return found.select("code", F.date_format("date", "yyyy-MM-dd").alias("day"), "kind", "before_price", "reference_price")
