"""Profiles of instruments and funds from a quote source's JSON, with gaps filled from the directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import _let, epoch_or_date
from ..functions.numbers import safe
from ..operators.actions import currency
from ..operators.symbols import first_wins, quote_kind

# The field that each column is read from; where there are several, the first that isn't 0 or empty counts.
NUMBERS = {
    "market_cap": "marketCap", "dividend_yield": "dividendYield yield", "dividend_rate": "dividendRate trailingAnnualDividendRate",
    "trailing_dividend_yield": "trailingAnnualDividendYield", "five_year_avg_dividend_yield": "fiveYearAvgDividendYield", "payout_ratio": "payoutRatio",
    "fifty_two_week_high": "fiftyTwoWeekHigh", "fifty_two_week_low": "fiftyTwoWeekLow", "average_volume": "averageVolume",
    "average_volume_10d": "averageDailyVolume10Day", "shares_outstanding": "sharesOutstanding", "previous_close": "previousClose",
}
TEXTS = {"exchange": "exchange fullExchangeName", "market": "market", "website": "website", "description": "longBusinessSummary description", "last_split_factor": "lastSplitFactor"}
DATES = {"ex_dividend_date": "exDividendDate", "last_split_date": "lastSplitDate"}
FUND_NUMBERS = {
    "total_assets": "totalAssets", "expense_ratio": "netExpenseRatio annualReportExpenseRatio", "nav_price": "navPrice", "ytd_return": "ytdReturn",
    "three_year_return": "threeYearAverageReturn", "five_year_return": "fiveYearAverageReturn", "holdings_turnover": "annualHoldingsTurnover",
}
FUND_TEXTS = {"fund_family": "fundFamily", "category": "category", "legal_type": "legalType"}
COMPANY_NUMBERS = {
    "trailing_pe": "trailingPE", "forward_pe": "forwardPE", "peg_ratio": "trailingPegRatio pegRatio", "eps": "trailingEps", "forward_eps": "forwardEps",
    "book_value": "bookValue", "price_to_book": "priceToBook", "price_to_sales": "priceToSalesTrailing12Months", "profit_margin": "profitMargins",
    "operating_margin": "operatingMargins", "gross_margin": "grossMargins", "roe": "returnOnEquity", "roa": "returnOnAssets",
    "debt_to_equity": "debtToEquity", "current_ratio": "currentRatio", "total_revenue": "totalRevenue", "revenue_growth": "revenueGrowth",
    "earnings_growth": "earningsGrowth", "free_cashflow": "freeCashflow", "employees": "fullTimeEmployees", "target_mean_price": "targetMeanPrice",
    "analyst_count": "numberOfAnalystOpinions",
}
COMPANY_TEXTS = {"sector": "sector", "industry": "industry", "country": "country", "city": "city", "recommendation": "recommendationKey"}
KIND_LABELS = {"etf": "ETF", "stock": "股票", "index": "指數", "fund": "基金", "crypto": "加密貨幣"}
OTHER_LABEL = "標的"

# Names under which holdings carry each field.
HOLDING_SYMBOL = ["Symbol", "symbol", "Holding Symbol", "holdingSymbol", "ticker"]
HOLDING_NAME = ["Name", "name", "Holding Name", "holdingName", "holding_name"]
HOLDING_WEIGHT = ["Holding Percent", "holdingPercent", "holding_percent", "Holding Percentage", "Weight", "weight", "weight_pct"]

# A fund's issuer by the first of these words in its name, and the issuer's page.
ISSUERS = [
    ("元大", "元大投信", "https://www.yuantaetfs.com/"),
    ("國泰", "國泰投信", "https://www.cathaysite.com.tw/"),
    ("富邦", "富邦投信", "https://www.fubon.com/asset-management/"),
    ("中信", "中國信託投信", "https://www.ctbcinvestments.com/"),
    ("群益", "群益投信", "https://www.capitalfund.com.tw/"),
    ("復華", "復華投信", "https://www.fhtrust.com.tw/"),
    ("野村", "野村投信", "https://www.nomurafunds.com.tw/"),
    ("永豐", "永豐投信", None),
    ("兆豐", "兆豐投信", None),
]
MOST = 10


def _field(info: Column, keys: str) -> Column:
    """The first value that is neither 0 nor empty; the last one as it is."""
    *early, last = [F.try_element_at(info, F.lit(k)) for k in keys.split(" ")]
    zero = lambda v: F.coalesce(v.try_cast("double") == 0, F.lit(False)) | v.isin("", "false")
    return F.coalesce(*(F.when(~zero(v), v) for v in early), last)


def _of_symbol(entries: DataFrame) -> DataFrame:
    """One directory entry per symbol, under names that clash with nothing."""
    mine = entries if "tier" in entries.columns else entries.withColumn("tier", F.lit(0))
    return first_wins(mine, "symbol", "tier").select(F.col("symbol").alias("_symbol"), F.col("name_zh").alias("_name"), F.col("kind").alias("_kind"))


def instrument_profiles(quotes: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per row of ``quotes`` (symbol, info: a JSON object). Kinds and names that info lacks come from ``entries``.

    Fund columns are null for other kinds, and company columns for funds traded on exchanges. Info that is null or isn't
    JSON gives what the symbol and the directory say.
    """
    q = quotes.select("symbol", F.from_json("info", "map<string,string>").alias("i")).join(_of_symbol(entries), F.col("symbol") == F.col("_symbol"), "left")
    i, own = F.col("i"), quote_kind(F.try_element_at("i", F.lit("quoteType")))
    q = q.withColumn("kind", F.coalesce(F.when(own != "unknown", own), F.col("_kind"), F.lit("unknown")))
    fund, text = F.col("kind") == "etf", lambda keys: F.nullif(_field(i, keys), F.lit(""))
    label = F.lit(OTHER_LABEL)
    for kind, words in KIND_LABELS.items():
        label = F.when(F.col("kind") == kind, words).otherwise(label)
    number = lambda keys: safe(_field(i, keys))
    return q.select(
        F.coalesce(text("symbol"), F.col("symbol")).alias("symbol"),
        F.coalesce(text("longName"), text("shortName"), F.nullif("_name", F.lit("")), F.col("symbol")).alias("name"),
        F.col("_name").alias("name_zh"), "kind", label.alias("kind_label"), F.coalesce(text("currency"), currency(F.col("symbol"))).alias("currency"),
        *(_field(i, k).alias(c) for c, k in TEXTS.items()), *(number(k).alias(c) for c, k in NUMBERS.items()), *(epoch_or_date(_field(i, k)).alias(c) for c, k in DATES.items()),
        F.round(number("52WeekChange") * 100, 2).alias("fifty_two_week_change_pct"), F.when(fund, number("beta3Year beta")).otherwise(number("beta")).alias("beta"),
        *(F.when(fund, number(k)).alias(c) for c, k in FUND_NUMBERS.items()), *(F.when(fund, _field(i, k)).alias(c) for c, k in FUND_TEXTS.items()),
        F.when(fund, epoch_or_date(_field(i, "fundInceptionDate"))).alias("inception_date"),
        *(F.when(~fund, number(k)).alias(c) for c, k in COMPANY_NUMBERS.items()), *(F.when(~fund, _field(i, k)).alias(c) for c, k in COMPANY_TEXTS.items()),
        F.when(~fund, epoch_or_date(_field(i, "earningsTimestamp"))).alias("earnings_date"),
    )


def _scale(weights: Column) -> Column:
    """100 where the weights together are shares, 1 where they are percent already or none is known."""
    known = F.filter(weights, lambda w: w.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda s, w: s + w)
    return F.when((F.size(known) > 0) & (total <= 1.5), 100.0).otherwise(1.0)


def top_holdings(json: Column) -> Column:
    """Up to ten holdings (symbol, name, weight_pct) of a JSON list of objects, or of an object of objects by symbol.

    Holdings with neither name nor symbol are left out after the first ten were taken; null and unreadable JSON give none.
    """
    listed = F.transform(F.from_json(json, "array<map<string,string>>"), lambda r: F.struct(F.lit(None).cast("string").alias("key"), r.alias("value")))
    rows = F.when(F.ltrim(json).startswith("{"), F.map_entries(F.from_json(json, "map<string,map<string,string>>"))).otherwise(listed)
    first = lambda r, keys: F.coalesce(*(F.try_element_at(r["value"], F.lit(k)) for k in keys))
    raw = F.transform(F.slice(F.filter(rows, lambda r: r.isNotNull()), 1, MOST), lambda r: F.struct(F.coalesce(first(r, HOLDING_SYMBOL), r["key"], F.lit("")).alias("s"), first(r, HOLDING_NAME).alias("n"), safe(first(r, HOLDING_WEIGHT)).alias("w")))
    named = F.transform(raw, lambda h: F.struct(F.trim(h["s"]).alias("s"), F.trim(F.coalesce(F.nullif(h["n"], F.lit("")), h["s"])).alias("n"), h["w"].alias("w")))
    kept = F.filter(named, lambda h: h["n"] != "")
    percent = lambda k, scale: F.transform(k, lambda h: F.struct(h["s"].alias("symbol"), h["n"].alias("name"), F.round(h["w"] * scale, 2).alias("weight_pct")))
    scaled = _let(kept, lambda k: _let(_scale(F.transform(k, lambda h: h["w"])), lambda scale: percent(k, scale)))  # else each holding would parse the list anew
    return F.coalesce(scaled, F.from_json(F.lit("[]"), "array<struct<symbol:string,name:string,weight_pct:double>>"))


def sector_weightings(json: Column) -> Column:
    """The ten largest sectors (sector, weight_pct) of a JSON object; weights that aren't numbers are left out."""
    pairs = F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e, i: F.struct((-F.abs(safe(e["value"]))).alias("o"), i.alias("i"), e["key"].alias("k"), safe(e["value"]).alias("w")))
    known = F.array_sort(F.filter(pairs, lambda p: p["w"].isNotNull()))
    percent = lambda k, scale: F.transform(F.slice(k, 1, MOST), lambda p: F.struct(p["k"].alias("sector"), F.round(p["w"] * scale, 2).alias("weight_pct")))
    scaled = _let(known, lambda k: _let(_scale(F.transform(k, lambda p: p["w"])), lambda scale: percent(k, scale)))
    return F.coalesce(scaled, F.from_json(F.lit("[]"), "array<struct<sector:string,weight_pct:double>>"))


def issuer_reference(symbol: Column, name: Column, kind: Column) -> Column:
    """Issuer, its page and the fund's name for Taiwan symbols that the directory names and doesn't call a stock."""
    hit = F.struct(F.lit(None).cast("string").alias("issuer"), F.lit(None).cast("string").alias("url"), name.alias("fund_name"))
    for word, issuer, url in reversed(ISSUERS):
        hit = F.when(F.contains(name, F.lit(word)), F.struct(F.lit(issuer).alias("issuer"), F.lit(url).cast("string").alias("url"), name.alias("fund_name"))).otherwise(hit)
    return F.when(symbol.rlike(r"\.TWO?$") & (name != "") & F.coalesce(kind != "stock", F.lit(True)), hit)


def fund_profiles(funds: DataFrame, entries: DataFrame) -> DataFrame:
    """symbol, description, overview, top_holdings, sector_weightings and, for want of holdings, holdings_reference.

    ``funds``: symbol, description, and overview, sectors and holdings as JSON. Funds of which nothing is known give no row.
    """
    f = funds.select("symbol", "description", F.from_json("overview", "map<string,string>").alias("overview"), top_holdings(F.col("holdings")).alias("top_holdings"), sector_weightings(F.col("sectors")).alias("sector_weightings"))
    f = f.join(_of_symbol(entries), F.col("symbol") == F.col("_symbol"), "left")
    f = f.withColumn("holdings_reference", F.when(F.size("top_holdings") == 0, issuer_reference(F.col("symbol"), F.col("_name"), F.col("_kind")))).drop("_symbol", "_name", "_kind")
    known = (F.size("top_holdings") > 0) | (F.size("sector_weightings") > 0) | (F.coalesce(F.size("overview"), F.lit(0)) > 0) | F.col("holdings_reference").isNotNull()
    return f.where(known)
