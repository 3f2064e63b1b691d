"""All corporate actions of an instrument in one row: one shuffle of tagged rows, one aggregate, nested results.

Dividends, splits, exchange records and the instruments themselves become rows of one table, told apart by a tag, and meet
by symbol once. What follows reads the arrays of that one row: an instrument's history has a payment or an event a day at
most, so its group is bounded by its age.

Defined cases: amounts and ratios that are null or not positive, and rows without a date, don't count; rows that repeat count
again, but a date has one rights record (the smallest); an instrument without actions has null blocks and says whether its
source answered; actions of symbols that aren't in the list are given as well, as of a source that answered.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .actions import DIVIDENDS, FREQUENCY, RIGHTS, SPLITS, YEARS, action_status, is_rights, ratio_text, rights_pending


def tagged(dividends: DataFrame, splits: DataFrame, exchange: DataFrame, instruments: DataFrame) -> DataFrame:
    """symbol, tag, date, x, y, text, answered, loading."""
    none = {"date": "date", "x": "double", "y": "double", "text": "string", "answered": "boolean", "loading": "boolean"}

    def rows(df: DataFrame, tag: str, **columns: str) -> DataFrame:
        return df.select("symbol", F.lit(tag).alias("tag"), *(F.col(columns[c]).cast(kind).alias(c) if c in columns else F.lit(None).cast(kind).alias(c) for c, kind in none.items()))

    parts = [
        rows(dividends.where("amount > 0 and ex_date is not null"), "dividend", date="ex_date", x="amount"),
        rows(splits.where("ratio > 0 and date is not null"), "split", date="date", x="ratio"),
        rows(exchange.where(F.col("kind").isin("rights", "both") & F.col("date").isNotNull()), "exchange", date="date", x="before_price", y="reference_price", text="kind_label"),
        rows(instruments, "instrument", x="close", answered="answered", loading="loading"),
    ]
    return functools.reduce(DataFrame.unionAll, parts)


def _last(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - F.lit(n - 1), F.lit(1)), n)


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + of(x))


def _yearly(d: Column) -> Column:
    """Year, total and payments of a sorted array of (date, amount), the newest ``YEARS`` years."""
    years = F.array_sort(F.array_distinct(F.transform(d, lambda p: F.year(p["date"]))))

    def year(y: Column) -> Column:
        mine = F.filter(d, lambda p: F.year(p["date"]) == y)
        return F.struct(y.alias("year"), F.round(_total(mine, lambda p: p["amount"]), 4).alias("total"), F.size(mine).alias("count"))

    return F.transform(_last(years, YEARS), year)


def _dividends(d: Column, yearly: Column, whole: Column, ttm: Column, close: Column) -> Column:
    """The block of dividends; ``whole`` are the last three complete years. Null without payments."""
    mean = lambda what: _total(whole, what) / F.nullif(F.size(whole), F.lit(0))
    payments = mean(lambda y: y["count"].cast("double"))
    often = F.when(payments.isNull(), "unknown")
    for least, name in FREQUENCY:
        often = often.when(payments >= least, name)
    average, newest = F.round(mean(lambda y: y["total"]), 4), F.element_at(yearly, -1)
    row = F.filter(yearly, lambda y, i: y["year"] - i == newest["year"] - F.size(yearly) + 1)
    of_price = lambda x: F.when(close > 0, F.round(x / close * 100, 2))
    block = {
        "records": F.slice(F.reverse(d), 1, DIVIDENDS), "yearly": yearly, "ttm_total": ttm, "average_3y": average, "frequency": often.otherwise("irregular"),
        "years_paid": F.size(yearly), "consecutive_years": F.size(row), "latest": F.element_at(d, -1), "total_records": F.size(d), "first_date": F.element_at(d, 1)["date"],
        "ttm_yield_pct": of_price(ttm), "average_3y_yield_pct": of_price(average),
    }
    return F.when(F.size(d) > 0, F.struct(*(v.alias(k) for k, v in block.items())))


def _splits(real: Column) -> Column:
    def named(e: Column) -> Column:
        up = e["ratio"] >= 1
        words = F.when(up, F.concat(F.lit("1:"), ratio_text(e["ratio"]))).otherwise(F.concat(ratio_text(1 / e["ratio"]), F.lit(":1")))
        return F.struct(e["date"].alias("date"), F.round(e["ratio"], 4).alias("ratio"), F.when(up, "split").otherwise("reverse_split").alias("kind"), words.alias("text"))

    return F.when(F.size(real) > 0, F.struct(F.transform(F.slice(real, 1, SPLITS), named).alias("records"), F.size(real).alias("count")))


def _first_of_date(rows: Column) -> Column:
    """Of a sorted array the first of each date, by a look at the one before."""
    return F.filter(rows, lambda x, i: (i == 0) | (F.get(rows, i - 1)["date"] != x["date"]))


def _merged(both: Column) -> Column:
    """Newest first, a row per date from a sorted array with an exchange record (part 0), a split (part 1) or both of each date."""

    def row(x: Column, i: Column) -> Column:
        after, before = F.get(both, i + 1), F.get(both, i - 1)
        paired = (x["part"] == 0) & F.coalesce(after["date"] == x["date"], F.lit(False))
        ratio = F.when(x["part"] == 1, x["ratio"]).when(paired, after["ratio"])
        drop = F.round((x["before"] - x["after"]) / F.nullif(x["before"], F.lit(0.0)) * 100, 2)
        source = F.when(paired, "exchange+splits").when(x["part"] == 0, "exchange").otherwise("splits")
        second = (x["part"] == 1) & (i > 0) & F.coalesce(before["date"] == x["date"], F.lit(False))
        return F.when(~second, F.struct(x["date"].alias("date"), F.coalesce(x["label"], F.lit("stock dividend")).alias("kind_label"), x["before"].alias("before_price"), x["after"].alias("reference_price"), drop.alias("drop_pct"), ratio.alias("ratio"), F.round((ratio - 1) * 1000, 2).alias("shares_per_1000"), source.alias("source")))

    return F.reverse(F.filter(F.transform(both, row), lambda x: x.isNotNull()))


def _rights(rows: Column, symbol: Column) -> Column:
    shares = F.round(_total(rows, lambda x: F.coalesce(x["shares_per_1000"], F.lit(0.0))), 2)
    sources = F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["source"])))
    block = F.struct(F.slice(rows, 1, RIGHTS).alias("records"), F.size(rows).alias("count"), F.nullif(shares, F.lit(0.0)).alias("total_shares_per_1000"), F.exists(sources, lambda s: F.contains(s, F.lit("exchange"))).alias("has_exchange"), sources.alias("sources"))
    return F.when(symbol.rlike(r"\.TWO?$") & (F.size(rows) > 0), block)


def corporate_actions(dividends: DataFrame, splits: DataFrame, exchange: DataFrame, instruments: DataFrame, as_of: Column) -> DataFrame:
    """symbol, status, rights_pending, and the nested blocks dividends, splits and rights, null where there is nothing.

    Takes dividends (symbol, ex_date, amount), splits (symbol, date, ratio), exchange records (symbol, date, kind, kind_label,
    before_price, reference_price) and instruments (symbol, close, answered, loading).
    """
    own = lambda tag, *fields: F.array_sort(F.collect_list(F.when(F.col("tag") == tag, F.struct("date", *fields))))
    whole = tagged(dividends, splits, exchange, instruments).where("symbol is not null").groupBy("symbol").agg(
        own("dividend", F.round("x", 4).alias("amount")).alias("_d"),
        own("split", F.col("x").alias("ratio")).alias("_s"),
        own("exchange", F.col("x").alias("before"), F.col("y").alias("after"), F.col("text").alias("label")).alias("_e"),
        F.max(F.when(F.col("tag") == "instrument", F.col("x"))).alias("_close"),
        F.coalesce(F.bool_and("answered"), F.lit(True)).alias("_answered"),
        F.coalesce(F.bool_or("loading"), F.lit(False)).alias("_loading"),
    )
    symbol, d = F.col("symbol"), F.col("_d")
    part = lambda tag, *fields: lambda x: F.struct(x["date"].alias("date"), F.lit(tag).alias("part"), *(x[f].alias(f) if f in fields else F.lit(None).cast("string" if f == "label" else "double").alias(f) for f in ("before", "after", "label", "ratio")))
    booked = F.filter("_s", lambda e: is_rights(symbol, e["ratio"]))
    both = F.concat(F.transform(_first_of_date(F.col("_e")), part(0, "before", "after", "label")), F.transform("_booked", part(1, "ratio")))
    steps = whole.withColumns({"_yearly": _yearly(d), "_booked": booked, "_real": F.reverse(F.filter("_s", lambda e: ~is_rights(symbol, e["ratio"])))})  # in steps, since each is used more than once
    steps = steps.withColumns({"_whole": _last(F.filter("_yearly", lambda y: y["year"] < F.year(as_of)), 3), "_booked": _first_of_date(F.col("_booked")), "_ttm": F.round(_total(F.filter(d, lambda p: F.date_diff(as_of, p["date"]) <= 365), lambda p: p["amount"]), 4)})
    steps = steps.withColumn("_both", F.array_sort(both)).withColumn("_rows", _merged(F.col("_both")))
    blocks = steps.withColumns({"dividends": _dividends(d, F.col("_yearly"), F.col("_whole"), F.col("_ttm"), F.col("_close")), "splits": _splits(F.col("_real")), "rights": _rights(F.col("_rows"), symbol)})
    some = F.coalesce("dividends.total_records", F.lit(0)) + F.coalesce("splits.count", F.lit(0)) + F.coalesce("rights.count", F.lit(0))
    return blocks.select("symbol", action_status(F.col("_answered"), some).alias("status"), rights_pending(symbol, F.col("_loading")).alias("rights_pending"), "dividends", "splits", "rights")
