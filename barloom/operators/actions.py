"""Dividends, splits, rights, and fund holdings. The date of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, ratio_text, rounded

#: Years and rows kept; payments a year from which a schedule is called so.
YEARS, DIVIDENDS, SPLITS, RIGHTS = 15, 600, 20, 30
FREQUENCY = [(10.0, "monthly"), (3.4, "quarterly"), (1.6, "semiannual"), (0.8, "annual")]


def paid(dividends: DataFrame) -> DataFrame:
    return dividends.where("amount > 0")


def yearly(dividends: DataFrame) -> DataFrame:
    """Total and count per year, the newest ``YEARS`` years."""
    y = paid(dividends).groupBy("symbol", F.year("ex_date").alias("year")).agg(F.round(F.sum("amount"), 4).alias("total"), F.count("*").alias("payments"))
    return y.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))).where(F.col("_n") <= YEARS).drop("_n")


def streaks(years: DataFrame) -> DataFrame:
    """Years in a row, back from the newest, and years paid."""
    w = Window.partitionBy("symbol").orderBy(F.desc("year"))
    island = years.withColumn("g", F.col("year") + F.row_number().over(w))
    return island.withColumn("top", F.max("g").over(Window.partitionBy("symbol"))).groupBy("symbol").agg(F.count_if(F.col("g") == F.col("top")).alias("streak"), F.count("*").alias("years_paid"))


def frequency(years: DataFrame, as_of: Column) -> DataFrame:
    """The schedule that the last three complete years' counts suggest."""
    full = years.where(F.col("year") < F.year(as_of)).withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("year")))).where("_n <= 3")
    mean = full.groupBy("symbol").agg(F.avg("payments").alias("mean"))
    name = F.when(F.col("mean").isNull(), "unknown")
    for least, what in FREQUENCY:
        name = name.when(F.col("mean") >= least, what)
    return years.select("symbol").distinct().join(mean, "symbol", "left").select("symbol", name.otherwise("irregular").alias("frequency"))


def trailing(dividends: DataFrame, as_of: Column) -> DataFrame:
    """Dividends of the last 365 days, and the mean year of the last three complete ones."""
    ttm = paid(dividends).groupBy("symbol").agg(F.round(F.coalesce(F.sum(F.when(F.date_diff(as_of, F.col("ex_date")) <= 365, F.col("amount"))), F.lit(0.0)), 4).alias("ttm"))
    w = Window.partitionBy("symbol").orderBy(F.desc("year"))
    full = yearly(dividends).where(F.col("year") < F.year(as_of)).withColumn("_n", F.row_number().over(w)).where("_n <= 3")
    return ttm.join(full.groupBy("symbol").agg(F.round(F.avg("total"), 4).alias("avg3")), "symbol", "left")


def dividend_summary(dividends: DataFrame, as_of: Column, latest_close: DataFrame | None = None) -> DataFrame:
    """One row per symbol: trailing and mean dividends, schedule, streak, last payment, yields on the latest close."""
    y = yearly(dividends)
    last = paid(dividends).groupBy("symbol").agg(F.max_by("amount", F.struct("ex_date", "amount")).alias("last_amount"), F.max("ex_date").alias("last_date"))
    s = trailing(dividends, as_of).join(frequency(y, as_of), "symbol").join(streaks(y), "symbol").join(last, "symbol")
    if latest_close is None:
        return s
    s = s.join(latest_close.select("symbol", "close"), "symbol", "left")
    return s.withColumns({"ttm_yield": F.round(ratio(F.col("ttm"), F.col("close")) * 100, 2), "avg3_yield": F.round(ratio(F.col("avg3"), F.col("close")) * 100, 2)})


def newest(df: DataFrame, date: str, most: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(date)))).where(F.col("_n") <= most).drop("_n")


def is_rights(symbol: Column, r: Column) -> Column:
    """Taiwan books stock dividends as small splits."""
    return symbol.rlike(r"\.TWO?$") & (r > 1) & (r <= 1.5)


def splits(events: DataFrame) -> DataFrame:
    """Real splits, newest first, with their direction and ratio in words."""
    real = newest(events.where((F.col("ratio") > 0) & ~is_rights(F.col("symbol"), F.col("ratio"))), "date", SPLITS)
    r = F.col("ratio")
    text = F.when(r >= 1, F.concat(F.lit("1:"), ratio_text(r))).otherwise(F.concat(ratio_text(1 / r), F.lit(":1")))
    return real.select("symbol", "date", "ratio", F.when(r >= 1, "split").otherwise("reverse_split").alias("kind"), text.alias("text"))


def rights_from_splits(events: DataFrame) -> DataFrame:
    """Stock dividends: shares per thousand held."""
    r = events.where(is_rights(F.col("symbol"), F.col("ratio")))
    return r.select("symbol", "date", "ratio", F.round((F.col("ratio") - 1) * 1000, 2).alias("shares_per_1000"))


def merged_rights(exchange: DataFrame, from_splits: DataFrame) -> DataFrame:
    """Exchange records and split-derived ones by date: prices from the former, ratios from the latter."""
    e = exchange.where(F.col("kind").isin("rights", "both")).select("symbol", "date", "kind_label", "before_price", "reference_price", F.lit("exchange").alias("s1"))
    m = e.join(from_splits.withColumn("s2", F.lit("splits")), ["symbol", "date"], "full_outer")
    drop = F.round((F.col("before_price") - F.col("reference_price")) / F.nullif(F.col("before_price"), F.lit(0.0)) * 100, 2)
    return newest(m.select("symbol", "date", F.coalesce("kind_label", F.lit("stock dividend")).alias("kind_label"), "before_price", "reference_price", drop.alias("drop_pct"), "ratio", "shares_per_1000", F.concat_ws("+", "s1", "s2").alias("source")), "date", RIGHTS)


def rights_summary(rights: DataFrame) -> DataFrame:
    return rights.groupBy("symbol").agg(F.count("*").alias("records"), F.round(F.sum("shares_per_1000"), 2).alias("total_shares"), F.array_sort(F.collect_set("source")).alias("sources"), F.bool_or(F.contains("source", F.lit("exchange"))).alias("has_exchange"), F.max("date").alias("latest"))


def kind_of(text: Column) -> Column:
    """What an exchange's label says: 權 rights, 息 dividend."""
    r, d = F.contains(text, F.lit("權")), F.contains(text, F.lit("息"))
    return F.when(r & d, "both").when(r, "rights").when(d, "dividend").otherwise("unknown")


def shared_scale(weights: DataFrame, by: str, weight: str = "weight") -> DataFrame:
    """Weights in percent: a fund whose weights sum to 1.5 or less states shares, and is scaled as a whole."""
    w = F.col(weight).try_cast("double")
    total = F.sum(F.abs(w)).over(Window.partitionBy(by))
    return weights.withColumn("weight_pct", rounded(F.when(total <= 1.5, w * 100).otherwise(w), 2)).where("weight_pct is not null")


def top_weights(weights: DataFrame, by: str, order: list[Column], most: int = 10) -> DataFrame:
    return weights.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= most)


def issuer(funds: DataFrame, issuers: DataFrame) -> DataFrame:
    """The issuer whose keyword stands first in the table among those in the fund's name. The table is a short list."""
    hit = funds.join(F.broadcast(issuers), F.contains(F.upper(funds["name"]), F.upper(issuers["keyword"])))
    best = hit.groupBy("fund").agg(F.min(F.struct("pos", "issuer")).alias("m")).select("fund", F.col("m.issuer").alias("issuer"))
    return funds.join(best, "fund", "left")


def currency(symbol: Column) -> Column:
    return F.when(symbol.rlike(r"\.TWO?$"), "TWD").otherwise("USD")


def action_status(available: Column, count: Column) -> Column:
    """ok with any records; without, empty if the source answered, else unavailable."""
    return F.when(count > 0, "ok").when(available, "empty").otherwise("unavailable")


def rights_pending(symbol: Column, loading: Column) -> Column:
    """Whether a Taiwan symbol still waits for the exchange's records."""
    return symbol.rlike(r"\.TWO?$") & loading
