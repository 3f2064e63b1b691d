"""Symbol directory: merging, ranked search and resolution, for tables of queries as well as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_query

PUBLIC = ["code", "symbol", "name_zh", "name_en", "market", "kind"]


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that comes first."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def merged_directory(catalog: DataFrame, directory: DataFrame) -> DataFrame:
    """The catalog, and directory entries whose code it lacks; tier 0 and 1."""
    rest = directory.join(catalog.select("code").distinct(), "code", "left_anti")
    return catalog.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)), allowMissingColumns=True)


def entry_score(q: Column) -> Column:
    """How well an entry answers a normalised query; the first rule that holds counts, 0 if none does."""
    code, symbol, zh, en = F.upper("code"), F.upper("symbol"), F.coalesce("name_zh", F.lit("")), F.upper(F.coalesce("name_en", F.lit("")))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.upper(t))
    return (
        F.when((code == q) | (symbol == q), 1000)
        .when(code.startswith(q) | symbol.startswith(q), 900 - F.length(code))
        .when(zh == q, 880)
        .when(zh.startswith(q), 800 - F.length(zh))
        .when(en.startswith(q), 780 - F.length(en))
        .when(F.contains(zh, q), 600)
        .when(F.contains(en, q), 560)
        .when(F.array_contains(tags, q), 540)
        .when(F.exists(tags, lambda t: F.contains(t, q)), 480)
        .when(F.contains(code, q) | F.contains(symbol, q), 400)
        .otherwise(0)
    )


#: What an empty query shows, in this order.
QUICK_PICKS = ["2330", "0050", "00878", "006208", "2454", "SPY", "QQQ", "NVDA"]


def quick_picks(empty: DataFrame, entries: DataFrame, picks: list[str], limit: int) -> DataFrame:
    """The picks that the catalog (tier 0) holds, in order and without scores, for each empty query; kinds don't matter."""
    held = first_wins(entries.where((F.col("tier") == 0) & F.col("code").isin(picks)), "code", "symbol")
    at = F.array_position(F.array(*map(F.lit, picks)), F.col("code"))
    ranked = held.withColumn("rank", F.row_number().over(Window.orderBy(at))).where(F.col("rank") <= limit)  # no more rows than picks
    return empty.select("query").join(F.broadcast(ranked), F.lit(True)).select("query", "rank", F.lit(0).alias("score"), *PUBLIC)


def search(queries: DataFrame, entries: DataFrame, limit: int = 10, kind: str | None = None, picks: list[str] = QUICK_PICKS) -> DataFrame:
    """The best entries per query (query): rank, score and public fields. The directory (tier 1, 5 points less) counts
    only where the catalog gives fewer than ``limit``. Null and empty queries give the ``picks``. Queries are few; they
    are sent to every entry."""
    asked = queries.select("query", F.coalesce(normal_query(F.col("query")), F.lit("")).alias("q"))
    q = F.broadcast(asked.where("q <> ''"))
    pool = entries if kind not in ("etf", "stock", "index") else entries.where(F.col("kind") == kind)
    hits = pool.join(q, F.lit(True)).withColumn("score", entry_score(F.col("q"))).where("score > 0").withColumn("score", F.col("score") - 5 * F.col("tier"))
    w = Window.partitionBy("query")
    hits = hits.withColumn("_own", F.count_if(F.col("tier") == 0).over(w)).where((F.col("tier") == 0) | (F.col("_own") < limit))
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy("query", "code").orderBy(F.desc("score"), "tier", "symbol"))).where("_n = 1")
    ranked = best.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "code")))
    found = ranked.where(F.col("rank") <= limit).select("query", "rank", "score", *PUBLIC)
    return found.unionByName(quick_picks(asked.where("q = ''"), entries, picks, limit))


def quote_kind(quote_type: Column) -> Column:
    """A quote source's type as a kind."""
    value = F.upper(F.coalesce(quote_type, F.lit("")))
    return F.when(value == "ETF", "etf").when(value.isin("MUTUALFUND", "MONEYMARKET"), "fund").when(value == "INDEX", "index").when(value.isin("CRYPTOCURRENCY", "CURRENCY"), "crypto").when(value == "EQUITY", "stock").otherwise("unknown")


def market_of(symbol: Column) -> Column:
    return F.when(symbol.endswith(".TW"), "TW").when(symbol.endswith(".TWO"), "TWO").when(symbol.isNotNull(), "US")


def directory_counts(entries: DataFrame) -> DataFrame:
    return entries.agg(F.count("*").alias("total"), F.count_if(F.col("kind") == "stock").alias("stocks"), F.count_if(F.col("kind") == "etf").alias("etfs"))


def resolve(queries: DataFrame, entries: DataFrame, best: DataFrame | None = None) -> DataFrame:
    """Candidate symbols per query, in order and once each: the entry of the whole query and that of its first word, then
    what the query's form says, then the best search hit (``best``: query, symbol) of names and unknown words."""
    q = queries.select("query", normal_query(F.col("query")).alias("q")).withColumn("head", F.split("q", " ").getItem(0))
    names = entries.select(F.explode(F.array(F.upper("code"), F.upper("symbol"), F.upper("name_zh"), F.upper("name_en"))).alias("q"), F.struct("tier", "code", "symbol", "market", "kind").alias("e")).where("q is not null")
    exact = names.groupBy("q").agg(F.min("e").alias("e"))
    df = q.join(exact, "q", "left").join(exact.select(F.col("q").alias("head"), F.col("e").alias("h")), "head", "left")
    df = df if best is None else df.join(best.select("query", F.col("symbol").alias("found")), "query", "left")
    found = F.lit(None).cast("string") if best is None else F.col("found")
    c, head, none = F.col("q"), F.col("head"), F.array().cast("array<string>")
    board = lambda x: F.array(F.concat(x, F.lit(".TW")), F.concat(x, F.lit(".TWO")))
    shape = (
        F.when(c == "", none)
        .when(F.contains(c, F.lit(".")) | c.startswith("^"), F.array(c))
        .when(c.rlike(r"^\d{4,6}[A-Z]?$"), board(c))
        .when(head.rlike(r"^\d{4,6}[A-Z]?$"), board(head))
        .when(c.rlike(r"^[A-Z0-9\-]{1,10}$"), F.when(F.col("e").isNull() & (F.length(c) >= 4), F.array(c, found)).otherwise(F.array(c)))
        .when(F.col("e").isNull(), F.array(found))
        .otherwise(none)
    )
    own = F.array(F.col("e.symbol"), F.when(head != c, F.col("h.symbol")))
    df = df.withColumn("candidates", F.array_distinct(F.array_compact(F.concat(own, shape)))).withColumn("primary", F.try_element_at("candidates", F.lit(1)))
    by_symbol = entries.select(F.upper("symbol").alias("_s"), F.struct("tier", "code", "symbol", "market", "kind").alias("k")).groupBy("_s").agg(F.min("k").alias("k"))
    df = df.join(by_symbol, F.upper("primary") == F.col("_s"), "left").withColumn("known", F.coalesce("e", "k"))
    return df.select("query", "candidates", "primary", F.coalesce("known.market", market_of(F.col("primary"))).alias("market"), F.col("known").isNotNull().alias("catalog"), F.coalesce("known.code", "q").alias("display_code"), F.col("known.kind").alias("kind"))
