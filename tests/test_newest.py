"""The newest rows per key without shuffling the rest; compatibility forms as the standard has them."""

import sys
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.operators import crawl


def test_a_ticker_with_a_million_news_sends_few(spark):
    n = 1_000_000
    hot = spark.range(0, n, 1, 8).select("id", F.lit("2330.TW").alias("ticker"), (F.col("id") * 7919 % n).alias("published_at"))
    other = spark.createDataFrame([(-1, "aapl", None), (-2, "AAPL", 5), (-3, None, 1), (-4, "AAPL", 5), (-5, "2330", n)], "id long, ticker string, published_at long")
    df = crawl.newest_news(hot.unionByName(other), 3)
    got = {}
    for r in df.collect():
        got.setdefault(r["root"], []).append((r["place"], r["id"]))
    back = {i * 7919 % n: i for i in range(n)}
    assert {k: sorted(v) for k, v in got.items()} == {"2330": [(1, -5), (2, back[n - 1]), (3, back[n - 2])], "AAPL": [(1, -4), (2, -2), (3, -1)], None: [(1, -3)]}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    final, exchange, partial = (plan.index(x) for x in ("Final", "Exchange hashpartitioning", "Partial"))
    assert "WindowGroupLimit" in plan and final < exchange < partial
    assert crawl.newest_news(other.where("false")).count() == 0


def folded(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string").repartition(4)
    return [r["y"] for r in df.select("i", text.nfkc(F.col("x")).alias("y")).orderBy("i").collect()]


def test_every_code_point_that_changes_or_combines(spark):
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    points = [c for c in points if unicodedata.normalize("NFKC", c) != c or unicodedata.normalize("NFKD", c) != c or unicodedata.combining(c)]
    texts = points + [f"e{c}\u0301" for c in points] + [None, "", "plain", "a\nb"]
    assert folded(spark, texts) == [x and unicodedata.normalize("NFKC", x) for x in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(), max_size=40))
def test_any_text(spark, texts):
    texts = [x.replace("\x00", "") for x in texts]
    assert folded(spark, ["x", *texts])[1:] == [unicodedata.normalize("NFKC", x) for x in texts]
