"""Sentiment, directories, dates and streaming on small fixtures."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from barloom import cli, schemas
from barloom.functions import dates, text
from barloom.operators import crawl, features, sentiment, symbols
from barloom.sources import directories, news
from barloom.streaming import news as stream


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("headline", "label", "score"), [
    ("營收創新高 股價漲停", "positive", 100.0), ("公司破產 違約", "negative", -100.0), ("", "neutral", 0.0), ("not bullish", "negative", None),
    ("Stocks surge but warning remains", "neutral", None), ("nothing to see", "neutral", 0.0),
])
def test_default_lexicon(spark, headline, label, score):
    row = sentiment.with_lexicon(spark.createDataFrame([(headline,)], "h string"), "h").first()
    assert row["lexicon_label"] == label and (score is None or row["lexicon_score"] == score)


def test_tolerant_reader_counts_bad_lines(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"id": "1", "headline": "a"}\n\nnot json\n{"id": "2", "headline": "b"}\n')
    rows = news.read_jsonl(spark, str(tmp_path / "n.jsonl"))
    assert news.bad_lines(rows.cache()).first()[0] == 1 and news.good_rows(rows).count() == 2


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item><item><title></title><link>http://x/2</link></item></channel></rss>")
    rows = news.read_feed(spark, str(tmp_path / "f.xml"), "s").collect()
    assert len(rows) == 1 and rows[0]["headline"] == "A" and rows[0]["ts"] == datetime(2024, 1, 2, 10)


@pytest.mark.parametrize("raw", ["114/07/18", "1140718", "20250718", "2025-07-18"])
def test_both_calendars(spark, raw):
    assert one(spark, dates.minguo_date(F.col("x")), raw) == date(2025, 7, 18)


@pytest.mark.parametrize("raw", ["", None, "soon", "99", "2025-13-40"])
def test_bad_dates_are_null(spark, raw):
    assert one(spark, dates.minguo_date(F.col("x")), raw) is None


def test_local_buckets_carry_their_offset(spark):
    df = spark.createDataFrame([("T", datetime(2024, 1, 1, 17, 50), 10.0, "positive"), ("T", None, 1.0, "neutral")], "ticker string, ts timestamp, sentiment_score double, sentiment_label string")
    row = features.bucket_features(df, "30min", "Asia/Taipei").collect()
    assert len(row) == 1 and row[0]["bucket_start"] == "2024-01-02T01:30:00+08:00" and row[0]["score_std"] == 0


def test_text_helpers(spark):
    assert one(spark, text.normal_query(F.col("x")), "　ｎｖｄａ ") == "NVDA"
    assert one(spark, text.markdown_text(F.col("x")), "# T\n[a](b) ![i](j) ```x``` *c*") == "T a c"
    assert one(spark, text.absolute_link(F.lit("https://h.org/a/b.html"), F.col("x")), "c") == "https://h.org/a/c"
    assert one(spark, text.absolute_link(F.lit("https://h.org/a/b.html"), F.col("x")), "/c") == "https://h.org/c"


def test_directories(spark):
    html = "<table><tr><td colspan=6>Stocks</td></tr>" + "".join(f"<tr><td>{c}</td><td>i</td><td>2001/01/01</td><td>{b}</td><td>x</td><td>{k}</td></tr>" for c, b, k in (("2330　TSMC", "上市", "ESVUFR"), ("6488　GW", "上櫃", "ESVUFR"), ("0050　ETF", "上市", "CEOGEU"), ("030001　W", "上市", "RWSCCE"))) + "</table>"
    got = {r["symbol"]: r["kind"] for r in directories.isin_table(spark.createDataFrame([(html,)], "html string")).collect()}
    assert got == {"2330.TW": "stock", "6488.TWO": "stock", "0050.TW": "etf"}
    lines = ["Symbol|Security Name|C|T|F|L|E|N", "AAPL|Apple Inc. - Common Stock|Q|N|N|100|N|N", "QQQ|Invesco QQQ|G|N|N|100|Y|N", "ZTEST|Test|G|Y|N|100|N|N", "ABCW|Abc - Warrants|G|N|N|100|N|N", "UNTD|United Co|G|N|N|100|N|N", "BRK.B|Berkshire|N|N|N|100|N|N", "File Creation Time: 1|||||||"]
    f = directories.symbol_file(spark.createDataFrame([(x,) for x in lines], "value string"), "NASDAQ")
    got = {r["code"]: (r["name_en"], r["kind"]) for r in directories.merged_files(f, f).collect()}
    assert got == {"AAPL": ("Apple Inc.", "stock"), "QQQ": ("Invesco QQQ", "etf"), "UNTD": ("United Co", "stock"), "BRK-B": ("Berkshire", "stock")}


def test_ex_rights_in_both_shapes(spark):
    a = '{"fields": ["資料日期", "股票代號", "權/息", "除權息前收盤價"], "data": [["114/07/18", "2330", "權息", "1,000.5"], ["x", "1", "息", "--"]]}'
    b = '{"data": [{"Date": "20250718", "Code": "1101", "Type": "息", "BeforePrice": "--"}]}'
    got = {r["code"]: (r["date"], r["kind"], r["before_price"]) for r in directories.ex_rights(spark.createDataFrame([(a,), (b,)], "json string")).collect()}
    assert got == {"2330": (date(2025, 7, 18), "both", 1000.5), "1101": (date(2025, 7, 18), "dividend", None)}


def test_resolution_goldens(spark):
    entries = spark.createDataFrame([("0050", "0050.TW", "元大台灣50", "Yuanta", "TW", "etf", ["top"]), ("6488", "6488.TWO", "環球晶", "GlobalWafers", "TWO", "stock", []), ("NVDA", "NVDA", "輝達", "NVIDIA", "US", "stock", [])], schemas.CATALOG).withColumn("tier", F.lit(0))
    asked = spark.createDataFrame([("0050",), ("6488",), ("1234",), (" ｎｖｄａ ",), ("^TWII",)], "query string")
    got = {r["query"]: r["candidates"] for r in symbols.resolve(asked, entries).collect()}
    assert got == {"0050": ["0050.TW", "0050.TWO"], "6488": ["6488.TWO", "6488.TW"], "1234": ["1234.TW", "1234.TWO"], " ｎｖｄａ ": ["NVDA"], "^TWII": ["^TWII"]}
    assert symbols.search(asked.limit(1), entries).first()["score"] == 1000


def test_crawl_status(spark):
    pages = spark.createDataFrame([("s", "http://h/l", '<a href="/a?x=1">1</a><a href="/a?x=1">2</a><a href="http://o/b">3</a>')], "source string, url string, html string")
    assert [r["link"] for r in crawl.list_links(pages, exclude=["o/"]).collect()] == ["http://h/a?x=1"]
    recs = spark.createDataFrame([("s", "u", "t", "x" * 50), ("t", "u", "t", "x" * 50), ("s", "v", None, "y" * 50)], "source string, url string, headline string, content string")
    assert sorted(r["status"] for r in crawl.with_status(recs).collect()) == ["duplicate", "filtered", "kept"]


def test_streams_deduplicate_and_bucket(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    lines = [f'{{"id": "{i}", "ticker": "T", "published_at": "2024-01-01T00:{i % 60:02d}:00Z", "sentiment_score": {i}.0, "sentiment_label": "neutral"}}' for i in (0, 1, 1, 20)]
    lines.append('{"id": "z", "ticker": "T", "published_at": "2024-01-02T00:00:00Z", "sentiment_score": 0.0, "sentiment_label": "neutral"}')
    (src / "a.json").write_text("\n".join(lines))
    rows = stream.deduplicated(stream.landing(spark, str(src)))
    stream.write_available(stream.bucket_stream(rows, watermarked=True), str(out), str(tmp_path / "cp")).awaitTermination()
    got = {r["bucket_start"].minute: r["news_count"] for r in spark.read.parquet(str(out)).collect() if r["bucket_start"].day == 1}
    assert got == {0: 2, 15: 1}


def test_cli_scores_and_aggregates(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"url": "u", "headline": "大漲", "content": "", "ticker": "T", "published_at": "2024-01-01T00:00:00Z"}\n')
    cli.main(["score", "--input", str(tmp_path / "n.jsonl"), "--output", str(tmp_path / "s"), "--ab-ratio", "1.0"])
    row = spark.read.json(str(tmp_path / "s")).first()
    assert row["sentiment_label"] == "positive" and row["arm"] == "rnn" and len(row["id"]) == 64
    cli.main(["features", "--input", str(tmp_path / "s"), "--output", str(tmp_path / "f")])
    assert news.read_features(spark, str(tmp_path / "f")).first()["news_count"] == 1


def test_empty_queries_show_the_quick_picks(spark):
    kinds = "code string, symbol string, name_zh string, name_en string, market string, kind string, tags array<string>, tier int"
    rows = [("SPY", "SPY", None, "S", "US", "etf", None, 0), ("2330", "2330.TW", None, "T", "TW", "stock", None, 0), ("NVDA", "NVDA", None, "N", "US", "stock", None, 1), ("ZZ", "ZZ", None, "Z", "US", "stock", None, 0)]
    found = symbols.search(spark.createDataFrame([("",), (None,), ("zz",)], "query string"), spark.createDataFrame(rows, kinds), kind="stock").collect()
    by = lambda q: [r["code"] for r in sorted(found, key=lambda r: r["rank"]) if r["query"] == q]
    assert by("") == by(None) == ["2330", "SPY"] and by("zz") == ["ZZ"]


def test_lexicon_scoring_holds_one_text_at_a_time(spark):
    from barloom.operators import sentiment

    scored = sentiment.with_lexicon(spark.createDataFrame([(1, "bullish surge"), (2, None), (3, "plunge"), (4, "")], "id int, text string"), "text")
    assert "[pythonUDF0#" in (plan := scored._jdf.queryExecution().executedPlan().toString()) and "], 250\n" in plan  # Arrow, not pandas
    assert [r["lexicon_label"] for r in scored.orderBy("id").collect()] == ["positive", "neutral", "negative", "neutral"]
