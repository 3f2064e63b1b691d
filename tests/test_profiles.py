"""The built-in catalog, profiles, board pages and source settings on small fixtures."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from barloom.functions import text
from barloom.operators import symbols
from barloom.sources import catalog, directories, news, profiles


def test_catalog_is_whole(spark):
    rows = catalog.built_in(spark).collect()
    assert len(rows) == 157 and len({r["symbol"] for r in rows}) == 157 and all(r["market"] in ("TW", "TWO", "US") and r["tags"] for r in rows)
    assert {r["code"] for r in rows} >= set(symbols.QUICK_PICKS)


def holdings(spark, value):
    return [tuple(h) for h in spark.createDataFrame([(value if value is None or isinstance(value, str) else json.dumps(value),)], "j string").select(profiles.top_holdings(F.col("j")).alias("h")).first()["h"]]


@pytest.mark.parametrize(("value", "found"), [
    ([{"Symbol": "A", "Name": "Aa", "Holding Percent": 0.5712}, {"symbol": "B", "holdingName": "Bb", "weight": 0.0421}], [("A", "Aa", 57.12), ("B", "Bb", 4.21)]),
    ([{"Symbol": "A", "Weight": 7.12}, {"Symbol": "B", "Weight": 6.05}], [("A", "A", 7.12), ("B", "B", 6.05)]),
    ({"A": {"Name": "Aa", "Holding Percent": 0.33}, "B": {"Name": "", "Holding Percent": "n/a"}}, [("A", "Aa", 33.0), ("B", "B", None)]),
    ([{"Name": "only", "weight": 40}, {"weight": 0.9}, None], [("", "only", 40.0)]), ([], []), (None, []), ("not json", []),
])
def test_holdings(spark, value, found):
    assert holdings(spark, value) == found


def test_ten_holdings_are_taken(spark):
    assert [h[0] for h in holdings(spark, [{"Symbol": f"S{i}", "Weight": 2} for i in range(25)])] == [f"S{i}" for i in range(10)]


def test_fund_profiles(spark):
    rows = [("0050.TW", None, None, None, None), ("X.TW", None, None, '{"a": 40.0, "b": 0.9, "c": "?", "d": -50}', None), ("SPY", None, None, None, None), ("QQQ", "d", '{"family": "f"}', None, "[]"), ("2330.TW", None, None, None, None)]
    got = {r["symbol"]: r for r in profiles.fund_profiles(spark.createDataFrame(rows, "symbol string, description string, overview string, sectors string, holdings string"), catalog.built_in(spark)).collect()}
    assert set(got) == {"0050.TW", "X.TW", "QQQ"} and got["0050.TW"]["holdings_reference"]["issuer"] == "元大投信"
    assert [tuple(s) for s in got["X.TW"]["sector_weightings"]] == [("d", -5000.0), ("a", 4000.0), ("b", 90.0)]  # sums to -9.1
    assert got["QQQ"]["overview"] == {"family": "f"} and got["QQQ"]["holdings_reference"] is None


def test_instruments_without_info_follow_the_directory(spark):
    rows = spark.createDataFrame([("2330.TW", None), ("SPY", "{}"), ("NEW", "not json"), ("QQQ", '{"quoteType": "etf", "beta3Year": 0, "beta": 1.5, "currency": ""}')], "symbol string, info string")
    got = {r["symbol"]: r for r in profiles.instrument_profiles(rows, catalog.built_in(spark)).collect()}
    assert (got["2330.TW"]["name"], got["2330.TW"]["kind"], got["2330.TW"]["currency"]) == ("台積電", "stock", "TWD")
    assert got["SPY"]["kind_label"] == "ETF" and (got["NEW"]["name"], got["NEW"]["kind"], got["NEW"]["kind_label"]) == ("NEW", "unknown", "標的")
    assert got["QQQ"]["beta"] == 1.5 and got["QQQ"]["currency"] == "USD" and got["QQQ"]["sector"] is None
    assert profiles.instrument_profiles(rows.limit(0), catalog.built_in(spark)).count() == 0


def test_board_pages_are_ms950(spark, tmp_path):
    row = "<table><tr>" + "".join(f"<td>{c}</td>" for c in ("{}　台積電", "TW00", "1994/09/05", "", "半導體業", "ESVUFR")) + "</tr></table>"
    for name, code in (("a", "2330"), ("b", "6488")):
        (tmp_path / name).write_bytes(row.replace("{}", code).encode("cp950"))
    got = {(r["symbol"], r["name_zh"], r["industry"]) for r in directories.read_boards(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()}
    assert got == {("2330.TW", "台積電", "半導體業"), ("6488.TWO", "台積電", "半導體業")}


def test_first_source_that_answers(spark):
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert sorted(r["x"] for r in directories.first_answering(frame(), frame(2, 3), frame(4)).collect()) == [2, 3]
    assert directories.first_answering(frame(), frame()).count() == 0
    records = spark.createDataFrame([(date(2020, 1, 1),), (date(2024, 1, 1),), (date(2026, 1, 1),), (None,)], "date date")
    assert [r["date"].year for r in directories.since(records, F.lit(date(2025, 1, 1)), 2).collect()] == [2024]


def test_source_settings_for_a_run(spark, tmp_path):
    entries = [
        {"name": "s-{ticker}", "enabled": True, "list_url": "https://h/{query_encoded}/{ticker}", "ticker_keywords": ["{ticker}", "k"], "max_items": 50},
        {"enabled": True, "type": "HTML", "list_url": "https://h/{other}/{ticker}x"}, {"list_url": "https://h"}, {"name": "no page"},
    ]
    (tmp_path / "list.json").write_text(json.dumps(entries))
    (tmp_path / "object.json").write_text(json.dumps({"sources": entries}))
    found = news.read_sources(spark, str(tmp_path / "list.json"))
    assert found.count() == 3 and sorted(map(str, found.collect())) == sorted(map(str, news.read_sources(spark, str(tmp_path / "object.json")).collect()))
    assert {(r["name"], r["type"], r["enabled"], r["max_items"]) for r in found.collect()} == {("s-{ticker}", "rss", True, 50), ("unknown_source", "html", True, 100), ("unknown_source", "rss", False, 100)}
    run = news.runtime_sources(found, "AB", "a b/c", 60, ["k", " z "], mode="html", fallback=False, timeout=9)
    first, other = run.where("max_items = 50").first(), run.where("type = 'html'").first()
    assert (first["name"], first["list_url"], first["ticker_keywords"], first["enabled"]) == ("s-AB", "https://h/a%20b/c/AB", ["AB", "k", "z"], True)
    assert other["list_url"] == "https://h/{other}/{ticker}x" and other["ticker_keywords"] == ["k", "z"] and other["max_items"] == 60
    assert {(r["content_extract_mode"], r["content_extract_fallback"], r["content_extract_timeout_seconds"]) for r in run.collect()} == {("html", False, 9)}
    assert {r["enabled"] for r in news.runtime_sources(found).collect()} == {False}


def test_words_in_addresses(spark):
    assert spark.createDataFrame([("a b&~*/+",)], "q string").select(text.encoded(F.col("q")).alias("q")).first()["q"] == "a%20b%26~%2A/%2B"


def test_holdings_are_parsed_once(spark):
    column = profiles.top_holdings(F.concat(F.lit("once"), "h")).alias("x")
    plan = spark.createDataFrame([("[]",)], "h string").select(column)._jdf.queryExecution().analyzed().expressions().head().sql()
    assert plan.count("'once'") <= 3  # as a list, as an object, and to see which
