"""The bundle of an instrument against its separate parts, and its odd rows."""

from datetime import date

from pyspark.sql import functions as F

from barloom.operators import actions, bundle


def tables(spark):
    d = [("1.TW", date(2020 + i // 4, 1 + 3 * (i % 4), 5), 0.5 + i / 8) for i in range(14)] + [("1.TW", date(2016, 1, 1), 9.0), ("1.TW", None, 1.0), ("1.TW", date(2021, 1, 1), -1.0), ("1.TW", date(2021, 1, 2), None), (None, date(2021, 1, 2), 1.0), ("X", date(2023, 1, 1), 1.0)]
    s = [("1.TW", date(2021, 5, 1), 1.05), ("1.TW", date(2021, 6, 1), 1.1), ("1.TW", date(2021, 6, 1), 1.2), ("1.TW", date(2022, 1, 1), 2.0), ("X", date(2022, 1, 1), 1.05), ("X", date(2022, 2, 1), 0.25), ("X", date(2022, 3, 1), None), ("X", date(2022, 3, 1), 0.0)]
    e = [("1.TW", date(2021, 6, 1), "both", "權息", 100.0, 90.0), ("1.TW", date(2021, 6, 1), "rights", "權", 100.0, 80.0), ("1.TW", date(2023, 6, 1), "rights", "權", 0.0, 1.0), ("1.TW", date(2023, 7, 1), "dividend", "息", 1.0, 1.0), ("X", date(2023, 7, 1), "rights", "權", 2.0, 1.0)]
    i = [("1.TW", 50.0, True, True), ("X", None, False, True), ("gone", 1.0, False, False), ("bare.TW", 1.0, True, False)]
    return (
        spark.createDataFrame(d, "symbol string, ex_date date, amount double"), spark.createDataFrame(s, "symbol string, date date, ratio double"),
        spark.createDataFrame(e, "symbol string, date date, kind string, kind_label string, before_price double, reference_price double"), spark.createDataFrame(i, "symbol string, close double, answered boolean, loading boolean"),
    )


def test_bundle(spark):
    d, s, e, i = tables(spark)
    day = F.to_date(F.lit("2024-03-01"))
    got = {r["symbol"]: r for r in bundle.corporate_actions(d, s, e, i, day).collect()}
    assert {k: (r["status"], r["rights_pending"]) for k, r in got.items()} == {"1.TW": ("ok", True), "X": ("ok", False), "gone": ("unavailable", False), "bare.TW": ("empty", False)}
    tw = got["1.TW"]
    alone = {r["symbol"]: r for r in actions.dividend_summary(d.where("ex_date is not null"), day).collect()}["1.TW"]
    block = tw["dividends"]
    assert (block["ttm_total"], block["average_3y"], block["frequency"], block["consecutive_years"], block["years_paid"]) == (alone["ttm"], alone["avg3"], alone["frequency"], alone["streak"], alone["years_paid"])
    assert block["total_records"] == 15 and block["first_date"] == date(2016, 1, 1) and block["records"][0]["date"] == date(2023, 4, 5) and len(block["yearly"]) == 5
    assert block["ttm_yield_pct"] == round(block["ttm_total"] / 50 * 100, 2)
    assert [(r["date"], r["text"]) for r in tw["splits"]["records"]] == [(date(2022, 1, 1), "1:2")]
    rights = [(r["date"].month, r["source"], r["kind_label"], r["drop_pct"], r["shares_per_1000"]) for r in tw["rights"]["records"]]
    assert rights == [(6, "exchange", "權", None, None), (6, "exchange+splits", "權", 20.0, 100.0), (5, "splits", "stock dividend", None, 50.0)]
    assert (tw["rights"]["count"], tw["rights"]["total_shares_per_1000"], tw["rights"]["sources"], tw["rights"]["has_exchange"]) == (3, 150.0, ["exchange", "exchange+splits", "splits"], True)
    x = got["X"]
    assert x["rights"] is None and x["dividends"]["ttm_yield_pct"] is None and [r["kind"] for r in x["splits"]["records"]] == ["reverse_split", "split"] and x["splits"]["count"] == 2
    assert bundle.corporate_actions(d.where("false"), s.where("false"), e.where("false"), i.where("false"), day).count() == 0
