"""Comparisons asked for as text: failed tickers, ties, blanks."""

from datetime import datetime, timedelta

from barloom import schemas
from barloom.plans import insight


def bars_of(spark, **closes):
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=i), c, c, c, c, 1) for s, path in closes.items() for i, c in enumerate(path)]
    return spark.createDataFrame(rows, schemas.BARS)


def test_compare_requests(spark):
    up, down = [100.0 + i for i in range(40)], [100.0 - i for i in range(40)]
    bars = bars_of(spark, UP=up, TWIN=up, DOWN=down)
    asked = spark.createDataFrame([(1, "DOWN,TWIN,UP", 0), (2, " X ,DOWN", 0), (3, "X,Y", 0), (4, None, 0), (5, " , ", 0), (6, "A,B,C,D,UP", 0), (7, "UP,UP", 0)], "request int, tickers string, close int")
    got = {r["request"]: r for r in insight.compare_requests(asked, bars).collect()}
    assert [got[i]["status"] for i in range(1, 8)] == ["success", "success", "error", "error", "error", "error", "success"]
    assert got[1]["best"] == "TWIN" and [s["ticker"] for s in got[1]["series"]] == ["DOWN", "TWIN", "UP"] and got[1]["series"][1]["latest_price"] == 139.0
    assert got[2]["failed"] == ["X"] and got[2]["count"] == 1 and got[3]["failed"] == ["X", "Y"] and got[3]["best"] is None
    assert got[4]["failed"] == [] and got[5]["count"] == 0 and got[6]["failed"] == ["A", "B", "C", "D"] and got[7]["count"] == 2
    assert insight.compare_requests(asked.where("false"), bars).count() == 0
    assert {r["status"] for r in insight.compare_requests(asked, bars.where("false")).collect()} == {"error"}
