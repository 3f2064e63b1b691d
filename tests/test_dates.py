"""Dates in free form against a parser of one text at a time."""

import warnings
from datetime import date, datetime, timedelta, timezone

import numpy as np
from dateutil import parser
from pyspark.sql import functions as F

from barloom.functions import dates

#: Ways to write a time, with the parts that they lose.
WAYS = ["%Y-%m-%d", "%Y/%m/%d %H:%M", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S+08:00", "%Y%m%d", "%Y%m%dT%H%M%S", "%Y%m%d%H%M", "%a, %d %b %Y %H:%M:%S GMT", "%a, %d %b %Y %H:%M:%S -0530", "%d %B %Y", "%B %d, %Y", "%b %d, %Y %I:%M %p", "%b. %d, %Y at %I:%M%p", "%A, %B %d, %Y", "%m/%d/%Y", "%m/%d/%y", "%d-%b-%y", "%d-%b-%Y %H:%M", "%Y.%m.%d", "%a %b %d %H:%M:%S %Y", "%a %b %d %H:%M:%S EST %Y", "%b %Y", "%Y %b %d", "%y-%b-%d", "%I %p %d %B %Y", "%H:%M %d.%m.%Y", "%Y-%m", "%m-%d", "%b %d", "%H:%M:%S %m/%d/%Y +03:00", "%dth of %B %Y"]
ODD = [None, "", "  ", "soon", "3 days ago", "2024-13-01", "2024-02-30", "31/12/2023", "13/13/2023", "12/11/10", "32/1/5", "25:00 2024-01-01", "10:61 2024-01-01", "13 pm 2024-01-01", "12 am Jan 5 2024", "12:30 PM Jan 5 2024", "Feb 2023", "31", "1999", "May", "Jan 5 6 2024 7", "Jan Feb 2024", "Sept 3rd, 2021", "2024-02-29T23:59:59.999999-11:30", "04-Jul-76", "04-Jul-75", "99-01-02", "240102", "3:05p 1/2/2024", "2024-01-02 03:04:05 UTC", "2024-01-02 03:04 (CST)"]
TODAY = date(2026, 8, 31)


def plainly(text):
    if not text:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            at = parser.parse(text, default=datetime(TODAY.year, TODAY.month, TODAY.day))
        return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).replace(tzinfo=None)
    except (ValueError, OverflowError, TypeError):
        return None


def parsed(spark, texts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").withColumn("at", dates.any_date(F.col("x"), F.lit(TODAY)))
    return [r["at"] for r in df.select("i", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).orderBy("i").collect()]


def shown(at):
    return at and f"{at:%Y-%m-%d %H:%M:%S.%f}".rjust(26, "0")


def test_ways_of_writing(spark):
    rng, texts = np.random.default_rng(4), []
    for way in WAYS:
        texts += [(datetime(1977, 1, 1) + timedelta(microseconds=int(us))).strftime(way) for us in rng.integers(0, 98 * 365 * 86_400_000_000, 60)]
    wrong = [(x, a, b) for x, a, b in zip(texts, parsed(spark, texts), map(shown, map(plainly, texts))) if a != b]
    assert not wrong, (len(wrong), wrong[::20])


def test_odd_texts(spark):
    wrong = [(x, a, shown(plainly(x))) for x, a in zip(ODD, parsed(spark, ODD)) if a != shown(plainly(x))]
    assert not wrong, wrong


def test_times_are_searched_once_a_text(spark):
    column = dates.any_date(F.col("id").cast("string"), F.lit(TODAY)).alias("at")
    plan = spark.range(1).select(column)._jdf.queryExecution().analyzed().expressions().head().sql()
    assert plan.count("[ap])m?") == 2  # the pattern once, where it has two such groups
