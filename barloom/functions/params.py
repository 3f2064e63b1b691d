"""Checks of request parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What requests may ask for.
PERIODS = ["1d", "5d", "1mo", "3mo", "6mo", "1y", "2y", "5y", "10y", "ytd", "max"]
INTERVALS = ["1m", "2m", "5m", "15m", "30m", "60m", "90m", "1h", "1d", "5d", "1wk", "1mo", "3mo"]
HORIZONS = [5, 7, 14, 30]
OFF = ["0", "false", "no", "off"]


def period_known(period: Column) -> Column:
    return F.coalesce(period.isin(PERIODS), F.lit(False))


def interval_known(interval: Column) -> Column:
    return F.coalesce(interval.isin(INTERVALS), F.lit(False))


def horizon(text: Column) -> Column:
    """The horizon asked for, 7 if it isn't one that is offered."""
    n = F.trim(text).try_cast("int")
    return F.when(n.isin(HORIZONS), n).otherwise(7)


def flag(text: Column) -> Column:
    """True unless the text says 0, false, no or off."""
    return ~F.lower(F.trim(F.coalesce(text, F.lit("1")))).isin(OFF)
