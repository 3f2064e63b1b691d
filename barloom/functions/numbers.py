"""Numeric column functions. Nothing here raises under ANSI mode; bad input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe(x: Column) -> Column:
    """The number, or null for NaN and infinities."""
    x = x.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, or null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    """x between low and high; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def rounded(x: Column, digits: int) -> Column:
    """As SQL engines round doubles: the product with the power of ten, halves away from zero. ``F.round`` goes by the digits
    that a double is printed with, so 1.005, which is a little less, gives 1.01 there and 1.0 here."""
    return F.round(x * 10.0**digits) / 10.0**digits


def parsed(text: Column) -> Column:
    """A number from text with thousands separators; dashes, X and blanks give null."""
    t = F.trim(F.replace(text, F.lit(","), F.lit("")))
    return F.when(~t.isin("", "-", "--", "X"), safe(t))


def hash_ratio(salt: str, key: Column) -> Column:
    """A stable number in [0, 1] from the first eight hex digits of md5(salt:key)."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def ratio_text(x: Column) -> Column:
    """Whole numbers without decimals, others with two."""
    return F.when(F.abs(x - F.round(x)) < 1e-6, F.format_string("%.0f", F.round(x))).otherwise(F.format_string("%.2f", x))


def signed_percent(x: Column) -> Column:
    """Two decimals, halves to even; what rounds to nothing keeps its sign."""
    near = F.bround(x, 2)
    return F.when(x.isNull(), "--").when((x < 0) & (near == 0), "-0.00%").otherwise(F.format_string("%+.2f%%", near))


def score_from_probabilities(positive: Column, negative: Column) -> Column:
    """(p+ - p-) * 100 within +-100, two decimals, halves to even."""
    return F.bround(clamp((positive - negative) * 100, -100.0, 100.0), 2)
