"""Date and time column functions; what can't be read is null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bucket sizes in seconds.
SPANS = {"day": 86_400, "hour": 3_600, "30min": 1_800, "15min": 900}


def utc(ts: Column) -> Column:
    """Time-zone-free timestamps as UTC instants."""
    return ts.cast("timestamp")


def bucket(ts: Column, frame: str, zone: str = "UTC") -> Column:
    """The start of the local day, hour, half or quarter hour, as local wall time."""
    local = F.from_utc_timestamp(ts, zone)
    if frame == "day":
        return F.date_trunc("day", local)
    if frame == "hour":
        return F.date_trunc("hour", local)
    step = SPANS[frame] // 60
    return F.date_trunc("hour", local) + F.make_dt_interval(mins=(F.floor(F.minute(local) / step) * step).cast("int"))


def bucket_end(start: Column, frame: str) -> Column:
    return start + F.make_dt_interval(secs=F.lit(SPANS[frame]))


def offset_label(local: Column, zone: str) -> Column:
    """Local wall time with the zone's offset, as in 2024-01-01T00:00:00+08:00."""
    minutes = ((F.unix_timestamp(local) - F.unix_timestamp(F.to_utc_timestamp(local, zone))) / 60).cast("int")
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.format_string("%02d:%02d", F.floor(F.abs(minutes) / 60), F.abs(minutes) % 60))


def iso(text: Column) -> Column:
    """An ISO timestamp, with Z or an offset or in UTC."""
    return F.try_to_timestamp(F.regexp_replace(text, r"Z$", "+00:00"))


def rfc822(text: Column) -> Column:
    """A feed's date: weekday dropped, GMT read as +0000."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|UT)$", "+0000")
    return F.try_to_timestamp(plain, F.lit("d MMM yyyy HH:mm:ss Z"))


# English names and filler words of dates.
_MONTHS = r"\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])"
_WEEKDAYS = r"\b(?:mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|rsday|r)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)(?![a-z])"
_FILLERS = r"(?<=\d)(?:st|nd|rd|th)\b|\b(?:at|on|and|ad|of|t)\b"
#: A time of day with what may follow it: half of the day, a zone that means UTC, an offset and its name in brackets.
_TIME = r"(?<![\d:])(?:(?<=\d)t|\bt)?(\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?(?:\s*([ap])m?\b)?|\s*([ap])m?\b)(?:\s*(?:z|utc|gmt)\b)?(?:\s*([+-])(\d{1,2})(?::?(\d{2}))?(?!\d)(?:\s*\([a-z]{3,5}\))?)?"
#: A time's groups in one pass; the cleaned text has no white space but blanks, so lines and tabs are free as marks.
_TIME_FIELDS = "\n" + "\t".join(f"${i}" for i in range(1, 10)) + "\n"
_SHORT = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Other zones' abbreviations after a time say nothing about the offset and are passed over.
_ZONE = r"(:\d{2}(?:\.\d+)?\s+)(?!JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|MON|TUE|WED|THU|FRI|SAT|SUN|UTC|GMT)[A-Z]{3,5}\b"


def _date_text(text: Column) -> Column:
    """Lower case, single blanks, solid digits split, an offset next to its time."""
    t = F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), _ZONE, "$1"))
    t = F.regexp_replace(t, r"(?<!\d)(\d{4})(\d{2})(\d{2})t?(\d{2})(\d{2})(\d{2})?(?!\d)", "$1-$2-$3 $4:$5:$6")
    t = F.regexp_replace(t, r"(\d{2}:\d{2}):(?!\d)", "$1")
    t = F.regexp_replace(t, r"(?<![\d.])(\d{4})(\d{2})(\d{2})(?![\d:])", "$1-$2-$3 ")
    t = F.regexp_replace(t, r"(?<![\d.:+-])(\d{2})(\d{2})(\d{2})(?![\d:.])", "$1-$2-$3 ")
    t = F.regexp_replace(t, r"(\d)t(?=\d)", "$1 ")
    return F.regexp_replace(t, r"(:\d{2}(?:\.\d+)?)(\s.*?)\s*([+-]\d{2}:?\d{2})$", "$1$3$2")  # an offset after the date


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; written out, the expression would grow with each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _date_parts(tokens: Column, name: Column, cy: Column) -> Column:
    """Year, month and day among number and month tokens, by their order, size and number of digits."""
    numbers = F.filter(tokens, lambda x: x != "#")
    facts = F.struct(*(F.get(numbers, F.lit(i)).alias(f"t{i}") for i in range(3)), F.array_position(tokens, "#").alias("at"), F.size(tokens).alias("k"), F.size(numbers).alias("of"))

    def decide(x: Column) -> Column:
        n = [x[f"t{i}"].try_cast("int") for i in range(3)]
        wide = [F.coalesce(F.length(x[f"t{i}"]) > 2, F.lit(False)) for i in range(2)]
        big = [w | F.coalesce(v > 31, F.lit(False)) for w, v in zip(wide, n)]
        first = F.when(wide[0], True).when(wide[1], False).when(x["at"] < 3, big[0]).otherwise(~big[1])  # with a name and two numbers: the year comes first
        ymd, dmy, three, two = big[0], n[0] > 12, (x["at"] == 0) & (x["k"] == 3), (x["at"] == 0) & (x["k"] == 2)
        pick = lambda i: x[f"t{i}"]
        year = F.when(three, F.when(ymd, pick(0)).otherwise(pick(2))).when(two, F.when(big[0], pick(0)).when(big[1], pick(1))).when(x["of"] == 2, F.when(first, pick(0)).otherwise(pick(1))).when((x["of"] == 1) & big[0], pick(0))
        month = F.when(three, F.when(ymd | dmy, n[1]).otherwise(n[0])).when(two, F.when(big[0], n[1]).otherwise(n[0])).otherwise(name)
        day = F.when(three, F.when(ymd, n[2]).when(dmy, n[0]).otherwise(n[1])).when(two, F.when(~big[0] & ~big[1], n[1])).when(x["of"] == 2, F.when(first, n[1]).otherwise(n[0])).when((x["of"] == 1) & ~big[0], n[0])
        ok = (x["k"] <= 3) & (x["k"] - x["of"] <= 1)
        return F.struct(F.when(ok, year).alias("digits"), F.when(ok, month).cast("int").alias("month"), F.when(ok, day).alias("day"), x["k"].alias("k"))

    def dated(x: Column) -> Column:
        short = x["digits"].try_cast("int") + F.floor(cy / 100) * 100
        near = F.when(short >= cy + 50, short - 100).when(short < cy - 50, short + 100).otherwise(short)
        year = F.when(F.length(x["digits"]) > 2, x["digits"].try_cast("int")).otherwise(near)
        return F.struct(year.cast("int").alias("year"), x["month"].alias("month"), x["day"].alias("day"), x["k"].alias("k"))

    return _let(_let(facts, decide), dated)


def any_date(text: Column, today: Column | None = None) -> Column:
    """The instant that a date in free form names: numbers in any usual order, English month names, times, offsets.

    Three numbers are month, day, year; a first number above 12 is the day, one above 31 or of more than two digits the
    year. Two-digit years lie within 50 years of ``today`` (the current date), which also gives missing parts; a missing
    day beyond the month's end is its last one. Without an offset it is UTC. Names of weekdays are passed over. Null,
    empty and other texts, and dates that don't exist, give null.
    """
    today = F.current_date() if today is None else today

    def timed(t: Column) -> Column:
        return F.split(F.regexp_replace(t, _TIME, _TIME_FIELDS), "\n")  # texts before, between and after times, and the times' fields

    def parted(x: Column) -> Column:
        rest = F.array_join(F.filter(x, lambda _, i: i % 2 == 0), " ")
        rest = F.regexp_replace(F.regexp_replace(rest, _WEEKDAYS, " "), _FILLERS, " ")
        return F.struct(F.split(F.get(x, F.lit(1)), "\t").alias("f"), rest.alias("rest"), F.regexp_replace(rest, _MONTHS, "#").alias("marked"))

    def tokens(p: Column) -> Column:
        named, marked = F.substring(F.regexp_extract(p["rest"], _MONTHS, 1), 1, 3), p["marked"]
        name = F.try_element_at(F.create_map(*(F.lit(x) for i, m in enumerate(_SHORT) for x in (m, i + 1))), named)
        known = F.regexp_replace(marked, r"[#\d\s.,;/'\-]", "") == ""
        ymd = _date_parts(F.regexp_extract_all(marked, F.lit(r"(\d+|#)"), F.lit(1)), name, F.year(today))
        part = {f"p{i}": F.nullif(F.get(p["f"], F.lit(i - 1)), F.lit("")) for i in range(1, 10)}
        return F.when(known, _let(F.struct(*(c.alias(k) for k, c in part.items()), ymd.alias("d")), instant))

    def instant(p: Column) -> Column:
        number = lambda i: F.coalesce(p[f"p{i}"], F.lit("0")).cast("int")
        half, hour, date = F.coalesce(p["p5"], p["p6"]), number(1), p["d"]
        hour = F.when(half.isNull(), hour).when(hour <= 12, hour % 12 + F.when(half == "p", 12).otherwise(0)).when(p["p6"].isNotNull(), hour).otherwise(99)
        given = F.coalesce(date["year"], date["month"], date["day"]).isNotNull()
        y, m = F.coalesce(date["year"], F.year(today)), F.coalesce(date["month"], F.month(today))
        ends = F.dayofmonth(F.last_day(F.when(m.between(1, 12) & y.between(1, 9999), F.make_date(y, m, F.lit(1)))))
        d = F.coalesce(date["day"], F.least(F.dayofmonth(today), ends))
        seconds = F.concat(F.coalesce(p["p3"], F.lit("0")), F.lit("."), F.coalesce(p["p4"], F.lit("0"))).cast("decimal(16,6)")
        real = y.between(1, 9999) & (hour < 24) & (number(2) < 60) & (seconds < 60) & (given | ((date["k"] == 0) & p["p1"].isNotNull()))
        shift = (number(8) * 60 + number(9)).cast("long") * F.when(p["p7"] == "-", -60_000_000).otherwise(60_000_000)
        at = F.try_make_timestamp(y, m, d, hour, number(2), seconds, F.lit("UTC"))
        return F.when(real, F.timestamp_micros(F.unix_micros(at) - shift))

    return _let(_let(_let(_date_text(text), timed), parted), tokens)


def minguo_date(text: Column) -> Column:
    """Dates with years of either calendar: y/m/d, y-m-d, yyyymmdd, yyymmdd; years below 1911 count from 1911."""
    t = F.trim(text)
    split = r"^(\d{2,4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
    solid = r"^(\d{3,4})(\d{2})(\d{2})$"
    part = lambda i: F.when(t.rlike(split), F.regexp_extract(t, split, i)).when(t.rlike(solid), F.regexp_extract(t, solid, i)).try_cast("int")
    year = F.when(part(1) < 1911, part(1) + 1911).otherwise(part(1))
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, part(2), part(3)), "yyyy-MM-dd")


def epoch_or_date(text: Column) -> Column:
    """yyyy-MM-dd from Unix seconds or the start of a date; 0, '' and null give null."""
    t = F.trim(text.cast("string"))
    seconds = t.try_cast("double")
    return F.when(t.isin("", "0") | (seconds == 0), None).when(seconds.isNotNull(), F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")).otherwise(F.date_format(F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"), "yyyy-MM-dd"))


def next_business_days(day: Column, count: int) -> Column:
    """The next ``count`` days that aren't Saturday or Sunday."""
    ahead = F.sequence(F.date_add(day, 1), F.date_add(day, 2 * count + 4))
    return F.slice(F.filter(ahead, lambda d: ~F.dayofweek(d).isin(1, 7)), 1, count)
