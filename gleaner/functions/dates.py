"""Dates of listings. ``asof`` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy-MM-dd-HH:mm"


def stamp(ts: Column) -> Column:
    """A date to the minute, as in feeds."""
    return F.date_format(ts, STAMP)


def parse_stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(STAMP))


def display_date(dates: Column) -> Column:
    """The first of some dates, marked if there are more."""
    first = F.date_format(F.get(dates, 0), "E dd MMM")
    return F.when(F.size(dates) > 1, F.concat(first, F.lit(" + more"))).otherwise(first)


def bump_year(ts: Column, asof: Column) -> Column:
    """Years before that of ``asof`` become that year; 29 February becomes null in other years."""
    moved = F.try_to_timestamp(F.concat(F.year(asof).cast("string"), F.date_format(ts, "-MM-dd HH:mm:ss")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.year(ts) < F.year(asof), moved).otherwise(ts)


def date_range(start: Column, end: Column, asof: Column) -> Column:
    """Every day from start to end, both at start's hour; a start in the past moves to ``asof`` at that hour."""
    at_hour = lambda t: F.date_trunc("DAY", t) + F.make_dt_interval(F.lit(0), F.hour(start), F.minute(t), F.second(t))
    begin = F.when(start < asof, at_hour(asof)).otherwise(start)
    last = at_hour(end)
    return F.when(begin <= last, F.sequence(begin, last, F.expr("INTERVAL 1 DAY"))).otherwise(F.array().cast("array<timestamp>"))


def future_dates(dates: Column, asof: Column) -> Column:
    """Dates from ``asof`` on, in order."""
    return F.sort_array(F.filter(dates, lambda d: d >= asof))


def parse_any(text: Column, formats: list[str], year: Column) -> Column:
    """The first format that fits; formats without a year get ``year``. Null if none fits."""
    tries = [F.try_to_timestamp(text if "y" in f else F.concat(text, F.lit(" "), year.cast("string")), F.lit(f if "y" in f else f"{f} yyyy")) for f in formats]
    return F.coalesce(*tries)


def unknown_time(ts: Column) -> Column:
    """01:01 stands for a time that isn't known."""
    return (F.hour(ts) == 1) & (F.minute(ts) == 1)


def next_weekday(asof: Column, weekday: str) -> Column:
    """The next date of a weekday, today included."""
    return F.next_day(F.date_sub(asof, 1), weekday)


def relative_dates(text: Column, asof: Column) -> Column:
    """Dates that a text such as "Tomorrow at 7:30" means; the time is taken without AM or PM.

    Tomorrow, then today, then all day-and-month pairs, then the name of a weekday.
    """
    time = F.regexp_extract(text, r"(\d{1,2}:\d{2})", 1)
    clock = F.coalesce(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), F.when(time != "", time).otherwise("1:01")), F.lit("yyyy-MM-dd H:mm")), F.lit("1970-01-01 01:01:00").cast("timestamp"))
    at = lambda day: F.date_trunc("DAY", day.cast("timestamp")) + F.make_dt_interval(F.lit(0), F.hour(clock), F.minute(clock), F.lit(0))
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2}\s[A-Za-z]+)"), 1), lambda x: parse_any(x, ["d MMM", "d MMMM"], F.year(asof)))
    found = F.filter(found, lambda d: d.isNotNull())
    day = F.lit(None).cast("date")
    for name in ("Sunday", "Saturday", "Friday", "Thursday", "Wednesday", "Tuesday", "Monday"):
        day = F.when(F.contains(text, F.lit(name)), next_weekday(asof, name[:3])).otherwise(day)
    return (
        F.when(F.contains(text, F.lit("Tomorrow")), F.array(at(F.date_add(asof, 1))))
        .when(F.contains(text, F.lit("Today")), F.array(at(F.to_date(asof))))
        .when(F.size(found) > 0, F.transform(found, at))
        .otherwise(F.array_compact(F.array(at(day))))
    )


def clock_24(text: Column) -> Column:
    """``7:05pm`` as 19:05; null without such a time."""
    h, m, half = (F.regexp_extract(F.lower(text), r"(\d{1,2}):(\d{2})\s*(am|pm)", k) for k in (1, 2, 3))
    hour = F.pmod(h.try_cast("int"), F.lit(12)) + F.when(half == "pm", 12).otherwise(0)
    return F.when(h != "", F.format_string("%02d:%s", hour, m))


def local_time(utc: Column, zone: str) -> Column:
    return F.from_utc_timestamp(utc, zone)


def zone_tag_shift(ts: Column, text: Column, tag: str, hours: int = 10) -> Column:
    """Hours added where the text carries a zone tag."""
    return F.when(F.contains(F.lower(text), F.lit(tag)), ts + F.make_dt_interval(F.lit(0), F.lit(hours))).otherwise(ts)


def span_dates(text: Column, dash: str = " – ") -> Column:
    """(start, end) of "d – d Month Year", "d Month – d Month Year", "d Month Year – d Month Year" or a single date; nulls if unreadable."""
    parts = F.split(text, dash)
    last = F.element_at(parts, -1)
    tail = F.regexp_extract(last, r"^\d{1,2}\s+(.*)$", 1)
    year = F.regexp_extract(last, r"(\d{4})$", 1)
    first = F.when(F.size(parts) == 1, last).when(F.get(parts, 0).rlike(r"\d{4}$"), F.get(parts, 0)).when(F.length(F.get(parts, 0)) > 2, F.concat(F.get(parts, 0), F.lit(" "), year)).otherwise(F.concat(F.get(parts, 0), F.lit(" "), tail))
    read = lambda c: F.coalesce(F.try_to_timestamp(c, F.lit("d MMMM yyyy")), F.try_to_timestamp(c, F.lit("d MMM yyyy")))
    return F.struct(read(first).alias("start"), read(last).alias("end"))


def start_and_end(start: Column, end: Column, apart_seconds: int = 18000) -> Column:
    """Both dates if they fall on different days of a month and lie far apart, else the start."""
    far = (F.dayofmonth(start) != F.dayofmonth(end)) & (F.abs(F.unix_timestamp(end) - F.unix_timestamp(start)) > apart_seconds)
    return F.when(far, F.array(start, end)).otherwise(F.array(start))


def search_until(asof: Column, days: int) -> Column:
    return F.date_add(asof, days)


def in_season(tags: Column, year: Column, word: str = "events") -> Column:
    """Whether a tag such as events2025 names ``year`` or later; other tags don't count."""
    return F.exists(tags, lambda t: F.coalesce(F.replace(t, F.lit(word), F.lit("")).try_cast("int") >= year, F.lit(False)))


def same_slot(days: Column, slot: Column) -> Column:
    """Every day at one time of day, given as ``7:05pm``; at 01:01 without one."""
    clock = F.coalesce(clock_24(slot), F.lit("01:01"))
    return F.transform(days, lambda d: F.to_timestamp(F.concat(F.date_format(d, "yyyy-MM-dd "), clock), "yyyy-MM-dd HH:mm"))


def day_and_time(text: Column, year: Column) -> Column:
    """The date of a text that has both a day with its month and a time; null if either is missing."""
    day, clock = F.regexp_extract(text, r"(\d{1,2}\s+[A-Z][a-z]{2,})", 1), clock_24(text)
    read = parse_any(F.when(day != "", F.regexp_replace(day, r"\s+", " ")), ["d MMM", "d MMMM"], year)
    return F.to_timestamp(F.concat(F.date_format(read, "yyyy-MM-dd "), clock), "yyyy-MM-dd HH:mm")


def by_shape(text: Column, year: Column, asof: Column) -> Column:
    """Dates of "2 Mar – 4 Apr", "2 – 4 Mar" or "2 Mar", told apart by how many words there are."""
    words = F.split(F.trim(text), r"\s+")
    day = lambda a, b: parse_any(F.concat(F.get(words, a), F.lit(" "), F.get(words, b)), ["d MMM", "d MMMM"], year)
    span = lambda a, b: date_range(a, b, asof)
    return F.when(F.size(words) == 5, span(day(0, 1), day(3, 4))).when(F.size(words) == 4, span(day(0, 3), day(2, 3))).otherwise(F.array_compact(F.array(day(0, 1))))
