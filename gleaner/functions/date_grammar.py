"""Dates in free text: a tokenizer, a classifier of its tokens, and rules that join them to dates.

A text is cut into the marks that matter for dates (days with months, ISO dates, clock times, years,
range marks, zone tags), each becomes a row of fields, and every date takes what it lacks from its
neighbours: its clock from the first one that follows, its month and year from the date that ends
its range. All of it is column functions, so a text of any shape is read in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.dates import bump_year, date_range

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_MONTH = r"(?<![a-z])(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?![a-z])\.?"
_NTH = r"\d{1,2}(?:st|nd|rd|th)?"
_YEAR = r"(?:19|20)\d{2}(?![\d:])"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:\s*[ap]\.?m\b)?|\d{1,2}(?:\.\d{2})?\s*[ap]\.?m\b"
_MARK = r"[-–—]|\b(?:to|until)\b"
#: Kinds of tokens, in the order in which they are tried at a place of the text.
_KINDS = {
    "iso": r"\d{4}-\d{1,2}-\d{1,2}",
    "clock": _CLOCK,
    "day_month": rf"(?<!\d){_NTH}\s*(?:of\s+)?{_MONTH}(?:,?\s*{_YEAR})?",
    "month_day": rf"{_MONTH}\s*(?:{_YEAR},?\s*)?{_NTH}(?![\d:]|\s*[ap]\.?m\b)(?:,?\s+{_YEAR})?",
    "year": rf"(?<!\d){_YEAR}",
    "day": rf"(?<![\d.,$/:]){_NTH}(?=\s*(?:{_MARK})\s*{_NTH}\s*{_MONTH})|(?<=[-–—]\s{{0,2}}){_NTH}(?![\d:/.]|\s*[ap]\.?m\b)",
    "zone": r"(?<![a-z])[a-z]{3,4}(?=\s*\))",
    "mark": _MARK,
}
_ANY = "(" + "|".join(_KINDS.values()) + ")"


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _number(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("int")


def _token(t: Column) -> Column:
    """The fields of one token: kind, year, month, day, minute of the day, zone tag."""
    kind = F.lit("mark")
    for name, pattern in reversed(_KINDS.items()):
        if name != "mark":
            whole = pattern.replace(rf"(?=\s*(?:{_MARK})\s*{_NTH}\s*{_MONTH})", "").replace(r"(?<=[-–—]\s{0,2})", "").replace(r"(?=\s*\))", "")
            kind = F.when(t.rlike(f"^(?:{whole})$"), F.lit(name)).otherwise(kind)

    def fields(k: Column) -> Column:
        iso, clock, dated = k == "iso", k == "clock", k.isin("day_month", "month_day")
        year = F.when(iso, _number(t, r"^(\d{4})")).when(dated | (k == "year"), _number(t, r"(\d{4})"))
        name = F.regexp_extract(t, rf"({_MONTH})", 1)
        month = F.when(iso, _number(t, r"^\d{4}-(\d+)")).when(dated, ((F.position(F.substring(name, 1, 3), F.lit(_MONTHS)) + 2) / 3).cast("int"))
        day = F.when(iso, _number(t, r"-(\d+)$")).when(dated | (k == "day"), _number(F.regexp_replace(t, r"\d{4}", ""), r"(\d{1,2})"))
        hour, minute = _number(t, r"^(\d{1,2})"), F.coalesce(_number(t, r"^\d{1,2}[:.](\d{2})"), F.lit(0))
        half = F.regexp_extract(t, r"([ap])\.?m", 1)
        hours = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        return F.struct(
            k.alias("kind"), year.alias("y"), month.alias("m"), day.alias("d"), F.when(clock, hours * 60 + minute).alias("minute"), F.when(clock, hour * 60 + minute).alias("bare"), F.when(k == "zone", t).alias("zone"),
        )

    return bound(kind, fields)


def date_tokens(text: Column) -> Column:
    """The tokens of a text in order, as structs (place, kind, y, m, d, minute, bare, zone)."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_ANY), 1), _token)
    placed = F.transform(found, lambda t, i: F.struct(i.alias("place"), *[t[c].alias(c) for c in ("kind", "y", "m", "d", "minute", "bare", "zone")]))
    # a bare day counts only beside a date that has a month, across a range mark
    dated = lambda t: t["m"].isNotNull()
    return bound(placed, lambda p: F.filter(p, lambda t: (t["kind"] != "day") | F.exists(_near(p, t), dated)))


def _near(tokens: Column, t: Column) -> Column:
    """The tokens two places before and after ``t`` whose way to it is a range mark."""
    mark = lambda k: F.get(tokens, (t["place"] + k).cast("int"))["kind"] == "mark"
    at = lambda k: F.get(tokens, (t["place"] + k).cast("int"))
    return F.array_compact(F.array(F.when(mark(-1) & (t["place"] > 1), at(-2)), F.when(mark(1), at(2))))


def read_dates(text: Column, year: Column, halves: bool = True) -> Column:
    """All dates of a text in order: structs (at timestamp, clock, linked, zone).

    ``at`` is at 01:01 if no clock belongs to the date; ``clock`` says whether one does. A date
    takes the first clock between it and the next date, else the next one at all, else the one
    before it. Without a year it takes that of the date it is linked with, the one before where
    the months say so, else a year that stands alone, else ``year``. ``linked``: a range mark
    leads to the next date. ``zone``: the tag in parentheses before the next date. ``halves``
    False ignores am and pm. What is no date of the calendar is left out.
    """
    tokens = date_tokens(text)

    def joined(ts: Column) -> Column:
        dated = F.filter(ts, lambda t: t["d"].isNotNull())
        clocks = F.filter(ts, lambda t: t["minute"].isNotNull())
        alone = F.get(F.filter(ts, lambda t: t["kind"] == "year"), 0)["y"]

        def one(x: Column, i: Column) -> Column:
            before, after = F.get(dated, i - 1), F.get(dated, i + 1)
            end = F.coalesce(after["place"], F.lit(1 << 30))
            own = F.get(F.filter(clocks, lambda c: (c["place"] > x["place"]) & (c["place"] < end)), 0)
            later = F.get(F.filter(clocks, lambda c: c["place"] > x["place"]), 0)
            clock = F.coalesce(own, later, F.element_at(F.when(F.size(clocks) > 0, clocks), -1))
            between = F.filter(ts, lambda t: (t["place"] > x["place"]) & (t["place"] < end))
            month = F.coalesce(x["m"], after["m"], F.when(i > 0, before["m"]))
            ahead = F.get(F.filter(dated, lambda t: (t["place"] > x["place"]) & t["y"].isNotNull()), 0)
            y = F.coalesce(x["y"], ahead["y"] - F.when(month > ahead["m"], 1).otherwise(0), F.when(i > 0, before["y"]), alone, year)
            minute = F.coalesce(clock["minute" if halves else "bare"], F.lit(61))
            at = F.try_make_timestamp(y, month, x["d"], F.floor(minute / 60).cast("int"), (minute % 60).cast("int"), F.lit(0).cast("decimal(8,6)"))
            return F.struct(
                at.alias("at"), clock.isNotNull().alias("clock"), (after.isNotNull() & F.exists(between, lambda t: t["kind"] == "mark")).alias("linked"),
                F.get(F.filter(between, lambda t: t["zone"].isNotNull()), 0)["zone"].alias("zone"),
            )

        return F.filter(F.transform(dated, one), lambda d: d["at"].isNotNull())

    return bound(tokens, joined)


def free_dates(text: Column, asof: Column, daily: bool = False, tag: str | None = None, hours: int = 10, halves: bool = True, bump: bool = False, clocked: bool = False) -> Column:
    """The dates of a text as timestamps, in its order.

    ``daily``: dates linked by a range mark are a range of days at the first one's hour. ``tag``:
    dates marked with this zone move by ``hours``. ``bump``: years before that of ``asof`` become it.
    ``clocked``: only dates with a time of their own or shared.
    """
    moved = lambda d: d["at"] if tag is None else F.when(d["zone"] == tag, d["at"] + F.make_dt_interval(F.lit(0), F.lit(hours))).otherwise(d["at"])
    placed = lambda d: bump_year(moved(d), asof) if bump else moved(d)

    def all_of(ds: Column) -> Column:
        if not daily:
            return F.transform(ds, placed)

        def days(d: Column, i: Column) -> Column:
            ended = (i > 0) & F.get(ds, i - 1)["linked"]
            span = date_range(placed(d), placed(F.get(ds, i + 1)), asof)
            return F.when(d["linked"] & (i + 1 < F.size(ds)), span).when(F.coalesce(ended, F.lit(False)), F.array().cast("array<timestamp>")).otherwise(F.array(placed(d)))

        return F.flatten(F.transform(ds, days))

    read = read_dates(text, F.year(asof), halves)
    return F.array_compact(bound(F.filter(read, lambda d: d["clock"]) if clocked else read, all_of))
