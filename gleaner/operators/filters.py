"""Predicates on listings before they become events. All push into the scan where it can test them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Status lines that mean a listing can't be visited.
CLOSED = ("sold out", "sales ended", "event ended", "unavailable")


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_closed(status: Column) -> Column:
    return any_of(*[F.contains(F.lower(status), F.lit(x)) for x in CLOSED])


def mentions(text: Column, *words: str) -> Column:
    return any_of(*[F.contains(F.lower(text), F.lit(w.lower())) for w in words])


def not_expired(image_url: Column, asof: Column) -> Column:
    from gleaner.functions.text import image_expiry

    return F.coalesce(image_expiry(image_url) > asof, F.lit(True))


def not_past(dates: Column, asof: Column) -> Column:
    """Whether the last date is still to come; a listing whose dates weren't readable stays."""
    return F.coalesce(F.try_element_at(dates, F.lit(-1)) >= asof, F.lit(True))


def has_text(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def not_skipped(skip: Column) -> Column:
    return ~F.coalesce(skip, F.lit(False))


def unlabelled(labels: Column) -> Column:
    return F.coalesce(F.size(labels), F.lit(0)) <= 0


def has_parts(text: Column, *patterns: str) -> Column:
    return reduce(lambda a, b: a & b, [text.rlike(p) for p in patterns])


def still_running(end: Column, asof: Column) -> Column:
    return end >= asof


def has_lines(text: Column, n: int) -> Column:
    return F.size(F.split(text, "\n")) >= n


def menu_entry(text: Column, allowed: list[str], word: str = "festival") -> Column:
    return text.isin(allowed) | F.contains(F.lower(text), F.lit(word))
