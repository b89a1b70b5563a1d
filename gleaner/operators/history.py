"""What has been seen, banned or loaded before: anti-joins and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def seen_urls(previous: DataFrame, banned: DataFrame) -> DataFrame:
    """Distinct urls of previous listings and of the ban list."""
    return previous.select("url").unionAll(banned.select("url")).distinct()


def source_history(events: DataFrame, source: str) -> DataFrame:
    return events.where(F.col("source") == source)


def unseen(frontier: DataFrame, seen: DataFrame, key: str = "url") -> DataFrame:
    """Rows whose key isn't in ``seen``; both sides meet by key, neither is broadcast by hand."""
    return frontier.join(seen.select(key), key, "left_anti")


def unseen_url_or_title(frontier: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of which neither url nor title is known: two anti-joins, as one with OR would be a nested loop."""
    return unseen(unseen(frontier, history, "url"), history, "title")


def split_future(events: DataFrame, asof: Column) -> tuple[DataFrame, DataFrame]:
    """(listings with the dates from ``asof`` on, urls to ban since all their dates are past)."""
    from gleaner.functions.dates import future_dates

    rows = events.withColumn("dates", future_dates(F.col("dates"), asof))
    return rows.where(F.size("dates") > 0), rows.where(F.size("dates") == 0).select("source", "url")


def resume(loaded: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """Loaded listings and those of a checkpoint whose url isn't loaded; the checkpoint may repeat urls."""
    return union_all(loaded, unseen(checkpoint, loaded))


def sources_from(sources: DataFrame, marker: str | None) -> DataFrame:
    """(source, ord, fetch): from the marked source on they are fetched again, before it they only give history."""
    if marker is None:
        return sources.withColumn("fetch", F.lit(True))
    at = sources.where(F.col("source") == marker).agg(F.min("ord").alias("at")).first()["at"]
    return sources.withColumn("fetch", F.col("ord") >= F.lit(at or 0))


def load_counters(events: DataFrame, kept: Column) -> DataFrame:
    """Rows in, out and skipped."""
    return events.agg(F.count("*").alias("n_in"), F.count_if(kept).alias("n_out"), F.count_if(~F.coalesce(kept, F.lit(False))).alias("n_skipped"))
