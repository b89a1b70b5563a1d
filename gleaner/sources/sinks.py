"""Feeds, checkpoints, lists and logs. A path is never read and overwritten by one job."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.dates import display_date, stamp
from gleaner.operators.publish import event_types, facet, feed_order
from gleaner.sources.documents import JsonDocument
from gleaner.sources.versions import publish_version

FEED_COLUMNS = ["id", "name", "imageUrl", "venue", "coordinates", "dates", "displayDate", "url", "source", "eventType", "long_description", "description", "labels"]


def feed_rows(events: DataFrame) -> DataFrame:
    """Events as the feed has them, in its order."""
    rows = events.orderBy(*feed_order(F.get("dates", 0), F.col("name"), F.col("seq")))
    rows = rows.withColumn("displayDate", display_date(F.col("dates"))).withColumn("dates", F.transform("dates", stamp))
    if "labels" not in rows.columns:
        rows = rows.withColumn("labels", F.array().cast("array<string>"))
    return rows.select(*FEED_COLUMNS)


def publish_feed(events: DataFrame, path: str) -> None:
    """Overwrite the feed: events as JSON lines in order, and its facets."""
    feed_rows(events).write.mode("overwrite").json(f"{path}/events")
    facet(events, "source").write.mode("overwrite").json(f"{path}/filters/sources")
    event_types(events).write.mode("overwrite").json(f"{path}/filters/eventTypes")


def publish_document(events: DataFrame, path: str) -> None:
    """The feed as one JSON document in ordered parts: their contents one after another are the document.

    Every task writes the events of its range of the order, a line each; nothing holds the feed.
    """
    facets = events.agg(F.array_sort(F.collect_set("source")).alias("s"), F.array_sort(F.array_remove(F.collect_set("eventType"), "Other")).alias("t")).first()  # names of sources and types
    filters = {"sources": facets["s"], "eventTypes": [*facets["t"], "Other"]}
    lines = feed_rows(events).select(F.to_json(F.struct(*FEED_COLUMNS)).alias("value"))
    events.sparkSession.dataSource.register(JsonDocument)
    head, tail = '{"events":[', f'],"filters":{json.dumps(filters, ensure_ascii=False, separators=(",", ":"))}}}'
    lines.write.format("json_document").option("path", path).option("head", head).option("tail", tail).mode("overwrite").save()


def keep_copy(spark: SparkSession, path: str, copy: str) -> None:
    """Copy what is published before it is overwritten."""
    spark.read.text(path).write.mode("overwrite").text(copy)


def append_events(events: DataFrame, path: str) -> None:
    """Checkpoint of a source: JSON lines, so that a part that is written stays readable."""
    events.write.mode("append").json(path)


def append_urls(urls: DataFrame, path: str) -> None:
    urls.write.mode("append").json(path)


def write_marker(spark: SparkSession, path: str, source: str) -> None:
    spark.createDataFrame([(source,)], "source string").coalesce(1).write.mode("overwrite").json(path)


def write_festivals(details: DataFrame, path: str) -> None:
    details.dropDuplicates(["id"]).orderBy("name").write.mode("overwrite").json(path)


def write_festival_feeds(events: DataFrame, path: str, by: str = "festival") -> None:
    """A feed a festival, as partitions."""
    events.orderBy("name").write.mode("overwrite").partitionBy(by).json(path)


def replace_if_changed(rows: DataFrame, n_changed: int, path: str) -> bool:
    """Publish ``rows`` as the table's next version, if any changed."""
    if n_changed:
        publish_version(rows, path)
    return bool(n_changed)


def write_splits(path: str, **frames: DataFrame) -> None:
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")


def append_predictions(predictions: DataFrame, path: str, run: str) -> None:
    """The log of a classification run, kept apart from other runs."""
    predictions.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def append_unmapped(misses: DataFrame, path: str) -> None:
    """Raw categories that the map lacked; repeats over time are kept, as they count."""
    misses.write.mode("append").json(path)
