"""Feeds: order, facets, projections, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import event_id
from gleaner.operators.category import OTHER
from gleaner.operators.dedupe import prefer_nonempty
from gleaner.operators.numbering import numbered


def feed_order(first_date: Column, name: Column, seq: Column) -> list[Column]:
    return [first_date, name, F.trim(name), seq]


def dedupe_events(events: DataFrame) -> DataFrame:
    """One listing per id; a later one with an image replaces an earlier one."""
    rows = events.withColumn("id", event_id(F.col("name"), F.col("venue"), F.col("source")))
    return prefer_nonempty(rows, ["id"], "seq", F.col("imageUrl"))


def facet(rows: DataFrame, column: str, last: str | None = None) -> DataFrame:
    """(ord, value): distinct values in order; ``last`` always comes, at the end."""
    values = rows.select(F.col(column).alias("value")).where("value is not null").distinct()
    if last is not None:
        values = values.where(F.col("value") != last).select("value", F.lit(0).alias("_z"))
        values = values.unionAll(rows.sparkSession.createDataFrame([(last, 1)], "value string, _z int"))
    else:
        values = values.withColumn("_z", F.lit(0))
    got = numbered(values, [], [F.col("_z"), F.col("value")], "ord")
    return got.select((F.col("ord") + 1).alias("ord"), "value")


def event_types(rows: DataFrame, column: str = "eventType") -> DataFrame:
    return facet(rows, column, OTHER)


def multi_facet(rows: DataFrame, values: Column) -> DataFrame:
    """Distinct non-empty elements of an array column, in order."""
    got = rows.select(F.explode(values).alias("value")).select(F.trim("value").alias("value")).where("value <> ''").distinct()
    return got.orderBy("value")


def price_range(rows: DataFrame, price: str = "price") -> DataFrame:
    """(lo, hi); hi is never below 0, and an empty table has infinity and 0."""
    return rows.agg(F.coalesce(F.min(price), F.lit(float("inf"))).alias("lo"), F.greatest(F.coalesce(F.max(price), F.lit(0.0)), F.lit(0.0)).alias("hi"))


def upsert_by_title(new: DataFrame, old: DataFrame, key: str, overriding: list[str]) -> DataFrame:
    """New rows; where the key was there before, the old row with the new ``overriding`` columns."""
    was = old.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in old.columns if c != key]).dropDuplicates(["_key"])
    got = new.join(was, F.col(key) == F.col("_key"), "left")
    keep = lambda c: F.col(c) if c == key or c in overriding or c not in old.columns else F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
    return got.select(*[keep(c).alias(c) for c in new.columns])


def lookup_coordinates(venues: DataFrame, gazetteer: DataFrame, variants: Column) -> DataFrame:
    """(venue, lat, long): coordinates of the first variant that the gazetteer (address, lat, long) has; nulls if none."""
    tries = venues.select("venue").distinct().select("venue", F.posexplode(variants).alias("pos", "address"))
    hits = tries.join(gazetteer, "address").groupBy("venue").agg(F.min_by(F.struct("lat", "long"), "pos").alias("at"))
    return venues.select("venue").distinct().join(hits, "venue", "left").select("venue", "at.lat", "at.long")


def zip_lists(a: Column, b: Column) -> Column:
    """Pairs by place, as many as the shorter list has."""
    return F.slice(F.arrays_zip(a.alias("a"), b.alias("b")), F.lit(1), F.least(F.size(a), F.size(b)))


def gather(rows: DataFrame, picks: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows at the distinct positions in the array column ``idx`` of ``picks``."""
    wanted = picks.select(F.explode("idx").alias(seq)).distinct()
    return rows.join(wanted, seq, "left_semi")
