"""Festival programmes from a content system's export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import dates, text
from gleaner.operators.publish import upsert_by_title

DOCUMENT = "title string, slug string, location string, metadata struct<tags:array<struct<contentful_id:string>>>, times array<struct<fullFestivalDuration:boolean,startDate:string>>, intro struct<raw:string>, description struct<raw:string>"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def festival_events(docs: DataFrame, asof: Column, opens: Column, closes: Column, base_url: str, source: str) -> DataFrame:
    """Events of this year's programme: whole-festival entries have every day, others their sessions."""
    tags = F.transform("metadata.tags", lambda t: t["contentful_id"])
    single = F.array_compact(F.transform("times", lambda t: F.try_to_timestamp(F.substring(t["startDate"], 1, 16), F.lit("yyyy-MM-dd'T'HH:mm"))))
    whole = F.exists("times", lambda t: F.coalesce(t["fullFestivalDuration"], F.lit(False)))
    rows = docs.where(dates.in_season(tags, F.year(asof)) & (closes >= asof))
    body = F.concat_ws("\n", text.rich_text(F.col("description.raw")), text.rich_text(F.col("intro.raw")))
    rows = rows.select(F.col("title").alias("name"), F.col("location").alias("venue"), F.concat(F.lit(base_url), "slug").alias("url"), F.lit(source).alias("source"), body.alias("long_description"), F.when(whole, dates.date_range(opens, closes, asof)).otherwise(single).alias("dates"))
    return rows.where(F.size("dates") > 0)


def merge_programme(new: DataFrame, old: DataFrame) -> DataFrame:
    """New programme rows; entries known before keep what they had but for image and dates."""
    return upsert_by_title(new, old, "name", ["imageUrl", "dates"])
