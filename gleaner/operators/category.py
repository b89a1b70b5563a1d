"""Raw categories mapped to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OTHER = "Other"
#: The canonical categories.
CANONICAL = (
    "Arts & Theatre", "Business & Networking", "Classes & Workshops", "Community & Culture", "Conservation & Nature", "Festivals",
    "Film & Media", "Food & Drink", "Government & Politics", "Health & Wellness", "Hobbies & Interests", "Kids & Parents",
    "Markets & Fairs", "Music & Concerts", "Religion & Spirituality", "Sports & Fitness", "Other",
)


def map_category(events: DataFrame, mapping: DataFrame, column: str = "category", legacy: bool = False) -> DataFrame:
    """``column`` through ``mapping`` (raw, canonical); what isn't in it becomes Other.

    Canonical names stand for themselves, so mapping twice changes nothing; with ``legacy``
    they don't unless the map says so.
    """
    # whether the map is broadcast is left to its measured size
    dim = mapping.select(F.col("raw").alias("_raw"), F.col("canonical").alias("_canonical")).dropDuplicates(["_raw"])
    out = events.join(dim, F.col(column) == F.col("_raw"), "left")
    own = F.lit(None).cast("string") if legacy else F.when(F.col(column).isin(*CANONICAL), F.col(column))
    return out.withColumn(column, F.coalesce("_canonical", own, F.lit(OTHER))).drop("_raw", "_canonical")


def unmapped(events: DataFrame, mapping: DataFrame, column: str = "category") -> DataFrame:
    """Distinct raw categories that the map lacks."""
    return events.select(F.col(column).alias("raw")).join(mapping.select("raw"), "raw", "left_anti").where("raw is not null").distinct()


def priority_lookup(rows: DataFrame, dim: DataFrame, key: str, out: str = "category") -> DataFrame:
    """The category whose list holds the key: major lists before minor ones, then by place."""
    first = dim.groupBy("id").agg(F.min_by("category", F.struct("tier", "seq")).alias("_found"))
    got = rows.join(first, F.col(key) == F.col("id"), "left").drop("id")
    return got.withColumn(out, F.coalesce("_found", F.lit(OTHER))).drop("_found")
