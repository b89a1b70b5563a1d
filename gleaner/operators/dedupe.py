"""First-wins and richer-row-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.numbering import numbered


def prefer_nonempty(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """A row per key: the last whose ``value`` isn't empty, else the first; with its first place as ``first_seq``.

    One aggregation with partial results, so a key with very many rows needs no large group.
    """
    whole = F.struct(*rows.columns)
    full = value.isNotNull() & (value.cast("string") != "")
    # the first row stays unless a later one has a value
    best = F.coalesce(F.max_by(F.when(full, whole), F.when(full, F.col(order))), F.min_by(whole, F.col(order)))
    got = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(best.alias("r"), F.min(order).alias("first_seq"))
    return got.select("r.*", "first_seq")


def first_wins(rows: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """The first row of each key. An aggregation, not a window: partial results meet, not all rows."""
    whole = F.struct(*rows.columns)
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    return rows.withColumns(named).groupBy(*named).agg(F.min_by(whole, F.col(order)).alias("r")).select("r.*")


def first_n(rows: DataFrame, key: str, n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each key; places come from partition counts, so no class is one window."""
    return numbered(rows, [key], list(order), "_place").where(F.col("_place") < int(n)).drop("_place")


def chunked(rows: DataFrame, size: int, *order: Column) -> DataFrame:
    """Chunk numbers for batches of ``size`` rows in the given order."""
    return numbered(rows, [], list(order), "_number").withColumn("chunk", F.floor(F.col("_number") / size)).drop("_number")


def crawl_plan(rows: DataFrame, category: str, limit: int, *order: Column) -> DataFrame:
    """The first ``limit`` links of each category with their ``place``, in the order of a crawl: by category, then place."""
    got = numbered(rows, [category], list(order), "_place").where(F.col("_place") < limit)
    return got.withColumn("place", (F.col("_place") + 1).cast("long")).drop("_place").orderBy(category, "place")
