"""Labelled corpora: ingestion, class counts, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import cut_at, skip_flag, title_of, training_description
from gleaner.operators.dedupe import first_n, first_wins
from gleaner.operators.filters import has_text, not_skipped
from gleaner.operators.numbering import numbered


def ingest(events: DataFrame, corpus: DataFrame, markers: tuple[str, ...], *boilerplates: str) -> DataFrame:
    """``corpus`` (description, label) and the new descriptions of ``events`` (seq, name, long_description, eventType).

    Descriptions are cut at the markers; a new one is neither in the corpus nor earlier among
    the events. ``new`` is set on those only. Order by label, then description.
    """
    rows = events.withColumn("long_description", cut_at(F.col("long_description"), *markers)).where(has_text(F.col("long_description")))
    rows = rows.select("seq", training_description(F.col("name"), F.col("long_description")).alias("description"), F.col("eventType").alias("label"))
    fresh = first_wins(rows, [F.col("description")], "seq")
    old = corpus.select(cut_at(F.col("description"), *markers).alias("description"), "label", F.lit(None).cast("boolean").alias("new"))
    fresh = fresh.join(old.select("description"), "description", "left_anti").select("description", "label", F.lit(True).alias("new"))
    return old.unionByName(fresh).withColumn("skip", skip_flag(F.col("description"), *boilerplates)).orderBy("label", "description")


def usable(rows: DataFrame, label: str = "label", skip: str = "skip") -> DataFrame:
    """Rows that have a label and aren't skipped."""
    return rows.where(F.col(label).isNotNull() & not_skipped(F.col(skip)))


def class_counts(rows: DataFrame, label: str = "label", skip: str | None = None) -> DataFrame:
    kept = rows.where(not_skipped(F.col(skip))) if skip else rows
    return kept.groupBy(label).agg(F.count("*").alias("n"))


def min_class(rows: DataFrame, label: str = "label") -> DataFrame:
    """The size of the smallest class: counts, then their minimum."""
    return class_counts(rows, label).agg(F.min("n").alias("min_n"), F.count("*").alias("n_classes"))


def first_per_title(rows: DataFrame, order: str = "seq") -> DataFrame:
    """One row per title; two rows with one description have one title."""
    return first_wins(rows, [title_of(F.col("description"))], order)


def shuffled(key: Column, seed: int) -> Column:
    """An order by hash: the same on every cluster and partitioning."""
    return F.xxhash64(key, F.lit(seed))


def smallest(rows: DataFrame, label: str) -> int:
    """The size of the smallest class; 0 without rows."""
    return min_class(rows, label).first()["min_n"] or 0


def test_split(rows: DataFrame, label: str, share: float, *order: Column) -> DataFrame:
    """As many rows of each class: ``share`` of the smallest class, rounded down."""
    return first_n(rows, label, int(share * smallest(rows, label)), *order)


def train_pool(rows: DataFrame, test: DataFrame, key: str = "description") -> DataFrame:
    return rows.join(test.select(key), key, "left_anti")


def balanced(rows: DataFrame, label: str, *order: Column) -> DataFrame:
    """As many rows of each class as the smallest has, the first of each."""
    return first_n(rows, label, smallest(rows, label), *order)


def kfold(rows: DataFrame, label: str, k: int, *order: Column) -> DataFrame:
    """Stratified folds: rows of a class take turns. k is lowered to the smallest class; below 2 there are none."""
    folds = min(k, smallest(rows, label))
    if folds < 2:
        return rows.withColumn("fold", F.lit(0)).where("false")
    return numbered(rows, [label], list(order), "_place").withColumn("fold", F.pmod("_place", F.lit(folds)).cast("int")).drop("_place")


def undersample(rows: DataFrame, positive: Column, *order: Column) -> DataFrame:
    """All positives, and negatives from the second on, one fewer than there are positives."""
    n = rows.where(positive).count()
    negatives = numbered(rows.where(~positive), [], list(order), "_place")
    return rows.where(positive).unionByName(negatives.where(F.col("_place").between(1, n - 1)).drop("_place"))


def hash_split(key: Column, parts: list[tuple[str, float]], seed: int = 42) -> Column:
    """A part's name by hash of the key, in the given shares: 80/20 and again 80/20 as 64/16/20."""
    code = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    at = F.pmod(F.conv(code, 16, 10).cast("long"), F.lit(10_000)) / 10_000.0
    edge, out = 0.0, F.when(F.lit(False), F.lit(""))
    for name, share in parts[:-1]:
        edge += share
        out = out.when(at < edge, F.lit(name))
    return out.otherwise(F.lit(parts[-1][0]))
