"""Predictions: top classes, accuracy, accepted updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes whose predictions replace a label without review.
ACCEPTED = ("Music & Concerts", "Markets & Fairs", "Classes & Workshops", "Film & Media")


def top_two(scores: Column, ratio: float = 0.5) -> Column:
    """Structs (score, cls) of the best class, and of the second if it has at least ``ratio`` of its score.

    Within a row, by arrays: no shuffle. Of equal scores the smaller class comes first.
    """
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("cls")))
    best = F.slice(F.array_sort(pairs), 1, 2)
    kept = F.filter(best, lambda p: -p["neg"] >= -F.get(best, 0)["neg"] * ratio)
    return F.transform(kept, lambda p: F.struct((-p["neg"]).alias("score"), p["cls"].alias("cls")))


def is_correct(predicted: Column, given: Column) -> Column:
    return F.array_contains(predicted, given)


def accuracy(rows: DataFrame, correct: Column) -> DataFrame:
    """(n, n_correct, accuracy); the accuracy of no rows is null."""
    return rows.agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))


def accuracy_by_class(rows: DataFrame, given: str, correct: Column) -> DataFrame:
    got = rows.groupBy(given).agg(F.count("*").alias("n"), F.count_if(correct).alias("n_correct"), F.round(F.avg(correct.cast("double")), 6).alias("accuracy"))
    return got.orderBy(F.desc("accuracy"), given)


def accepted(top: Column, given: Column, classes=ACCEPTED) -> Column:
    return top.isin(*classes) & (top != given)


def write_back(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``updates`` (key, new_value) where there is an update."""
    got = rows.join(updates.select(F.col(key).alias("_key"), F.col("new_value").alias("_value")), F.col(key) == F.col("_key"), "left")
    return got.withColumn(column, F.coalesce("_value", column)).drop("_key", "_value")


def review_label(label: Column, new: Column) -> Column:
    """The label as shown; rows that nobody has reviewed are marked and so count as wrong."""
    return F.when(new.isNotNull(), F.concat(label, F.lit("\nnew"))).otherwise(label)
