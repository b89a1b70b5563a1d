"""Tables that are replaced as a whole: every state is a version of its own, and pointers name the current one.

``root``/versions/<name> holds a version's files, ``root``/pointers/n=<k> a line with the name of the
version that was current from the k-th change on. A version is written whole before its pointer; the
pointer is written by one task and counts once its folder is complete. So whenever a job dies, the
table that readers see is the one before or the one after, and rows may be read from the table that
they replace. Older versions are the back-up.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def pointers(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(n, version) of all changes, oldest first: a row a change."""
    try:
        rows = spark.read.schema("value string, n long").text(f"{root}/pointers").collect()
    except AnalysisException:
        return []
    return sorted((r["n"], r["value"]) for r in rows if r["n"] is not None)


def read_current(spark: SparkSession, root: str, back: int = 0) -> DataFrame:
    """The table as it is, or as it was ``back`` changes ago."""
    known = pointers(spark, root)
    if len(known) <= back:
        raise FileNotFoundError(f"{root} has {len(known)} versions")
    return spark.read.parquet(f"{root}/versions/{known[-1 - back][1]}")


def write_version(rows: DataFrame, root: str) -> str:
    """Write a version that no pointer names yet; its name."""
    name = uuid.uuid4().hex
    rows.write.parquet(f"{root}/versions/{name}")
    return name


def point_to(spark: SparkSession, root: str, name: str) -> int:
    """Make a version the current one. Of two writers that see the same state one fails."""
    n = max((k for k, _ in pointers(spark, root)), default=0) + 1
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{root}/pointers/n={n}")
    return n


def publish_version(rows: DataFrame, root: str) -> int:
    """``rows`` become the table; they may be read from it."""
    return point_to(rows.sparkSession, root, write_version(rows, root))


def roll_back(spark: SparkSession, root: str, back: int = 1) -> int:
    """The version of ``back`` changes ago becomes the current one again."""
    known = pointers(spark, root)
    if len(known) <= back:
        raise FileNotFoundError(f"{root} has {len(known)} versions")
    return point_to(spark, root, known[-1 - back][1])
