"""Feeds, checkpoints, corpora and control tables as DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.dates import future_dates, parse_stamp
from gleaner.operators.filters import not_expired
from gleaner.sources import schemas


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The listings of a feed document, with ``seq`` their place in it.

    A document in parts, which are of bounded size, is read part by part, each its lines; any other one is a row.
    """
    parts = spark.read.option("pathGlobFilter", "part-*-1").text(path, wholetext=True) if is_in_parts(spark, path) else None
    if parts is not None:
        lines = F.split(F.regexp_replace("value", r"\n$", ""), r",?\n")
        rows = parts.select(F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("_part"), lines.alias("_lines"))
        before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        starts = rows.select("_part", F.size("_lines").alias("_n")).withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row a part
        each = rows.join(F.broadcast(starts), "_part").select("_first", F.posexplode("_lines").alias("_at", "_line"))
        return each.select((F.col("_first") + F.col("_at")).cast("long").alias("seq"), F.from_json("_line", schemas.EVENT).alias("e")).select("seq", "e.*")
    doc = spark.read.schema(schemas.FEED).option("multiLine", True).json(path)
    return doc.select(F.posexplode("events").alias("seq", "e")).select(F.col("seq").cast("long"), "e.*")


def is_in_parts(spark: SparkSession, path: str) -> bool:
    """Whether a document was written by sinks.publish_document, an event a line."""
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", "part-*-9").load(path).select("path").limit(1).count() > 0
    except AnalysisException:
        return False


def usable_events(events: DataFrame, asof: Column, check_images: bool = True) -> DataFrame:
    """Listings with dates still to come; of a main feed also without images past their expiry."""
    dates = future_dates(F.transform("dates", parse_stamp), asof)
    rows = events.withColumn("dates", dates).where(F.size("dates") > 0)
    return rows.where(not_expired(F.col("imageUrl"), asof)) if check_images else rows


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def repaired(value: Column, element: str) -> Column:
    """A JSON array of ``element`` from a checkpoint: strict, with a comma before the end, or a list without brackets.

    Every variant is tried only if the one before doesn't parse; null if none does.
    """
    kind = f"array<{element}>"
    trimmed = F.regexp_replace(value, r",\s*\n?\s*\]\s*$", "\n]")
    listed = F.concat(F.lit("["), F.regexp_replace(F.rtrim(F.regexp_replace(value, r"^\s*\[?", "")), r",\s*\]?\s*$", ""), F.lit("]"))
    return F.coalesce(F.from_json(value, kind), F.from_json(trimmed, kind), F.from_json(listed, kind))


def read_checkpoint(spark: SparkSession, path: str, element: str) -> DataFrame:
    """(file, seq, item) from checkpoint files in any of their variants."""
    rows = _whole(spark, path).select("file", repaired(F.col("value"), element).alias("items"))
    return rows.select("file", F.posexplode("items").alias("seq", "item"))


def read_banned(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a ban list: a comma after each url, no brackets; blanks are left out."""
    return read_checkpoint(spark, path, "string").where("item <> ''").select(F.col("item").alias("url"))


def checkpoint_files(spark: SparkSession, root: str, sources: list[str], name: str = "events.json") -> DataFrame:
    """(source, file) of the checkpoints that active sources have under ``root``/source/."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", name).option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("file"))
    named = files.withColumn("source", F.replace(F.element_at(F.split("file", "/"), -2), F.lit("%20"), F.lit(" ")))
    return named.where(F.col("source").isin(sources)).select("source", "file")


#: Places of url, category, image and the several-dates flag in a frontier element, by shape.
FRONTIER_SHAPES = {
    "url_category": (0, 1, None, None),
    "category_url": (1, 0, None, None),
    "url_category_multiple": (0, 1, None, 2),
    "url_image": (0, None, 1, None),
    "url": (0, None, None, None),
}


def frontier(rows: DataFrame, shape: str) -> DataFrame:
    """One layout (url, category, image, multiple_dates) from a column ``item`` of strings in a source's shape."""
    at = FRONTIER_SHAPES[shape]
    pick = lambda k: F.get("item", k) if k is not None else F.lit(None).cast("string")
    flag = F.lower(pick(at[3])) == "true" if at[3] is not None else F.lit(None).cast("boolean")
    return rows.select(pick(at[0]).alias("url"), pick(at[1]).alias("category"), pick(at[2]).alias("image"), flag.alias("multiple_dates"))


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON table; missing or damaged files count as empty."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    return read_or_empty(spark, path, schemas.TRAINING)


def read_required(spark: SparkSession, path: str, schema: str, hint: str) -> DataFrame:
    """A table that an earlier step writes; without it the error says which step."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"{path} is missing: {hint}") from e


def read_marker(spark: SparkSession, path: str) -> str | None:
    """The source at which a run stopped."""
    row = read_or_empty(spark, path, "source string").first()
    return row["source"] if row else None


def festivals(spark: SparkSession, seasonal: list[tuple[str, str, str, str]], *found: DataFrame) -> DataFrame:
    """Festival details: the season's and those that sources found, each once."""
    rows = spark.createDataFrame(seasonal, schemas.FESTIVAL)
    for x in found:
        rows = rows.unionByName(x)
    return rows.dropDuplicates(["id"])


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def reader(name: str):
    def add(f):
        READERS[name] = f
        return f

    return add


def get_reader(name: str) -> Callable[[SparkSession, str], DataFrame]:
    if name not in READERS:
        raise KeyError(f"no reader for source {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name]


def active_sources(spark: SparkSession, names: list[str], seasonal: dict[str, tuple[int, int]], month: int) -> DataFrame:
    """(source, ord, active): seasonal sources are active in their months only."""
    on = lambda n: n not in seasonal or seasonal[n][0] <= month <= seasonal[n][1]
    return spark.createDataFrame([(n, i, on(n)) for i, n in enumerate(names)], "source string, ord int, active boolean")
