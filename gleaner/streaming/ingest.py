"""Raw listings as a file stream: late ones dropped, seen ones dropped, batches appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def listing_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(rows: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; older state is forgotten."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(rows: DataFrame, time: str, key: str, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    return rows.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def append_unseen(rows: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append rows whose key the table at ``out`` lacks. A batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        old = spark.read.option("basePath", out).schema(batch.schema.add("_batch", "long")).parquet(out) if _exists(spark, out) else None
        if old is not None:
            fresh = fresh.join(old.where(F.col("_batch") != number).select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{out}/_batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
