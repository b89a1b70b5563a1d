"""Session set-up and table loading."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes that Python workers get at once, the same for all operators.
BATCH_BYTES = 4 << 20


def get_session(master: str = "local[*]", partitions: int = 8, app: str = "gleaner") -> SparkSession:
    """A session with the settings every plan here assumes (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def python_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, or one row, so that long texts don't pile up in a Python worker.

    Also lets Python workers find this package where the driver found it, beside what was
    shipped with the application.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``; pruning and pushdown are left to the scan."""
    python_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
