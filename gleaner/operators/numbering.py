"""Row numbers and running sums without a window over all rows or over a large group."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The local folder of each application whose settings name no shared one.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master, session = spark.conf.get("spark.master", ""), spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; the master is {master!r}")
    if session not in _OWN:
        _OWN[session] = tempfile.mkdtemp(prefix="gleaner-")
        atexit.register(shutil.rmtree, _OWN[session], ignore_errors=True)
    return f"file://{_OWN[session]}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/gleaner/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends at files that every executor can read, so a lost executor costs no
    recomputation of what came before.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleaner_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_gleaner_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def ordered(df: DataFrame, order: list[Column], tag: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with ``_pid`` and ``_idx``, on disk.

    How many partitions there are is left to adaptive execution, which joins small neighbours.

    ``_pid`` rises with the order, ``_idx`` is the place within the partition. The rows are
    written once, so that totals and offsets taken from them agree whatever is recomputed.
    """
    place = F.monotonically_increasing_id()
    out = df.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.withColumns({"_pid": F.shiftright(place, 33).cast("int"), "_idx": place.bitwiseAND(F.lit((1 << 33) - 1))})
    return materialize(out, tag)


def prefix_sums(rows: DataFrame, values: dict[str, Column], block: int = 4096) -> DataFrame:
    """Adds exclusive global running sums of ``values`` to the result of ``ordered``.

    The sums run inside blocks of consecutive rows, over the blocks of a partition, and over
    the partitions; each window holds a block, a partition's block totals or one row a partition.
    """
    at = F.floor(F.col("_idx") / block)
    rows = rows.withColumn("_blk", at)
    run = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = rows.groupBy("_pid", "_blk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in values.items()])
    parts = totals.groupBy("_pid").agg(*[F.sum(f"_t_{k}").alias(f"_p_{k}") for k in values])
    parts = parts.select("_pid", *[F.coalesce(F.sum(f"_p_{k}").over(run([], "_pid")), zero).alias(f"_q_{k}") for k in values])
    blocks = totals.select("_pid", "_blk", *[F.coalesce(F.sum(f"_t_{k}").over(run(["_pid"], "_blk")), zero).alias(f"_b_{k}") for k in values])
    blocks = blocks.join(parts, "_pid").select("_pid", "_blk", *[(F.col(f"_b_{k}") + F.col(f"_q_{k}")).alias(f"_o_{k}") for k in values])
    inner = rows.withColumns({f"_r_{k}": F.coalesce(F.sum(v).over(run(["_pid", "_blk"], "_idx")), zero) for k, v in values.items()})
    out = inner.join(blocks, ["_pid", "_blk"])
    return out.withColumns({k: F.col(f"_r_{k}") + F.col(f"_o_{k}") for k in values}).drop("_blk", *[f"_r_{k}" for k in values], *[f"_o_{k}" for k in values])


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their number from 0 within their key, in the given order; ``keys`` may be empty.

    A key may hold any share of the rows: numbers come from partition counts and the place
    within a partition, less the key's first number. Columns of ``rows`` named _pid, _idx,
    _before, _first or _first_… would clash.
    """
    placed = ordered(rows, [*(F.col(k) for k in keys), *order], "numbered")
    before = F.coalesce(F.sum("count").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_pid").count().select("_pid", before.alias("_before"))  # a row a partition
    placed = placed.join(starts, "_pid").withColumn(name, F.col("_before") + F.col("_idx")).drop("_pid", "_idx", "_before")
    if not keys:
        return placed
    first = placed.groupBy(*[F.col(k).alias(f"_first_{k}") for k in keys]).agg(F.min(name).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_first_{k}")) for k in keys]
    out = placed.join(first, same)
    return out.withColumn(name, F.col(name) - F.col("_first")).drop("_first", *[f"_first_{k}" for k in keys])
