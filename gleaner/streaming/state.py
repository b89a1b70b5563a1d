"""What a run remembers of listings, as keyed state of a stream: when each was seen, and whether it is banned.

The state lives in the stream's checkpoint, so a batch reads no table that earlier batches wrote.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Stands for a null tie, the last of its time.
NO_TIE = (1 << 63) - 1

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Streams of this session keep keyed state in RocksDB, on disk beside the executors, as stateful processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def merge_runs(runs: tuple[np.ndarray, ...], at: np.ndarray, tie: np.ndarray, forget: int) -> tuple[np.ndarray, ...]:
    """``runs`` with more times: (first time, its tie, last time) of the longest runs of times no more than ``forget`` apart."""
    first, ties, last = (np.concatenate([have, new]) for have, new in zip(runs, (at, tie, at), strict=True))
    order = np.lexsort((ties, first))
    first, ties, last = first[order], ties[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(first[1:] - last[:-1] > forget) + 1
    begin, end = np.append(0, cut), np.append(cut, len(first)) - 1
    return first[begin], ties[begin], last[end]


class Seen(StatefulProcessor):
    """Per key: the last time it was seen, and whether it is banned.

    Emits a row if its key isn't banned and wasn't seen for ``forget`` microseconds before it. Rows
    count in the order of their times (of equal ones bans first), in whatever order they come. A key
    that wasn't seen for that long is dropped from the state when the watermark passes; bans stay.

    Rows come in chunks. What is held of them is runs of times that ``forget`` doesn't part, so a
    batch may have any number of rows of a key.
    """

    def __init__(self, forget: int):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", StructType([StructField("last", LongType()), StructField("banned", BooleanType())]))

    def _due(self, last: int) -> int:
        return (last + self.forget) // 1000 + 1  # timers are in milliseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        known = self.state.get() if self.state.exists() else None
        was, banned = known if known else (None, False)
        runs, ban = tuple(np.empty(0, np.int64) for _ in range(3)), None
        for chunk in rows:
            at, tie, bans = (chunk[c].to_numpy(kind) for c, kind in (("at_", np.int64), ("tie_", np.int64), ("ban_", bool)))
            if bans.any():
                ban = min(x for x in (ban, at[bans].min()) if x is not None)
            if not bans.all():
                runs = merge_runs(runs, at[~bans], tie[~bans], self.forget)
        first, tie, ends = runs
        new = np.full(len(first), not banned)
        if was is not None:
            new &= first - was > self.forget
        if ban is not None:
            new &= first < ban
        banned = banned or ban is not None
        last = max((int(x) for x in (was, *ends[-1:]) if x is not None), default=None)
        if was is not None and last != was and not known[1]:
            self.handle.deleteTimer(self._due(was))
        if last is not None and not banned and last != was:
            self.handle.registerTimer(self._due(last))
        self.state.update((last, banned))
        return iter([pd.DataFrame({"key_": key[0], "at_": first[new], "tie_": tie[new]})] if new.any() else [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        if self.state.exists() and not self.state.get()[1]:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def unseen_stream(rows: DataFrame, key: str, time: str, tie: str, ban=None, forget_days: float = 30, late: str = "0 seconds") -> DataFrame:
    """(key, at, tie) of a stream's rows whose key is new, or was not seen for ``forget_days`` before, and isn't banned.

    ``tie`` is a long that tells rows of one time apart (nulls last) and comes back with them, ``ban`` a condition
    that makes a row a ban of its key from its time on. Rows that come later than ``late`` are lost to
    the watermark. Rows without key or time are left out. A repeated batch finds the state that it
    found before.
    """
    keyed_state(rows.sparkSession)
    at = F.unix_micros(F.col(time).cast("timestamp"))
    stamped = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).withColumn("time_", F.col(time).cast("timestamp")).withWatermark("time_", late)
    # no names with a leading underscore: pandas renames them
    slim = stamped.select("time_", F.col(key).cast("string").alias("key_"), at.alias("at_"), F.coalesce(F.col(tie).cast("long"), F.lit(NO_TIE)).alias("tie_"), F.coalesce(ban if ban is not None else F.lit(False), F.lit(False)).alias("ban_"))
    got = slim.groupBy("key_").transformWithStateInPandas(Seen(int(forget_days * 86_400_000_000)), "key_ string, at_ long, tie_ long", "Append", "EventTime")
    return got.select(F.col("key_").alias(key), F.timestamp_micros("at_").alias("at"), F.nullif("tie_", F.lit(NO_TIE)).alias(tie))


def run_once(rows: DataFrame, out: str, checkpoint: str) -> None:
    """Everything that has come since the last run with this checkpoint, appended to ``out``.

    Executors close a partition's state when it is committed, else they would hold that of each run for a while.
    """
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.unloadOnCommit"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        _run_once(rows, out, checkpoint)
    finally:
        conf.set(name, before)


def _run_once(rows: DataFrame, out: str, checkpoint: str) -> None:
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
