"""Contiguous byte-balanced shards from global prefix sums, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, ordered, prefix_sums

#: A group of equal texts of at most this share of a shard's target isn't cut.
KEEP_SHARE = 0.05


def shard(docs: DataFrame, n_shards: int = 16, keep_share: float = KEEP_SHARE, columns: tuple[str, ...] = ()) -> DataFrame:
    """Each document's place: doc_id, size, text_crc32, shard, slot (and ``columns`` of ``docs``).

    Documents are ordered by (md5 of the text, doc_id), so equal texts are neighbours. Sizes
    (UTF-8 bytes plus 1) are summed per partition of that order; the partition totals give every
    document its global offset, and the shard is the one of ``n_shards`` equal spans that holds
    the document's middle byte. Of the groups that a cut would split (fewer than ``n_shards``),
    those up to ``keep_share`` of a shard go whole to the shard of their middle.

    Null texts have size 1. Repeated rows are documents of their own; null doc_ids come first
    among equal texts. An empty table gives no rows. Only ids, sizes and hashes are shuffled.
    """
    text = F.col("text")
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.md5(F.encode(text, "UTF-8")), F.lit("")).alias("_text_key"),
        *[F.col(c) for c in columns],
    )
    rows = ordered(slim, [F.col("_text_key"), F.col("doc_id")], "shard-order")
    placed = materialize(prefix_sums(rows, {"_start": F.col("size"), "_rank": F.lit(1).cast("long")}), "shard-places")
    total = placed.agg(F.sum("size").alias("t")).first()["t"] or 1
    cut = lambda middle: F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.lit(float(total)))).cast("int")
    placed = placed.withColumn("shard", cut(F.col("_start") + F.col("size") / 2))
    groups = placed.groupBy("_text_key").agg(F.min("shard").alias("_lo"), F.max("shard").alias("_hi"), F.min("_start").alias("_from"), F.sum("size").alias("_bytes"))
    split = groups.filter((F.col("_lo") < F.col("_hi")) & (F.col("_bytes") <= F.lit(keep_share * total / n_shards)))
    split = split.select("_text_key", cut(F.col("_from") + F.col("_bytes") / 2).alias("_whole"))
    # at most n_shards - 1 groups straddle a cut
    placed = placed.join(F.broadcast(split), "_text_key", "left").withColumn("shard", F.coalesce("_whole", "shard"))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("_rank") - F.col("_first")).alias("slot"), *columns)


def shard_report(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """``shard`` under the law ``bytes``, for which no grown shard exists."""
    out = shard(docs, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_totals(placed: DataFrame) -> DataFrame:
    """Documents and bytes of each shard, for manifests."""
    return placed.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("size").alias("bytes"), F.max("slot").alias("last_slot"))


