"""Importance resampling to a target distribution over hashed word features.

A document's features are hashed into buckets by higher-order functions and kept as one array;
the only rows made of features are the bucket totals, which each task sums before the shuffle.
Scoring sums ``element_at`` of a literal array of gains over a document's buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, let, materialize, ordered, prefix_sums

BUCKETS, MOST_RUN = 10_000, 2
SEED, SHARE, LEAST_WORDS = 7, (25, 100), 20
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: ASCII characters that separate words; lower-cased letters, digits and all other characters make them.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def folded_words(text: Column) -> Column:
    """Words of ASCII letters (A-Z lower-cased), digits and non-ASCII characters, in order; none for null."""
    low = F.coalesce(text.cast("string"), F.lit(""))
    for a in _UPPER:
        low = F.replace(low, F.lit(a), F.lit(a.lower()))
    return F.array_remove(F.split(low, _BETWEEN), "")


def bucket_of(feature: Column, buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def bucket_array(words: Column, most: int = MOST_RUN, buckets: int = BUCKETS) -> Column:
    """The buckets of all runs of 1 to ``most`` consecutive words."""

    def runs(w: Column) -> Column:
        parts, joined = [F.transform(w, lambda x: bucket_of(x, buckets))], w
        for n in range(2, most + 1):
            rest = F.slice(w, n, F.greatest(F.size(w) - (n - 1), F.lit(0)))
            joined = F.zip_with(F.slice(joined, 1, F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))
            parts.append(F.transform(joined, lambda x: bucket_of(x, buckets)))
        return F.concat(*parts)

    return let(words, runs)


def hashed(docs: DataFrame, most: int = MOST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """(n_words, buckets) beside the columns of ``docs`` but the text."""
    words = let(folded_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), bucket_array(w, most, buckets).alias("b")))
    rows = docs.withColumn("_words", words)
    return rows.select(*[c for c in docs.columns if c != "text"], F.col("_words.n").alias("_n_words"), F.col("_words.b").alias("_buckets"))


def bucket_totals(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(spark, corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of each bucket, in thousandths of a nat: a list as long as there are buckets.

    ``corpus`` and ``target`` come from ``hashed``. The driver gets ``buckets`` numbers.
    """
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(bucket_totals(corpus, "s"), "bucket", "left").join(bucket_totals(target, "t"), "bucket", "left")
    rows = both.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")).toArrow().to_pandas()
    total_s, total_t = int(rows["s"].sum()), int(rows["t"].sum())
    ratio = ((F.col("t") + 1).cast("double") * F.lit(float(total_s + buckets))) / ((F.col("s") + 1).cast("double") * F.lit(float(total_t + buckets)))
    scored = spark.createDataFrame(rows[["bucket", "s", "t"]]).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("g"))
    out = [0] * buckets
    for r in scored.collect():
        out[r["bucket"]] = r["g"]
    return out


def weight_of(buckets: Column, gain: list[int]) -> Column:
    """The floored mean gain of an array of buckets; 0 if it is empty."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into one literal
    total = F.aggregate(buckets, F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b + 1))
    n = F.size(buckets).cast("long")
    return F.when(n > 0, let(total, lambda x: ((x - F.pmod(x, n)) / n))).otherwise(F.lit(0)).cast("long")


def luck(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel variate in thousandths, rounded down, from the hash of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, most: int = MOST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank (null if it isn't drawn), longs.

    Of the N documents with ``least_words`` words, floor(share N) with the highest scores are
    drawn: the sum of the mean log ratio of the target's and the corpus's bucket frequencies
    and a Gumbel variate, so this is sampling without replacement in proportion to the ratio.

    A null text has no words: no features, weight 0, not drawn. A null doc_id has the variate
    of an empty id. Repeated rows are documents of their own; equal scores go to the smaller
    doc_id, null last, then to more features. Empty tables give no rows, or totals of nought.
    Columns beyond doc_id and text are ignored. Ranks come from range-sorted partitions and
    their counts, so no task has all rows.
    """
    spark = docs.sparkSession
    rows = materialize(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), most, buckets), "importance-buckets")
    gain = gains(spark, rows, hashed(target.select("text"), most, buckets), buckets)
    n = F.size("_buckets").cast("long").alias("n_features")
    scored = rows.select("doc_id", n, weight_of(F.col("_buckets"), gain).alias("weight"), "_n_words")
    scored = materialize(scored.withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed)), "importance-scores")
    discard(rows)
    able = scored.filter(F.col("_n_words") >= least_words)
    drawn = able.count() * share[0] // share[1]
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc()]
    placed = prefix_sums(ordered(able.drop("_n_words"), order, "importance-order"), {"_before": F.lit(1).cast("long")})
    ranked = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("_before") < drawn, F.col("_before") + 1).alias("rank"))
    rest = scored.filter(F.col("_n_words") < least_words)
    return ranked.unionAll(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``docs`` that ``resample`` draws; doc_id has to be a key."""
    picked = resample(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(picked, docs["doc_id"] == F.col("_drawn"), "left_semi")
