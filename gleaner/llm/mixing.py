"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, ordered, prefix_sums, words_of

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK = 4096
CHUNK = 4096
BITS = 40
#: Blocks that a source's target must fill to be taken in whole blocks; smaller ones are taken to the word.
LEAST_BLOCKS = 64


def source_targets(slim: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row a source: source, sid (place by code point, null last), size, weight, target.

    Targets share the sum of all sizes by weight; one that exceeds ``max_repeats`` times its
    source's size stops there and the excess is shared again. The driver only holds sums.
    """
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = prefix_sums(ordered(per, [F.col("source").asc_nulls_last()], "mix-sources"), {"sid": F.lit(1).cast("long")})
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int"))
    rows = materialize(rows.select("source", "sid", "source_size", weight.alias("weight")), "mix-weights")
    full = (max_repeats * F.col("source_size")).cast("double")
    level = 0.0
    while True:
        over = F.col("weight") * F.lit(level) > full
        x = rows.agg(F.sum("source_size").alias("t"), F.sum(F.when(over, full)).alias("c"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if not x["w"]:
            break
        then = ((x["t"] or 0) - (x["c"] or 0.0)) / x["w"]
        if then <= level:
            break
        level = then
    return rows.withColumn("target", F.least(F.col("weight") * F.lit(level), full))


def radical_inverse(j: Column, bits: int = BITS) -> Column:
    """The van der Corput point of ``j`` in base 2, times 2^bits: its bits mirrored."""
    return F.conv(F.reverse(F.lpad(F.bin(j), bits, "0")), 2, 10).cast("long")


def slots(spark, sources: DataFrame, n_slots: int, total: float, n_sources: int) -> DataFrame:
    """slot, sid and the slot's rank within its source.

    Slot j's point falls into the span that its source's target covers of the whole. Spans and
    points are whole numbers of 2^-BITS and meet on the cells of a grid, so neither side is
    broadcast or compared with all rows.
    Ranks add up counts of chunks of slots, so a source with most slots is no single window.
    """
    whole = 1 << BITS
    cell_of = lambda x: F.floor(x / F.lit(whole / (4 * n_sources + 16)))
    run = sources.select("sid", F.round(F.col("target") / F.lit(total) * F.lit(float(whole))).cast("long").alias("ticks"))
    run = prefix_sums(ordered(run, [F.col("sid")], "mix-spans"), {"lo": F.col("ticks")})
    spans = run.select("sid", "lo", (F.col("lo") + F.col("ticks")).alias("hi")).filter("hi > lo")
    last = spans.agg(F.max("sid").alias("m")).first()["m"]
    spans = spans.withColumn("hi", F.when(F.col("sid") == F.lit(last), F.greatest("hi", F.lit(whole))).otherwise(F.col("hi")))
    spans = spans.withColumn("cell", F.explode(F.sequence(cell_of(F.col("lo")), cell_of(F.col("hi")))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), radical_inverse(F.col("id")).alias("u"))
    points = points.withColumn("cell", cell_of(F.col("u")))
    got = points.join(spans, "cell").filter("u >= lo and u < hi").select("slot", "sid", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    got = materialize(got, "mix-slots")
    before = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = got.groupBy("sid", "chunk").count().select("sid", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    return got.withColumn("_in", inside).join(counts, ["sid", "chunk"]).select("slot", "sid", (F.col("_base") + F.col("_in")).alias("rank"))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, seed: int = 13, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces): the sizes and targets, and the words of documents that each slot holds.

    Every source's documents are put in an order shuffled by hash, repeated up to
    ``max_repeats`` times, and cut into blocks of equal words; the source's k-th slot of the
    schedule takes its k-th block. ``block`` shrinks on small inputs so that there are at
    least 50,000 blocks and 200 for a source on average. A source whose target is under
    ``LEAST_BLOCKS`` blocks would get several too few or too many of them, or none: it is
    taken to exactly its rounded target, its last block in part, and its blocks are added to
    slots at even distances, so it can't vanish.

    documents: doc_key, doc_id, source, size, source_size, target. pieces: slot, doc_key,
    epoch, from_word, to_word. Null texts and texts without words have size 0 and no pieces;
    a null source is a source of its own; repeated rows are documents of their own; an empty
    table gives no rows. The same rows give the same mix. ``row`` names a column of ``docs``
    that documents shall have as __row.
    """
    spark = docs.sparkSession
    own = F.col(row).cast("long") if row else F.lit(None).cast("long")
    slim = materialize(docs.select(own.alias("__row"), "doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    sources = materialize(source_targets(slim, weights, max_repeats), "mix-targets")
    x = sources.agg(F.sum("source_size").alias("t"), F.sum("target").alias("g"), F.count("*").alias("n")).first()
    total, n_sources = x["t"] or 0, x["n"]
    length = int(min(block, max(1, total // max(50_000, 200 * n_sources))))
    keyed = slim.withColumn("_h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))))
    order = ordered(keyed, [F.col("source").asc_nulls_last(), F.col("_h"), F.col("doc_id"), F.col("size")], "mix-order")
    runs = prefix_sums(order, {"_start": F.col("size"), "doc_key": F.lit(1).cast("long")})
    before = prefix_sums(ordered(sources, [F.col("sid")], "mix-source-order"), {"_source_start": F.col("source_size")})
    before = before.select(F.col("source").alias("_s"), "sid", "source_size", "target", "_source_start")
    runs = runs.join(before, F.col("source").eqNullSafe(F.col("_s")))
    placed = materialize(runs.select("__row", "doc_key", "doc_id", "source", "sid", "size", "source_size", "target", (F.col("_start") - F.col("_source_start")).alias("off")), "mix-places")
    for done in (slim, order):
        discard(done)
    if not total:
        none = placed.select(F.lit(0).cast("long").alias("slot"), "doc_key", F.lit(0).alias("epoch"), F.col("size").alias("from_word"), F.col("size").alias("to_word")).limit(0)
        return placed.drop("sid", "off"), none
    n_slots = max(1, round(x["g"] / length))
    plan = slots(spark, sources, n_slots, float(x["g"]), n_sources)
    epochs = placed.filter("size > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(max_repeats)])))
    epochs = epochs.withColumn("_at", F.col("off") + F.col("epoch") * F.col("source_size")).filter(F.col("_at") < F.col("target") * 1.05 + 64 * length)
    first, final = F.floor(F.col("_at") / length), F.floor((F.col("_at") + F.col("size") - 1) / length)
    cut = epochs.withColumn("rank", F.explode(F.sequence(first, final)))
    lo = F.greatest(F.col("_at"), F.col("rank") * length) - F.col("_at")
    hi = F.least(F.col("_at") + F.col("size"), (F.col("rank") + 1) * length) - F.col("_at")
    small = F.lit(length > 1) & (F.col("target") < LEAST_BLOCKS * length)
    want = F.round("target").cast("long")
    even = F.floor((F.col("rank") + 0.5) * F.lit(n_slots) / F.ceil(want / length)).cast("long")
    few = cut.filter(small).select(even.alias("slot"), "doc_key", "epoch", lo.alias("from_word"), F.least(hi, want - F.col("_at")).alias("to_word")).filter("to_word > from_word")
    pieces = cut.filter(~small).select("sid", "rank", "doc_key", "epoch", lo.alias("from_word"), hi.alias("to_word"))
    return placed.drop("sid", "off"), pieces.join(plan, ["sid", "rank"]).select("slot", "doc_key", "epoch", "from_word", "to_word").unionAll(few)


def _taken(docs: DataFrame, **options) -> DataFrame:
    placed, pieces = mix(docs, **options)
    sums = pieces.groupBy("doc_key").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("_taken"))
    return placed.join(sums, "doc_key", "left").withColumn("taken", F.coalesce("_taken", F.lit(0)).cast("long"))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words of each document in the mix."""
    return _taken(docs, **options).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its words were taken, rounded.

    Documents without words are kept once. Rows are told apart by a number that they get here,
    so those that share a doc_id or have none are documents of their own; columns whose names
    begin with __mix are the only ones that ``docs`` may not have.
    """
    rows = materialize(docs.withColumn("__mix_row", F.monotonically_increasing_id()), "mix-rows")
    taken = _taken(rows, row="__mix_row", **options)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    taken = taken.select(F.col("__row").alias("__mix_row"), copies.alias("__mix_copies")).filter("__mix_copies > 0")
    out = rows.join(taken, "__mix_row").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))))
    return out.select(*docs.columns)
