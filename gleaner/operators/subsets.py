"""Search for a training subset whose population, features and guesses are tables; only scores come to the driver."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.corpus import balanced
from gleaner.operators.ml import VOCABULARY, tfidf, vocabulary
from gleaner.operators.numbering import discard, materialize, numbered

#: Rows of centroid weights, of some 50 bytes, up to which they are broadcast.
BROADCAST_ROWS = 1_000_000


def pool_rows(pool: DataFrame, key: str = "seq", text: str = "description", label: str = "label") -> DataFrame:
    """(seq, label, description) with one row a key, the smallest; rows without a key or a label are left out."""
    least = F.min(F.struct(F.col(label).alias("label"), F.col(text).alias("description"))).alias("_least")
    rows = pool.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("seq")).agg(least)
    return rows.select("seq", "_least.label", "_least.description")


def pool_terms(rows: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """(seq, terms): a text's TF-IDF weights of the ``size`` most frequent words; no row for texts without such."""
    kept = tfidf(rows, "seq", "description").join(F.broadcast(vocabulary(rows, "description", size).select("word")), "word", "left_semi")
    return kept.groupBy("seq").agg(F.collect_list(F.struct("word", "weight")).alias("terms"))


def fold_guesses(genes: DataFrame, rows: DataFrame, terms: DataFrame, folds: int = 5) -> DataFrame:
    """(individual, fold, seq, label, guess) of nearest centroids, each trained on an individual's other folds.

    ``genes`` (individual, seq) may repeat rows, which count once. Rows of a class take turns in
    the order of seq; an individual has as many folds as its smallest class has rows, at most
    ``folds``. One with fewer than two folds or classes has no guesses. A row goes to the class
    whose mean vector has the largest product with its own; of equal ones, as where no word is
    shared, to the first by name.

    A class may hold any share of the rows: places are global numbers, sums combine before the
    shuffle. Centroids are at most individuals times folds times classes times words.
    """
    picked = numbered(genes.select("individual", "seq").distinct().join(rows.select("seq", "label"), "seq"), ["individual", "label"], [F.col("seq")], "_place")
    picked = materialize(picked, "subset-rows")
    plan = picked.groupBy("individual", "label").agg(F.count("*").alias("n")).groupBy("individual")
    plan = plan.agg(F.least(F.min("n"), F.lit(folds)).alias("k"), F.count("*").alias("classes"), F.min("label").alias("first")).where("k > 1 and classes > 1")
    placed = picked.join(plan, "individual").withColumn("fold", F.pmod("_place", "k").cast("int")).drop("_place", "classes")

    others = F.explode(F.filter(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda f: f != F.col("fold")))
    counts = placed.groupBy("individual", "label", "fold", "k").agg(F.count("*").alias("n")).select("individual", "label", others.alias("fold"), "n")
    counts = counts.groupBy("individual", "fold", "label").agg(F.sum("n").alias("n"))
    words = placed.join(terms, "seq").select("individual", "fold", "k", "seq", "label", F.explode("terms").alias("t")).select("*", "t.word", "t.weight").drop("t")
    sums = words.groupBy("individual", "label", "fold", "k", "word").agg(F.sum("weight").alias("s")).select("individual", "label", "word", "s", others.alias("fold"))
    sums = sums.groupBy("individual", "fold", "label", "word").agg(F.sum("s").alias("s")).join(counts, ["individual", "fold", "label"])
    centres = materialize(sums.select("individual", "fold", "word", F.col("label").alias("guess"), (F.col("s") / F.col("n")).alias("c")), "subset-centres")

    small = F.broadcast(centres) if centres.count() <= BROADCAST_ROWS else centres
    scores = words.select("individual", "fold", "seq", "word", "weight").join(small, ["individual", "fold", "word"])
    scores = scores.groupBy("individual", "seq", "guess").agg(F.round(F.sum(F.col("weight") * F.col("c")), 9).alias("score")).where("score > 0")
    best = scores.groupBy("individual", "seq").agg(F.min(F.struct(-F.col("score"), F.col("guess").alias("guess"))).alias("_best"))
    return placed.join(best, ["individual", "seq"], "left").select("individual", "fold", "seq", "label", F.coalesce("_best.guess", "first").alias("guess"))


def subset_fitness(genes: DataFrame, guesses: DataFrame) -> DataFrame:
    """(individual, n_rows, n_folds, fitness): the mean over folds of the share of right guesses; 0 without folds."""
    right = guesses.groupBy("individual", "fold").agg(F.avg((F.col("guess") == F.col("label")).cast("double")).alias("a"))
    right = right.groupBy("individual").agg(F.count("*").alias("n_folds"), F.avg("a").alias("fitness"))
    n = genes.groupBy("individual").agg(F.count_distinct("seq").alias("n_rows"))
    none = F.lit(0)
    return n.join(right, "individual", "left").select("individual", "n_rows", F.coalesce("n_folds", none).alias("n_folds"), F.coalesce("fitness", none.cast("double")).alias("fitness"))


def _draw(seed: int, *parts: Column) -> Column:
    """A number from 0 to 2^31 - 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 33)


def _first_population(start: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """(individual, slot, row): the balanced rows, and individuals that keep each with even odds or draw another."""
    people = start.withColumn("individual", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    kept = (F.col("individual") == 0) | (_draw(seed, F.lit("keep"), F.col("individual"), F.col("slot")) % 2 == 0)
    drawn = _draw(seed, F.lit("draw"), F.col("individual"), F.col("slot")) % n
    return people.select("individual", "slot", F.when(kept, F.col("row")).otherwise(drawn).alias("row"))


def _next_population(people: DataFrame, plan: list[tuple[int, int, int, float]], n: int, seed: int, generation: int) -> DataFrame:
    """Children by ``plan`` (child, parents, mutation rate): each slot from one of the parents by even odds, or drawn anew.

    A parent's genes go to its children straight away, so nothing is shuffled.
    """
    sides = [(c, p, side, rate) for c, a, b, rate in plan for side, p in enumerate((a, b))]
    of = people.sparkSession.createDataFrame(sides, "child int, individual int, side int, rate double")
    at = [F.lit(generation), F.col("child"), F.col("slot")]
    genes = people.join(F.broadcast(of), "individual").where(_draw(seed, F.lit("side"), *at) % 2 == F.col("side"))  # two rows a child
    mutates = _draw(seed, F.lit("mutates"), *at) < F.col("rate") * 2.0**31
    return genes.select(F.col("child").alias("individual"), "slot", F.when(mutates, _draw(seed, F.lit("drawn"), *at) % n).otherwise(F.col("row")).alias("row"))


def search_subset(
    spark: SparkSession, pool: DataFrame, key: str = "seq", text: str = "description", label: str = "label", population: int = 30, generations: int = 10, mutation: tuple[float, float] = (0.25, 0.06), tournament: int = 3, folds: int = 5, seed: int = 42, size: int = VOCABULARY
) -> DataFrame:
    """(seq, label, fitness): the rows of the best subset that a genetic search finds in a pool of any size.

    The first individual is the balanced subset; tournaments choose parents, slots cross over by
    even odds, individuals below the mean mutate at the first rate, others at the second; the
    best survives. Parents are chosen on the driver from one score an individual; genes,
    features and guesses stay in tables. Draws are hashes, so reruns agree. A pool without two
    rows of two classes gives its balanced subset with fitness 0; an empty one gives no rows.
    """
    rows = materialize(numbered(pool_rows(pool, key, text, label), [], [F.col("seq")], "row"), "subset-pool")
    terms, n = materialize(pool_terms(rows, size), "subset-terms"), rows.count()
    start = numbered(balanced(rows, "label", F.col("seq")).select("row"), [], [F.col("row")], "slot")
    people = materialize(_first_population(start, max(n, 1), population, seed), "subset-genes")
    rng = random.Random(seed)

    def scored(people: DataFrame) -> list[float]:
        genes = people.join(rows.select("row", "seq"), "row").select("individual", "seq")
        got = subset_fitness(genes, fold_guesses(genes, rows, terms, folds)).collect()  # a row an individual
        of = {r["individual"]: r["fitness"] for r in got}
        return [of.get(i, 0.0) for i in range(population)]

    best_of = lambda scores: max(range(population), key=lambda i: (scores[i], -i))
    scores = scored(people)
    for generation in range(generations):
        mean, best, plan = sum(scores) / population, best_of(scores), []
        pick = lambda: max(rng.sample(range(population), min(tournament, population)), key=lambda i: scores[i])  # noqa: B023,E731
        for child in range(1, population):
            a, b = pick(), pick()
            plan.append((child, a, b, mutation[0] if max(scores[a], scores[b]) < mean else mutation[1]))
        before, people = people, materialize(_next_population(people, [(0, best, best, 0.0), *plan], max(n, 1), seed, generation), "subset-genes")
        discard(before)
        scores = scored(people)
    best = best_of(scores)
    found = people.where(F.col("individual") == best).select("row").distinct()
    return rows.join(found, "row", "left_semi").select("seq", "label", F.lit(float(scores[best])).alias("fitness"))
