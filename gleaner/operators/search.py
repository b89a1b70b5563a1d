"""Genetic search for a training subset: the loop on the driver, fitness as one Spark job a generation."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gleaner.operators.ml import tfidf, vocabulary


def nearest_centroid_accuracy(x: np.ndarray, y: np.ndarray, genes: list[int], folds: int = 5) -> float:
    """Mean stratified k-fold accuracy of a nearest-centroid classifier on the distinct rows picked."""
    idx = np.array(sorted(set(genes)))
    if len(idx) < 2:
        return 0.0
    labels, counts = np.unique(y[idx], return_counts=True)
    k = min(folds, int(counts.min()))
    if k < 2 or len(labels) < 2:
        return 0.0
    fold = np.zeros(len(idx), int)
    for label in labels:
        at = np.flatnonzero(y[idx] == label)
        fold[at] = np.arange(len(at)) % k
    scores = []
    for f in range(k):
        train, held = idx[fold != f], idx[fold == f]
        centres = np.stack([x[train[y[train] == label]].mean(axis=0) for label in labels])
        scores.append(float((labels[np.argmax(x[held] @ centres.T, axis=1)] == y[held]).mean()))
    return float(np.mean(scores))


def logistic_accuracy(x: np.ndarray, y: np.ndarray, genes: list[int], folds: int = 5, steps: int = 60, penalty: float = 1.0) -> float:
    """Mean stratified k-fold accuracy of logistic regression, one against the rest, on the distinct rows picked.

    The weights are sums of training rows, so a step works on the products of rows alone.
    """
    idx = np.array(sorted(set(genes)))
    labels, counts = np.unique(y[idx], return_counts=True) if len(idx) else (np.zeros(0), np.zeros(0))
    k = min(folds, int(counts.min())) if len(idx) > 1 else 0
    if k < 2 or len(labels) < 2:
        return 0.0
    fold = np.zeros(len(idx), int)
    for label in labels:
        at = np.flatnonzero(y[idx] == label)
        fold[at] = np.arange(len(at)) % k
    products = (x[idx] @ x[idx].T).astype(np.float64) + 1.0
    scores = []
    for f in range(k):
        train, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        gram, want = products[np.ix_(train, train)], (y[idx][train][:, None] == labels[None, :]).astype(float)
        rate = 4.0 / (np.trace(gram) + penalty)
        alpha = np.zeros(want.shape)
        for _ in range(steps):
            alpha += rate * (want - 1 / (1 + np.exp(-(gram @ alpha))) - penalty * alpha / len(train))
        guess = labels[np.argmax(products[np.ix_(held, train)] @ alpha, axis=1)]
        scores.append(float((guess == y[idx][held]).mean()))
    return float(np.mean(scores))


def fits_driver(rows: int, size: int = 2000, limit_mb: int = 256) -> bool:
    """Whether the features of so many rows are at most ``limit_mb``."""
    return rows * size * 4 <= limit_mb << 20


def pool_features(pool: DataFrame, key: str, text: str, label: str, size: int = 2000, limit_mb: int = 256) -> tuple[np.ndarray, np.ndarray, list]:
    """(TF-IDF rows, labels, keys) of a training pool in the order of its keys.

    The search holds them on the driver, so a pool whose features would exceed ``limit_mb`` is refused.
    """
    rows = pool.count()
    if not fits_driver(rows, size, limit_mb):
        raise ValueError(f"the features of {rows} rows exceed {limit_mb} MB; give a smaller pool or raise limit_mb")
    words = [r["word"] for r in vocabulary(pool, text, size).collect()]  # ``size`` words
    of = {w: i for i, w in enumerate(words)}
    keys = [r[key] for r in pool.select(key).orderBy(key).collect()]
    at, x = {k: i for i, k in enumerate(keys)}, np.zeros((rows, size), np.float32)
    named = pool.sparkSession.createDataFrame([(w,) for w in words], "word string")
    for r in tfidf(pool, key, text).join(named, "word", "left_semi").toLocalIterator():
        x[at[r[key]], of[r["word"]]] = r["weight"]
    y = np.array([r[label] for r in pool.select(key, label).orderBy(key).collect()])
    return x, y, keys


def balanced_start(y: np.ndarray) -> list[int]:
    """As many of the first rows of each class as the smallest one has."""
    labels, counts = np.unique(y, return_counts=True)
    return [int(i) for label in labels for i in np.flatnonzero(y == label)[: int(counts.min())]]


def evaluate(spark: SparkSession, population: list[list[int]], features, fitness=nearest_centroid_accuracy) -> list[float]:
    """Fitness of every individual; a row each, spread over the cluster, the features broadcast.

    ``features`` is a broadcast (x, y) of the training pool, whose size the caller has checked.
    """

    def run(batches):
        x, y = features.value
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "fitness": [fitness(x, y, list(g)) for g in pdf["genes"]]})

    rows = spark.createDataFrame([(i, g) for i, g in enumerate(population)], "id int, genes array<int>")
    got = rows.repartition(min(len(population), spark.sparkContext.defaultParallelism)).mapInPandas(run, "id int, fitness double").collect()
    return [r["fitness"] for r in sorted(got, key=lambda r: r["id"])]


def first_population(size: int, genes: int, pool: int, balanced: list[int], rng: random.Random) -> list[list[int]]:
    """The balanced subset, and individuals that keep about half of it and fill up with other rows."""
    out = [list(balanced[:genes])]
    while len(out) < size:
        kept = [g for g in balanced if rng.random() < 0.5][:genes]
        rest = [g for g in range(pool) if g not in set(kept)]
        out.append(kept + rng.sample(rest, min(genes - len(kept), len(rest))))
    return out


def search(spark: SparkSession, x: np.ndarray, y: np.ndarray, balanced: list[int], population: int = 30, generations: int = 10, mutation: tuple[float, float] = (0.25, 0.06), tournament: int = 3, seed: int = 42, limit_mb: int = 256, fitness=nearest_centroid_accuracy) -> tuple[list[int], float]:
    """(positions, fitness) of the best subset: tournaments, scattered crossover, adaptive mutation, one survivor.

    Individuals below the mean fitness mutate at the first rate, the others at the second. The
    pool's features are broadcast, so they may not exceed ``limit_mb``.
    """
    if x.nbytes > limit_mb << 20:
        raise ValueError(f"the pool's features take {x.nbytes >> 20} MB; sample the pool or raise limit_mb")
    rng = random.Random(seed)
    features = spark.sparkContext.broadcast((x, y))
    people = first_population(population, len(balanced), len(y), balanced, rng)
    scores = evaluate(spark, people, features, fitness)
    for _ in range(generations):
        mean = sum(scores) / len(scores)
        best = max(range(len(people)), key=lambda i: (scores[i], -i))
        pick = lambda: max(rng.sample(range(len(people)), min(tournament, len(people))), key=lambda i: scores[i])  # noqa: B023,E731
        children = [people[best]]
        while len(children) < population:
            a, b = pick(), pick()
            child = [p if rng.random() < 0.5 else q for p, q in zip(people[a], people[b], strict=True)]
            rate = mutation[0] if max(scores[a], scores[b]) < mean else mutation[1]
            children.append([rng.randrange(len(y)) if rng.random() < rate else g for g in child])
        people, scores = children, evaluate(spark, children, features, fitness)
    best = max(range(len(people)), key=lambda i: (scores[i], -i))
    features.unpersist()
    return sorted(set(people[best])), scores[best]


def export_best(pool: DataFrame, test: DataFrame, positions: list[int], seq: str = "seq") -> DataFrame:
    """The picked rows of the pool and the test set together."""
    spark = pool.sparkSession
    picks = spark.createDataFrame([(p,) for p in positions], f"{seq} long")
    return pool.join(picks, seq, "left_semi").unionByName(test, allowMissingColumns=True)
