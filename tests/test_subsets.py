"""Subset fitness and search over tables against the same on arrays."""

import random

import numpy as np
import pytest
from gleaner.operators import search, subsets
from pyspark.sql import functions as F


def pool(spark, n=60):
    rng = random.Random(3)
    words = {"music": "band stage song encore".split(), "food": "chef dish stall bite".split(), "art": "paint canvas wall ink".split()}
    names = sorted(words)
    rows = [(i, " ".join(rng.choices(words[names[i % 3]], k=2) + rng.choices(sum(words.values(), []), k=3)), names[i % 3]) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, "art"), (n + 1, "!", "food"), (None, "song", "music"), (n + 2, "song", None), (0, "zz later", "zzz")], "seq long, description string, label string")


def arrays(rows, terms):
    rows = sorted(rows.collect(), key=lambda r: r["seq"])
    words = sorted({t["word"] for r in terms.collect() for t in r["terms"]})
    x, at, of = np.zeros((len(rows), len(words))), {r["seq"]: i for i, r in enumerate(rows)}, {w: i for i, w in enumerate(words)}
    for r in terms.collect():
        for t in r["terms"]:
            x[at[r["seq"]], of[t["word"]]] = t["weight"]
    return x, np.array([r["label"] for r in rows]), at


@pytest.fixture(scope="module")
def tables(spark):
    rows = subsets.pool_rows(pool(spark)).cache()
    return rows, subsets.pool_terms(rows).cache()


def test_fitness_equals_that_of_arrays(spark, tables):
    rows, terms = tables
    x, y, at = arrays(rows, terms)
    assert rows.count() == 62
    rng = random.Random(5)
    people = [sorted(at), *(rng.choices(sorted(at), k=30) for _ in range(4)), [s for s in sorted(at) if y[at[s]] == "art"], [0, 1, 2]]
    genes = spark.createDataFrame([(i, s) for i, p in enumerate(people) for s in p], "individual int, seq long")
    got = {r["individual"]: r for r in subsets.subset_fitness(genes, subsets.fold_guesses(genes, rows, terms)).collect()}
    for i, p in enumerate(people):
        assert got[i]["n_rows"] == len(set(p))
        assert got[i]["fitness"] == pytest.approx(search.nearest_centroid_accuracy(x, y, [at[s] for s in p]))
    assert got[5]["n_folds"] == 0 and got[6]["fitness"] == 0.0


def test_centroids_joined_without_broadcast_agree(spark, tables, monkeypatch):
    rows, terms = tables
    genes = rows.select(F.lit(0).alias("individual"), "seq")
    fitness = lambda: subsets.subset_fitness(genes, subsets.fold_guesses(genes, rows, terms)).first()["fitness"]
    was = fitness()
    monkeypatch.setattr(subsets, "BROADCAST_ROWS", 0)
    assert fitness() == was


def test_search_is_no_worse_than_its_start_and_reruns_agree(spark, tables):
    rows, terms = tables
    x, y, at = arrays(rows, terms)
    run = lambda: {(r["seq"], r["label"]): r["fitness"] for r in subsets.search_subset(spark, pool(spark), population=5, generations=2).collect()}
    found = run()
    score = next(iter(found.values()))
    assert score == pytest.approx(search.nearest_centroid_accuracy(x, y, [at[s] for s, _ in found]))
    assert score >= search.nearest_centroid_accuracy(x, y, search.balanced_start(y)) - 1e-12
    assert run() == found


def test_empty_pool(spark):
    assert subsets.search_subset(spark, pool(spark).limit(0), population=3, generations=1).count() == 0
