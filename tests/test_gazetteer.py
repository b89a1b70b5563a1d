"""Tolerant lookup against comparing all pairs."""

import random

import pytest
from gleaner.operators import gazetteer
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, was = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize(("edits", "q"), [(1, 2), (2, 2), (2, 3), (3, 2)])
def test_no_pair_is_lost(spark, edits, q):
    rng = random.Random(edits * 10 + q)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    known = {word(rng.randrange(14)) for _ in range(150)} | {"", "a", "aaaaaaaaaa", "Hall, 5 Main Street"}
    asked = set()
    for name in known:
        text = list(name)
        for _ in range(rng.randrange(edits + 2)):
            at = rng.randrange(len(text) + 1)
            text[at : at + rng.randrange(2)] = rng.choice(["", "a", "z"])
        asked.add("".join(text))
    frame = lambda names: spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {(r["name"], r["match"], r["distance"]) for r in gazetteer.close_names(frame(asked), frame(known), edits, q).collect()}
    assert got == {(a, b, d) for a in asked for b in known if (d := distance(a, b)) <= edits}


def test_lookup(spark):
    places = spark.createDataFrame([("Town Hall", 1.0, 2.0), ("Town Mall", 3.0, 4.0), ("Town Hall", 9.0, 9.0), (None, 0.0, 0.0)], "address string, lat double, long double")
    venues = spark.createDataFrame([("Town Hall",), ("Town Wall",), ("Twn Hal",), ("Elsewhere",), ("Town Hall",)], "venue string")
    got = {r["venue"]: (r["address"], r["distance"], r["lat"]) for r in gazetteer.lookup_tolerant(venues, places).collect()}
    assert got == {"Town Hall": ("Town Hall", 0, 1.0), "Town Wall": ("Town Hall", 1, 1.0), "Twn Hal": ("Town Hall", 2, 1.0), "Elsewhere": (None, None, None)}


def test_deletions(spark):
    got = spark.range(1).select(gazetteer.deletions(F.lit("abc"), 2), gazetteer.deletions(F.lit(""), 2)).first()
    assert sorted(got[0]) == ["a", "ab", "abc", "ac", "b", "bc", "c"] and got[1] == [""]
