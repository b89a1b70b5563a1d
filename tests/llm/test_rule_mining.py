"""Mined rules against brute force, at the exact thresholds and of any length, both ways."""

import itertools
import random
from fractions import Fraction

import pytest
from gleaner.llm import urlrules
from pyspark.sql import functions as F


def brute(rows, backing, confidence):
    """Rules of sets of tokens that no part of theirs equals or beats: {tokens: confidence}."""
    found = {}
    for tokens, bad in rows:
        for size in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), size):
                b, m = found.get(part, (0, 0))
                found[part] = (b + bad, m + 1)
    rules = {t: Fraction(b, m) for t, (b, m) in found.items() if b >= backing and Fraction(b, m) >= confidence}
    beaten = lambda t: any(rules.get(p, -1) >= rules[t] for k in range(1, len(t)) for p in itertools.combinations(t, k))
    return {t: c for t, c in rules.items() if not beaten(t)}


def mined(spark, rows, **how):
    urls = spark.createDataFrame([(i, "http://" + "/" + "".join(f"/{t}" for t in sorted(ts))) for i, (ts, _) in enumerate(rows)], "url_id long, url string")
    labels = spark.createDataFrame([(i, bool(bad)) for i, (_, bad) in enumerate(rows)], "url_id long, bad boolean")
    return {tuple(t.removeprefix("p:") for t in r["tokens"]): r["confidence"] for r in urlrules.mine_rules(urls, labels, **how).collect()}


@pytest.mark.parametrize("longest", [12, 0])
def test_exact_support(spark, longest):
    """26 of 1,445 labelled urls back the rule; a share of them, rounded up again, would ask for 27."""
    rows = [(("spam",), 1)] * 26 + [((f"{chr(97 + i % 26)}x",), 0) for i in range(1419)]
    assert mined(spark, rows, support=0.0179, least=1, longest=longest) == {("spam",): 1.0}
    assert mined(spark, rows, support=0.005, least=26, longest=longest) == {("spam",): 1.0}
    assert mined(spark, rows, support=0.005, least=27, longest=longest) == {}


@pytest.mark.parametrize("longest", [12, 0])
def test_exact_confidence(spark, longest):
    rows = [(("half", "way"), 1)] * 9 + [(("half", "on"), 0)] * 6 + [(("on",), 0)] * 5
    assert mined(spark, rows, support=0.0, least=9, confidence=0.6, longest=longest) == {("half",): 0.6, ("way",): 1.0}
    assert mined(spark, rows, support=0.0, least=9, confidence=0.61, longest=longest) == {("way",): 1.0}


@pytest.mark.parametrize("longest", [12, 0])
def test_long_rules(spark, longest):
    """Only all five tokens together are always unwanted."""
    five = ("a", "b", "c", "d", "e")
    rows = [(five, 1)] * 8 + [(tuple(x for x in five if x != gone), 0) for gone in five for _ in range(4)]
    assert mined(spark, rows, support=0.0, least=5, confidence=0.9, longest=longest) == {five: 1.0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(tuple(t for t in "abcdefg" if rng.random() < 0.5), int(rng.random() < 0.45)) for _ in range(300)]
    rows = [(t, int(b or {"a", "c"} <= set(t) and rng.random() < 0.5 or {"b", "d", "g"} <= set(t))) for t, b in rows if t]
    want = brute(rows, 12, Fraction(3, 5))
    assert want
    for longest in (12, 0):
        got = mined(spark, rows, support=0.0, least=12, confidence=0.6, longest=longest)
        assert set(got) == set(want) and all(abs(got[t] - float(want[t])) < 1e-12 for t in got)


def test_no_labels(spark):
    urls = spark.createDataFrame([(1, "http://a/b")], "url_id long, url string")
    assert urlrules.mine_rules(urls, urls.select("url_id", F.lit(True).alias("bad")).limit(0)).count() == 0
