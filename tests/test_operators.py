"""Operators on small inline tables, with order-dependent and degenerate cases."""

import random

import numpy as np
import pytest
from gleaner.operators import category, corpus, dedupe, evaluate, filters, history, ml, publish, search, summary
from pyspark.sql import functions as F


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_prefer_nonempty(spark):
    data = [(1, "a", None), (2, "a", "x"), (3, "a", ""), (4, "b", ""), (5, "b", None), (6, "c", "p"), (7, "c", "q"), (8, None, "z")]
    df = spark.createDataFrame(data, "seq long, id string, imageUrl string")
    got = rows(dedupe.prefer_nonempty(df, ["id"], "seq", F.col("imageUrl")), "first_seq")
    assert got == [(2, "a", "x", 1), (4, "b", "", 4), (7, "c", "q", 6), (8, None, "z", 8)]
    assert dedupe.prefer_nonempty(df.limit(0), ["id"], "seq", F.col("imageUrl")).count() == 0


def test_dedupe_is_idempotent(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("abcd"), "v", "s", rng.choice(["", None, "x", "y"])) for i in range(60)]
    df = spark.createDataFrame(data, "seq long, name string, venue string, source string, imageUrl string")
    once = publish.dedupe_events(df).drop("first_seq")
    assert rows(publish.dedupe_events(once.drop("id")).select(*once.columns), "seq") == rows(once, "seq")


def test_first_wins_on_title_equals_title_or_description(spark):
    rng = random.Random(5)
    data = [(i, rng.choice(["t1", "t2", "t3"]) + rng.choice(["", ", x", ", y"])) for i in range(80)]
    seen, want = set(), []
    for i, d in data:
        title = d.split(",")[0]
        if d in seen or title in seen:
            continue
        seen |= {d, title}
        want.append((i, d))
    assert rows(corpus.first_per_title(spark.createDataFrame(data, "seq long, description string")), "seq") == want


def test_history(spark):
    front = spark.createDataFrame([("u1", "t1"), ("u2", "t2"), ("u3", "t3"), (None, "t9")], "url string, title string")
    past = spark.createDataFrame([("u1", "t8"), ("u7", "t2")], "url string, title string")
    banned = spark.createDataFrame([("u3",)], "url string")
    assert {r["url"] for r in history.unseen(front, history.seen_urls(past, banned)).collect()} == {"u2", None}
    assert {r["url"] for r in history.unseen_url_or_title(front, past).collect()} == {"u3", None}
    sources = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "source string, ord int")
    assert [r["fetch"] for r in history.sources_from(sources, "b").orderBy("ord").collect()] == [False, True, True]
    assert all(r["fetch"] for r in history.sources_from(sources, None).collect())


def test_split_future(spark):
    df = spark.sql("select 's' source, 'u' url, array(timestamp'2020-01-01', timestamp'2030-01-01') dates union all select 's', 'v', array(timestamp'2020-01-01')")
    keep, ban = history.split_future(df, F.lit("2024-01-01").cast("timestamp"))
    assert [r["url"] for r in keep.collect()] == ["u"] and [r["url"] for r in ban.collect()] == ["v"]


def test_filters(spark):
    row = spark.range(1)
    one = lambda c: row.select(c.alias("x")).first()["x"]
    assert one(filters.is_closed(F.lit("SOLD OUT today"))) is True
    assert one(filters.not_past(F.array().cast("array<timestamp>"), F.lit("2024-01-01").cast("timestamp"))) is True
    assert one(filters.not_skipped(F.lit(None).cast("boolean"))) is True
    assert one(filters.unlabelled(F.lit(None).cast("array<string>"))) is True
    assert one(filters.has_parts(F.lit("3 May 7:30"), r"\d+ [A-Z]", r"\d:\d\d")) is True
    assert one(filters.has_lines(F.lit("a\nb"), 3)) is False
    assert one(filters.menu_entry(F.lit("Italian Festival"), ["Now"])) is True
    assert one(filters.not_expired(F.lit("http://x/i?oe=10"), F.lit("2024-01-01").cast("timestamp"))) is False


def test_categories(spark):
    dim = spark.createDataFrame([("Business", "Business & Networking"), ("Jazz", "Music & Concerts")], "raw string, canonical string")
    df = spark.createDataFrame([(1, "Business"), (2, "Jazz"), (3, "?"), (4, None), (5, "Business & Networking")], "seq int, category string")
    once = category.map_category(df, dim)
    assert [r["category"] for r in once.orderBy("seq").collect()] == ["Business & Networking", "Music & Concerts", "Other", "Other", "Business & Networking"]
    assert rows(category.map_category(once, dim), "seq") == rows(once, "seq")
    assert [r["category"] for r in category.map_category(once, dim, legacy=True).orderBy("seq").collect()][0] == "Other"
    assert {r["raw"] for r in category.unmapped(df, dim).collect()} == {"?", "Business & Networking"}
    ids = spark.createDataFrame([(1, "b", 1, 0), (1, "a", 0, 5), (2, "b", 1, 0)], "id int, category string, tier int, seq int")
    assert rows(category.priority_lookup(spark.createDataFrame([(1,), (2,), (3,)], "k int"), ids, "k"), "k") == [(1, "a"), (2, "b"), (3, "Other")]


def test_facets(spark):
    df = spark.createDataFrame([("Other",), ("b",), ("a",), ("b",), (None,)], "eventType string")
    assert rows(publish.event_types(df), "ord") == [(1, "a"), (2, "b"), (3, "Other")]
    assert rows(publish.event_types(df.limit(0)), "ord") == [(1, "Other")]
    prices = spark.createDataFrame([(-3.0,), (-1.0,)], "price double")
    assert tuple(publish.price_range(prices).first()) == (-3.0, 0.0)
    assert tuple(publish.price_range(prices.limit(0)).first()) == (float("inf"), 0.0)


def test_upsert_keeps_the_old_row(spark):
    old = spark.createDataFrame([("t", "old", "i0")], "title string, text string, image string")
    new = spark.createDataFrame([("t", "new", "i1"), ("n", "x", "i2")], "title string, text string, image string")
    assert rows(publish.upsert_by_title(new, old, "title", ["image"]), "title") == [("n", "x", "i2"), ("t", "old", "i1")]


def test_lookup_and_gather(spark):
    venues = spark.createDataFrame([("A, B",), ("A, B",), ("C",)], "venue string")
    places = spark.createDataFrame([("B", 1.0, 2.0), ("A, B", 3.0, 4.0)], "address string, lat double, long double")
    got = publish.lookup_coordinates(venues, places, F.array(F.lit("zz"), F.col("venue"), F.lit("B")))
    assert rows(got, "venue") == [("A, B", 3.0, 4.0), ("C", 1.0, 2.0)]
    data = spark.createDataFrame([(i, str(i)) for i in range(5)], "seq int, v string")
    assert rows(publish.gather(data, spark.createDataFrame([([1, 3, 1],)], "idx array<int>")), "seq") == [(1, "1"), (3, "3")]
    zipped = spark.range(1).select(publish.zip_lists(F.array(F.lit(1), F.lit(2), F.lit(3)), F.array(F.lit("a"), F.lit("b"))).alias("z")).first()["z"]
    assert [tuple(x) for x in zipped] == [(1, "a"), (2, "b")]


def test_splits_are_disjoint_and_balanced(spark):
    data = [(i, "a" if i < 12 else "b" if i < 20 else "c", f"d{i}") for i in range(30)]
    df = spark.createDataFrame(data, "seq long, label string, description string")
    order = corpus.shuffled(F.col("seq"), 42)
    test = corpus.test_split(df, "label", 0.4, order)
    assert {r["label"]: r["n"] for r in corpus.class_counts(test).collect()} == {"a": 3, "b": 3, "c": 3}
    pool = corpus.train_pool(df, test)
    assert pool.count() == 21 and pool.join(test, "seq").count() == 0
    assert {r["n"] for r in corpus.class_counts(corpus.balanced(pool, "label", F.col("seq"))).collect()} == {5}
    folds = corpus.kfold(df, "label", 5, F.col("seq")).groupBy("label", "fold").count().collect()
    assert len(folds) == 15
    lone = df.unionAll(spark.createDataFrame([(99, "z", "q")], df.schema))
    assert corpus.kfold(lone, "label", 5, F.col("seq")).count() == 0
    assert corpus.test_split(df.limit(0), "label", 0.4, order).count() == 0


def test_undersample(spark):
    df = spark.createDataFrame([(i, i < 3) for i in range(10)], "seq long, pos boolean")
    assert rows(corpus.undersample(df, F.col("pos"), F.col("seq")), "seq") == [(0, True), (1, True), (2, True), (4, False), (5, False)]


def test_ingest(spark):
    old = spark.createDataFrame([("n, known~~x", "l")], "description string, label string")
    events = spark.createDataFrame([(1, "n", "known", "t"), (2, "m", "new~~cut", "t"), (3, "m", "new", "u"), (4, "m", "~~empty", "t")], "seq long, name string, long_description string, eventType string")
    got = rows(corpus.ingest(events, old, ("~~",), "zz").select("description", "label", "new", "skip"), "label", "description")
    assert got == [("n, known", "l", None, True), ("m, new", "t", True, True)]


@pytest.mark.parametrize(("scores", "want"), [([1.0, 0.5, 0.1], [0, 1]), ([1.0, 0.49], [0]), ([0.3, 0.3, 0.3], [0, 1]), ([0.2, 0.9, 0.46], [1, 2])])
def test_top_two(spark, scores, want):
    got = spark.createDataFrame([(scores,)], "s array<double>").select(evaluate.top_two(F.col("s")).alias("t")).first()["t"]
    assert [x["cls"] for x in got] == want


def test_evaluation(spark):
    df = spark.createDataFrame([("a", ["a", "b"]), ("a", ["b"]), ("b", ["b"])], "given string, got array<string>")
    correct = evaluate.is_correct(F.col("got"), F.col("given"))
    assert tuple(evaluate.accuracy(df, correct).first()) == (3, 2, 0.666667)
    assert evaluate.accuracy(df.limit(0), correct).first()["accuracy"] is None
    assert [tuple(r) for r in evaluate.accuracy_by_class(df, "given", correct).collect()] == [("b", 1, 1, 1.0), ("a", 2, 1, 0.5)]
    flagged = df.withColumn("new", F.lit(True)).select(evaluate.review_label(F.col("given"), F.col("new")).alias("x"))
    assert flagged.first()["x"] == "a\nnew"


def test_chunked(spark):
    got = rows(dedupe.chunked(spark.range(0, 45, 1, 4), 20, F.col("id")), "id")
    assert [c for _, c in got] == [0] * 20 + [1] * 20 + [2] * 5


def test_vocabulary_and_sequences(spark):
    df = spark.createDataFrame([(1, "The cat, the dog."), (2, "a cat")], "id int, text string")
    assert rows(ml.vocabulary(df, "text", 2), F.desc("n"), "word") == [("cat", 2), ("the", 2)]
    got = ml.sequences(df, "text", ["cat", "the"], 3).orderBy("id").collect()
    assert [r["sequence"] for r in got] == [[2, 3, 1], [1, 2, 0]]


def test_classifier_round_trip(spark, tmp_path):
    data = [(i, "music song band" if i % 2 else "food cake bread", "m" if i % 2 else "f") for i in range(30)]
    df = spark.createDataFrame(data, "seq long, description string, label string")
    for kind in ("logistic", "ovr"):
        model = ml.train_classifier(df, kind=kind)
        ml.save_model(model, str(tmp_path / kind))
        assert ml.predict(ml.load_model(str(tmp_path / kind)), df).where("predicted <> label").count() == 0
    assert ml.cross_accuracy(df, "description", "label", 3) == 1.0
    assert ml.cross_accuracy(df.limit(1), "description", "label", 3) == 0.0


def test_search_improves_on_nothing(spark):
    rng = np.random.default_rng(0)
    y = np.array([i % 3 for i in range(60)])
    x = (np.eye(3)[y] + rng.normal(0, 0.6, (60, 3))).astype(np.float32)
    start = list(range(12))
    picks, score = search.search(spark, x, y, start, population=8, generations=3)
    assert score >= search.nearest_centroid_accuracy(x, y, start) and len(set(picks)) == len(picks)
    assert search.nearest_centroid_accuracy(x, y, [1]) == 0.0 and search.nearest_centroid_accuracy(x, y, [0, 1, 2]) == 0.0


def test_lexrank():
    assert summary.lexrank("One. Two.") == "One.\nTwo."
    text = " ".join(f"The cat sat on mat {i}." for i in range(6)) + " Unrelated zebra quux."
    got = summary.lexrank(text, 5).split("\n")
    assert len(got) == 5 and "Unrelated zebra quux." not in got
    assert summary.lexrank(None) == ""


def test_numbers_within_a_key_that_holds_most_rows(spark):
    from gleaner.operators.numbering import numbered, ordered, prefix_sums

    data = [(i, None if i % 50 == 0 else "hot" if i % 3 else "cold") for i in range(500)]
    df = spark.createDataFrame(data, "seq long, k string").repartition(7)
    got = {(r["k"], r["seq"]): r["number"] for r in numbered(df, ["k"], [F.col("seq")]).collect()}
    for key in (None, "hot", "cold"):
        own = sorted(s for s, k in data if k == key)
        assert [got[key, s] for s in own] == list(range(len(own)))
    assert numbered(df.limit(0), ["k"], [F.col("seq")]).count() == 0
    sums = prefix_sums(ordered(df, [F.col("seq")], "t"), {"before": F.col("seq")}, block=16)
    assert all(r["before"] == r["seq"] * (r["seq"] - 1) // 2 for r in sums.collect())
