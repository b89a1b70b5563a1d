"""What the findings of round 3 named: joins that texts don't need, parts and pages of bounded size, searches of large pools."""

import numpy as np
import pytest
from gleaner.operators import gazetteer, network, summary
from gleaner.sources import readers, sinks
from pyspark.sql import functions as F


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_sentences_without_a_shuffle(spark):
    text = "a b. c d! a a\n c. x; É' ?? b  c.\n a"
    rows = spark.createDataFrame([(1, text), (2, None), (3, " .?! "), (4, "One"), (None, "One")], "doc_id long, text string")
    got = summary.summary_by_frequency(rows, "doc_id", "text", 3)
    assert "Exchange" not in plan_of(got)
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "a b\na a\na"), (4, "One")]
    long = " ".join(f"w{i}." for i in range(5000)) + " w7 w7"
    assert spark.createDataFrame([(long,)], "text string").select(summary.frequency_summary(F.col("text"), 2)).first()[0] == "w7\nw7 w7"


def test_a_feed_is_written_in_parts_of_bounded_size(spark, tmp_path):
    import json

    n = 40_000
    rows = spark.range(n).select(
        F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.format_string("n%06d", "id").alias("name"), F.lit("i").alias("imageUrl"), F.lit("v").alias("venue"),
        F.lit(None).cast("struct<lat:double,long:double>").alias("coordinates"), F.array(F.lit("2024-02-01 10:00:00").cast("timestamp")).alias("dates"), F.lit("u").alias("url"), F.lit("S").alias("source"),
        F.lit("Other").alias("eventType"), F.repeat(F.lit("x"), 300).alias("long_description"), F.lit("d").alias("description"),
    ).coalesce(1)
    path = str(tmp_path / "feed")
    sinks.publish_document(rows, path)
    files = sorted((tmp_path / "feed").glob("part-*"))
    assert max(f.stat().st_size for f in files) < 5 << 20
    assert [e["name"] for e in json.loads("".join(f.read_text() for f in files))["events"]] == [f"n{i:06d}" for i in range(n)]
    assert readers.read_feed(spark, path).where(F.col("name") == F.format_string("n%06d", "seq")).count() == n


def test_distance_by_bytes(spark):
    known = spark.createDataFrame([("Elmévi", 1.0, 0.0), ("Zoë", 2.0, 0.0)], "address string, lat double, long double")
    asked = spark.createDataFrame([("Elmvi",), ("lmvi",), ("Zoë",)], "venue string")
    got = lambda **how: {r["venue"]: (r["address"], r["distance"]) for r in gazetteer.lookup_tolerant(asked, known, **how).collect()}
    assert got() == {"Elmvi": ("Elmévi", 1), "lmvi": ("Elmévi", 2), "Zoë": ("Zoë", 0)}
    assert got(by_bytes=True) == {"Elmvi": ("Elmévi", 2), "lmvi": (None, None), "Zoë": ("Zoë", 0)}


def test_headings_as_markup(spark, tmp_path):
    from gleaner.plans.source_queries import page_sections

    page = "<html><nav></nav><article><h1>Say &quot;a &amp; b&quot;</h1></article></html>"
    spark.createDataFrame([(1, page), (2, "<article><h1><b>x</b></h1></article>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {r["page_id"]: r["heading"] for r in page_sections(spark, str(tmp_path)).collect()} == {1: "Say &quot;a & b&quot;", 2: ""}


def test_saved_listings_are_read_by_folders(spark, tmp_path):
    from gleaner.plans.file_queries import _saved_listing, _saved_pages
    from gleaner.sources import paged

    path, n = f"file://{tmp_path}/pages", 2 * paged.FOLDER + 3
    spark.dataSource.register(paged.Pages)
    rows = lambda pages: pages.select(F.col("id").cast("int").alias("page"), F.concat("id", F.lit("-u")).alias("url"), F.lit("p").alias("payload"))
    _saved_pages(spark, rows(spark.range(n)), path)
    got = _saved_listing(spark.read, path)
    assert got.rdd.getNumPartitions() == 3 and {(r["page"], r["url"]) for r in got.collect()} == {(i, f"{i}-u") for i in range(n)}
    assert len(paged.foldered_page(n - 1, path)) == 1 and paged.foldered_page(n, path) == []
    _saved_pages(spark, rows(spark.range(n, n + 2)), path)  # into a folder that was read
    assert len(paged.foldered_page(n, path)) == 1
    stream = paged.PagesStream({"fetch": "f", "pages": "4"})
    assert [list(p.value) for p in stream.partitions({"page": 3}, {"page": 9})] == [[3], [4, 5, 6, 7], [8]]


def test_san_fran_has_a_row_for_every_page(spark, sf_dir):
    from gleaner.plans.source_queries import san_fran

    got = {r["page_id"]: r["outcome"] for r in san_fran(spark, sf_dir).collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and set(got.values()) == {"event", "past"}


def test_a_pool_too_large_for_the_driver_is_searched_over_tables(spark, sf_dir, monkeypatch):
    from gleaner.operators import search
    from gleaner.plans.text_queries import ga_subset

    monkeypatch.setattr(search, "fits_driver", lambda *_: False)
    got = ga_subset(spark, sf_dir)
    assert got.columns == ["seq", "fitness"] and got.count() > 0


def test_addresses_are_cleaned_once(spark):
    from gleaner.functions import text

    df = spark.createDataFrame([("Hall, Main St, Metro 6011, Land",)], "a string").select(text.address_variants(F.col("a"), "Metro", "Land").alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Mana") == 1


def test_a_network_exchanges_some_times_an_epoch(spark):
    from test_network import rows

    calls = []
    one, many = (network.train_network(rows(spark), plan=network.Training(epochs=6, batch=4, rate=0.02, apart=8, rounds=2, tasks=t), length=20, filters=8, hidden=8, embedding=8) for t in (1, 3))
    assert np.allclose(one.history, many.history, atol=1e-9) and one.history[-1][0] < one.history[0][0] / 2
    got = network.predict_network(many, rows(spark)).where("description is not null and label is not null")
    assert got.where("predicted = label").count() > 0.95 * got.count()

    net, plan, rng = network.Layout("pooling", classes=2, words=20, length=9, embedding=4), network.Training(epochs=2, batch=1), np.random.default_rng(1)
    share = network.Share(net, plan, np.arange(200), rng.integers(0, 22, (200, 9)), rng.integers(0, 2, 200), np.arange(200) % 5 == 0)
    network.fit_shares(net, plan, [share], 3, lambda m: calls.append(m) or [m])
    assert len(calls) == 1 + 2 * (3 + 1) and share.step > 150


def test_word_counts_of_odd_texts(spark, tmp_path):
    from gleaner.operators import ml

    texts = ["It's a CAT, a cat\tİt \u212aat é", None, "", "É??", "dog dog zebra"]
    df = spark.createDataFrame([(i, t, "x" if i % 2 else "y") for i, t in enumerate(texts)], "seq long, description string, label string").repartition(3)
    split = {r["seq"]: r["w"] for r in df.select("seq", ml.tokens(F.col("description")).alias("w")).collect()}
    assert all(ml.words_in(None if t is None else t.encode()) == [w.encode() for w in split[i] or []] for i, t in enumerate(texts))
    counter = ml.WordCounts(inputCol="description", outputCol="c", vocabulary=["cat", "dog", "kat"])
    got = {r["seq"]: (r["c"].indices.tolist(), r["c"].values.tolist(), r["c"].size) for r in counter.transform(df).collect()}
    assert got == {0: ([0, 2], [2.0, 1.0], 3), 1: ([], [], 3), 2: ([], [], 3), 3: ([], [], 3), 4: ([1], [2.0], 3)}
    model = ml.train_classifier(df, kind="perceptron")
    ml.save_model(model, str(tmp_path / "model"))
    assert ml.load_model(str(tmp_path / "model")).stages[1].getOrDefault("vocabulary") == model.stages[1].getOrDefault("vocabulary")
    assert "RegexTokenizer" not in str(model.stages) and ml.predict(model, df).count() == len(texts)


def test_terms_are_counted_in_their_row(spark, monkeypatch):
    from math import log, sqrt

    from gleaner.operators import ml

    written = []
    monkeypatch.setattr(ml, "materialize", lambda df, tag: written.append(plan_of(df)) or df)
    texts = [(1, "A b a"), (2, "b c's"), (3, None), (None, "b")]

    def weights(data):
        got = ml.tfidf(spark.createDataFrame(data, "k long, t string").repartition(2), "k", "t").collect()
        return {(r["k"], r["word"]): round(r["weight"], 9) for r in got}

    def expected(bags):
        idf = {w: log((1 + len(bags)) / (1 + sum(w in b for b in bags.values()))) + 1 for b in bags.values() for w in b}
        norm = {k: sqrt(sum((c * idf[w]) ** 2 for w, c in b.items())) for k, b in bags.items()}
        return {(k, w): round(c * idf[w] / norm[k], 9) for k, b in bags.items() for w, c in b.items()}

    assert weights(texts) == expected({1: {"a": 2, "b": 1}, 2: {"b": 1, "c's": 1}, 3: {}, None: {"b": 1}})
    assert "MapInArrow" in written[0] and "HashAggregate" not in written[0]
    assert weights([*texts, (1, "b z"), (None, "b")]) == expected({1: {"a": 2, "b": 2, "z": 1}, 2: {"b": 1, "c's": 1}, 3: {}, None: {"b": 2}})


SOURCES = ["roxy", "valhalla", "humanitix", "event_brite", "ticket_master", "high_school", "event_finder", "facebook", "all_events_in", "ticketek", "fringe"]


@pytest.mark.parametrize("source", SOURCES)
def test_a_source_cuts_its_pages_into_elements_once(spark, sf_dir, source):
    from gleaner.plans import QUERIES

    plan = plan_of(QUERIES[f"source_{source}"][0](spark, sf_dir))
    assert plan.count("ArrowEvalPython") == 1 and plan.count("FileScan") == 1


def test_elements_are_python_objects_for_some_pages_at_once(monkeypatch):
    import pyarrow as pa
    from gleaner.functions import elements

    pages, sizes, whole = pa.array([f"<p a='{i}'>x<br>" * (i % 4) or None for i in range(1000)]), [], elements._slice_elements
    monkeypatch.setattr(elements, "_slice_elements", lambda x: sizes.append(len(x)) or whole(x))
    assert elements._elements(pages).equals(whole(pages)) and elements._elements(pages.slice(3, 600)).equals(whole(pages.slice(3, 600)))
    assert max(sizes) == elements.SLICE and len(elements._elements(pages[:0])) == 0


def test_sentences_are_ranked_in_their_row(spark, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(30)}" + "." * int(rng.random() < 0.2) for _ in range(n)) for n in (0, 3, 400, 900)]
    rows = spark.createDataFrame([*enumerate([*texts, texts[3]]), (9, None), (None, "One. Two.\n\n Three")], "k long, t string").repartition(3)
    got = summary.summarize(rows, "t", k=2)
    assert "Exchange hash" not in plan_of(got) and "Join" not in plan_of(got)
    assert {r["k"]: r["summary"] for r in got.collect()} == {None: "One.\nTwo.", 9: "", **{i: summary.lexrank(t, 2) for i, t in enumerate([*texts, texts[3]])}}

    bags = [[f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 9))] for _ in range(200)]
    table = summary.sentence_graph(bags, 0.1)
    held = {w: sum(w in bag for bag in bags) for bag in bags for w in bag}
    weights = [{w: bag.count(w) / max(map(bag.count, bag)) * np.log(200 / (1 + held[w])) for w in bag} for bag in bags]
    norm = [np.sqrt(sum(x * x for x in w.values())) for w in weights]
    expected = [[norm[i] * norm[j] > 0 and sum(x * b.get(w, 0) for w, x in a.items()) > 0.1 * norm[i] * norm[j] for j, b in enumerate(weights)] for i, a in enumerate(weights)]
    assert np.array_equal(np.unpackbits(table, axis=1, count=200), np.array(expected))
    monkeypatch.setattr(summary, "PAIRS", 2000)  # lists of sentences instead of a table
    assert np.array_equal(summary.sentence_graph(bags, 0.1), table)
