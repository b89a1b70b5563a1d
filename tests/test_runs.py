"""Whole runs on a few listings, the burger feed, the festival programme and paged sources."""

import json

from gleaner.operators import ml
from gleaner.plans import runs
from gleaner.sources import burgers, cms, schemas
from pyspark.sql import functions as F
from test_sources import asof, raw

EVENTS = "seq long, id string, name string, imageUrl string, venue string, coordinates struct<lat:double,long:double>, dates array<timestamp>, url string, source string, eventType string, long_description string, description string"


def previous(spark):
    rows = [(9, "x", "Old", "i", "V", None, "u9", "Event Brite", "Jazz", "d", "d"), (8, "y", "Seen", "", "V", None, "u1", "Event Brite", "Jazz", "d", "d")]
    df = spark.createDataFrame(rows, EVENTS.replace("dates array<timestamp>, ", ""))
    return df.withColumn("dates", F.array(F.lit("2024-02-01 10:00:00").cast("timestamp")))


def inputs(spark):
    banned = spark.createDataFrame([("Event Brite", "u0")], "source string, url string")
    mapping = spark.createDataFrame([("Jazz", "Music & Concerts")], "raw string, canonical string")
    return banned, mapping


def test_full_run(spark):
    banned, mapping = inputs(spark)
    run = runs.full_run(raw(spark), previous(spark), banned, mapping, asof(), "Metro")
    got = {r["url"]: r for r in run.events.collect()}
    assert set(got) == {"u9", "u1", "u5", "u6"}
    assert got["u1"]["name"] == "Seen" and got["u9"]["eventType"] == "Music & Concerts" and got["u6"]["eventType"] == "Other"
    assert {r["url"] for r in run.banned.collect()} == {"u0", "u2", "u3", "u4"}
    assert {r["raw"] for r in run.misses.collect()} == {"Art", "Other"}


def test_resume_takes_later_sources_again(spark):
    banned, mapping = inputs(spark)
    order = spark.createDataFrame([("Event Brite", 0), ("Facebook", 1), ("City Guide", 2)], "source string, ord int")
    run = runs.resume_run(raw(spark), previous(spark), previous(spark).limit(0), banned, mapping, asof(), "Metro", order, "City Guide")
    assert {r["url"] for r in run.events.collect()} == {"u9", "u1", "u6"}


def test_classify_and_review(spark):
    data = [(i, "gig, band music" if i % 2 else "stall, market food", "Music & Concerts" if i % 2 else "Markets & Fairs", False, None) for i in range(20)]
    corpus = spark.createDataFrame(data + [(98, "gig, band music", "Markets & Fairs", False, True), (99, "gig, band", "Festivals", True, None)], "entry_id long, description string, label string, skip boolean, new boolean")
    model = ml.train_classifier(corpus.where("entry_id < 90"))
    names = ["Markets & Fairs", "Music & Concerts"]
    rows, log, report = runs.review_run(corpus, model, names)
    assert {r["entry_id"]: r["label"] for r in rows.collect()}[98] == "Music & Concerts"
    assert log.count() == 21 and {r["given"]: r["accuracy"] for r in report.collect()}["Markets & Fairs\nnew"] == 0.0
    events = spark.createDataFrame([(1, "gig", "band music", []), (2, "x", "y", ["kept"])], "seq long, name string, long_description string, labels array<string>").withColumn("description", F.lit("d"))
    got = {r["seq"]: r["labels"] for r in runs.classify_unlabelled(events, model, names).collect()}
    assert got[2] == ["kept"] and got[1][0] == "Music & Concerts"


def test_burgers(spark, tmp_path):
    rows = [("1", "b", None, "d", 20.0, 5.0, True, True, "Ale", "beef (x), pork", None), ("2", "a", None, "d", 15.0, None, False, None, None, None, True)]
    raw_rows = spark.createDataFrame(rows, schemas.BURGER).withColumns({"venue": F.lit("V"), "vegan": F.lit(None).cast("boolean"), "veganPossible": F.col("id") == "2"})
    got = burgers.to_burgers(raw_rows)
    assert [(r["mealAvailable"], r["dietaryRequirements"]) for r in got.orderBy("id").collect()] == [("Lunch & Dinner", []), ("Dinner", ["Vegan"])]
    filters = burgers.burger_filters(got)
    assert tuple(filters["priceRange"].first()) == (15.0, 20.0)
    assert [r["value"] for r in filters["proteins"].collect()] == ["beef", "pork"] or [r["value"] for r in filters["proteins"].collect()] == ["beef"]
    burgers.publish_burgers(got, str(tmp_path / "feed"))
    assert spark.read.json(str(tmp_path / "feed/burgers")).count() == 2


def test_festival_programme(spark, tmp_path):
    doc = lambda title, tag, times: {"title": title, "slug": "s", "location": "L", "metadata": {"tags": [{"contentful_id": tag}]}, "times": times, "intro": {"raw": json.dumps({"content": [{"value": "intro"}]})}, "description": {"raw": json.dumps({"content": [{"content": [{"value": "text"}]}]})}}
    docs = [doc("Whole", "events2024", [{"fullFestivalDuration": True}]), doc("One", "events2024", [{"startDate": "2024-01-20T10:00"}]), doc("Past", "events2020", [])]
    (tmp_path / "docs.json").write_text(json.dumps(docs))
    read = cms.read_documents(spark, str(tmp_path / "docs.json"))
    day = lambda d: F.lit(d).cast("timestamp")
    got = cms.festival_events(read, asof(), day("2024-01-18 09:00:00"), day("2024-01-20 09:00:00"), "http://x/", "Heritage Festival")
    rows = {r["name"]: r for r in got.collect()}
    assert set(rows) == {"Whole", "One"} and len(rows["Whole"]["dates"]) == 3 and rows["One"]["long_description"] == "text\nintro"
    new = got.withColumn("imageUrl", F.lit("new")).withColumn("url", F.col("url"))
    old = new.where("name = 'One'").withColumn("imageUrl", F.lit("old")).withColumn("venue", F.lit("kept"))
    merged = {r["name"]: r for r in cms.merge_programme(new, old).collect()}
    assert (merged["One"]["venue"], merged["One"]["imageUrl"]) == ("kept", "new")


def test_paged_source(spark):
    from pathlib import Path

    from gleaner.sources.paged import Pages

    spark.sparkContext.addPyFile(str(Path(__file__).parent / "paged.py"))
    spark.dataSource.register(Pages)
    df = spark.read.format("listing_pages").option("fetch", "paged.demo_page").load()
    assert df.count() == 6 and df.rdd.getNumPartitions() == 3
