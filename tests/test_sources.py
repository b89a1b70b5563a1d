"""Readers, profiles, sinks and the stream on files in a temporary folder."""

import json

import pytest
from gleaner.sources import profiles, readers, schemas, sinks
from gleaner.streaming import ingest
from pyspark.sql import functions as F


def asof():
    return F.lit("2024-01-17 10:30:00").cast("timestamp")


@pytest.mark.parametrize(
    ("content", "want"),
    [
        ('["a", "b"]', ["a", "b"]),
        ('["a",\n"b",\n]', ["a", "b"]),
        ('"a",\n"b",\n', ["a", "b"]),
        ('"a", ', ["a"]),
        ("[]", []),
        ('"",\n', [""]),
    ],
)
def test_checkpoint_variants(spark, tmp_path, content, want):
    (tmp_path / "urls.json").write_text(content)
    got = readers.read_checkpoint(spark, str(tmp_path), "string").orderBy("seq").collect()
    assert [r["item"] for r in got] == want
    assert readers.read_banned(spark, str(tmp_path)).count() == len([w for w in want if w])


def test_frontier_shapes(spark):
    df = spark.createDataFrame([(["u", "c", "true"],)], "item array<string>")
    assert tuple(readers.frontier(df, "url_category_multiple").first()) == ("u", "c", None, True)
    assert tuple(readers.frontier(df, "category_url").first()) == ("c", "u", None, None)
    assert tuple(readers.frontier(df, "url_image").first()) == ("u", None, "c", None)


def test_missing_files(spark, tmp_path):
    assert readers.read_corpus(spark, str(tmp_path / "none.json")).count() == 0
    assert readers.read_marker(spark, str(tmp_path / "none")) is None
    with pytest.raises(FileNotFoundError, match="split"):
        readers.read_required(spark, str(tmp_path / "none"), schemas.TRAINING, "run the split step").count()
    sinks.write_marker(spark, str(tmp_path / "marker"), "Roxy")
    assert readers.read_marker(spark, str(tmp_path / "marker")) == "Roxy"


def raw(spark):
    data = [
        (0, "Event Brite", "u0", "Jazz", "Gig", None, "Hall", ["20 Jan 2024 7:30PM"], "<p>Fun</p>", None),
        (1, "Event Brite", "u1", "Jazz", "Gig", "img", "Hall", ["20th January 2024"], "Fun", None),
        (2, "Event Brite", "u2", "Jazz", "Far", None, "LeadFlake Hall", ["20 Jan 2024"], "x", None),
        (3, "Event Brite", "u3", None, "Odd", None, "Hall", ["soon"], "x", None),
        (4, "Ticketek", "u4", "Sport", "Match", None, "Stadium, Elsewhere", ["20 Jan 2024"], "x", None),
        (5, "Facebook", "u5", None, "Party", None, "Bar", ["Tomorrow at 7:30"], None, None),
        (6, "City Guide", "u6", "Art", "Show", None, "Gallery", ["20 – 22 January 2024"], "x", None),
    ]
    return spark.createDataFrame([(*r, None, None, None) for r in data], schemas.RAW_LISTING)


def test_profiles(spark):
    events, banned = profiles.to_events(raw(spark), profiles.PROFILES["Event Brite"], asof(), "Metro")
    assert [r["url"] for r in events.orderBy("seq").collect()] == ["u0", "u1"]
    assert {r["url"] for r in banned.collect()} == {"u2", "u3"}
    assert {r["url"] for r in profiles.to_events(raw(spark), profiles.PROFILES["Ticketek"], asof(), "Metro")[1].collect()} == {"u4"}
    party = profiles.to_events(raw(spark), profiles.PROFILES["Facebook"], asof(), "Metro")[0].first()
    assert str(party["dates"][0]).startswith("2024-01-18 07:30")
    show = profiles.to_events(raw(spark), profiles.PROFILES["City Guide"], asof(), "Metro")[0].first()
    assert len(show["dates"]) == 3 and show["venue"] == "Gallery, Metro"
    assert len(profiles.PROFILES) == 17 and set(profiles.PROFILES) <= set(readers.READERS)
    with pytest.raises(KeyError):
        readers.get_reader("nobody")


def test_undated_listings_are_banned_only_where_the_source_bans(spark):
    data = [(0, "Fringe", "u0", None, "A", None, "Tent", ["soon"], "x", None), (1, "Fringe", "u1", None, "B", None, "Tent", ["1-3 Feb"], "x", None), (2, "Ticketek", "u2", None, "C", None, "Hall, Metro", ["soon"], "x", None)]
    rows = spark.createDataFrame([(*r, None, None, "7:30") for r in data], schemas.RAW_LISTING)
    events, banned = profiles.to_events(rows, profiles.PROFILES["Fringe"], asof(), "Metro")
    assert [r["url"] for r in events.collect()] == ["u1"] and banned.count() == 0
    assert [r["url"] for r in profiles.to_events(rows, profiles.PROFILES["Ticketek"], asof(), "Metro")[1].collect()] == ["u2"]


def test_feed_round_trip(spark, tmp_path):
    from gleaner.operators.publish import dedupe_events

    events, _ = profiles.to_events(raw(spark), profiles.PROFILES["Event Brite"], asof(), "Metro")
    best = dedupe_events(events.drop("id")).drop("first_seq")
    sinks.publish_feed(best, str(tmp_path / "feed"))
    sinks.publish_document(best, str(tmp_path / "doc"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    doc = json.loads(text)
    assert [e["imageUrl"] for e in doc["events"]] == ["img"] and doc["filters"] == {"sources": ["Event Brite"], "eventTypes": ["Jazz", "Other"]}
    got = readers.read_feed(spark, str(tmp_path / "doc"))
    assert got.count() == 1 and readers.usable_events(got, asof()).count() == 1
    assert readers.usable_events(got, F.lit("2030-01-01").cast("timestamp")).count() == 0
    assert spark.read.json(str(tmp_path / "feed/filters/eventTypes")).count() == 2


def test_document_in_parts(spark, tmp_path):
    path = str(tmp_path / "doc")
    rows = spark.range(1000).select(F.col("id").alias("seq"), *[F.lit("x").alias(c) for c in ("id", "imageUrl", "venue", "url", "eventType", "long_description", "description")], F.lit(None).cast(schemas.COORDINATES).alias("coordinates"))
    rows = rows.withColumns({"name": F.format_string("n%04d", F.col("seq")), "dates": F.array(asof()), "source": F.lit('S "1"')})
    for n in (10, 1000):
        sinks.publish_document(rows.where(F.col("seq") < n).repartition(7), path)
    doc = json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))
    assert [e["name"] for e in doc["events"]] == [f"n{i:04d}" for i in range(1000)] and doc["filters"] == {"sources": ['S "1"'], "eventTypes": ["x", "Other"]}
    got = readers.read_feed(spark, path).orderBy("seq").collect()
    assert [(r["seq"], r["name"]) for r in got] == [(i, f"n{i:04d}") for i in range(1000)]
    assert {p.name for p in tmp_path.iterdir()} == {"doc"}
    sinks.publish_document(rows.limit(0), path)
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*"))))["events"] == [] and readers.read_feed(spark, path).count() == 0


def test_a_failed_document_leaves_the_old_one(spark, tmp_path):
    from gleaner.sources.documents import JsonDocument

    path = str(tmp_path / "doc")
    spark.dataSource.register(JsonDocument)
    save = lambda df: df.write.format("json_document").options(path=path, head="[", tail="]").mode("overwrite").save()
    save(spark.range(5).select(F.col("id").cast("string").alias("value")))
    with pytest.raises(Exception, match="broken"):
        save(spark.range(50).select(F.when(F.col("id") == 40, F.raise_error(F.lit("broken"))).otherwise(F.col("id").cast("string")).alias("value")))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))) == [0, 1, 2, 3, 4]
    one = tmp_path / "plain.json"
    one.write_text(json.dumps({"events": [{"id": "a", "name": "A"}], "filters": {}}))
    assert [tuple(r) for r in readers.read_feed(spark, str(one)).select("seq", "name").collect()] == [(0, "A")]


def test_versions_survive_a_crash_at_any_step(spark, tmp_path, monkeypatch):
    from gleaner.sources import versions

    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, root)
    versions.publish_version(spark.range(3), root)
    assert sinks.replace_if_changed(spark.range(9), 0, root) is False
    read = lambda: versions.read_current(spark, root).count()
    broken = spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken"):  # while the version is written
        versions.publish_version(broken, root)
    assert read() == 3
    with monkeypatch.context() as m:  # between version and pointer
        m.setattr(versions, "point_to", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            versions.publish_version(spark.range(7), root)
    assert read() == 3
    (tmp_path / "t" / "pointers" / "_temporary").mkdir()  # a pointer's task that died
    assert read() == 3
    assert sinks.replace_if_changed(versions.read_current(spark, root).where("id > 0"), 1, root) and read() == 2
    assert versions.read_current(spark, root, back=1).count() == 3
    versions.roll_back(spark, root)
    assert read() == 3 and len(versions.pointers(spark, root)) == 3
    name = versions.write_version(spark.range(1), root)
    monkeypatch.setattr(versions, "pointers", lambda *a: [(2, "x")])  # another writer came first
    with pytest.raises(Exception, match="(?i)exists"):
        versions.point_to(spark, root, name)


def test_first_empty_page():
    from gleaner.sources.paged import first_empty

    for n in (0, 1, 2, 3, 7, 8, 9, 1000):
        asked = []
        page = lambda k, n=n, asked=asked: asked.append(k) or ([1] if k < n else [])
        assert first_empty(page) == n and len(asked) <= 2 * max(1, n).bit_length() + 2
        assert first_empty(page, min(n, 5)) == n


def test_ids_are_pushed_down(spark, tmp_path):
    from gleaner.sources import paged

    reader = paged.DetailsReader({"search": "x.y", "detail": "x.z", "chunk": "2"})
    left = list(reader.pushFilters([paged.In(("id",), ("a", "b", "c", "a")), paged.EqualTo(("payload",), "p")]))
    assert [type(f) for f in left] == [paged.EqualTo] and [p.ids for p in reader.partitions()] == [("a", "b"), ("c",)]


def test_active_sources(spark):
    got = readers.active_sources(spark, ["a", "b"], {"b": (7, 8)}, 1).orderBy("ord").collect()
    assert [r["active"] for r in got] == [True, False]


def test_stream_appends_each_key_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    schema = "url string, n int"
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], schema).write.parquet(src)
    ingest.append_unseen(ingest.listing_stream(spark, src, schema), "url", out, ck).awaitTermination()
    spark.createDataFrame([("b", 5), ("c", 1)], schema).write.mode("append").parquet(src)
    ingest.append_unseen(ingest.listing_stream(spark, src, schema), "url", out, ck).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
