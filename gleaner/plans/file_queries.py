"""Sinks and readers: what is written into the shared folder and read back, against what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import corpus, ml
from gleaner.operators.numbering import fresh_path
from gleaner.plans.catalog import query
from gleaner.session import table
from gleaner.sources import burgers, cms, paged, readers, schemas, sinks, versions
from gleaner.streaming import ingest, state

ASOF = "2024-01-15 12:00:00"


def _asof():
    return F.lit(ASOF).cast("timestamp")


def _listings(spark, sf) -> DataFrame:
    """The events table as listings: a date each, an image for some, a label for some."""
    rows = table(spark, sf, "events")
    image = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("http://i/x?oe="), F.hex(F.unix_timestamp("ts") + 86400 * 30)))
    return rows.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("e-"), "event_id").alias("id"), F.concat(F.lit("e"), "event_id").alias("name"), image.alias("imageUrl"), F.concat(F.lit("v"), "user_id").alias("venue"),
        F.lit(None).cast(schemas.COORDINATES).alias("coordinates"), F.array(F.col("ts").cast("timestamp")).alias("dates"), F.concat(F.lit("http://u/"), "event_id").alias("url"), F.lit("S").alias("source"),
        F.col("event_type").alias("eventType"), F.lit("long").alias("long_description"), F.lit("short").alias("description"),
    )


_STAMP = "strftime(ts, '%Y-%m-%d-%H:%M')"


@query("sink_feed", f"SELECT name, venue, stamp, display, row_number() OVER (ORDER BY minute, name, event_id) AS place FROM (SELECT event_id, 'e' || event_id AS name, 'v' || user_id AS venue, {_STAMP} AS stamp, strftime(ts, '%a %d %b') AS display, ts AS minute FROM events)")
def sink_feed(spark, sf):
    """The published feed document, read back in its order."""
    path = fresh_path(spark, "feed")
    sinks.publish_document(_listings(spark, sf), path)
    return readers.read_feed(spark, path).select("name", "venue", F.get("dates", 0).alias("stamp"), F.col("displayDate").alias("display"), (F.col("seq") + 1).alias("place"))


@query("sink_feed_lines", "SELECT 'e' || event_id AS name FROM events UNION ALL SELECT 'source S' UNION ALL SELECT 'type ' || t FROM (SELECT DISTINCT event_type AS t FROM events WHERE event_type <> 'Other' UNION ALL SELECT 'Other')")
def sink_feed_lines(spark, sf):
    """The feed as lines, with its facets beside it; published over an older one, of which a copy is kept."""
    path = fresh_path(spark, "feed-lines")
    sinks.publish_feed(_listings(spark, sf).limit(1), path)
    sinks.keep_copy(spark, f"{path}/events", f"{path}-copy")
    sinks.publish_feed(_listings(spark, sf), path)
    read = lambda part, mark, column: spark.read.json(f"{path}/{part}").select(F.concat(F.lit(mark), F.col(column)).alias("name"))
    assert spark.read.text(f"{path}-copy").count() == 1
    return read("events", "", "name").unionAll(read("filters/sources", "source ", "value")).unionAll(read("filters/eventTypes", "type ", "value"))


@query("usable_feed", f"SELECT 'e' || event_id AS name FROM events WHERE ts >= TIMESTAMP '{ASOF}' AND (event_id % 3 <> 0 OR date_trunc('second', ts) + INTERVAL 30 DAY > TIMESTAMP '{ASOF}')")
def usable_feed(spark, sf):
    """A feed read again: only listings with dates to come and without expired images."""
    path = fresh_path(spark, "feed-read")
    sinks.publish_document(_listings(spark, sf).withColumn("dates", F.array(F.col("dates")[0])), path)
    asof = F.lit(ASOF).cast("timestamp")
    return readers.usable_events(readers.read_feed(spark, path), asof).select("name")


@query("unexpired_images", f"SELECT event_id FROM events WHERE event_id % 2 = 0 OR date_trunc('second', ts) > TIMESTAMP '{ASOF}'")
def unexpired_images(spark, sf):
    from gleaner.operators.filters import not_expired

    image = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit("http://i/x?oe="), F.hex(F.unix_timestamp("ts")), F.lit("&v=1")))
    return table(spark, sf, "events").where(not_expired(image, _asof())).select("event_id")


@query("sink_festivals", "SELECT DISTINCT r_name AS name, 'http://f/' || r_regionkey AS url FROM region")
def sink_festivals(spark, sf):
    """The season's festivals and those that sources found, each once."""
    found = table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.lit("i").alias("icon"), F.concat(F.lit("http://f/"), "r_regionkey").alias("url"))
    path = fresh_path(spark, "festivals")
    sinks.write_festivals(readers.festivals(spark, [], found, found), path)
    return spark.read.schema(schemas.FESTIVAL).json(path).select("name", "url")


@query("sink_checkpoints", "SELECT CAST(event_id AS BIGINT) AS seq, 'events' AS kind FROM events UNION ALL SELECT page_id, 'urls' FROM pages")
def sink_checkpoints(spark, sf):
    """Events and urls appended in two parts each."""
    path, rows, urls = fresh_path(spark, "checkpoints"), _listings(spark, sf), table(spark, sf, "pages").select("page_id", "url")
    for part in (0, 1):
        sinks.append_events(rows.where(F.col("seq") % 2 == part), f"{path}/events")
        sinks.append_urls(urls.where(F.col("page_id") % 2 == part), f"{path}/urls")
    read = lambda kind, key: spark.read.json(f"{path}/{kind}").select(F.col(key).cast("long").alias("seq"), F.lit(kind).alias("kind"))
    return read("events", "seq").unionAll(read("urls", "page_id"))


@query("banned_urls", "SELECT url FROM pages WHERE page_id % 2 = 0")
def banned_urls(spark, sf):
    """A ban list with a comma after each url and no brackets; blanks don't count."""
    path = fresh_path(spark, "bans")
    lines = F.concat(F.lit('"'), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(""), F.lit('",\n'))
    table(spark, sf, "pages").select(lines.alias("value")).write.option("lineSep", " ").text(path)
    return readers.read_banned(spark, path).select("url")


@query("checkpoint_sources", "SELECT 'Source ' || r_regionkey AS source FROM region WHERE r_regionkey < 3")
def checkpoint_sources(spark, sf):
    """The checkpoint files of active sources, by folder."""
    path = fresh_path(spark, "source-files")
    names = table(spark, sf, "region").select(F.concat(F.lit("Source "), "r_regionkey").alias("source"), F.lit("[]").alias("value"))
    names.repartition("source").write.partitionBy("source").text(path)
    named = readers.checkpoint_files(spark, path, ["source=Source 0", "source=Source 1", "source=Source 2"], "part-*")
    return named.select(F.replace("source", F.lit("source="), F.lit("")).alias("source")).distinct()


@query("sink_marker", "SELECT max(n_name) AS source FROM nation")
def sink_marker(spark, sf):
    """The source at which a run stopped, written twice."""
    path = fresh_path(spark, "marker")
    sinks.write_marker(spark, path, "before")
    sinks.write_marker(spark, path, table(spark, sf, "nation").agg(F.max("n_name").alias("m")).first()["m"])
    return spark.createDataFrame([(readers.read_marker(spark, path),)], "source string")


@query("sink_festival_feeds", "SELECT event_type AS festival, count(*) AS n FROM events GROUP BY 1")
def sink_festival_feeds(spark, sf):
    """A feed a festival, as partitions."""
    path = fresh_path(spark, "festival-feeds")
    sinks.write_festival_feeds(_listings(spark, sf).withColumn("festival", F.col("eventType")), path)
    return spark.read.json(path).groupBy("festival").agg(F.count("*").alias("n"))


def _burgers(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    return part.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.lit("i").alias("image"), F.lit("d").alias("description"), F.col("p_retailprice").alias("price"), F.lit(5.0).alias("beerMatchPrice"),
        (F.col("p_size") % 2 == 0).alias("availableForLunch"), (F.col("p_size") % 3 == 0).alias("availableForDinner"), F.col("p_brand").alias("beerMatch"), F.concat("p_type", F.lit(" (x), pork")).alias("mainProtein"),
        F.lit(None).cast("boolean").alias("sidesIncluded"), F.lit("V").alias("venue"), (F.col("p_size") > 25).alias("vegan"),
    )


@query("sink_burgers", "SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'Lunch & Dinner' WHEN p_size % 2 = 0 THEN 'Lunch' ELSE 'Dinner' END AS meal, CASE WHEN p_size > 25 THEN 'Vegan' ELSE '' END AS dietary FROM part")
def sink_burgers(spark, sf):
    """The burger feed, published and read back."""
    path = fresh_path(spark, "burgers")
    burgers.publish_burgers(burgers.to_burgers(_burgers(spark, sf)), path)
    got = spark.read.json(f"{path}/burgers")
    return got.select("id", F.col("mealAvailable").alias("meal"), F.array_join("dietaryRequirements", "|").alias("dietary"))


@query("sink_corpus", "SELECT source || ', ' || text AS description, source AS label FROM documents WHERE text <> ''")
def sink_corpus(spark, sf):
    """A corpus that replaces the table it is read from, twice; a wrong one is rolled back."""
    path = fresh_path(spark, "corpus")
    docs = table(spark, sf, "documents").where("text <> ''")
    rows = docs.select(F.concat_ws(", ", "source", "text").alias("description"), F.col("source").alias("label"), F.lit(False).alias("skip"))
    versions.publish_version(rows, path)
    for _ in range(2):
        versions.publish_version(versions.read_current(spark, path), path)
    versions.publish_version(rows.limit(0), path)
    versions.roll_back(spark, path)
    return versions.read_current(spark, path).select("description", "label")


@query("corpus_read", "SELECT count(*) AS n, count(DISTINCT label) AS labels FROM (SELECT source AS label FROM documents)")
def corpus_read(spark, sf):
    """A corpus in JSON; a missing one is empty, and a required one names the step that makes it."""
    path = fresh_path(spark, "corpus-json")
    docs = table(spark, sf, "documents").select(F.col("text").alias("description"), F.col("source").alias("label"), F.lit(False).alias("skip"))
    array = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("description", "label", "skip"))), ","), F.lit("]"))
    docs.withColumn("_file", F.crc32(F.coalesce("description", F.lit("")).cast("binary")) % 64).groupBy("_file").agg(array.alias("value")).write.partitionBy("_file").text(path)
    assert readers.read_corpus(spark, f"{path}-none").count() == 0
    rows = readers.read_corpus(spark, path)
    return rows.agg(F.count("*").alias("n"), F.count_distinct("label").alias("labels"))


@query("sink_predictions", "SELECT source AS run, count(*) AS n FROM documents GROUP BY 1")
def sink_predictions(spark, sf):
    """Logs of runs, kept apart, in two parts."""
    path, docs = fresh_path(spark, "predictions"), table(spark, sf, "documents").select("doc_id", "source")
    for r in docs.select("source").distinct().collect():  # a run a source
        sinks.append_predictions(docs.where(F.col("source") == r["source"]).drop("source"), path, r["source"])
    return spark.read.parquet(path).groupBy(F.col("run").cast("string").alias("run")).agg(F.count("*").alias("n"))


@query("sink_unmapped", "SELECT event_type AS raw, 2 AS n FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')")
def sink_unmapped(spark, sf):
    """Raw categories that the map lacks, logged by two runs; repeats are kept."""
    from gleaner.operators.category import unmapped

    path = fresh_path(spark, "unmapped")
    for _ in range(2):
        sinks.append_unmapped(unmapped(table(spark, sf, "events"), spark.createDataFrame([("view", "Festivals")], "raw string, canonical string"), "event_type"), path)
    return spark.read.json(path).groupBy("raw").agg(F.count("*").cast("int").alias("n"))


@query("sink_labels", "SELECT doc_id, CASE WHEN toxic = 1 THEN 7 ELSE quality END AS quality FROM labels")
def sink_labels(spark, sf):
    """Labels rewritten in their table, only if any changed."""
    from gleaner.operators.evaluate import write_back

    path, rows = fresh_path(spark, "labels"), table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    versions.publish_version(rows, path)
    updates = rows.where("toxic = 1").select("doc_id", F.lit(7).alias("new_value"))
    sinks.replace_if_changed(write_back(versions.read_current(spark, path), updates, "doc_id", "quality"), updates.count(), path)
    assert not sinks.replace_if_changed(rows, 0, path)
    return versions.read_current(spark, path).select("doc_id", F.col("quality").cast("int").alias("quality"))


@query("sink_splits", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS part FROM documents")
def sink_splits(spark, sf):
    """Split files, read back by the step that needs them."""
    path, docs = fresh_path(spark, "splits"), table(spark, sf, "documents").select("doc_id")
    sinks.write_splits(path, test=docs.where("doc_id % 3 = 0"), train=docs.where("doc_id % 3 <> 0"))
    read = lambda part: readers.read_required(spark, f"{path}/{part}", "doc_id long", "run the split step").withColumn("part", F.lit(part))
    return read("test").unionAll(read("train"))


@query("sink_model", "SELECT count(*) AS n, true AS same FROM documents WHERE lang IS NOT NULL")
def sink_model(spark, sf):
    """A model saved and loaded gives the predictions it gave before."""
    path = fresh_path(spark, "model")
    rows = table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", F.col("text").alias("description"), F.col("lang").alias("label"))
    model = ml.train_classifier(rows)
    ml.save_model(model, path)
    was = ml.predict(model, rows).select("doc_id", F.col("predicted").alias("p"))
    got = ml.predict(ml.load_model(path), rows).join(was, "doc_id")
    return got.agg(F.count("*").alias("n"), F.every(F.col("predicted") == F.col("p")).alias("same"))


def _saved_pages(spark, rows: DataFrame, path: str) -> None:
    """Rows (page, url, payload) as a crawler saves them: folders of consecutive pages."""
    rows.withColumn("pages", F.floor(F.col("page") / paged.FOLDER)).repartition("pages").sortWithinPartitions("pages", "page", "url").write.mode("append").partitionBy("pages").json(path)


def _saved_listing(read, path: str):
    return read.format("listing_pages").option("fetch", "gleaner.sources.paged.foldered_page").option("pages", paged.FOLDER).option("root", path).load()


@query("paged_source", "SELECT CAST(o_orderkey // 100 AS INTEGER) AS page, o_orderstatus AS payload, count(*) AS n FROM orders GROUP BY 1, 2")
def paged_source(spark, sf):
    """A listing read up to its first empty page, a folder of pages a task."""
    path, key = fresh_path(spark, "paged"), F.col("o_orderkey")
    _saved_pages(spark, table(spark, sf, "orders").select(F.floor(key / 100).cast("int").alias("page"), key.cast("string").alias("url"), F.col("o_orderstatus").alias("payload")), path)
    spark.dataSource.register(paged.Pages)
    return _saved_listing(spark.read, path).groupBy("page", "payload").agg(F.count("*").alias("n"))


@query("paged_stream", "SELECT c_mktsegment AS payload, count(*) AS n, count(DISTINCT c_custkey // 50) AS pages FROM customer GROUP BY 1")
def paged_stream(spark, sf):
    """A listing as a stream: a first run reads the pages there are, pages added later come with the next, from the same checkpoint."""
    path, out, key = fresh_path(spark, "paged-stream"), fresh_path(spark, "paged-rows"), F.col("c_custkey")
    rows = table(spark, sf, "customer").select(F.floor(key / 50).cast("int").alias("page"), key.cast("string").alias("url"), F.col("c_mktsegment").alias("payload"))
    half = rows.agg(F.max("page").alias("m")).first()["m"] // 2
    spark.dataSource.register(paged.Pages)
    for part in (rows.where(F.col("page") <= half), rows.where(F.col("page") > half)):
        _saved_pages(spark, part, path)
        run = _saved_listing(spark.readStream, path).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(processingTime="1 second").start()
        run.processAllAvailable()
        run.stop()
    return spark.read.parquet(out).groupBy("payload").agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages"))


@query("search_then_fetch", """
SELECT 'all' AS asked, p_brand AS payload, count(*) AS n FROM (SELECT p_partkey, min(p_brand) AS p_brand FROM part GROUP BY 1) GROUP BY 2
UNION ALL SELECT 'named', p_brand, count(*) FROM (SELECT p_partkey, min(p_brand) AS p_brand FROM part WHERE p_partkey IN (7, 30, 31, 107) GROUP BY 1) GROUP BY 2""")
def search_then_fetch(spark, sf):
    """Ids from the pages of a search, then details by chunks of ids; ids that the query names are fetched without a search."""
    path, key = fresh_path(spark, "details"), F.col("p_partkey")
    items = table(spark, sf, "part").groupBy("p_partkey").agg(F.min("p_brand").alias("payload"))
    _saved_pages(spark, items.select(F.floor(key / 100).cast("int").alias("page"), key.cast("string").alias("url"), F.lit("").alias("payload")), path)
    items.select(key.cast("string").alias("id"), "payload", F.floor(key / (100 * paged.FOLDER)).alias("ids")).repartition("ids").write.mode("append").partitionBy("ids").json(path)
    spark.dataSource.register(paged.Details)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"search": "gleaner.sources.paged.foldered_page", "detail": "gleaner.sources.paged.foldered_details", "pages": str(paged.FOLDER), "root": path}
    details = lambda: spark.read.format("listing_details").options(**options).load()
    found, named = details(), details().where(F.col("id").isin("7", "30", "31", "107"))
    tell = lambda rows, asked: rows.groupBy("payload").agg(F.count("*").alias("n")).select(F.lit(asked).alias("asked"), "payload", "n")
    return tell(found, "all").unionAll(tell(named, "named"))


@query("programme_events", "SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 3 ELSE 1 END AS n_dates FROM nation WHERE n_nationkey % 3 <> 0")
def programme_events(spark, sf):
    """A festival's programme from documents: this year's entries, for the whole festival or for their sessions."""
    key = F.col("n_nationkey")
    tags = F.array(F.struct(F.when(key % 3 == 0, "events2020").otherwise("events2024").alias("contentful_id")))
    times = F.array(F.struct((key % 2 == 0).alias("fullFestivalDuration"), F.lit("2024-01-20T10:00").alias("startDate")))
    raw = F.struct(F.lit('{"content":[{"value":"text"}]}').alias("raw"))
    docs = table(spark, sf, "nation").select(F.col("n_name").alias("title"), F.lit("s").alias("slug"), F.lit("L").alias("location"), F.struct(tags.alias("tags")).alias("metadata"), times.alias("times"), raw.alias("intro"), raw.alias("description"))
    path = fresh_path(spark, "programme")
    docs.write.json(path)
    read = spark.read.schema(cms.DOCUMENT).json(path)
    day = lambda d: F.lit(d).cast("timestamp")
    got = cms.festival_events(read, _asof(), day("2024-01-18 09:00:00"), day("2024-01-20 09:00:00"), "http://x/", "Heritage Festival")
    return got.select("name", F.size("dates").alias("n_dates"))


@query("active_sources", "SELECT DISTINCT source, CAST(source <> 'src3' AS BOOLEAN) AS active FROM documents")
def active_sources(spark, sf):
    """Seasonal sources are active in their months only."""
    names = sorted(r["source"] for r in table(spark, sf, "documents").select("source").distinct().collect())  # the registry
    return readers.active_sources(spark, names, {"src3": (7, 8), "src4": (1, 2)}, 1).select("source", "active")


@query("usable_rows", "SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0")
def usable_rows(spark, sf):
    """Rows that have a label and aren't skipped."""
    rows = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").alias("label"), F.when(F.col("toxic") == 1, True).alias("skip"))
    return corpus.usable(rows).select("doc_id")


@query("running_festivals", f"SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 YEAR >= TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 4 YEAR")
def running_festivals(spark, sf):
    from gleaner.operators.filters import still_running

    end = F.add_months(F.to_date("o_orderdate"), 360).cast("timestamp")
    return table(spark, sf, "orders").where(still_running(end, F.lit("2028-01-15 12:00:00").cast("timestamp"))).select("o_orderkey")


@query("kid_friendly", "SELECT count(*) AS n, true AS better FROM labels JOIN documents USING (doc_id)")
def kid_friendly(spark, sf):
    """A binary classifier: positives, as many negatives less one, best class by score; better than guessing the larger class is on its training rows."""
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.when(F.col("toxic") == 1, "no").otherwise("yes").alias("label"))
    model = ml.train_classifier(rows, size=500)
    got = ml.predict(model, rows)
    share = F.greatest(F.avg((F.col("label") == "yes").cast("double")), F.avg((F.col("label") == "no").cast("double")))
    return got.agg(F.count("*").alias("n"), (F.avg((F.col("predicted") == F.col("label")).cast("double")) >= share).alias("better"))


@query("relabelled", "SELECT count(*) AS n, 0 AS unlabelled FROM documents")
def relabelled(spark, sf):
    """Every listing labelled anew, whatever labels it had."""
    from gleaner.plans.runs import relabel_all

    rows = table(spark, sf, "documents").where("lang IS NOT NULL").select("doc_id", F.col("text").alias("description"), F.col("lang").alias("label"))
    names = sorted(r["label"] for r in rows.select("label").distinct().collect())  # the classes
    model = ml.train_classifier(rows, size=500)
    events = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("long_description"), F.array(F.lit("old")).alias("labels"), F.lit("d").alias("description"))
    got = relabel_all(events, model, names)
    return got.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.size("labels") > 0, F.lit(False)) | F.array_contains("labels", "old")).cast("int").alias("unlabelled"))


@query("seen_stream", "SELECT DISTINCT event_type || '-' || user_id AS key FROM events")
def seen_stream(spark, sf):
    """A stream in two files of which keys are appended once, over two runs with one checkpoint."""
    path, out = fresh_path(spark, "seen-in"), fresh_path(spark, "seen-out")
    rows = table(spark, sf, "events").select(F.concat_ws("-", "event_type", "user_id").alias("key"), "event_id")
    for part in (0, 1):
        rows.where(F.col("event_id") % 2 == part).coalesce(1).write.mode("append").parquet(path)
        ingest.append_unseen(ingest.listing_stream(spark, path, "key string, event_id long"), "key", out, f"{out}-state").awaitTermination()
    return spark.read.parquet(out).select("key")


_KEYED = "SELECT *, event_type || '-' || user_id % 20 AS key FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL"


@query("state_stream", f"""
WITH e AS ({_KEYED}),
b AS (SELECT key, min(ts) AS banned FROM e WHERE event_id % 97 = 0 GROUP BY key),
s AS (SELECT key, ts, event_id, lag(ts) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM e WHERE event_id % 97 <> 0)
SELECT key, event_id FROM s LEFT JOIN b USING (key) WHERE (before IS NULL OR ts - before > INTERVAL 12 HOUR) AND (banned IS NULL OR ts < banned)""")
def state_stream(spark, sf):
    """New listings by keyed state over four runs with one checkpoint: seen ones are known for twelve hours, bans for good."""
    path, out = fresh_path(spark, "state-in"), fresh_path(spark, "state-out")
    rows = table(spark, sf, "events").select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 20).cast("string")).alias("key"), "event_id", "ts").where("key is not null and ts is not null and event_id is not null")
    cuts = rows.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).agg(F.percentile_approx("t", [0.25, 0.5, 0.75], 1000).alias("c")).first()["c"] or [0]  # any cuts serve
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.unix_micros(F.col("ts").cast("timestamp"))))
    kind = rows.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    for k in range(4):
        rows.where(part == k).write.mode("append").parquet(path)
        new = state.unseen_stream(spark.readStream.schema(kind).parquet(path), "key", "ts", "event_id", F.col("event_id") % 97 == 0, 0.5)
        state.run_once(new, out, f"{out}-state")
    return spark.read.schema(new.schema).parquet(out).select("key", "event_id")
