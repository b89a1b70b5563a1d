"""Queries for the smaller derivations and predicates of listings, on texts written from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import dates, text
from gleaner.operators import category, corpus, evaluate, filters, history, ml, publish, summary
from gleaner.plans.catalog import query
from gleaner.plans.text_queries import SUMMARY_SQL
from gleaner.session import table
from gleaner.sources.readers import frontier, repaired

ASOF = "2024-01-15 12:00:00"


def _asof():
    return F.lit(ASOF).cast("timestamp")


@query("stored_description", f"WITH z AS ({SUMMARY_SQL}) SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE z.summary END AS description FROM documents d LEFT JOIN z USING (doc_id)")
def stored_description(spark, sf):
    """Listings known before keep their description, new ones get a summary of the cleaned one."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    known = F.col("doc_id") % 2 == 0
    docs = docs.withColumn("summary", summary.frequency_summary(F.when(known, None).otherwise(F.col("text"))))
    return docs.select("doc_id", summary.as_description(known, F.col("text"), F.col("summary")).alias("description"))


@query(
    "span_dates",
    """SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d-%H:%M') AS first_day,
       strftime(date_trunc('day', o_orderdate) + INTERVAL 40 DAY * CAST(o_orderkey % 3 <> 0 AS INTEGER), '%Y-%m-%d-%H:%M') AS last_day FROM orders""",
)
def span_dates(spark, sf):
    """Order dates written as "d Month – d Month Year", with both years where they differ, or as a single date, and parsed again."""
    last = F.date_add("o_orderdate", 40)
    first = F.when(F.year("o_orderdate") == F.year(last), F.date_format("o_orderdate", "d MMMM")).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).otherwise(F.concat(first, F.lit(" – "), F.date_format(last, "d MMMM yyyy")))
    rows = table(spark, sf, "orders").select("o_orderkey", dates.span_dates(written).alias("s"))
    return rows.select("o_orderkey", dates.stamp(F.col("s.start")).alias("first_day"), dates.stamp(F.col("s.end")).alias("last_day"))


@query("ordinal_cleanup", "SELECT event_id, event_id || ' of ' || event_type AS cleaned FROM events")
def ordinal_cleanup(spark, sf):
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("st", "ND", "rd", "th")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", text.drop_ordinals(F.concat(F.col("event_id").cast("string"), suffix, F.lit(" of "), "event_type")).alias("cleaned"))


@query(
    "relative_dates",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(TIMESTAMP '{ASOF}' + INTERVAL 1 DAY, '%Y-%m-%d-07:30') WHEN 1 THEN strftime(TIMESTAMP '{ASOF}', '%Y-%m-%d-09:05')
        WHEN 2 THEN '2024-02-03-18:00|2024-02-04-18:00' ELSE '2024-01-19-01:01' END AS stamps FROM events""",
)
def relative_dates(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Tomorrow at 7:30 PM", "Today at 9:05", "3 Feb and 4 Feb, 18:00", "on Friday")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(dates.relative_dates(said, _asof()), dates.stamp), "|").alias("stamps"))


@query("clock_24", "SELECT event_id, strftime(ts, '%H:%M') AS clock FROM events")
def clock_24(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.clock_24(F.concat(F.lit("Today "), F.date_format("ts", "h:mma"))).alias("clock"))


@query("zone_shift", "SELECT event_id, strftime(ts + INTERVAL 10 HOUR * CAST(event_type = 'click' AS INTEGER), '%Y-%m-%d-%H:%M') AS stamp FROM events")
def zone_shift(spark, sf):
    return table(spark, sf, "events").select("event_id", dates.stamp(dates.zone_tag_shift(F.col("ts"), F.upper("event_type"), "click")).alias("stamp"))


@query("start_and_end", "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 2 ELSE 1 END AS n_dates FROM events")
def start_and_end(spark, sf):
    """Pairs of the same day, of the next day within five hours, and of the next day."""
    evening = F.date_trunc("DAY", "ts") + F.make_dt_interval(F.lit(0), F.lit(22))
    end = evening + F.make_dt_interval(F.lit(0), F.element_at(F.array(F.lit(1), F.lit(4), F.lit(6)), (F.col("event_id") % 3 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", F.size(dates.start_and_end(evening, end)).alias("n_dates"))


@query("search_window", "SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS until FROM orders")
def search_window(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(dates.search_until(F.to_date("o_orderdate"), 30), "yyyy-MM-dd").alias("until"))


@query("season_tags", "SELECT o_orderkey FROM orders WHERE year(o_orderdate) >= 1996")
def season_tags(spark, sf):
    tags = F.array(F.lit("news"), F.concat(F.lit("events"), F.year("o_orderdate").cast("string")))
    return table(spark, sf, "orders").where(dates.in_season(tags, F.lit(1996))).select("o_orderkey")


@query("rich_text", "SELECT p_partkey, p_name || chr(10) || p_brand || chr(10) || p_type AS body FROM part")
def rich_text(spark, sf):
    node = F.struct(F.col("p_name").alias("value"))
    inner = F.struct(F.array(F.struct(F.col("p_brand").alias("value")), F.struct(F.col("p_type").alias("value"))).alias("content"))
    doc = F.concat(F.lit('{"content":['), F.to_json(node), F.lit(","), F.to_json(inner), F.lit("]}"))
    return table(spark, sf, "part").select("p_partkey", text.rich_text(doc).alias("body"))


@query("protein_text", "SELECT p_partkey, p_brand || ', ' || p_size AS protein FROM part")
def protein_text(spark, sf):
    raw = F.concat("p_brand", F.lit(","), F.col("p_size").cast("string"), F.lit(" ("), "p_type", F.lit(", (x))"))
    return table(spark, sf, "part").select("p_partkey", text.protein_text(raw).alias("protein"))


@query("venue_lines", "SELECT c_custkey, c_name || ', ' || n_name || CASE WHEN contains(lower(n_name), 'france') THEN '' ELSE ', France' END AS venue FROM customer JOIN nation ON c_nationkey = n_nationkey")
def venue_lines(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", text.with_city(text.venue_line(F.col("c_name"), F.col("n_name")), "France").alias("venue"))


@query("css_urls", "SELECT page_id, url AS image FROM pages")
def css_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.css_url(F.concat(F.lit('background-image: url("'), "url", F.lit('") left'))).alias("image"))


@query("clean_names", r"SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')) AS name FROM documents")
def clean_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_name(F.col("text")).alias("name"))


@query("segment_titles", "SELECT c_custkey, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS title FROM customer")
def segment_titles(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.display_name(F.col("c_mktsegment")).alias("title"))


@query("training_text", "SELECT doc_id, source || ', ' || text AS description FROM documents")
def training_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.training_description(F.col("source"), F.col("text")).alias("description"))


@query(
    "address_variants",
    """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Customer|Customer, Springfield, Land'
      WHEN 1 THEN 'Hall, Customer|1 Hall, Customer|Customer|1 Customer|Customer, Springfield, Land|1 Customer, Springfield, Land|Hall, Customer, Springfield, Land|1 Hall, Customer, Springfield, Land'
      ELSE ', ' || c_custkey || ' Main St, Springfield|' || c_custkey || ' Main St, Springfield|' || c_custkey || ' Main St, Springfield, Springfield, Land|, ' || c_custkey || ' Main St, Springfield, Springfield, Land' END AS variants FROM customer""",
)
def address_variants(spark, sf):
    """Numbers after #, floors, postcodes and the country go; addresses without a digit are numbered."""
    key = F.col("c_custkey").cast("string")
    raw = F.element_at(F.array(F.concat("c_name", F.lit(", Land")), F.concat(F.lit("Hall, "), "c_name", F.lit(", Springfield 6011, Land")), F.concat(key, F.lit("th floor, "), key, F.lit(" Main St, Springfield, Land"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(text.address_variants(raw, "Springfield", "Land"), "|").alias("variants"))


@query("closed_listings", "SELECT doc_id FROM documents WHERE contains(lower(text), 'sold out') OR contains(lower(text), 'sales ended') OR contains(lower(text), 'event ended') OR contains(lower(text), 'unavailable') OR contains(lower(text), 'the')")
def closed_listings(spark, sf):
    return table(spark, sf, "documents").where(filters.is_closed(F.col("text")) | filters.mentions(F.col("text"), "THE")).select("doc_id")


@query("listing_shape", r"SELECT doc_id FROM documents WHERE len(string_split(text, chr(10))) >= 3 AND regexp_matches(text, '[A-Z]') AND regexp_matches(text, ',')")
def listing_shape(spark, sf):
    return table(spark, sf, "documents").where(filters.has_lines(F.col("text"), 3) & filters.has_parts(F.col("text"), "[A-Z]", ",")).select("doc_id")


@query("menu_entries", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR contains(lower(c_mktsegment), 'house')")
def menu_entries(spark, sf):
    return table(spark, sf, "customer").where(filters.menu_entry(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"], "house")).select("c_custkey")


@query("still_listed", f"SELECT user_id FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{ASOF}'")
def still_listed(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.array(F.max("ts")).alias("dates"))  # the last date decides
    return rows.where(filters.not_past(F.col("dates"), _asof())).select("user_id")


@query("unlabelled_rows", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def unlabelled_rows(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.array(F.col("quality").cast("string")).alias("labels"))
    return table(spark, sf, "documents").join(labels, "doc_id", "left").where(filters.unlabelled(F.col("labels"))).select("doc_id")


@query("source_history", "SELECT doc_id FROM documents WHERE source = 'src3'")
def source_history(spark, sf):
    return history.source_history(table(spark, sf, "documents"), "src3").select("doc_id")


@query("resume_sources", "SELECT source, CAST(CAST(source[4:] AS INTEGER) >= 7 AS BOOLEAN) AS fetch FROM (SELECT DISTINCT source FROM documents)")
def resume_sources(spark, sf):
    sources = table(spark, sf, "documents").select("source").distinct().withColumn("ord", F.substring("source", 4, 9).cast("int"))
    return history.sources_from(sources, "src7").select("source", "fetch")


@query("checkpoint_repair", "SELECT n_nationkey, n_name AS name FROM nation")
def checkpoint_repair(spark, sf):
    """Nation names as checkpoint lists in three damaged forms, repaired and unfolded."""
    quoted = F.concat(F.lit('"'), "n_name", F.lit('"'))
    form = F.col("n_nationkey") % 3
    written = F.when(form == 0, F.concat(F.lit("["), quoted, F.lit("]"))).when(form == 1, F.concat(F.lit("["), quoted, F.lit(",\n]"))).otherwise(F.concat(quoted, F.lit(",\n")))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(repaired(written, "string")).alias("name"))


@query("frontier_rows", "SELECT url, CAST('c' || page_id % 3 AS VARCHAR) AS category, page_id % 2 = 0 AS multiple_dates FROM pages")
def frontier_rows(spark, sf):
    item = F.array("url", F.concat(F.lit("c"), (F.col("page_id") % 3).cast("string")), (F.col("page_id") % 2 == 0).cast("string"))
    return frontier(table(spark, sf, "pages").select(item.alias("item")), "url_category_multiple").select("url", "category", "multiple_dates")


@query("zipped_lists", "SELECT vec_id, list_sum(list_transform(range(1, 4), lambda i: round(CAST(embedding[i] AS DOUBLE) * i, 6))) AS total FROM embeddings")
def zipped_lists(spark, sf):
    pairs = publish.zip_lists(F.col("embedding"), F.array(F.lit(1), F.lit(2), F.lit(3)))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.round(p["a"].cast("double") * p["b"], 6))
    return table(spark, sf, "embeddings").select("vec_id", total.alias("total"))


@query("gathered_rows", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT DISTINCT l_partkey FROM lineitem)")
def gathered_rows(spark, sf):
    picks = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("idx"))
    return publish.gather(table(spark, sf, "part").select("p_partkey"), picks, "p_partkey")


@query("best_class", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS cls FROM embeddings")
def best_class(spark, sf):
    top = F.get(evaluate.top_two(F.transform("embedding", lambda x: x.cast("double")), 1.0), 0)["cls"]
    return table(spark, sf, "embeddings").select("vec_id", top.alias("cls"))


@query("review_labels", "SELECT doc_id, CASE WHEN toxic = 1 THEN quality || chr(10) || 'new' ELSE CAST(quality AS VARCHAR) END AS shown FROM labels")
def review_labels(spark, sf):
    new = F.when(F.col("toxic") == 1, F.lit(True))
    return table(spark, sf, "labels").select("doc_id", evaluate.review_label(F.col("quality").cast("string"), new).alias("shown"))


@query("label_numbers", "SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS number FROM documents")
def label_numbers(spark, sf):
    """Labels numbered in alphabetical order, by Spark ML's indexer."""
    from pyspark.ml.feature import StringIndexer

    rows = table(spark, sf, "documents").select("doc_id", "source")
    return StringIndexer(inputCol="source", outputCol="n", stringOrderType="alphabetAsc").fit(rows).transform(rows).select("doc_id", F.col("n").cast("int").alias("number"))


@query(
    "word_sequences",
    r"""
    WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda w: w <> '') AS w FROM documents),
    e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - greatest(len(w) - 1500, 0) AS i FROM t),
    v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS k FROM (SELECT word, count(*) AS n FROM e GROUP BY word ORDER BY n DESC, word LIMIT 2000)),
    s AS (SELECT doc_id, list(coalesce(k, 1) ORDER BY i) AS a FROM e LEFT JOIN v USING (word) WHERE i > 0 GROUP BY doc_id)
    SELECT doc_id, md5(array_to_string(list_concat(coalesce(a, []), list_transform(range(0, 1500 - coalesce(len(a), 0)), lambda x: 0)), ' ')) AS sequence_md5 FROM t LEFT JOIN s USING (doc_id)
    """,
)
def word_sequences(spark, sf):
    """Numbers of the 2,000 most frequent words, the last 1,500 of each text, as a digest."""
    rows = table(spark, sf, "documents")
    words = [r["word"] for r in ml.vocabulary(rows, "text").collect()]  # 2,000 words
    got = ml.sequences(rows, "text", words)
    return got.select("doc_id", F.md5(F.array_join(F.col("sequence").cast("array<string>"), " ").cast("binary")).alias("sequence_md5"))


@query("legacy_categories", "SELECT event_type, CASE WHEN event_type = 'view' THEN 'Festivals' ELSE 'Other' END AS category, count(*) AS n FROM events GROUP BY ALL")
def legacy_categories(spark, sf):
    mapping = spark.createDataFrame([("view", "Festivals")], "raw string, canonical string")
    rows = table(spark, sf, "events").select("event_type", F.col("event_type").alias("category"))
    return category.map_category(rows, mapping, legacy=True).groupBy("event_type", "category").agg(F.count("*").alias("n"))


@query("class_histogram", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def class_histogram(spark, sf):
    return corpus.class_counts(table(spark, sf, "embeddings"))


@query("festival_order", "SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) AS INTEGER) AS place FROM nation")
def festival_order(spark, sf):
    """Names in order, with their place: a facet over a small dimension, joined back."""
    nation = table(spark, sf, "nation")
    places = publish.facet(nation, "n_name")
    return nation.join(places, F.col("n_name") == F.col("value")).select("n_nationkey", F.col("ord").cast("int").alias("place"))


_LATE = "event_id % 10 = 0 AND ts < (SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query(
    "stream_hourly_counts",
    f"""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n FROM events
    WHERE NOT ({_LATE}) AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events) GROUP BY ALL""",
)
def stream_hourly_counts(spark, sf):
    """Events as a stream of two files, in the second of which late ones come: hours that the watermark has passed, without those."""
    from gleaner.operators.numbering import fresh_path
    from gleaner.streaming.ingest import windowed_counts

    events = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    top = events.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("t")).first()["t"]
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit(top))
    path, out = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    for rows in (events.where(~late), events.where(late)):
        rows.coalesce(1).write.mode("append").parquet(path)
        run = windowed_counts(spark.readStream.schema(events.schema).parquet(path), "ts", "event_type").writeStream.outputMode("append").format("parquet")
        run.option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")
