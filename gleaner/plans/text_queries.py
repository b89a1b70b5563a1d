"""Queries over documents and pages: cleaning, first-wins, corpora, history, html."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import corpus, dedupe, evaluate, history, ml, publish, summary
from gleaner.operators.numbering import materialize
from gleaner.plans.catalog import query
from gleaner.session import table

LICENSE = "Licensed under the Apache License, Version 2.0."


@query(
    "flagship",
    f"""
    WITH r AS (
      SELECT d.doc_id, d.source, split_part(split_part(d.text, '{LICENSE}', 1), ',', 1) AS title, CAST(l.quality AS VARCHAR) AS mark
      FROM documents d LEFT JOIN labels l USING (doc_id)),
    g AS (SELECT title, source, coalesce(max(doc_id) FILTER (WHERE mark IS NOT NULL AND mark <> ''), min(doc_id)) AS doc_id FROM r GROUP BY ALL)
    SELECT source, count(*) AS n_titles, count(r.mark) AS n_labelled, min(title) AS first_title
    FROM g JOIN r USING (doc_id, title, source) GROUP BY source
    """,
)
def flagship(spark, sf):
    """Cut boilerplate, one row per title and source (labelled ones preferred), then count by source."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("mark")), "doc_id", "left")
    rows = docs.select("doc_id", "source", text.title_of(text.cut_at(F.col("text"), LICENSE)).alias("title"), "mark")
    best = dedupe.prefer_nonempty(rows, ["title", "source"], "doc_id", F.col("mark"))
    return best.groupBy("source").agg(F.count("*").alias("n_titles"), F.count("mark").alias("n_labelled"), F.min("title").alias("first_title"))


@query("clean_boilerplate", f"SELECT doc_id, split_part(text, '{LICENSE}', 1) AS clean FROM documents WHERE split_part(text, '{LICENSE}', 1) <> ''")
def clean_boilerplate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.cut_at(F.col("text"), LICENSE).alias("clean")).where("clean <> ''")


@query("title_first_wins", "SELECT doc_id, split_part(text, ',', 1) AS title FROM documents QUALIFY row_number() OVER (PARTITION BY split_part(text, ',', 1) ORDER BY doc_id) = 1")
def title_first_wins(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.title_of(F.col("text")).alias("title"))
    return dedupe.first_wins(rows, [F.col("title")], "doc_id")


@query("text_first_wins", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def text_first_wins(spark, sf):
    return dedupe.first_wins(table(spark, sf, "documents").select("doc_id", "text"), [F.col("text")], "doc_id")


@query(
    "skip_flag_counts",
    f"""SELECT source, (length(text) < 110 OR contains(text, '{LICENSE}') OR length(regexp_replace(text, '{LICENSE}', '', 'g')) < 110) AS skip, count(*) AS n
    FROM documents GROUP BY ALL""",
)
def skip_flag_counts(spark, sf):
    rows = table(spark, sf, "documents").select("source", text.skip_flag(F.col("text"), LICENSE).alias("skip"))
    return rows.groupBy("source", "skip").agg(F.count("*").alias("n"))


@query(
    "corpus_ingest",
    f"""
    WITH e AS (SELECT doc_id AS seq, lang || ', ' || split_part(text, '{LICENSE}', 1) AS description, source AS label FROM documents WHERE split_part(text, '{LICENSE}', 1) <> ''),
    f AS (SELECT description, label FROM e QUALIFY row_number() OVER (PARTITION BY description ORDER BY seq) = 1),
    o AS (SELECT split_part(text, '{LICENSE}', 1) AS description, 'benchmark' AS label FROM benchmark),
    u AS (SELECT description, label, CAST(NULL AS BOOLEAN) AS "new" FROM o
          UNION ALL SELECT description, label, true FROM f WHERE description NOT IN (SELECT description FROM o))
    SELECT description, label, "new", (length(description) < 110 OR contains(description, '{LICENSE}') OR length(regexp_replace(description, '{LICENSE}', '', 'g')) < 110) AS skip FROM u
    """,
)
def corpus_ingest(spark, sf):
    events = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("name"), F.col("text").alias("long_description"), F.col("source").alias("eventType"))
    old = table(spark, sf, "benchmark").select(F.col("text").alias("description"), F.lit("benchmark").alias("label"))
    return corpus.ingest(events, old, (LICENSE,), LICENSE).select("description", "label", "new", "skip")


@query("corpus_class_counts", "SELECT lang AS label, count(*) AS n FROM documents GROUP BY lang")
def corpus_class_counts(spark, sf):
    return corpus.class_counts(table(spark, sf, "documents").select(F.col("lang").alias("label")))


@query("url_anti_history", "SELECT page_id, url FROM pages WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id % 7 = 0)")
def url_anti_history(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    seen = history.seen_urls(pages.where("page_id % 2 = 0"), pages.where("page_id % 7 = 0"))
    return history.unseen(pages.where("page_id % 2 = 1"), seen).select("page_id", "url")


@query(
    "url_or_title_anti",
    """
    WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages), h AS (SELECT * FROM p WHERE page_id % 3 = 0)
    SELECT page_id, url, title FROM p WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM h) AND title NOT IN (SELECT title FROM h)
    """,
)
def url_or_title_anti(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return history.unseen_url_or_title(pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 = 0")).select("page_id", "url", "title")


@query("resume_union", "SELECT page_id, url FROM pages WHERE page_id % 4 <> 1 UNION ALL SELECT page_id, url FROM pages WHERE page_id % 4 < 2 AND url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 1)")
def resume_union(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    return history.resume(pages.where("page_id % 4 <> 1"), pages.where("page_id % 4 < 2")).select("page_id", "url")


_HTML_SQL = r"""
    WITH a AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|footer|header|nav|title|head|body|html)(\s[^>]*)?/?>', chr(10), 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '<[^>]*>', '', 'g') AS t FROM b),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&apos;', chr(39)), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t FROM c)
    SELECT page_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM d
"""


@query("html_to_text", _HTML_SQL)
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("url_canonical", "SELECT page_id, nullif(regexp_extract(url, '[a-z]+\\.[a-z]+/[a-z]+/[0-9]+'), '') AS canonical FROM pages")
def url_canonical(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.canonical_url(F.col("url"), r"[a-z]+\.[a-z]+/[a-z]+/[0-9]+").alias("canonical"))


@query(
    "line_state_machine",
    """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
    p AS (SELECT doc_id, a, list_position(list_transform(a, lambda x: contains(x, 'the')), true) AS i FROM l)
    SELECT doc_id, list_filter(a[i + 1:], lambda x: NOT contains(x, 'the'))[1] AS value FROM p WHERE i > 0
    """,
)
def line_state_machine(spark, sf):
    """The first line without the label after one that contains it."""
    rows = table(spark, sf, "documents").where(F.contains("text", F.lit("the")))
    return rows.select("doc_id", text.value_after(F.col("text"), "the").alias("value"))


@query(
    "vocab_topk",
    r"""
    SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda w: w <> '')) AS word FROM documents)
    GROUP BY word ORDER BY n DESC, word LIMIT 2000
    """,
)
def vocab_topk(spark, sf):
    return ml.vocabulary(table(spark, sf, "documents"), "text")


@query(
    "tfidf_scores",
    r"""
    WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda w: w <> '')) AS word FROM documents),
    t AS (SELECT doc_id, word, count(*) AS tf FROM w GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM t GROUP BY word),
    x AS (SELECT doc_id, word, tf * (ln((1 + (SELECT count(DISTINCT doc_id) FROM documents)) / (1.0 + df)) + 1) AS w FROM t JOIN d USING (word))
    SELECT doc_id, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x
    """,
)
def tfidf_scores(spark, sf):
    return ml.tfidf(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "word", F.round("weight", 6).alias("weight"))


SUMMARY_SQL = r"""
    WITH s AS (SELECT doc_id, text, list_transform(list_filter(regexp_split_to_array(text, '[.!?\n]+'), lambda x: trim(x) <> ''), lambda x: trim(x)) AS a FROM documents),
    e AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) AS pos FROM s),
    w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9'']+'), lambda x: x <> '')) AS word FROM documents) GROUP BY ALL),
    t AS (SELECT doc_id, pos, sentence, unnest(list_filter(regexp_split_to_array(lower(sentence), '[^a-z0-9'']+'), lambda x: x <> '')) AS word FROM e),
    r AS (SELECT doc_id, pos, any_value(sentence) AS sentence, avg(n) AS score FROM t JOIN w USING (doc_id, word) GROUP BY doc_id, pos),
    k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) <= 5)
    SELECT doc_id, string_agg(sentence, chr(10) ORDER BY pos) AS summary FROM k GROUP BY doc_id
    """


@query("summary_topk", SUMMARY_SQL)
def summary_topk(spark, sf):
    return summary.summary_by_frequency(table(spark, sf, "documents"), "doc_id", "text")


LEXRANK_SQL = r"""
    WITH RECURSIVE s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(12) || chr(13))), lambda x: x <> '') AS a FROM documents),
    e AS (SELECT doc_id, len(a) AS n, unnest(a) AS sentence, generate_subscripts(a, 1) AS pos FROM s),
    t AS (SELECT doc_id, n, pos, word, count(*) AS c FROM (SELECT doc_id, n, pos, unnest(regexp_extract_all(lower(sentence), '[\p{L}\p{N}_]+')) AS word FROM e WHERE n > 5) GROUP BY ALL),
    w AS (SELECT doc_id, pos, word, c / max(c) OVER (PARTITION BY doc_id, pos) * ln(n / (1.0 + count(*) OVER (PARTITION BY doc_id, word))) AS w FROM t),
    m AS (SELECT doc_id, pos, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id, pos),
    p AS (SELECT x.doc_id, x.pos AS i, y.pos AS j, sum(x.w * y.w) AS dot FROM w x JOIN w y USING (doc_id, word) GROUP BY ALL),
    g AS (SELECT p.doc_id, i, j FROM p JOIN m a ON a.doc_id = p.doc_id AND a.pos = i JOIN m b ON b.doc_id = p.doc_id AND b.pos = j WHERE a.norm * b.norm > 0 AND dot > 0.1 * a.norm * b.norm),
    v AS (SELECT e.doc_id, e.pos, e.n, coalesce(list(j ORDER BY j) FILTER (WHERE j IS NOT NULL), []) AS near FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.pos WHERE e.n > 5 GROUP BY ALL),
    h AS (SELECT doc_id, n, list(near ORDER BY pos) AS near, list(greatest(len(near), 1) ORDER BY pos) AS degree FROM v GROUP BY doc_id, n),
    r AS (SELECT doc_id, 0 AS k, list_transform(range(0, n), lambda x: 1.0::DOUBLE / n) AS p, 1.0::DOUBLE AS moved FROM h
          UNION ALL SELECT doc_id, k, q, sqrt(list_sum(list_transform(list_zip(p, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) FROM (
            SELECT r.doc_id, k + 1 AS k, p, list_transform(near, lambda a: coalesce(list_sum(list_transform(a, lambda i: p[i] / degree[i])), 0.0)) AS q FROM r JOIN h USING (doc_id) WHERE moved > 0.1)),
    z AS (SELECT doc_id, arg_max(p, k) AS p FROM r GROUP BY doc_id),
    b AS (SELECT e.doc_id, e.pos, sentence FROM e LEFT JOIN z USING (doc_id) QUALIFY row_number() OVER (PARTITION BY e.doc_id ORDER BY round(p[e.pos], 9) DESC, e.pos) <= 5)
    SELECT s.doc_id, coalesce(string_agg(b.sentence, chr(10) ORDER BY b.pos), '') AS summary FROM s LEFT JOIN b USING (doc_id) GROUP BY s.doc_id
    """


@query("summary_lexrank", LEXRANK_SQL)
def summary_lexrank(spark, sf):
    """Sentences by a random walk over a graph of similar ones; the twin walks it in a recursive query."""
    return summary.summarize(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "summary")


@query(
    "upsert_title",
    """
    WITH n AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE page_id % 2 = 1),
    o AS (SELECT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, min(page_id) AS page_id FROM pages WHERE page_id % 2 = 0 GROUP BY 1)
    SELECT coalesce(o.page_id, n.page_id) AS page_id, n.url, n.title FROM n LEFT JOIN o USING (title)
    """,
)
def upsert_title(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    old = pages.where("page_id % 2 = 0").groupBy("title").agg(F.min("page_id").alias("page_id"))
    return publish.upsert_by_title(pages.where("page_id % 2 = 1"), old.select("page_id", "title"), "title", ["url"])


def _labelled(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.format_string("q%d-t%d", "quality", "toxic").alias("label"))


_LABELLED = "r AS (SELECT doc_id AS seq, text AS description, 'q' || quality || '-t' || toxic AS label FROM documents JOIN labels USING (doc_id)), m AS (SELECT min(n) AS min_n FROM (SELECT count(*) AS n FROM r GROUP BY label))"


@query("class_counts", f"WITH {_LABELLED} SELECT label, count(*) AS n FROM r GROUP BY label")
def class_counts(spark, sf):
    return corpus.class_counts(_labelled(spark, sf))


@query("min_class", f"WITH {_LABELLED} SELECT min_n, (SELECT count(DISTINCT label) FROM r) AS n_classes FROM m")
def min_class(spark, sf):
    return corpus.min_class(_labelled(spark, sf))


_TEST = f"{_LABELLED}, t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq) <= (SELECT floor(0.4 * min_n) FROM m))"


@query("test_split_per_class", f"WITH {_TEST} SELECT seq, label FROM t")
def test_split_per_class(spark, sf):
    return corpus.test_split(_labelled(spark, sf), "label", 0.4, F.col("seq")).select("seq", "label")


@query("train_pool_anti", f"WITH {_TEST} SELECT seq, label FROM r WHERE description NOT IN (SELECT description FROM t)")
def train_pool_anti(spark, sf):
    rows = _labelled(spark, sf)
    return corpus.train_pool(rows, corpus.test_split(rows, "label", 0.4, F.col("seq"))).select("seq", "label")


@query("balanced_subset", f"WITH {_LABELLED} SELECT seq, label FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY seq) <= (SELECT min_n FROM m)")
def balanced_subset(spark, sf):
    return corpus.balanced(_labelled(spark, sf), "label", F.col("seq")).select("seq", "label")


@query(
    "undersample_negatives",
    """
    WITH r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic = 1 ORDER BY doc_id) AS k FROM labels)
    SELECT doc_id, toxic FROM r WHERE toxic = 1 OR k BETWEEN 2 AND (SELECT count(*) FROM labels WHERE toxic = 1)
    """,
)
def undersample_negatives(spark, sf):
    return corpus.undersample(table(spark, sf, "labels").select("doc_id", "toxic"), F.col("toxic") == 1, F.col("doc_id"))


@query(
    "hash_split",
    """SELECT doc_id, CASE WHEN k / 10000.0 < 0.64 THEN 'train' WHEN k / 10000.0 < 0.8 THEN 'validation' ELSE 'test' END AS part
    FROM (SELECT doc_id, CAST('0x' || substr(md5(doc_id || ':42'), 1, 8) AS BIGINT) % 10000 AS k FROM documents)""",
)
def hash_split(spark, sf):
    part = corpus.hash_split(F.col("doc_id"), [("train", 0.64), ("validation", 0.16), ("test", 0.2)])
    return table(spark, sf, "documents").select("doc_id", part.alias("part"))


@query("lr_classifier")
def lr_classifier(spark, sf):
    """Train one classifier a class, each against the rest, on one part of the documents; predict and evaluate the other."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.col("lang").alias("label"))
    rows = rows.withColumn("part", corpus.hash_split(F.col("seq"), [("train", 0.8), ("test", 0.2)]))
    model = ml.train_classifier(rows.where("part = 'train'"), kind="ovr")
    got = ml.predict(model, rows.where("part = 'test'").drop("part"))
    return evaluate.accuracy_by_class(got, "label", F.col("predicted") == F.col("label"))


def _by_network(spark, sf, kind: str, epochs: int) -> DataFrame:
    """Train a network on one part of the documents in barrier tasks; its accuracy by language on the other."""
    from gleaner.operators import network

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.col("lang").alias("label")).where("lang is not null")
    rows = rows.withColumn("part", corpus.hash_split(F.col("seq"), [("train", 0.8), ("test", 0.2)]))
    tasks = max(1, min(8, spark.sparkContext.defaultParallelism))
    model = network.train_network(rows.where("part = 'train'"), kind=kind, plan=network.Training(epochs=epochs, batch=64, rate=0.01, tasks=tasks), length=100, filters=32)
    got = network.predict_network(model, rows.where("part = 'test'").drop("part"))
    return evaluate.accuracy_by_class(got, "label", F.col("predicted") == F.col("label"))


@query("cnn_classifier")
def cnn_classifier(spark, sf):
    return _by_network(spark, sf, "convolution", 3)


@query("pooling_classifier")
def pooling_classifier(spark, sf):
    return _by_network(spark, sf, "pooling", 6)


@query("ga_subset")
def ga_subset(spark, sf):
    """Search a training subset of the labelled documents by the accuracy that a classifier reaches on it.

    The classifier is a logistic regression where the pool's features fit the driver; a larger pool
    is searched whole over tables, by nearest centroids.
    """
    from gleaner.operators import search, subsets

    pool = _labelled(spark, sf).select("seq", "description", "label")
    if not search.fits_driver(pool.count()):
        return subsets.search_subset(spark, pool, population=16, generations=4).select("seq", "fitness")
    x, y, keys = search.pool_features(pool, "seq", "description", "label")
    picks, score = search.search(spark, x, y, search.balanced_start(y), population=16, generations=4, fitness=search.logistic_accuracy)
    return spark.createDataFrame([(int(keys[i]), float(score)) for i in picks], "seq long, fitness double")


_FITNESS_SQL = f"""
    WITH {_LABELLED.split(", m AS")[0]}, u AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY seq ORDER BY label, description NULLS FIRST) = 1),
    w AS (SELECT seq, word, count(*) AS tf FROM (SELECT seq, unnest(list_filter(regexp_split_to_array(lower(description), '[^a-z0-9'']+'), lambda w: w <> '')) AS word FROM u) GROUP BY ALL),
    v AS (SELECT word, sum(tf) AS tf, count(*) AS df FROM w GROUP BY word),
    x AS (SELECT seq, word, w.tf * (ln((1 + (SELECT count(*) FROM u)) / (1.0 + df)) + 1) AS x FROM w JOIN v USING (word)),
    f AS (SELECT * FROM (SELECT seq, word, x / sqrt(sum(x * x) OVER (PARTITION BY seq)) AS x FROM x) WHERE word IN (SELECT word FROM v ORDER BY tf DESC, word LIMIT 2000)),
    g AS (SELECT i AS individual, seq, label FROM u, range(8) t(i) WHERE i = 0 OR CAST('0x' || substr(md5(seq || ':' || i), 1, 8) AS BIGINT) % 8 <= i),
    k AS (SELECT individual, least(5, min(n)) AS k, min(label) AS first FROM (SELECT individual, label, count(*) AS n FROM g GROUP BY ALL) GROUP BY individual HAVING min(n) > 1 AND count(*) > 1),
    o AS (SELECT individual, first, k, seq, label, (row_number() OVER (PARTITION BY individual, label ORDER BY seq) - 1) % k AS fold FROM g JOIN k USING (individual)),
    h AS (SELECT DISTINCT individual, fold AS held FROM o),
    n AS (SELECT individual, held, label, count(*) AS n FROM o JOIN h USING (individual) WHERE fold <> held GROUP BY ALL),
    s AS (SELECT individual, fold, label, word, sum(x) AS s FROM o JOIN f USING (seq) GROUP BY ALL),
    c AS (SELECT individual, held, label, word, sum(s) / any_value(n) AS c FROM s JOIN n USING (individual, label) WHERE fold <> held GROUP BY ALL),
    p AS (SELECT o.individual, o.seq, c.label AS guess, round(sum(x * c), 9) AS score FROM o JOIN f USING (seq) JOIN c ON c.individual = o.individual AND held = fold AND c.word = f.word GROUP BY ALL),
    b AS (SELECT * FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY individual, seq ORDER BY score DESC, guess) = 1),
    a AS (SELECT individual, fold, avg(CAST(coalesce(guess, first) = label AS INTEGER)) AS a FROM o LEFT JOIN b USING (individual, seq) GROUP BY ALL)
    SELECT CAST(individual AS INTEGER) AS individual, n_rows, coalesce(n_folds, 0) AS n_folds, round(coalesce(fitness, 0), 6) AS fitness
    FROM (SELECT individual, count(*) AS n_rows FROM g GROUP BY ALL) LEFT JOIN (SELECT individual, count(*) AS n_folds, avg(a) AS fitness FROM a GROUP BY ALL) USING (individual)
    """


@query("subset_fitness", _FITNESS_SQL)
def subset_fitness(spark, sf):
    """Fitness of eight training subsets of the labelled documents, the first of them all: guesses by fold as a table, their accuracy as an aggregate."""
    from gleaner.operators import subsets

    rows = materialize(subsets.pool_rows(_labelled(spark, sf)), "subset-pool")
    code = F.conv(F.substring(F.md5(F.concat(F.col("seq").cast("string"), F.lit(":"), F.col("individual").cast("string"))), 1, 8), 16, 10).cast("long")
    genes = rows.select("seq", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("individual")).where((F.col("individual") == 0) | (code % 8 <= F.col("individual")))
    terms = materialize(subsets.pool_terms(rows), "subset-terms")
    got = subsets.subset_fitness(genes, subsets.fold_guesses(genes, rows, terms))
    return got.select("individual", "n_rows", "n_folds", F.round("fitness", 6).alias("fitness"))


@query("subset_search")
def subset_search(spark, sf):
    """A training subset of the labelled documents by a genetic search over tables."""
    from gleaner.operators import subsets

    return subsets.search_subset(spark, _labelled(spark, sf), population=16, generations=4)


@query("cross_accuracy")
def cross_accuracy(spark, sf):
    """Mean accuracy over stratified folds of the labelled documents, by language."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("seq"), F.col("text").alias("description"), F.col("lang").alias("label"))
    return spark.createDataFrame([(ml.cross_accuracy(rows, "description", "label", 3),)], "accuracy double")


@query("export_best", f"WITH {_TEST} SELECT seq FROM r WHERE seq % 3 = 0 AND seq NOT IN (SELECT seq FROM t) UNION ALL SELECT seq FROM t")
def export_best(spark, sf):
    """Picked rows of a pool and the test set together."""
    from gleaner.operators import search

    rows = _labelled(spark, sf)
    test = corpus.test_split(rows, "label", 0.4, F.col("seq"))
    pool = rows.join(test.select("seq"), "seq", "left_anti")
    picks = [r["seq"] for r in pool.where("seq % 3 = 0").select("seq").collect()]  # stands for what a search picks
    return search.export_best(pool, test, picks).select("seq")
