"""Whole runs: sources to feed, resuming, feed to corpus, corpus to labels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators import corpus, evaluate, history, ml
from gleaner.operators.category import map_category, unmapped
from gleaner.operators.publish import dedupe_events
from gleaner.sources.profiles import PROFILES, to_events


@dataclass
class Run:
    """``events`` for the feed, urls to ban, raw categories that the map lacks."""

    events: DataFrame
    banned: DataFrame
    misses: DataFrame


def full_run(raw: DataFrame, previous: DataFrame, banned: DataFrame, mapping: DataFrame, asof: Column, city: str, sources: list[str] | None = None) -> Run:
    """Every source's unseen listings and its history, mapped and de-duplicated.

    ``previous`` has the columns of events, dates as timestamps. A source that keeps no
    history starts anew each time.
    """
    parts, bans = [], [banned.select("source", "url")]
    for name in sources or list(PROFILES):
        profile = PROFILES[name]
        own = history.source_history(previous, name) if profile.keeps_history else previous.limit(0)
        fresh = history.unseen(raw.where(F.col("source") == name), history.seen_urls(own, banned))
        if profile.match_title:
            fresh = history.unseen_url_or_title(fresh.withColumn("title", F.col("name")), own.withColumn("title", F.col("name"))).drop("title")
        events, out = to_events(fresh, profile, asof, city)
        kept, past = history.split_future(events, asof)
        parts += [kept.drop("id"), own.drop("id")]
        bans += [out, past] if profile.bans_undated else [out]
    rows = history.union_all(*parts)
    misses = unmapped(rows, mapping, "eventType")
    rows = map_category(rows, mapping, "eventType")
    return Run(dedupe_events(rows).drop("first_seq"), history.union_all(*bans).distinct(), misses)


def resume_run(raw: DataFrame, loaded: DataFrame, checkpoints: DataFrame, banned: DataFrame, mapping: DataFrame, asof: Column, city: str, order: DataFrame, marker: str | None) -> Run:
    """Sources from the marked one on are taken again; checkpoints give what isn't loaded."""
    again = [r["source"] for r in history.sources_from(order, marker).where("fetch").select("source").collect()]
    known = history.resume(loaded, checkpoints)
    before = known.where(~F.col("source").isin(again))
    run = full_run(raw, known, banned, mapping, asof, city, again)
    return Run(dedupe_events(history.union_all(before.drop("id"), run.events.drop("id"))).drop("first_seq"), run.banned, run.misses)


def classify_unlabelled(events: DataFrame, model, names: list[str]) -> DataFrame:
    """Events without labels get those of the classifier: the best class, and the next if it has half its score."""
    rows = events.withColumn("description_", corpus.training_description(F.col("name"), F.col("long_description")))
    todo = rows.where(F.coalesce(F.size("labels"), F.lit(0)) <= 0).withColumn("description", F.col("description_")).drop("description_", "labels")
    done = rows.where(F.coalesce(F.size("labels"), F.lit(0)) > 0).drop("description_")
    classes = F.array(*[F.lit(n) for n in names])
    top = evaluate.top_two(F.slice("scores", 1, len(names)))
    got = ml.predict(model, todo).withColumn("labels", F.transform(top, lambda t: F.get(classes, t["cls"]))).drop("predicted", "scores")
    return done.unionByName(got)


def relabel_all(events: DataFrame, model, names: list[str]) -> DataFrame:
    """Every event with the classifier's labels in place of its own."""
    return classify_unlabelled(events.withColumn("labels", F.array().cast("array<string>")), model, names)


def review_run(rows: DataFrame, model, names: list[str], classes=evaluate.ACCEPTED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with accepted labels, predictions, accuracy by class) of a corpus (entry_id, description, label, skip, new)."""
    todo = rows.where(~F.coalesce("skip", F.lit(False)))
    got = ml.predict(model, todo).withColumn("top", evaluate.top_two(F.slice("scores", 1, len(names))))
    names_of = F.array(*[F.lit(n) for n in names])
    got = got.withColumn("labels", F.transform("top", lambda t: F.get(names_of, t["cls"]))).withColumn("best", F.get("labels", 0))
    shown = evaluate.review_label(F.col("label"), F.col("new"))
    report = evaluate.accuracy_by_class(got.withColumn("given", shown), "given", evaluate.is_correct(F.col("labels"), F.col("given")))
    updates = got.where(evaluate.accepted(F.col("best"), F.col("label"), classes)).select("entry_id", F.col("best").alias("new_value"))
    return evaluate.write_back(rows, updates, "entry_id", "label"), got.select("entry_id", "label", "labels", "top"), report
