"""Quality rules as a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import SPACES, discard, let, materialize, words_of

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def symbols(text: Column) -> Column:
    """Characters of ``[#*$%&|<>]``."""
    t = F.coalesce(text, F.lit(""))
    return (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long")


def lines_of(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.ltrim(x, F.lit(SPACES)) != "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside a window of ``width`` words that occurs twice or more in the text.

    Windows are compared by 64-bit hashes of their words' 64-bit hashes. Texts without a
    repeated window stop after one hash set; the others sort the hashes with their places.
    """

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(width), F.coalesce(F.get(places, i + 1) - p, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeats(s: Column) -> Column:
        same = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        marked = F.transform(s, lambda x, i: F.when(same(x, i), x["i"]))
        return let(F.array_sort(F.array_compact(marked)), covered)

    def windows(h: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)]))
        placed = lambda w: F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(spans, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(placed(w), repeats)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < width, F.lit(0).cast("long")).otherwise(let(hashes, windows))


#: What rules look at, by name: from text and words to a count.
FACTS = {
    "n_words": lambda text, words: F.size(words).cast("long"),
    "word_chars": lambda text, words: word_chars(words),
    "n_symbols": lambda text, words: symbols(text),
    "n_lines": lambda text, words: F.size(lines_of(text)).cast("long"),
    "n_dup_lines": lambda text, words: duplicate_lines(text),
    "n_repeat_words": lambda text, words: repeated_words(words),
}


#: Seconds that no measured cost falls below, so that rules on facts already known still have one.
LEAST_COST = 1e-4
#: Times each fact is computed on the sample; the fastest counts.
TRIES = 2
log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Rule:
    """``rejects``: from facts by name to a boolean that is never null. The facts come as columns
    already computed, or as expressions that are only evaluated if a row gets to the rule;
    ``needs`` names what it always computes."""

    name: str
    needs: tuple[str, ...]
    rejects: object


#: What op7 applies; the first two are the base rules. Lines are counted only where one is repeated.
RULES = (
    Rule("few_words", ("words", "n_words"), lambda f: f["n_words"] < 20),
    Rule("repetitive", ("words", "n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"]),
    Rule("symbol_heavy", ("words", "n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > 3 * f["n_words"]),
    Rule("odd_word_length", ("words", "n_words", "word_chars"), lambda f: let(f["word_chars"], lambda c: (c < 2 * f["n_words"]) | (c > 15 * f["n_words"]))),
    Rule("line_repeats", ("n_dup_lines",), lambda f: let(f["n_dup_lines"], lambda d: (d > 0) & (2 * d > F.greatest(f["n_lines"], F.lit(1))))),
)


def lazy_facts(text: Column, words: Column) -> dict[str, Column]:
    return {name: fact(text, words) for name, fact in FACTS.items()}


def measured_costs(sample: DataFrame, names, tries: int = TRIES) -> dict[str, float]:
    """Seconds that each fact takes on the rows of ``sample`` (text), beyond what it builds on.

    Every fact is computed in a task of its own, timed, less the time of a task that only reads
    the texts; "words" is the split that facts of words share, and comes off them.
    """
    one, split = sample.coalesce(1), words_of(F.col("text"))
    facts = {"": F.length("text"), "words": F.size(split)} | {n: FACTS[n](F.col("text"), split) for n in names if n in FACTS}

    def seconds(fact: Column) -> float:
        took = []
        for _ in range(tries):
            began = time.perf_counter()
            one.agg(F.sum(fact)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    took = {n: seconds(f) for n, f in facts.items()}
    words = max(took["words"] - took[""], LEAST_COST)
    of_words = {"n_words", "word_chars", "n_repeat_words"}
    return {"words": words} | {n: max(took[n] - took[""] - (words if n in of_words else 0), LEAST_COST) for n in facts if n not in ("", "words")}


def order_rules(docs: DataFrame, rules=RULES, sample_rows: int = 2000, text: str = "text", costs: dict[str, float] | None = None) -> list[Rule]:
    """Rules by rejections per cost, both estimated on a sample of about ``sample_rows`` rows.

    One job counts rows and code points for each set of rules that reject a row, so that a
    rule's selectivity and cost are those on the rows that the rules before it let through. Its
    cost is the measured time of the facts that no rule before it needs (or ``costs``, seconds by
    fact). A rule that rejects nothing counts as rejecting half a row, so cheap ones still come
    first. The sample and the clock only set the order in which a row's rules are tried, never
    the verdict; the order is settled once, before the run, and logged.
    """
    n = docs.count()
    if not n:
        return list(rules)
    rows = materialize(docs.select(F.col(text).cast("string").alias("text")).sample(False, min(1.0, sample_rows / n), seed=7), "quality-sample")
    costs = costs or measured_costs(rows, {f for r in rules for f in r.needs})
    split = rows.select("text", words_of(F.col("text")).alias("words"))
    facts = lazy_facts(F.col("text"), F.col("words"))
    seen = split.select(F.array(*[r.rejects(facts) for r in rules]).alias("by"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    seen = seen.groupBy("by").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()  # a row a set of rules
    discard(rows)
    left, known, order = [(r["by"], r["n"], r["size"]) for r in seen], set(), []
    whole = max(sum(size for _, _, size in left), 1)

    def gain(k):
        hit = sum(n for by, n, _ in left if by[k]) or 0.5
        work = sum(costs[f] for f in rules[k].needs if f not in known) + LEAST_COST
        return hit / (work * max(sum(size for _, _, size in left), 1) / whole)

    while len(order) < len(rules):
        best = max((k for k in range(len(rules)) if k not in order), key=gain)
        order.append(best)
        known |= set(rules[best].needs)
        left = [x for x in left if not x[0][best]]
    log.info("rules in order: %s; seconds on the sample: %s", ", ".join(rules[k].name for k in order), {f: round(c, 4) for f, c in costs.items()})
    return [rules[k] for k in order]


def cascade(facts: dict[str, Column], rules) -> Column:
    """The name of the first rule that rejects a row, or null. CASE stops at the first that holds."""
    out = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        out = out.when(rule.rejects(facts), F.lit(rule.name))
    return out


def verdict(text: Column, order) -> Column:
    """The rule that rejects a text, or null; its words are split once."""
    return let(words_of(text), lambda words: cascade(lazy_facts(text, words), order))


def judge(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` with ``rejected_by``: null for documents that pass every rule.

    Null and empty texts have no words and fail few_words. Works row by row: ties, repeated
    rows, empty tables and extra columns need no care; a column rejected_by is replaced.
    """
    return docs.withColumn("rejected_by", verdict(F.col("text"), order_rules(docs, rules, sample_rows)))


def keep(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """``docs`` that pass every rule, all columns as they are."""
    return docs.filter(verdict(F.col("text"), order_rules(docs, rules, sample_rows)).isNull())


def quality_report(docs: DataFrame, rules=RULES, sample_rows: int = 2000) -> DataFrame:
    """The counts behind the base rules for every document, ``base_failed`` and the cascade's ``kept``.

    As all counts but that of lines are returned, the rules here read them instead of the text.
    """
    order = order_rules(docs, rules, sample_rows)
    rows = docs.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    later = "n_lines"
    rows = rows.select("doc_id", "text", *[c.alias(name) for name, c in lazy_facts(F.col("text"), F.col("words")).items() if name != later])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("rejected_by", cascade({name: fact(F.col("text"), None) if name == later else F.col(name) for name, fact in FACTS.items()}, order))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))
