"""URL filters: listed host and path rules, and token rules mined with FP-growth.

DataFrame and SQL functions throughout.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The item that marks a labelled url as unwanted.
BAD = "\x00bad"
#: Production parameters: support of token sets among labelled urls, confidence of rules.
SUPPORT, CONFIDENCE = 0.005, 0.6
#: Unwanted urls that must back a rule, however few labels there are.
LEAST = 25
#: Tokens of a basket up to which FP-growth enumerates its subsets.
LONGEST = 12
#: Rules in a literal index; more are joined.
LITERAL_RULES = 2000


@dataclass(frozen=True)
class Listed:
    rule: str
    verdict: str


#: The listed rules of op1.
LISTED = (Listed("com/", "allow"), Listed("example.com/en/", "block"), Listed("www.example.com/en/", "allow"), Listed("net/es/", "block"), Listed("net/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for a url without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens: host labels as h:…, the words of labels with hyphens as w:…, path segments without digits as p:…."""
    labels = F.array_remove(F.split(host, r"\."), "")
    parts = F.array_remove(F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.split(x, "-"))), "")
    segments = F.filter(F.split(F.translate(path, UPPER, LOWER), "/"), lambda s: (s != "") & ~s.rlike("[0-9]"))
    mark = lambda kind, a: F.transform(a, lambda x: F.concat(F.lit(kind), x))
    return F.array_distinct(F.concat(mark("h:", labels), mark("w:", parts), mark("p:", segments)))


def listed_verdict(host: Column, path: Column, rules) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, or null.

    A rule ``h/p`` fits host ``h`` and its subdomains if the path starts with ``/p``. Rules are
    tried from the longest on; equal lengths in code point order.
    """
    out = F.when(F.lit(False), F.struct(F.lit("").alias("rule"), F.lit("").alias("verdict")))
    for x in sorted(rules, key=lambda x: (-len(x.rule), x.rule)):
        own, slash, rest = x.rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        out = out.when(fits, F.struct(F.lit(x.rule).alias("rule"), F.lit(x.verdict).alias("verdict")))
    return out


def mine_rules(urls: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(tokens, confidence, support, hook): combinations of tokens whose urls are mostly unwanted.

    ``urls`` (url_id, url), ``labels`` (url_id, bad). FP-growth runs on all labelled urls, each a
    basket of its tokens and, if bad, a mark; rules that conclude the mark stay if they are above
    the two thresholds and ``least`` unwanted urls back them. A rule that contains another one's
    tokens with no more confidence goes. hook is the rule's token that fewest labelled urls have.

    Baskets are made short first, which changes no rule: tokens that too few unwanted urls have
    go, and of tokens that the same urls have one stands for all. If one is still longer than
    ``longest``, whose subsets FP-growth would enumerate, sets are counted level by level instead,
    with the same rules as a result. A rule has as many tokens as it takes. Rules are written once.
    """
    judged = labels.groupBy("url_id").agg(F.max(F.coalesce(F.col("bad"), F.lit(False))).alias("bad"))
    rows = urls.join(judged, "url_id").select(tokens_of(host_of(F.col("url")), path_of(F.col("url"))).alias("t"), "bad").filter(F.size("t") > 0)
    rows = materialize(rows.withColumn("id", F.monotonically_increasing_id()), "url-baskets")
    n = max(1, rows.count())
    backing = max(least, 1, math.ceil(Fraction(str(support)) * n))  # unwanted urls, exactly
    single = rows.select("id", "bad", F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("b"), F.bit_xor(F.xxhash64("id")).alias("same"))
    single = single.filter(F.col("b") >= backing)
    kinds = single.groupBy("n", "same").agg(F.min("token").alias("kind"))
    members = materialize(single.join(kinds, ["n", "same"]).select("token", "kind", "n"), "url-tokens")
    short = rows.select("id", "bad", F.explode("t").alias("token")).join(members, "token").groupBy("id", "bad").agg(F.array_sort(F.collect_set("kind")).alias("t"))  # those of one url
    short = materialize(short, "url-short")
    if (short.agg(F.max(F.size("t")).alias("m")).first()["m"] or 0) <= longest:
        found = _by_growth(short, n, backing, confidence)
    else:
        found = _by_level(short, n, backing, confidence)
    found = materialize(found, "url-found")
    rules = _spelt(materialize(_pruned(found), "url-pruned"), members)
    for done in (rows, short):
        discard(done)
    return materialize(rules, "url-rules")


def _by_growth(baskets: DataFrame, n: int, backing: int, confidence: float) -> DataFrame:
    items = baskets.select(F.when(F.col("bad"), F.concat("t", F.array(F.lit(BAD)))).otherwise(F.col("t")).alias("items"))
    held = max(1, items.count())  # FP-growth takes a share and rounds it up to a count again: half a url less makes that ``backing``
    rules = FPGrowth(itemsCol="items", minSupport=min(1.0, (backing - 0.5) / held), minConfidence=confidence).fit(items).associationRules
    rules = rules.filter(F.col("consequent") == F.array(F.lit(BAD)))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * held / n).alias("support"))


def _by_level(baskets: DataFrame, n: int, backing: int, confidence: float) -> DataFrame:
    """Rules of which ``_pruned`` leaves the same as of FP-growth's, from counts of sets, a level at a time.

    A set grows by a token that comes after its own, if it has the backing, some of its urls are
    wanted, and the token isn't on all of its urls: else the larger set has no higher confidence
    than a part of it, and neither has any set that holds it.
    """
    sets = baskets.select("bad", "t", F.explode("t").alias("x")).select("bad", "t", F.array("x").alias("tokens"), F.lit(n + 1).cast("long").alias("held"))
    out = None
    while True:
        counts = sets.groupBy("tokens").agg(F.count("*").alias("m"), F.count_if("bad").alias("b"), F.first("held").alias("held"))
        counts = materialize(counts.filter((F.col("b") >= backing) & (F.col("m") < F.col("held"))), "url-level")
        rules = counts.filter(F.col("b") / F.col("m") >= confidence).select("tokens", (F.col("b") / F.col("m")).alias("confidence"), (F.col("b") / n).alias("support"))
        out = rules if out is None else out.unionAll(rules)
        mixed = counts.filter("b < m")
        if mixed.isEmpty():
            return out
        grown = sets.drop("held").join(mixed.select("tokens", F.col("m").alias("held")), "tokens")
        after = F.filter("t", lambda x: x > F.element_at("tokens", -1))
        sets = grown.select("bad", "t", "tokens", "held", F.explode(after).alias("x")).select("bad", "t", F.concat("tokens", F.array("x")).alias("tokens"), "held")
        sets = materialize(sets, "url-sets")


def _pruned(rules: DataFrame) -> DataFrame:
    """Without rules that add tokens to another rule and aren't more confident."""
    masks = F.sequence(F.lit(1).cast("long"), F.pow(F.lit(2), F.size("tokens")).cast("long") - 2)
    parts = F.transform(masks, lambda mask: F.filter("tokens", lambda x, i: F.pmod(F.floor(mask / F.pow(F.lit(2), i)), F.lit(2)) == 1))
    inner = rules.filter(F.size("tokens") > 1).select("tokens", "confidence", F.explode(parts).alias("part"))
    less = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c"))
    beaten = inner.join(less, "part").filter(F.col("c") >= F.col("confidence")).select("tokens").distinct()
    return rules.join(beaten, "tokens", "left_anti")


def _spelt(rules: DataFrame, members: DataFrame) -> DataFrame:
    """Rules with each token in turn for the one that stands for it, and their hooks."""
    out = rules.withColumns({"got": F.array().cast("array<string>"), "uses": F.array().cast("array<struct<n:bigint,token:string>>")})
    for k in range(rules.agg(F.max(F.size("tokens")).alias("m")).first()["m"] or 0):
        here = members.select(F.col("kind").alias("_kind"), F.col("token").alias("_token"), F.col("n").alias("_n"))
        with_token = out.filter(F.size("tokens") > k).withColumn("_kind", F.get("tokens", F.lit(k))).join(here, "_kind")
        with_token = with_token.withColumn("got", F.array_append("got", F.col("_token"))).withColumn("uses", F.array_append("uses", F.struct(F.col("_n").alias("n"), F.col("_token").alias("token"))))
        out = out.filter(F.size("tokens") <= k).unionAll(with_token.select(*out.columns))
    return out.select(F.array_sort("got").alias("tokens"), "confidence", "support", F.array_min("uses")["token"].alias("hook"))


def mined_match(tokens: Column, rules: list) -> Column:
    """The tokens of the most confident mined rule that fits, blank-joined, or null.

    The rules are an inverted index: each hangs on its hook, so a url only meets rules of which
    it has that token.
    """
    if not rules:
        return F.lit(None).cast("string")
    index: dict[str, list] = {}
    for r in rules:
        index.setdefault(r["hook"], []).append(r)
    entry = lambda r: F.struct(F.lit(float(r["confidence"])).alias("c"), F.lit(float(r["support"])).alias("s"), F.array(*[F.lit(t) for t in r["tokens"]]).alias("t"))
    table = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*[entry(r) for r in rs]))])
    none = F.array().cast("array<struct<c:double,s:double,t:array<string>>>")
    met = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), none)))
    fits = F.filter(met, lambda r: F.size(F.array_except(r["t"], tokens)) == 0)
    return F.array_join(F.array_max(fits)["t"], " ")


def judge_urls(pages: DataFrame, rules: DataFrame | list | None, listed=LISTED) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and mined_rule.

    A listed rule decides if one fits; else a fitting mined rule blocks, else the url is
    allowed. Null urls and urls without ``://`` have empty host and path, fit nothing and are
    allowed. Each row is judged on its own: repeated rows and empty tables need no care.
    """
    if isinstance(rules, DataFrame):
        few = rules.limit(LITERAL_RULES + 1).collect()
        if len(few) > LITERAL_RULES:
            return _judge_by_join(pages, rules, listed)
        rules = few
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_listed", listed_verdict(F.col("host"), F.col("path"), listed))
    rows = rows.withColumn("mined_rule", mined_match(tokens_of(F.col("host"), F.col("path")), rules or []))
    return rows.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), _verdict(), "mined_rule")


def _verdict() -> Column:
    return F.coalesce(F.col("_listed.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")


def _judge_by_join(pages: DataFrame, rules: DataFrame, listed) -> DataFrame:
    """For many rules: distinct token sets meet an index table of rules by their hooks, the rarest tokens."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_t", F.array_sort(tokens_of(F.col("host"), F.col("path"))))
    sets = rows.select("_t").distinct().withColumn("_k", F.explode("_t"))
    hung = rules.withColumnRenamed("hook", "_k").withColumnRenamed("tokens", "_r")
    fits = sets.join(hung, "_k").filter(F.size(F.array_except("_r", "_t")) == 0)
    best = fits.groupBy("_t").agg(F.max(F.struct("confidence", "support", "_r")).alias("b")).select("_t", F.array_join("b._r", " ").alias("mined_rule"))
    rows = rows.join(best, "_t", "left").withColumn("_listed", listed_verdict(F.col("host"), F.col("path"), listed))
    return rows.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), _verdict(), "mined_rule")


def url_report(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """All pages judged; unwanted in training is a page whose label has quality 0 or toxic 1."""
    bad = labels.select(F.col("doc_id").alias("url_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rules = mine_rules(pages.select(F.col("page_id").alias("url_id"), "url"), bad, support, confidence)
    return judge_urls(pages, rules)
