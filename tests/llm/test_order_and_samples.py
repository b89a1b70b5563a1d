"""The order of quality rules from measured costs, and the samples that languages are learnt from."""

from gleaner.llm import langid, quality
from pyspark.sql import functions as F


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_costs_are_measured(spark):
    docs = frame(spark, ["word " * 400 + "\n"] * 300)
    costs = quality.measured_costs(docs, {"words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}, tries=3)
    assert set(costs) == {"words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"}
    assert min(costs.values()) >= quality.LEAST_COST and costs["n_repeat_words"] > costs["n_words"]


def test_rules_go_by_rejections_per_cost(spark):
    good = "plain words of a text that is long enough to be kept by every rule that there is here, twenty and more of them"
    docs = frame(spark, ["few words"] * 40 + [good + " # $ % & * < > | # $ % &"] * 30 + [good] * 50)
    flat = dict.fromkeys(("words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), 1.0)
    names = lambda costs: [r.name for r in quality.order_rules(docs, costs=costs)]
    assert names(flat)[:2] == ["few_words", "symbol_heavy"]
    assert names(flat | {"n_symbols": 1e6})[0] == "few_words" and names(flat | {"n_symbols": 1e6})[-1] == "symbol_heavy"
    assert names(flat | {"words": 1e3, "n_dup_lines": 1e-3, "n_symbols": 1e-3})[0] in ("few_words", "line_repeats")
    assert sorted(names(None)) == sorted(r.name for r in quality.RULES)


def test_the_order_changes_no_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [{r[0] for r in docs.filter(quality.verdict(F.col("text"), order).isNull()).select("doc_id").collect()} for order in (quality.RULES, quality.RULES[::-1])]
    assert kept[0] == kept[1] == {r["doc_id"] for r in quality.keep(docs).select("doc_id").collect()}


def test_texts_that_share_an_id_are_all_learnt(spark):
    rows = [(1, "alpha beta", "a"), (1, "omega psi", "a"), (1, "omega psi", "a"), (2, "gamma", "a"), (None, "delta", "b"), (3, None, "b"), (4, "x", None)]
    got = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"a", "b"} and sorted(got["a"].split()) == ["alpha", "beta", "gamma", "omega", "psi"] and got["b"].split() == ["delta"]
    few = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), docs_per_lang=1)
    assert len(few["a"].split()) in (1, 2)
