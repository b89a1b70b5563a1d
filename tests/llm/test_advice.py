"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from gleaner.llm import decontam, langid, mixing, simhash


def _words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]


def test_texts_that_share_a_repeated_phrase_only_are_no_near_copies(spark):
    rng = random.Random(5)
    phrase = _words(rng, 7)
    texts = [" ".join(w for _ in range(50) for w in [*phrase, *_words(rng, 7)]) for _ in range(12)]
    texts.append(texts[0].replace(texts[0].split()[-1], "other"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()) == list(range(12))


def test_rows_without_or_with_the_same_doc_id_are_documents_of_their_own(spark):
    rng = random.Random(7)
    a, b, c, d, e = (" ".join(_words(rng, 30)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (3, d), (None, d), (2, e), (1, e)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, a), (0, b), (3, c), (3, d), (1, e)])


def test_small_sources_are_taken_to_the_word(spark):
    """With blocks of some 60 words a source of 20 is a third of one."""
    rows = [(i, "w " * 1000, "big" if i % 2 else "large") for i in range(3000)] + [(10_000 + i, "v " * 20, f"s{i:02}") for i in range(40)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    small = [r for r in got if r["source"].startswith("s")]
    assert len(small) == 40 and all(r["target"] == 60 and r["taken"] == 60 for r in small)
    assert sum(r["taken"] for r in got) == pytest.approx(sum({r["source"]: r["target"] for r in got}.values()), rel=0.01)


def test_items_without_an_id_are_found(spark):
    passage = " ".join(_words(random.Random(8), 20))
    docs = spark.createDataFrame([(1, passage), (2, "clean text")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage)], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontam.contamination_report(docs, items).collect()}
    assert got[1]["n_hit"] == 20 and got[1]["n_items"] == 0 and got[1]["contaminated"] and not got[2]["contaminated"]
    assert [r["doc_id"] for r in decontam.drop_contaminated(docs, items).collect()] == [2]


def test_languages_of_many_scripts_are_told_apart(monkeypatch):
    rng = random.Random(9)
    starts = {"el": 0x3B1, "ru": 0x430, "hy": 0x561, "ka": 0x10D0, "zh": 0x4E00, "ja": 0x5200, "ko": 0xAC00, "xx": 0x20000}
    write = lambda first, n: " ".join("".join(chr(first + int(24 * rng.random() ** 2)) for _ in range(5)) for _ in range(n))
    samples = {lang: write(first, 400) for lang, first in starts.items()} | {"en": write(0x61, 4000)}
    texts = {lang: write(first, 10) for lang, first in starts.items()}
    parser = langid.CrossParser(samples)
    assert [p[0] for p in parser.predict(list(texts.values()))] == list(texts)
    monkeypatch.setattr(langid, "TABLE_BYTES", 0)
    assert (langid.CrossParser(samples).phrases(list(texts.values()))[0] == parser.phrases(list(texts.values()))[0]).all()


def test_every_language_that_occurs_is_learnt(spark):
    rows = [(i, f"text {i}", f"l{i % 70:02}") for i in range(140)]
    assert len(langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == 70
