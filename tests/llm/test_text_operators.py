"""Quality rules, sharding, mixing, decontamination and language ID against brute force, with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from gleaner.llm import decontam, langid, mixing, quality, shard
from gleaner.llm.queries import QUERIES
from oracle import compare, duck
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, _words int, rid int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def odd_rows(spark, more=()):
    """Nulls everywhere, empty and long texts, repeated rows, and columns with names that operators use inside."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [
        (1, "one two  three\tfour\n\none two", "en", "b", 1, 1), (1, "one two  three\tfour\n\none two", "en", "b", 1, 1), (2, None, None, None, None, None),
        (3, "", "fr", "", 0, 0), (4, " \n\t ", "fr", "é", 0, 0), (5, long, "en", "b", 0, 0), (6, "a b c d e f g h " * 30, "en", "a", 0, 0),
        (None, "x\x00y ### $$ |", None, "a", 0, 0), (7, "line\nline\n\n \nline", "de", "Z", 0, 0), *more,
    ]
    return spark.createDataFrame(rows, DOCS)


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality(spark):
    docs = odd_rows(spark)
    got = quality.quality_report(docs).collect()
    want = Counter((r["doc_id"], *brute_quality(r["text"])) for r in docs.collect())
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert quality.quality_report(docs.limit(0)).count() == 0
    judged = quality.judge(docs)
    assert judged.columns == [*docs.columns, "rejected_by"]
    assert {r["doc_id"] for r in judged.where("rejected_by is null").collect()} <= {r["doc_id"] for r in got if r["kept"]}


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    words = F.split("text", " ")
    docs = spark.createDataFrame([("# " * 30,), ("ok " * 3,), (" ".join(f"word{i}" for i in range(40)),)], "text string")
    verdict = lambda rules: [r["x"] is None for r in docs.select(quality.cascade(quality.lazy_facts(F.col("text"), words), rules).alias("x")).collect()]
    assert verdict(quality.RULES) == verdict(quality.RULES[::-1]) == [False, False, True]


def test_shards(spark):
    docs = odd_rows(spark, [(100 + i, f"text {i} " * (i % 13), "en", "s", 0, 0) for i in range(400)])
    got = shard.shard_report(docs).collect()
    assert len(got) == docs.count()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = {k: [r for r in got if r["shard"] == k] for k in {r["shard"] for r in got}}
    for rows in by.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert set(by) <= set(range(16))
    assert shard.shard_report(docs.limit(0)).count() == 0


def test_shards_are_even_and_keep_small_groups_whole(spark):
    docs = spark.createDataFrame([(i, f"{i % 700:05d}" * 9) for i in range(2100)], "doc_id long, text string")
    got = shard.shard_report(docs).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) < 0.06 * sum(sizes.values()) / 16
    whole = {r["text_crc32"]: set() for r in got}
    for r in got:
        whole[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in whole.values())


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return {**capped, **share}
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    docs = odd_rows(spark, [(100 + i, "w " * (i % 50), "en", "abc"[i % 3] if i % 20 else "tiny", 0, 0) for i in range(900)])
    got = mixing.taken_words(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want = brute_targets(sizes)
    assert len(got) == docs.count()
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, target in want.items():
        assert abs(taken[s] - target) <= 0.01 * target + 20
    again = mixing.taken_words(docs.repartition(3)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    assert key(again) == key(got)
    assert mixing.taken_words(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.taken_words(blank).collect()] == [0, 0] and mixing.mixed_documents(blank).count() == 2


def test_every_slot_of_the_schedule_is_filled_once(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2]) for i in range(50)], "doc_id long, text string, source string")
    _, pieces = mixing.mix(docs)
    per = pieces.groupBy("slot").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).collect()
    assert {r["n"] for r in per} == {1} and len({r["slot"] for r in per}) == len(per)


FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(docs, items):
    windows = {}
    for key, text in items:
        words = BENCH_WORD.findall((text or "").translate(FOLD))
        for i in range(max(1, len(words) - 12) if words else 0):
            windows.setdefault(tuple(words[i : i + 13]), set()).add(str(key))
    out = Counter()
    for key, text in docs:
        words = BENCH_WORD.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                if keys := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= keys
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[key, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)] += 1
    return out


def contaminated_tables(spark):
    item = "The quick brown fox, jumps over 13 lazy dogs while été zebras sleep soundly at noon"
    items = [(10, item), (9, item.upper()), (2, "Short answer"), (3, None), (4, "?!"), (10, item)]
    docs = odd_rows(spark, [(50, f"Before it. {item.replace(' ', '--')} and after", "en", "a", 0, 0), (51, item[:40], "en", "a", 0, 0), (52, "a SHORT, answer! " + "x " * 200, "en", "a", 0, 0), (53, "shortanswer", "en", "a", 0, 0)])
    return docs, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [1 << 20, 60])
def test_contamination(spark, limit):
    docs, items = contaminated_tables(spark)
    want = brute_contamination([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert Counter(tuple(r[n] for n in names) for r in decontam.contamination_report(docs, items, limit=limit).collect()) == want
    kept = decontam.drop_contaminated(docs, items, limit=limit)
    assert kept.columns == docs.columns
    clean = sum(n for k, n in want.items() if not k[-1])
    assert kept.count() == clean and 50 not in {r["doc_id"] for r in kept.collect()}
    assert decontam.contamination_report(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination_report(docs.limit(0), items).count() == 0


def test_spans_point_into_the_original(spark):
    docs, items = contaminated_tables(spark)
    row = decontam.find_passages(docs.where("doc_id = 50"), items).first()
    raw = docs.where("doc_id = 50").first()["text"].encode()
    span = row["spans"][0]
    assert raw[span["from_byte"] : span["to_byte"]].decode().startswith("The--quick") and raw[: span["to_byte"]].decode().endswith("noon")


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    more = docs.unionAll(spark.createDataFrame([(None, "the and of", None), (9001, None, None), (9002, "12 !?", "xx"), (9003, "", "xx")], docs.schema))
    got = {r["doc_id"]: r for r in langid.language_report(more).collect()}
    truth = [(r["doc_id"], r["lang"]) for r in docs.collect()]
    held = [(i, lang) for i, lang in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"] and i in dict(truth)} == {i for i, _ in held}
    assert sum(got[i]["lang_pred"] == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (9001, 9002, 9003)} == {"und"}
    assert langid.language_report(docs.limit(0)).count() == 0
    unlabelled = docs.limit(3).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.language_report(unlabelled).collect()} == {"und"}


def test_phrase_counts_against_brute_force():
    parser = langid.CrossParser({"a": "abracadabra abba", "b": "xyz zyx yy"})
    sample = {"a": "abracadabra abba", "b": "xyz zyx yy"}

    def brute(text, base):
        n, i = 1, 0
        cur = ""
        for ch in text:
            if cur + ch in base:
                cur += ch
            else:
                n, cur = n + 1, ch if ch in base else ""
            i += 1
        return n

    rng = random.Random(2)
    long = ["".join(rng.choices("abcdrxyz ", k=4000)).replace("  ", " ").strip(), "abra" * 1000, "zyx" * 700 + "abba" * 400, "y" * 1500]
    for text in ("abra", "abba xyz", "zzz", "cad q abr", "a", *(" ".join(x.split()) for x in long)):
        counts, ok = parser.phrases([text])
        assert ok[0] and counts[0].tolist() == [brute(text, sample["a"]), brute(text, sample["b"])]


def test_parsers_travel():
    import pickle

    parser = langid.CrossParser({"a": "abracadabra abba", "b": "xyz zyx yy"})
    again = pickle.loads(pickle.dumps(parser))
    assert (again.phrases(["abba xyz q"])[0] == parser.phrases(["abba xyz q"])[0]).all()


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_sql_twins(spark, sf_dir, name):
    assert compare(spark, duck(sf_dir), *QUERIES[name], sf_dir) is None
