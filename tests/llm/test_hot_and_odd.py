"""Many rows under one or no id, and rows that differ though their ids don't."""

import random
from collections import Counter

from gleaner.llm import decontam, mixing, warc


def test_one_response_a_group_of_equal_pages(spark):
    rows = [(None, "http://a", "A")] + [(3, "http://a", "A")] * 2 + [(5, "http://b", "A"), (None, "http://c", "C"), (None, "http://d", "C"), (7, None, None), (8, "http://e", "")]
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_report(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter({(3, 1, "response", None): 1, (3, 1, "revisit", 3): 1, (None, 1, "revisit", 3): 1, (5, 1, "revisit", 3): 1, (None, 1, "response", None): 1, (None, 1, "revisit", None): 1, (7, 0, "response", None): 1, (8, 0, "revisit", 7): 1})


def test_most_pages_without_an_id(spark):
    pages = spark.range(3000).selectExpr("if(id % 10 = 0, id, null) AS page_id", "'http://h' AS url", "if(id % 3 = 0, '', concat('page ', id % 50)) AS html")
    got = Counter(r["record_type"] for r in warc.archive_report(pages).select("record_type").collect())
    assert got == Counter({"response": 51, "revisit": 2949})


def test_rows_of_one_id_are_mixed_by_themselves(spark):
    rows = [(1, "a " * 100, "x", 0), (1, "b " * 10, "y", 1), (None, "c " * 50, "x", 2), (None, "d " * 50, "y", 3), (2, None, "x", 4), (3, "e " * 300, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = Counter(r["size"] for r in mixing.mixed_documents(docs).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    taken = {(r["source"], r["size"]): r["taken"] for r in mixing.taken_words(docs).collect()}
    for _, text, source, number in rows:
        n = len((text or "").split())
        assert got[number] == (int(taken[source, n] / n + 0.5) if n else 1)


def test_windows_across_runs_of_a_long_item(spark):
    rng = random.Random(1)
    item = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    texts = [" ".join(["x"] * 5 + item[a : a + 13] + ["y"]) for a in range(0, 387, 7)] + [" ".join(item[a : a + 12]) for a in range(0, 380, 11)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([("i", " ".join(item)), ("j", " ".join(item[:7])), ("k", "q " * 30)], "item_id string, text string")
    want = {i: 13 if i < 56 else 7 if i == 56 else 0 for i in range(len(texts))}
    want[0] = 13
    for limit in (1 << 20, 640):
        got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.contamination_report(docs, items, limit=limit).collect()}
        assert {k: v[0] for k, v in got.items()} == want
        assert got[0][1] == 2 and got[1][1] == 1 and got[56][1] == 1


def test_automaton_memory(spark):
    """A megabyte of items takes under 300 MB."""
    import subprocess
    import sys

    code = """
import random, resource
from gleaner.llm.decontam import Scanner
rng = random.Random(1)
words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20000)]
items = [(str(i), " ".join(rng.choices(words, k=120))) for i in range(1250)]
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
Scanner(items)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 300


def test_parts_of_a_benchmark_are_even_and_repeats_count_once(spark):
    items = spark.createDataFrame([("same", "alpha beta gamma delta " * 5)] * 300 + [(str(i), f"word{i} " * 20) for i in range(200)], "item_id string, text string")
    parts = [[len(r["text"]) for r in p.collect()] for p in decontam.benchmark_parts(items, limit=4096)]
    longest = max(map(max, parts))
    assert len(parts) > 3 and sum(map(len, parts)) == 201 and all(sum(p) <= 4096 + longest for p in parts)
    assert all(sum(p) > 4096 - longest for p in parts[:-1])


def test_columns_of_any_name_stay(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", "y"), (2, "clean words", "z", "w")], "doc_id long, text string, row string, _row string")
    items = spark.createDataFrame([("i", "a b c"), ("j", "other things entirely")], "item_id string, text string")
    for limit in (1 << 20, 4):
        kept = decontam.drop_contaminated(docs, items, limit=limit)
        assert [tuple(r) for r in kept.collect()] == [(2, "clean words", "z", "w")] and kept.columns == docs.columns
