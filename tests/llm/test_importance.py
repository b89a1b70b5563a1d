"""Importance resampling against a plain computation, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from gleaner.llm import importance
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, weight string, rank int"


def features(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(x.encode()) % 10_000 for x in runs]


def plain(docs, bench):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in bench:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (total_s + 10_000.0)) / ((s[b] + 1.0) * (total_t + 10_000.0))))
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for k, r in enumerate(able[: len(able) * 25 // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def check(spark, docs, bench):
    df = spark.createDataFrame([(*d, "w", 1) for d in docs], DOCS)
    got = importance.resample(df, spark.createDataFrame([(t,) for t in bench], "text string"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(docs, bench)


def test_whole_tables(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    docs = [tuple(r) for r in read("documents").select("doc_id", "text").collect()]
    check(spark, docs, [r[0] for r in read("benchmark").select("text").collect()])


def test_odd_rows(spark):
    word = "Über-Straße Z9 naïve x "
    docs = [(1, None), (2, ""), (3, "one"), (4, "A b"), (5, word * 30), (5, word * 30), (6, "ab " * 19), (7, "ab " * 20), (8, "ab " * 20), (None, "cd " * 40), (9, "x\x00y|z " * 3000), (10, "--- !!")]
    docs += [(100 + i, f"shared words number {i} " * 8) for i in range(20)]
    check(spark, docs, ["shared words", None, ""])
    check(spark, docs, [])


@pytest.mark.parametrize("n", [0, 3])
def test_few_documents(spark, n):
    check(spark, [(i, "many words here " * 10) for i in range(n)], ["words"])


def test_drawn_documents_keep_their_columns(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 30, "w", 1) for i in range(40)], DOCS)
    got = importance.drawn_documents(df, spark.createDataFrame([("word3 word3",)], "text string"))
    assert got.count() == 10 and got.columns == df.columns


def test_runs_of_three(spark):
    words = F.array(*[F.lit(w) for w in "a b c d".split()])
    got = spark.range(1).select(importance.bucket_array(words, most=3)).first()[0]
    want = [zlib.crc32(x.encode()) % 10_000 for x in ("a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d")]
    assert got == want
