"""Winnowed fingerprints against a plain computation, the match guarantee, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from gleaner.llm import winnow

K, W = winnow.GRAM, winnow.WINDOW


def grams(text, k=K):
    k = min(k, len(text))
    return [int(winnow.rolling_hashes(np.array([ord(c) for c in text[i : i + k]], np.uint32), k)[0]) for i in range(len(text) - k + 1)] if text else []


def plain(text, k=K, w=W):
    """Positions and hashes: of each window the least upper half, the rightmost of equal ones."""
    hashes, out = grams(text, k), []
    for i in range(max(1, len(hashes) - w + 1) if hashes else 0):
        window = range(i, min(i + w, len(hashes)))
        best = min(window, key=lambda j: (hashes[j] >> 32, -j))
        if not out or out[-1] != best:
            out.append(best)
    return out, [hashes[j] for j in out]


TEXTS = ["", "a", "short", "x" * 12, "x" * 200, "abcabcabc" * 20, "Größe und Maß \U0001f600 " * 9, "".join(random.Random(5).choice("abcd ") for _ in range(900))]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("piece", [1 << 18, 7])
def test_selection(monkeypatch, text, piece):
    monkeypatch.setattr(winnow, "PIECE", piece)
    at, hashes = winnow.select(text)
    assert (at.tolist(), [int(h) for h in hashes]) == plain(text)


def test_rolling_hashes_depend_on_their_own_points_only():
    a, b = "some words that go on and on", "other words that go on"
    i, j = a.index("words that go"), b.index("words that go")
    assert grams(a)[i] == grams(b)[j] and len(set(grams(a))) == len(grams(a))


def test_match_guarantee():
    """Any passage of GRAM + WINDOW - 1 code points that two texts share is fingerprinted in both."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    for _ in range(50):
        shared = noise(K + W - 1)
        a, b = (noise(rng.randrange(60)) + shared + noise(rng.randrange(60)) for _ in range(2))
        assert np.intersect1d(winnow.select(a)[1], winnow.select(b)[1]).size


def brute(rows):
    """The report by sorting everything in one place."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts, out = [t or "" for _, t in rows], []
    prints = [plain(t)[1] for t in texts]
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if set(a) | set(b) else 1.0
    name = lambda h: hashlib.blake2b(np.array(h, np.uint64).tobytes(), digest_size=16).hexdigest()
    for i, (doc_id, _) in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(rows)]
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        other = plain(edited)[1]
        out.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), name(prints[i]), name(other), like(prints[i], other), like(prints[i], prints[(i + 1) % len(rows)]), len(prints[i])))
    return sorted(out, key=repr)


def check(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, slice int").repartition(parts)
    got = winnow.edit_report(df)
    assert got.columns[0] == "doc_id"
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_report_on_a_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(d, t[:700] if t else t) for d, t in rows]  # the brute-force side is slow
    check(spark, rows)


@pytest.mark.parametrize("rows", [
    [], [(1, "only one text of some length")], [(5, "a"), (3, None), (4, ""), (9, "the quick brown fox jumps over it"), (-2, "z" * 100)],
    [(i, TEXTS[i % len(TEXTS)]) for i in range(40)], [(1, "same text, same id, twice " * 3)] * 3 + [(None, "no id at all " * 5), (0, "end")],
])
def test_odd_rows(spark, rows):
    check(spark, rows)


def test_equal_texts_and_copies(spark):
    a = "a passage that is long enough to have several kept hashes in it, and more of it"
    got = {r["doc_id"]: r for r in winnow.edit_report(spark.createDataFrame([(3, a), (2, a), (1, "quite another text, also of some length, shares nothing")], "doc_id long, text string")).collect()}
    assert got[3]["fingerprint"] == got[2]["fingerprint"] != got[1]["fingerprint"] and got[3]["near_next"] == 1.0 and got[2]["near_next"] < 0.1
    assert 0.1 < got[2]["near_edited"] < 0.8
    kept = {r["doc_id"]: r for r in winnow.fingerprints(spark.createDataFrame([(1, a), (2, None)], "doc_id long, text string")).collect()}
    assert kept[1]["positions"] == plain(a)[0] and kept[2]["hashes"] == []
