"""The complete similarity search of the near-duplicate filter against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest
from gleaner.llm import setjoin, simhash
from test_pipeline import first_of_near_copies

T = Fraction(4, 5)


def words(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n)]


def changed(rng, text, k):
    """``text`` with ``k`` runs of words replaced at its end, so that few shingles change for many words."""
    return [*text[: len(text) - k], *words(rng, k)]


@pytest.mark.parametrize("n", [20, 45, 100, 400])
def test_every_pair_at_the_threshold_is_found(spark, n):
    """Pairs that are just similar enough and pairs that just aren't, each alone among the others."""
    rng = random.Random(n)
    pairs = [[(w := words(rng, n + 4)), changed(rng, w, k)] for k in range(max(1, n // 12), n // 7 + 2) for _ in range(12)]
    docs = [(i, " ".join(t), "s") for i, t in enumerate(t for p in pairs for t in p)]
    want = [d[0] for d in first_of_near_copies(docs)]
    assert len(docs) // 2 < len(want) < len(docs)
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("crowd", [3, 256])
def test_groups_of_copies_and_shared_passages(spark, crowd):
    rng = random.Random(crowd)
    passage, base = words(rng, 40), words(rng, 90)
    texts = [[*words(rng, 30), *passage, *words(rng, 30)] for _ in range(60)]
    for _ in range(80):
        t = list(base)
        for at in rng.sample(range(90), rng.randrange(5)):
            t[at] = words(rng, 1)[0]
        texts.append(t)
    texts += [words(rng, rng.randrange(9)) for _ in range(20)] + [["same"], ["Same"], [], []]
    docs = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, source string"), crowd=crowd)
    blank = [k for k, t, _ in docs if not t]  # copies of each other, though brute force sees no similarity
    want = [d[0] for d in first_of_near_copies([d for d in docs if d[1]])] + blank[:1]
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_one_group_of_most_rows(spark):
    rng = random.Random(3)
    base = words(rng, 120)
    docs = [(i, " ".join([*base[:60], words(rng, 1)[0], *base[61:]]) if i % 10 else " ".join(words(rng, 50))) for i in range(1500)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted([1, *range(0, 1500, 10)])


def family(n, own, shared, seed=11):
    """Texts of ``own`` words each beside ``shared`` ones that all have, so that shared - 4 of some shared + own shingles are common to all."""
    rng = random.Random(seed)
    passage = words(rng, shared)
    return [(i, " ".join([*words(rng, own), *passage])) for i in range(n)]


def test_a_passage_that_most_of_every_text_is_makes_no_lists(spark):
    """85 of 100 shingles in common is a similarity of 0.74: none may be linked, and no two texts may meet."""
    docs = family(4000, 15, 89)
    sets = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in docs[:2]]
    assert (len(sets[0] & sets[1]), len(sets[0])) == (85, 100)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    late = setjoin.common_tokens(df, 5, T, setjoin.CROWD, 84_000)
    assert setjoin.shared_lists(setjoin.postings(df, 5, T, late)).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 4000


def test_a_passage_that_makes_all_texts_similar(spark):
    df = spark.createDataFrame(family(600, 6, 89) + [(1000 + i, t) for i, t in family(300, 40, 89, 12)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()) == [0, *range(1000, 1300)]


def test_sizes_between_which_similar_sets_lie(spark):
    """Sets of many sizes around a common core, against brute force: the smaller set of a pair is early."""
    rng = random.Random(21)
    core = words(rng, 70)
    texts = [[*words(rng, rng.randrange(12)), *core[rng.randrange(12) :], *words(rng, rng.randrange(12))] for _ in range(150)]
    docs = [(i, " ".join(t), "s") for i, t in enumerate(texts)]
    for crowd in (2, 256):
        got = simhash.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, source string"), crowd=crowd)
        assert sorted(r["doc_id"] for r in got.collect()) == [d[0] for d in first_of_near_copies(docs)]


def test_fingerprints_never_discard_what_is_similar():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 500, 5000):
        for _ in range(20):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 2), dtype=np.uint64)])) for _ in range(2))
            both = len(np.intersect1d(a, b))
            if both * 5 >= 4 * (len(a) + len(b) - both):
                (tier, *_) = set(setjoin.tiers_of(len(a), T)) & set(setjoin.tiers_of(len(b), T))
                f = [setjoin.set_fingerprint(s, 1024 * 4**tier) for s in (a, b)]
                assert setjoin.distances(*f) <= setjoin._limit(len(a), len(b), T)
                whole = setjoin.set_fingerprint(a, 1024 * 4 ** (tier + 1))
                assert (np.bitwise_xor.reduce(whole.reshape(4, -1)) == f[0]).all()
                small, large = sorted((a, b), key=len)
                first = np.intersect1d(a, b)[0]
                assert first in large[: setjoin.prefix_length(len(large), T)] and first in small[: setjoin.early_length(len(small), T)]


def test_shingles_and_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    text = " \n".join(words(rng, 3000))
    texts = [text, None, "", " \t\x0b\f\r\n", "One  two\x1fthree four FIVE", " one two\x1fthree\nfour five ", "a b", text.upper() + " ", "b a", "\u00a0 \u2003x"]
    sets = setjoin.shingle_sets(pa.array(texts, pa.string()), 5)
    assert [len(s) for s in sets] == [2996, 0, 0, 0, 1, 1, 1, 2996, 1, 1]
    assert (sets[0] == sets[7]).all() and (sets[6] != sets[8]).all()
    prints = simhash.fingerprint_many([text, "one two", "a b c", "", None])
    monkeypatch.setattr(simhash, "PIECE", 10)
    assert (simhash.fingerprint_many([text, "one two", "a b c", "", None]) == prints).all()


def test_tiers_overlap():
    for n in range(1, 40_000):
        least = -(-4 * n // 5)
        assert setjoin.tiers_of(n, T)[0] in setjoin.tiers_of(least, T)


def test_lists_go_on_over_batches():
    import pyarrow as pa

    tiers = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 1])
    lists = np.array([1, 1, 2, 2, 2, 2, 2, 3, 5, 5, 5, 6])
    fps = [np.full(16 * 4**k, i, np.uint64).tobytes() for i, k in enumerate(tiers)]
    for seed in range(50):
        cuts = sorted(random.Random(seed).choices(range(13), k=seed % 6))
        batches = [pa.RecordBatch.from_arrays([pa.array(tiers[a:b]), pa.array(lists[a:b]), pa.array(fps[a:b], pa.binary())], ["tier", "list", "fp"]) for a, b in zip([0, *cuts], [*cuts, 12], strict=True)]
        got = list(setjoin._whole_lists(batches))
        assert [x for g in got for x in g[0]] == lists.tolist()
        assert [int(x) for g in got for x in g[1][:, 0]] == list(range(12))
        keys = [{(g[1].shape[1], x) for x in g[0]} for g in got]
        assert sum(map(len, keys)) == len(set().union(*keys)) == 6
