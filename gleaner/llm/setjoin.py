"""A complete search for texts whose word shingle sets have a Jaccard similarity of at least t.

Candidates. Put the shingles of a set in an order that all sets share. The first one that two
sets with a similarity of t or more have in common is among the first n - ceil(t n) + 1 of the
larger set, and among the first m - ceil(2 t m / (1 + t)) + 1 of the other, which has m. Sets meet in
the lists of their first shingles only; a set is early in a list whose shingle is among the
second, fewer ones, and pairs have an early set. The order is by hash, but shingles that very
many sets begin with come last: a passage that many texts share is then late in all of them, and
its lists, without an early set, are none, unless so much is shared that the sets are similar.
Lists of the same sets are one list.

Fingerprints. A set's fingerprint has a bit for each of some classes of shingles: whether it
holds an odd number of them. Two fingerprints differ in at most as many bits as the sets have
different shingles, which is at most (1 - t) / (1 + t) of both sizes together for a similarity
of t: the discarded pairs are none of the wanted. In long lists a table of distances to some
fingerprints of the list (pivots) discards most pairs by a coordinate's difference first.
Larger sets have longer fingerprints: tiers of sizes overlap so far that every two sets of
similar size have one in common.

Verification. What is left is compared shingle by shingle: first as many pairs as would connect
all, then, between groups that are still apart, the closest pairs of each set and at last all.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, marked, materialize, slot, slot_map
from gleaner.llm.components import components

#: Bits of fingerprints of the first tier, the largest sets in it, and how much both grow from tier to tier.
BITS, LARGEST, GROWTH = 1024, 1536, 4
#: Sets that begin with a shingle from which on it is put last, and the most of such shingles that are broadcast.
CROWD, CROWDS = 256, 1 << 20
#: One of so many texts, by hash, is looked at for shingles to be put last; which ones are changes no result.
SAMPLED = 16
#: Rows of a list from which on pivots are used, and how many.
LONG, PIVOTS = 64, 8
#: Pairs compared at once.
PAIRS = 1 << 16
#: Bytes of words hashed at once.
PIECE = 1 << 20

_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)], np.uint64)


_SOLID = np.array([b != 0x20 and not 9 <= b <= 0x0D for b in range(256)])


@lru_cache(1)
def _powers(n: int) -> np.ndarray:
    p = np.full(n, 0x9E3779B97F4A7C15, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, A-Z lower-cased, and the number of words of each.

    A word's hash is its bytes times powers of a number, summed up and mixed.
    """
    low = pc.ascii_lower(pc.fill_null(texts, ""))
    _, offsets, raw = low.buffers()
    cuts = np.frombuffer(offsets, np.int32, len(low) + 1, 4 * low.offset).astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[: cuts[-1]] if raw else np.zeros(0, np.uint8)
    solid = _SOLID[data]
    follows = np.zeros(len(data) + 1, bool)
    follows[1:] = solid
    follows[cuts] = False
    starts = np.flatnonzero(solid & ~follows[:-1])
    leads = np.zeros(len(data) + 1, bool)
    leads[:-1] = solid
    leads[cuts] = False
    ends = np.flatnonzero(solid & ~leads[1:]) + 1
    lengths = ends - starts
    power = _powers(1 << max(10, int(lengths.max(initial=1)).bit_length()))
    total, out, i = np.cumsum(lengths), np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(total, total[i] + PIECE)))
        size = lengths[i:j]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        out[i:j] = np.add.reduceat((data[np.repeat(starts[i:j], size) + place] + np.uint64(1)) * power[place], first)
        i = j
    return _mixed(out + lengths.astype(np.uint64)), np.diff(np.searchsorted(starts, cuts))


def _sorted(h: np.ndarray) -> np.ndarray:
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the distinct hashes of all runs of ``width`` words, rising; of the whole text if it is shorter."""
    words, sizes = word_hashes(texts)
    ends = np.cumsum(sizes)
    runs = np.full(max(len(words) - width + 1, 0), width, np.uint64)
    for k in range(width):
        runs += words[k : k + len(runs)] * _ODD[k]
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        if n >= width:
            h = runs[end - n : end - width + 1]
        else:
            h = np.array([np.uint64(n) + (words[end - n : end] * _ODD[:n]).sum(dtype=np.uint64)], np.uint64)[: min(n, 1)]
        out.append(_sorted(_mixed(h)))
    return out


def names_of(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64)


def prefix_length(n: int, t: Fraction) -> int:
    """Elements in which sets of n that are as similar as t to others must meet them."""
    return n - -(-t.numerator * n // t.denominator) + 1 if n else 0


def early_length(n: int, t: Fraction) -> int:
    """Elements in which sets of n that are as similar as t to others, at least as large ones, have the first common one."""
    return n - -(-2 * t.numerator * n // (t.numerator + t.denominator)) + 1 if n else 0


def tiers_of(n: int, t: Fraction) -> list[int]:
    """The tiers that sets of size n are in: of two sets as similar as t the larger one's lowest is one of the other's."""
    low = 0
    while n > LARGEST * GROWTH**low:
        low += 1
    above = n * t.denominator > t.numerator * LARGEST * GROWTH**low
    return [low, low + 1] if above else [low]


def set_fingerprint(s: np.ndarray, bits: int) -> np.ndarray:
    """bits / 64 words: the parity of the number of elements in each class of hashes."""
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


_WORD = pa.int64()


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), _WORD)


def _pieces(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 256):
        yield batch.slice(at, 256)


def described(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """place, node, n and fp of ``docs`` (row, doc_id, text).

    node is a hash of the set, n its size, fp the fingerprint in its highest tier; place orders
    rows by doc_id, null last, then by the text's hash and row.
    """

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part.column(2), width)
                fp = [set_fingerprint(s, BITS * GROWTH ** tiers_of(len(s), t)[-1]).tobytes() for s in sets]
                facts = [_longs(names_of(sets)), pa.array([len(s) for s in sets], _WORD), pa.array(fp, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *facts], ["row", "doc_id", "hash", "node", "n", "fp"])

    rows = docs.select("row", F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))
    out = rows.mapInArrow(run, "row long, doc_id long, hash long, node long, n long, fp binary")
    return out.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "row").alias("place"), "node", "n", "fp")


def _hits(late: np.ndarray, s: np.ndarray) -> np.ndarray:
    return late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s if len(late) else np.zeros(len(s), bool)


def postings(texts: DataFrame, width: int, t: Fraction, late: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """Distinct (token, node, early) for the prefixes of the texts' sets, in the order by hash but ``late`` elements last.

    With ``before``, an earlier state of ``late``, only of sets whose prefix has changed since.
    """
    shared = texts.sparkSession.sparkContext.broadcast((late, before))  # 8 bytes for each of few times CROWDS at most

    def run(batches):
        late, before = shared.value
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part.column(0), width)
                nodes, tokens, early = names_of(sets), [], []
                for s in sets:
                    n, hit = prefix_length(len(s), t), _hits(late, s)
                    if before is not None:
                        old = _hits(before, s)
                        if not hit[np.concatenate([np.flatnonzero(~old), np.flatnonzero(old)])[:n]].any():
                            n = 0
                    tokens.append(np.concatenate([s[~hit][:n], s[hit][: max(n - len(s) + int(hit.sum()), 0)]]) if hit.any() else s[:n])
                    early.append(np.arange(len(tokens[-1])) < early_length(len(s), t))
                owner = np.repeat(nodes, [len(x) for x in tokens])
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(tokens)), _longs(owner), pa.array(np.concatenate(early))], ["token", "node", "early"])

    rows = texts.select(F.col("text").cast("string")).mapInArrow(run, "token long, node long, early boolean")
    return rows.repartition("token").dropDuplicates(["token", "node"])


def frequent_tokens(texts: DataFrame, width: int, least: int) -> np.ndarray:
    """Shingles that at least ``least`` different sets hold, of one in SAMPLED of the texts."""

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part.column(0), width)
                owner = np.repeat(names_of(sets), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sets)), _longs(owner)], ["token", "node"])

    some = texts.select(F.col("text").cast("string").alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    pairs = some.mapInArrow(run, "token long, node long").repartition("token").dropDuplicates(["token", "node"])
    counts = pairs.groupBy("token").count().filter(F.col("count") >= least)
    return np.unique(counts.select("token").toArrow().column(0).to_numpy().view(np.uint64))


def common_tokens(texts: DataFrame, width: int, t: Fraction, crowd: int, total: int, rounds: int = 4) -> np.ndarray:
    """Shingles to be put last: those that about ``crowd`` sets hold, and those that over ``crowd`` sets begin with.

    The former come from a sample; the latter are found in a few rounds, as others come to the
    fore, mostly one that finds none. Any order gives a complete search, this one keeps lists
    short. ``crowd`` rises with the ``total`` of prefix elements, so that a round, and the sample,
    find at most CROWDS.
    """
    every = int(total / (1 - t))
    late = frequent_tokens(texts, width, max(2, -(-max(crowd, -(-every // CROWDS)) // SAMPLED)))
    crowd, before = max(crowd, -(-total // CROWDS)), None
    for _ in range(rounds):
        counts = postings(texts, width, t, late, before).groupBy("token").count().filter(F.col("count") > crowd)
        found = counts.select("token").toArrow().column(0).to_numpy().view(np.uint64)  # at most CROWDS
        before, late = late, np.union1d(late, found)
        if len(late) == len(before):
            break
    return late


def shared_lists(pairs: DataFrame) -> DataFrame:
    """(list, node, early): the sets that have a prefix shingle in common, one of them early; a list's name is a hash of its members."""
    same = Window.partitionBy("token")  # buffered rows spill
    rows = pairs.withColumns({"m": F.count("*").over(same), "e": F.max("early").over(same), "list": F.bit_xor(F.xxhash64("node", "early")).over(same)})
    return rows.filter("m > 1 and e").select("list", "node", "early").distinct()


def sets_of(texts: DataFrame, live: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the whole sets, as binary, of the nodes in ``live`` (node), from (row, text).

    A map of the nodes spares most other sets the way through the shuffle.
    """
    shared = texts.sparkSession.sparkContext.broadcast(slot_map(live, "node"))

    def run(batches):
        for batch in batches:
            for part in _pieces(batch):
                sets = shingle_sets(part.column(0), width)
                nodes = names_of(sets)
                yield pa.RecordBatch.from_arrays([_longs(nodes), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    def wanted(batches):
        for batch in batches:
            yield batch.select([1, 2]).filter(pa.array(marked(shared.value, batch.column(0).to_numpy())))

    sets = texts.select(F.col("text").cast("string")).mapInArrow(run, "node long, shingles binary")
    near = sets.select(slot("node").alias("slot"), "node", "shingles").mapInArrow(wanted, "node long, shingles binary")
    return near.join(live, "node", "left_semi").dropDuplicates(["node"])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _limit(na: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """The most shingles in which sets of these sizes may differ."""
    return (t.denominator - t.numerator) * (na + nb) // (t.denominator + t.numerator)


def candidate_links(lists: np.ndarray, early: np.ndarray, n: np.ndarray, fps: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one list that may be similar, as many as connect all such rows.

    Rows are sorted by list, early ones first. An early row i meets row i + step of its list, for
    rising steps, unless pairs found before connect the two.
    """
    size = len(lists)
    parent = np.arange(size)
    firsts, seconds = [], []

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    new = np.concatenate([[True], lists[1:] != lists[:-1]]) if size else np.zeros(0, bool)
    head = np.flatnonzero(new)
    long = np.diff(np.append(head, size))
    table = np.zeros((size, PIVOTS), np.int16)
    for h, m in zip(head[long >= LONG].tolist(), long[long >= LONG].tolist(), strict=True):
        for k in range(PIVOTS):
            table[h : h + m, k] = distances(fps[h : h + m], fps[h + k * m // PIVOTS])
    left, step = np.flatnonzero(early), 1
    group = np.cumsum(new) - 1
    while len(left):
        left = left[left + step < size]
        left = left[lists[left] == lists[left + step]]
        joined = False
        for at in range(0, len(left), PAIRS):
            a = left[at : at + PAIRS]
            b = a + step
            most = _limit(n[a], n[b], t)
            fits = (parent[a] != parent[b]) & (np.abs(n[a] - n[b]) <= most)
            a, b, most = a[fits], b[fits], most[fits]
            near = (np.abs(table[a] - table[b]) <= most[:, None]).all(axis=1)
            a, b, most = a[near], b[near], most[near]
            near = distances(fps[a], fps[b]) <= most
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                x, y = find(i), find(j)
                if x != y:
                    parent[max(x, y)], joined = min(x, y), True
                    firsts.append(i)
                    seconds.append(j)
        if joined:
            while (parent[parent] != parent).any():
                parent = parent[parent]
            apart = np.minimum.reduceat(parent, head) != np.maximum.reduceat(parent, head)
            left = left[apart[group[left]]]
        step += 1
    return np.array(firsts, np.int64), np.array(seconds, np.int64)


def open_pairs(lists: np.ndarray, early: np.ndarray, root: np.ndarray, n: np.ndarray, fps: np.ndarray, t: Fraction, quota: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of rows of one list and different roots that may be similar, and whether there are more.

    Every early row gives its ``quota`` closest partners: among all rows if it isn't of its list's
    largest root, else among those that aren't.
    """
    firsts, seconds, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], False
    cut = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]])) if len(lists) else []
    for s, e in zip(cut[:-1], cut[1:], strict=True):
        names, r, counts = np.unique(root[s:e], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        main, begins = r == counts.argmax(), early[s:e]
        for ours, theirs in ((np.flatnonzero(begins & ~main), np.arange(e - s)), (np.flatnonzero(begins & main), np.flatnonzero(~main))):
            block = max(1, PAIRS // max(1, len(theirs)))
            for at in range(0, len(ours), block):
                a = ours[at : at + block]
                most = _limit(n[s:e][a][:, None], n[s:e][theirs][None, :], t)
                ok = (r[a][:, None] != r[theirs][None, :]) & (np.abs(n[s:e][a][:, None] - n[s:e][theirs][None, :]) <= most)
                x, y = np.nonzero(ok)
                bits = distances(fps[s + a[x]], fps[s + theirs[y]])
                near = bits <= most[x, y]
                x, y, bits = x[near], y[near], bits[near]
                order = np.lexsort((y, bits, x))
                x, y = x[order], y[order]
                nth = np.arange(len(x)) - np.searchsorted(x, x)
                more |= bool((nth >= quota).any())
                firsts.append(s + a[x[nth < quota]])
                seconds.append(s + theirs[y[nth < quota]])
    return np.concatenate(firsts), np.concatenate(seconds), more


def tiered(nodes: DataFrame, t: Fraction) -> DataFrame:
    """(node, n, tier, fp) for each tier of (node, n, fp); a shorter fingerprint is the longer one folded."""

    def run(batches):
        for batch in batches:
            out = []
            for node, n, fp in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                low, *high = tiers_of(n, t)
                if high:
                    out.append((node, n, high[0], fp))
                    fp = np.bitwise_xor.reduce(np.frombuffer(fp, np.uint64).reshape(GROWTH, -1)).tobytes()
                out.append((node, n, low, fp))
            kinds = (_WORD, _WORD, _WORD, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["node", "n", "tier", "fp"])

    return nodes.select("node", "n", "fp").mapInArrow(run, "node long, n long, tier long, fp binary")


def _whole_lists(batches):
    """Arrays of the columns, from batches sorted by tier and list, cut so that neither goes on in the next ones."""
    held: list[list] = []

    def joined():
        words = BITS * GROWTH ** int(held[0][0][0]) // 64
        rows = [np.concatenate(x) for x in zip(*(h[1:-1] for h in held), strict=True)]
        return [*rows, np.frombuffer(b"".join(x.as_buffer() for h in held for x in h[-1]), np.uint64).reshape(-1, words)]

    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
        if not batch.num_rows:
            continue
        new = (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)
        change = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), batch.num_rows]
        last = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
        if held and (held[-1][0][-1], held[-1][1][-1]) != (rows[0][0], rows[1][0]):
            yield joined()
            held = []
        for a, b in zip(change[:-1], change[1:], strict=True):
            for c, d in ((a, min(b, last)), (max(a, last), b)):  # the last list may go on
                if c < d:
                    held.append([*(x[c:d] for x in rows), batch.column(batch.num_columns - 1).slice(c, d - c)])
                    if d <= last:
                        yield joined()
                        held = []
    if held:
        yield joined()


def _pairs_of(a: np.ndarray, b: np.ndarray, more: bool = False) -> pa.RecordBatch:
    mark = pa.nulls(int(more), _WORD)
    return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(np.minimum(a, b)), mark]), pa.concat_arrays([pa.array(np.maximum(a, b)), mark])], ["a", "b"])


def _first_links(rows: DataFrame, t: Fraction) -> DataFrame:
    """(a, b) from (list, node, early, n, tier, fp): presumed links, enough to connect all that may be similar in a list."""

    def run(batches):
        for lists, node, early, n, fps in _whole_lists(batches):
            a, b = candidate_links(lists, early, n, fps, t)
            yield _pairs_of(node[a], node[b])

    dealt = rows.select("tier", "list", "node", "early", "n", "fp").repartition("tier", "list").sortWithinPartitions("tier", "list", F.desc("early"), "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _further_pairs(rows: DataFrame, t: Fraction, quota: int) -> DataFrame:
    """(a, b) from (list, node, early, n, tier, fp, root): pairs of groups that are apart; a row of nulls says there are more."""

    def run(batches):
        for lists, node, early, n, root, fps in _whole_lists(batches):
            a, b, more = open_pairs(lists, early, root, n, fps, t, quota)
            yield _pairs_of(node[a], node[b], more)

    dealt = rows.select("tier", "list", "node", "early", "n", "root", "fp").repartition("tier", "list").sortWithinPartitions("tier", "list", F.desc("early"), "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_pairs(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Of pairs (a, b) those whose sets have at least the similarity."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both * t.denominator >= t.numerator * (len(u) + len(v) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def similar_groups(nodes: DataFrame, texts: DataFrame, width: int, similarity: float, crowd: int = CROWD) -> DataFrame:
    """(node, root) of the sets that a chain of similar ones connects with another.

    ``nodes`` has node, n and fp of every different set, ``texts`` the column text.
    """
    t = Fraction(str(similarity))
    total = nodes.agg(F.sum(F.col("n") * float(1 - t) + 1).alias("p")).first()["p"] or 0
    late = common_tokens(texts, width, t, crowd, int(total))
    lists = materialize(shared_lists(postings(texts, width, t, late)), "near-lists")
    facts = materialize(tiered(nodes, t), "near-tiers")
    links = materialize(_first_links(lists.join(facts, "node"), t), "near-links")
    live = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(sets_of(texts, live, width), "near-sets")
    found = materialize(similar_pairs(links, sets, t), "near-found")
    roots = components(found)
    met = materialize(lists.join(live, "node").join(facts, "node"), "near-met")
    for x in (lists, facts):
        discard(x)
    done, quota = links, 1
    while True:
        at = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        split = at.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("list")
        pairs = materialize(_further_pairs(at.join(split, "list", "left_semi"), t, quota), "near-pairs")
        fresh = materialize(pairs.filter("a is not null").join(done, ["a", "b"], "left_anti"), "near-fresh")
        good = materialize(similar_pairs(fresh, sets, t), "near-good")
        if good.limit(1).count():
            found = found.unionAll(good)
            roots = components(found)
        if not pairs.filter("a is null").limit(1).count():
            break
        done, quota = done.unionAll(fresh), quota * 8 if quota < 64 else 1 << 62
    for x in (met, sets):
        discard(x)
    return roots
