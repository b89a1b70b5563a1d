"""SimHash near-duplicates, found through pivot distance tables."""

from __future__ import annotations

import random
import re
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm import setjoin
from gleaner.llm.common import discard, materialize, python_batches
from gleaner.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: References in the table of a block, and over the whole fingerprint.
BLOCK_PIVOTS, PIVOTS = 12, 24
#: Fingerprints that share a key up to which they are compared pair by pair in one task.
BUCKET = 4096
#: Bytes of text hashed at once, shingles whose bits are unpacked at once.
PIECE, BATCH = 1 << 20, 1 << 17

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def shingle_hashes(text: str | None, width: int = SHINGLE):
    """Arrays of the XXH64 (seed 42) of every shingle; of the whole sequence if it is shorter; none without words.

    Long texts come in pieces of about PIECE bytes, each with the last words of the one before.
    """
    import xxhash

    raw, digest = (text or "").encode("utf-8", "surrogatepass"), xxhash.xxh64_intdigest
    carried, seen, at = [], 0, 0
    while at < len(raw):
        cut = _BLANK.search(raw, at + PIECE)
        end = cut.start() if cut else len(raw)
        words = carried + raw[at:end].translate(_LOWER).split()
        seen, at = seen + len(words) - len(carried), end
        if len(words) < width:
            carried = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(words) - width + 1].tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
        carried = words[len(words) - width + 1 :]
    if 0 < seen < width:
        yield np.array([digest(b" ".join(carried), SEED)], np.uint64)


def fingerprint_many(texts: list, width: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text: a bit is 1 if set in over half of its shingles' hashes."""
    ones, total = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush():
        nonlocal held, waiting
        if held:
            sizes = np.array([len(h) for _, h in held])
            hashes, at = np.concatenate([h for _, h in held]), np.cumsum(sizes) - sizes
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            np.add.at(ones, [i for i, _ in held], np.add.reduceat(bits, at, axis=0, dtype=np.int32))
        held, waiting = [], 0

    for i, text in enumerate(texts):
        for hashes in shingle_hashes(text, width):
            total[i] += len(hashes)
            held.append((i, hashes))
            waiting += len(hashes)
            if waiting >= BATCH:
                flush()
    flush()
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long. Null texts and texts without words have 0."""
    python_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = fingerprint_many(batch.column(1).to_pylist(), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks(radius: int) -> list[int]:
    """Masks of ``radius + 2`` blocks: two fingerprints within the radius agree on two at least."""
    n = radius + 2
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]


def references(n: int, seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.getrandbits(64) for _ in range(n)]


def table_keys(fp: Column, radius: int) -> list[Column]:
    """A key for each pair of blocks: the row of distances to the pair's references, hashed.

    Within a block the distances to its references are a pivot table of its own. Fingerprints
    within ``radius`` have distance 0 on two blocks at least, so their coordinates there can't
    differ at all, and they share the key of that pair.
    """
    tables = [[F.bit_count(fp.bitwiseXOR(F.lit(_signed(ref))).bitwiseAND(F.lit(_signed(mask)))) for ref in references(BLOCK_PIVOTS, 100 + k)] for k, mask in enumerate(blocks(radius))]
    return [F.xxhash64(F.lit(k), *tables[a], *tables[b]) for k, (a, b) in enumerate(combinations(range(len(tables)), 2))]


def pivot_coordinates(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to the references."""
    return np.bitwise_count(fps[:, None] ^ np.array(references(PIVOTS, 7), np.uint64)[None, :]).astype(np.int16)


def near_pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (sorted by key) and the roots in their key that links within ``radius`` lead them to.

    Row i meets row i + step of the same key, for rising steps, unless links already connect
    the two. A pair whose pivot coordinates differ by over ``radius`` anywhere is discarded;
    for the others the distance is taken. A key whose rows are all connected is done with.
    """
    n = len(fps)
    parent = np.arange(n)
    coords = pivot_coordinates(fps)
    left = np.arange(max(n - 1, 0))
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if n else np.zeros(0, bool)
    head, group = np.flatnonzero(new), np.cumsum(new) - 1

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    step = 1
    while len(left):
        left = left[left + step < n]
        left = left[keys[left] == keys[left + step]]
        joined = False
        for at in range(0, len(left), 1 << 17):
            a = left[at : at + (1 << 17)]
            b = a + step
            apart = parent[a] != parent[b]
            a, b = a[apart], b[apart]
            for k in range(0, PIVOTS, 6):
                near = (np.abs(coords[a, k : k + 6] - coords[b, k : k + 6]) <= radius).all(axis=1)
                a, b = a[near], b[near]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            for i, j in zip(a[near].tolist(), b[near].tolist(), strict=True):
                i, j = find(i), find(j)
                if i != j:
                    parent[max(i, j)], joined = min(i, j), True
        if joined:
            while (parent[parent] != parent).any():
                parent = parent[parent]
            open_group = np.minimum.reduceat(parent, head) != np.maximum.reduceat(parent, head)
            left = left[open_group[group[left]]]
        step += 1
    moved = np.flatnonzero(parent != np.arange(n))
    return moved, parent[moved]


def _bucket_links(rows: DataFrame, radius: int) -> DataFrame:
    def run(batches):
        kept_k, kept_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def link(k, f):
            a, b = near_pairs(k, f, radius)
            return pa.RecordBatch.from_arrays([pa.array(f[a].view(np.int64)), pa.array(f[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            k = np.concatenate([kept_k, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([kept_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            end = int(np.searchsorted(k, k[-1])) if len(k) else 0  # the last key may go on
            if end:
                yield link(k[:end], f[:end])
            kept_k, kept_f = k[end:], f[end:]
        if len(kept_k):
            yield link(kept_k, kept_f)

    return rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def _hot_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links within keys of too many fingerprints, without pairing them.

    The fingerprints of a key agree on two blocks. Two are within the radius if they are equal
    once some ``radius`` of the other bits are cleared; each such set of bits gives groups of at
    most 2^radius fingerprints, whose members are linked with the smallest.
    """
    masks = blocks(radius)
    sets = []
    for a, b in combinations(range(len(masks)), 2):
        free = [i for i in range(64) if not (masks[a] | masks[b]) >> i & 1]
        sets.append(F.array(*[F.lit(_signed(sum(1 << i for i in c))) for c in combinations(free, radius)]))
    spread = rows.select("key", "fp", F.explode(F.get(F.array(*sets), F.col("pair"))).alias("free"))
    spread = spread.withColumn("rest", F.col("fp").bitwiseAND(F.bitwise_not("free")))
    least = spread.groupBy("key", "free", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("_top")).filter("b <> _top")
    return spread.join(least, ["key", "free", "rest"]).filter("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints, enough to connect all that links within ``radius`` connect.

    ``prints`` has one column fp without repeats. Keys of over ``bucket`` fingerprints take
    another exact way.
    """
    pairs = table_keys(F.col("fp"), radius)
    keyed = prints.select("fp", F.posexplode(F.array(*pairs)).alias("pair", "key"))
    crowd = keyed.groupBy("key").count().filter("count > 1")
    keyed = materialize(keyed.join(crowd, "key").select("key", "pair", "fp", "count"), "simhash-keys")
    links = _bucket_links(keyed.filter(F.col("count") <= bucket), radius)
    if keyed.filter(F.col("count") > bucket).limit(1).count():
        links = links.unionAll(_hot_links(keyed.filter(F.col("count") > bucket), radius))
    links = materialize(links, "simhash-links")
    discard(keyed)
    return links


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable by links.

    Equal fingerprints are one node, so copies are never paired. Null texts and texts without
    words share fingerprint zero and are linked like any other; repeated rows come out each;
    null doc_ids are never a component's id unless it has no other; an empty table gives no rows.
    """
    rows = materialize(fingerprints(docs, width), "simhash-prints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(link_fingerprints(nodes.select("fp"), radius, bucket))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = materialize(placed.join(ids, "root").select("fp", "component_id"), "simhash-components")
    discard(nodes)
    out = rows.join(placed, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of the near-duplicate filter: words of a shingle, similarity.
FILTER_SHINGLE, SIMILARITY = 5, 0.8


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, width: int = FILTER_SHINGLE, crowd: int = setjoin.CROWD) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each group of near copies.

    Near copies are texts whose sets of ``width``-word shingles have a Jaccard similarity of at
    least ``similarity``; groups are what chains of them connect. All such pairs are found (see
    setjoin): bits of a majority can't prove a similarity of 0.8, so the fingerprints here have
    a bit of parity for each class of shingles, to which distance tables and exact checks apply.

    Groups are of rows: different texts that share a doc_id or have none are documents of their
    own. A null doc_id comes after all others; of rows with the same one, the text's hash decides.
    Texts of equal shingle sets are one node; a repeated shingle counts once. Texts without
    words are copies of each other. An empty table gives no rows; of other columns only one named
    __near_row would be lost.
    """
    python_batches(docs.sparkSession)
    rows = materialize(docs.withColumn("__near_row", F.monotonically_increasing_id()), "near-rows")
    facts = setjoin.described(rows.select(F.col("__near_row").alias("row"), "doc_id", "text"), width, Fraction(str(similarity)))
    nodes = materialize(facts.groupBy("node").agg(F.min("place").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp")), "near-nodes")
    roots = setjoin.similar_groups(nodes.select("node", "n", "fp"), rows.select("text"), width, similarity, crowd)
    placed = nodes.select("node", "least").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    kept = placed.groupBy("root").agg(F.min("least").alias("_keep")).select(F.col("_keep.row").alias("__near_row"))
    return rows.join(kept, "__near_row", "left_semi").select(*docs.columns)
