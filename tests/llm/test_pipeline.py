"""The pipeline as a whole against brute force, and stage by stage on its own input."""

import hashlib
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from gleaner.llm.common import materialize
from gleaner.llm.queries import QUERIES
from test_text_operators import WORD, brute_contamination, brute_quality, brute_targets


def passes_quality(text):
    words, chars, symbols, dup_lines, repeated = brute_quality(text)
    lines = len([x for x in (text or "").split("\n") if WORD.search(x)])
    return not (words < 20 or 100 * repeated > 30 * words or 10 * symbols > 3 * words or chars < 2 * words or chars > 15 * words or 10 * dup_lines > 5 * max(lines, 1))


def first_of_near_copies(docs, similarity=0.8, width=5):
    fold = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, text, *_ in docs:
        w = WORD.findall(text.translate(fold))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if find(i) == i]


def copies_in_mix(docs):
    sizes = Counter()
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text))
    targets = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: s.encode())
    total, words = sum(targets.values()), sum(sizes.values())
    length = max(1, min(4096, words // max(50_000, 200 * len(names))))
    edges, at = [], 0
    for s in names:
        at += round(targets[s] / total * 2**40)
        edges.append(at)
    blocks = Counter()
    for j in range(round(total / length)):
        u = int(f"{j:040b}"[::-1], 2)
        blocks[next((s for s, e in zip(names, edges, strict=True) if u < e), names[-1])] += 1
    copies = {}
    for s in names:
        at = 0
        for key, text, _ in sorted((d for d in docs if d[2] == s), key=lambda d: hashlib.md5(f"{d[0]}:13".encode()).hexdigest()):
            n = len(WORD.findall(text))
            taken = sum(max(0, min(n, blocks[s] * length - at - e * sizes[s])) for e in range(3))
            copies[key] = int(taken / n + 0.5)
            at += n
    return copies


def brute_shards(docs, n=16):
    rows = sorted((hashlib.md5(t.encode()).hexdigest(), k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in docs)
    total, at, placed, groups = sum(r[2] for r in rows), 0, [], defaultdict(list)
    cut = lambda middle: min(n - 1, int(middle * n / total))
    for r in rows:
        placed.append([r, cut(at + r[2] / 2)])
        groups[r[0]].append((at, r[2], placed[-1]))
        at += r[2]
    for rows_of in groups.values():
        size = sum(x[1] for x in rows_of)
        if len({x[2][1] for x in rows_of}) > 1 and size <= 0.05 * total / n:
            for x in rows_of:
                x[2][1] = cut(rows_of[0][0] + size / 2)
    slots, out = Counter(), Counter()
    for (_, key, size, crc), shard in placed:
        out[key, size, crc, "bytes", shard, slots[shard], None] += 1
        slots[shard] += 1
    return out


def test_run_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = first_of_near_copies([d for d in docs if passes_quality(d[1])])
    dirty = {k[0] for k in brute_contamination([d[:2] for d in kept], items) if k[-1]}
    kept = [d for d in kept if d[0] not in dirty]
    copies = copies_in_mix(kept)
    want = brute_shards([(k, t) for k, t, _ in kept for _ in range(copies[k])])
    got = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        after = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(after) <= before and after
        if k < 3:
            assert len(after) == len(set(after))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert {"shard", "slot"} <= set(docs.columns)


def test_run_takes_an_empty_table(spark, sf_dir, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0 if t == "documents" else 10).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_has_its_query(n):
    assert len([q for q in QUERIES if q.startswith(f"op{n}_")]) == 1
