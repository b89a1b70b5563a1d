"""Removal of repeated byte strings with a distributed difference-cover suffix sort.

A byte goes if some string of ``length`` bytes that covers it starts earlier as well. The sort
is spread over tasks so that equal strings meet in one: every window of ``length`` bytes is
filed under its minimizer, the k-gram in it with the smallest hash (the leftmost of several).
Consecutive windows with one minimizer form a segment. Segments of equal bytes need no sorting
among themselves: the first stays, the others are repeats throughout. Where a minimizer has
segments that differ, the first of each kind is fetched, and the suffixes of a task's segments
are sorted: triples at the places that aren't multiples of three are sorted and named, the
names are sorted by recursion, the other suffixes are merged in, and neighbours are compared.
No window is left out: minimizers are a function of the window's bytes.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, ordered, prefix_sums, python_batches

LENGTH = 100
KGRAM = 32
#: Bytes hashed at once, bytes whose segments a task gathers before it sends them, bytes sorted at once.
PIECE, GATHER, SORT = 1 << 20, 32 << 20, 2 << 20
#: Different segments of one minimizer from which on they are split, and the windows of a part.
CROWD, PART = 1024, 4
#: Different segments of one minimizer in a task's gathering from which on they are spread by their content.
SPREAD = 64
#: Bytes of different parts that a task holds to tell equal ones.
FIRSTS = 8 << 20
_PLACE_BITS = 24
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = KGRAM):
    """(start, windows, minimizer's place in the segment, its hash, content hash) of the segments of documents laid end to end.

    ``starts`` and ``ends`` are the documents' bounds in ``data``, of at most PIECE + length bytes.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    power, inverse = _powers(PIECE + 4 * length)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    grams = _mix((total[k:] - total[: n - k + 1]) * inverse[: n - k + 1])
    least = (grams & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(grams), dtype=np.uint64)
    width, span = length - k + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    room = np.zeros(n + 1, np.int32)
    whole = ends - starts >= length
    np.add.at(room, starts[whole], 1)
    np.add.at(room, ends[whole] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(room)[: len(least)] > 0)
    if not len(valid):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    place = (least[valid] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1)]))
    count = np.diff(np.concatenate([first, [len(valid)]]))
    a, m = valid[first], place[first]
    content = (total[a + count - 1 + length] - total[a]) * inverse[a]
    return a, count, m - a, grams[m], _mix(content ^ ((m - a) * 1000 + count).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def merge_runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Intervals of each document, overlapping and touching ones united, in order."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.concatenate([[True], doc[1:] != doc[:-1]])
    at = np.cumsum(new) - 1
    shift = at * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    head = np.concatenate([[True], (start[1:] + shift[1:] > reach[:-1]) | new[1:]])
    first = np.flatnonzero(head)
    last = np.concatenate([first[1:] - 1, [len(doc) - 1]])
    return doc[first], start[first], reach[last] - shift[last]


def _pack(*columns: np.ndarray) -> np.ndarray:
    """One number a row that sorts as the rows of non-negative columns do."""
    bits = [max(1, int(c.max()).bit_length()) if len(c) else 1 for c in columns]
    if sum(bits) <= 63:
        out = columns[0].astype(np.int64)
        for c, b in zip(columns[1:], bits[1:], strict=True):
            out = (out << b) | c
        return out
    return _pack(np.unique(_pack(*columns[:-1]), return_inverse=True)[1], columns[-1])


def suffix_array(s: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Places of ``s`` (numbers from 1 on) in the order of the suffixes there, by difference cover modulo 3.

    Suffixes that agree on ``depth`` numbers may come in any order.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, np.zeros(3, s.dtype)]).astype(np.int64)
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([ones, twos])
    keys = _pack(t[sample], t[sample + 1], t[sample + 2]) if n > 1 << 21 or int(s.max()) >> 21 else t[sample] << 42 | t[sample + 1] << 21 | t[sample + 2]
    by = np.argsort(keys, kind="stable")
    step = np.concatenate([[1], (keys[by][1:] != keys[by][:-1]).astype(np.int64)])
    names = np.empty(len(sample), np.int64)
    names[by] = np.cumsum(step)
    if depth > 3 and names[by[-1]] < len(sample):
        by = suffix_array(names, -(-depth // 3) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample[by]] = np.arange(1, len(sample) + 1)
    zeros = np.arange(0, n, 3)
    zeros = zeros[np.argsort(_pack(t[zeros], rank[zeros + 1]), kind="stable")]
    order = sample[by]
    order1, order2 = order[order % 3 == 1], order[order % 3 == 2]
    order1, order2 = order1[order1 < n], order2
    pair = _pack(t[:n], rank[1 : n + 1])
    triple = _pack(t[:n], t[1 : n + 1], rank[2 : n + 2])
    before = np.searchsorted(pair[order1], pair[zeros]) + np.searchsorted(triple[order2], triple[zeros])
    before = np.maximum.accumulate(before) if len(before) else before
    out = np.empty(n, np.int64)
    at = np.arange(len(zeros)) + before
    out[at] = zeros
    rest = np.ones(n, bool)
    rest[at] = False
    out[rest] = order[order < n]
    return out


def repeated_windows(data: np.ndarray, starts: np.ndarray, counts: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int = LENGTH):
    """(doc, start) of the windows of segments that occur earlier in another segment.

    ``data`` has the segments' bytes with a number between that no byte has; ``starts`` their
    places in it, ``counts`` their windows, ``doc`` and ``pos`` where they come from.
    """
    sa = suffix_array(data, length)
    owner = np.full(len(data), -1, np.int64)
    spots = np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    owner[spots] = np.repeat(np.arange(len(starts)), counts)
    sa = sa[owner[sa] >= 0]
    same = np.zeros(len(sa), bool)
    wide = np.ascontiguousarray(data - 1).astype(np.uint8)  # windows lie within segments
    for at in range(0, max(len(sa) - 1, 0), 1 << 16):
        a, b = sa[at : at + (1 << 16)][: len(sa) - 1 - at], sa[at + 1 : at + 1 + (1 << 16)]
        alike = np.ones(len(a), bool)
        for k in range(0, length, 10):
            left = np.flatnonzero(alike)
            if not len(left):
                break
            cols = np.arange(k, min(k + 10, length))
            alike[left] = (wide[a[left, None] + cols] == wide[b[left, None] + cols]).all(axis=1)
        same[at + 1 : at + 1 + len(a)] = alike
    group = np.cumsum(~same)
    seg = owner[sa]
    d, p = doc[seg], pos[seg] + sa - starts[seg]
    order = np.lexsort((p, d, group))
    later = np.concatenate([[False], group[order][1:] == group[order][:-1]])
    return d[order][later], p[order][later]




def _dump(e: dict) -> bytes:
    base = int(e["rid"].min())
    small = int(e["rid"].max()) - base < 1 << 32 and int(e["pos"].max()) < 1 << 32
    kinds = ("<u4", "<u4") if small else ("<i8", "<i8")
    return np.array([len(e["rid"]), base, small], "<i8").tobytes() + b"".join([e["mh"].tobytes(), e["sh"].tobytes(), (e["rid"] - base).astype(kinds[0]).tobytes(), e["pos"].astype(kinds[1]).tobytes(), e["n"].astype("u1").tobytes(), e["off"].astype("u1").tobytes()])


def _load(blob) -> dict:
    n, base, small = np.frombuffer(blob, "<i8", 3).tolist()
    at, out = 24, {}
    for name, kind in (("mh", "<u8"), ("sh", "<u8"), ("rid", "<u4" if small else "<i8"), ("pos", "<u4" if small else "<i8"), ("n", "u1"), ("off", "u1")):
        out[name] = np.frombuffer(blob, kind, n, at)
        at += out[name].nbytes
    return out | {"rid": out["rid"].astype(np.int64) + base, "pos": out["pos"].astype(np.int64)}


def _take(e: dict, at) -> dict:
    return {k: v[at] for k, v in e.items()}


def _join(parts: list[dict]) -> dict:
    return {k: np.concatenate([p[k] for p in parts]) for k in ("mh", "sh", "rid", "pos", "n", "off")}


def _first_of_equals(e: dict) -> tuple[dict, dict]:
    """Entries in order with the first of each content, and the others."""
    e = _take(e, np.lexsort((e["pos"], e["rid"], e["sh"], e["mh"])))
    again = np.concatenate([[False], (e["mh"][1:] == e["mh"][:-1]) & (e["sh"][1:] == e["sh"][:-1])])
    # one place may come twice only if a document does
    return _take(e, ~again), _take(e, again)


def _covered(e: dict, length: int):
    return merge_runs(e["rid"], e["pos"], e["pos"] + e["n"].astype(np.int64) - 1 + length)


def text_segments(rid: list, texts: list, length: int):
    """Entries of a few documents; long ones in pieces that overlap by a window."""
    pieces: list[tuple[int, int, np.ndarray]] = []
    out, size = [], 0

    def flush():
        nonlocal pieces, size
        if pieces:
            sizes = np.array([len(p[2]) for p in pieces])
            ends = np.cumsum(sizes)
            a, n, off, mh, sh = segments(np.concatenate([p[2] for p in pieces]), ends - sizes, ends, length)
            which = np.searchsorted(ends, a, side="right")
            base = np.array([p[1] for p in pieces]) - (ends - sizes)
            out.append({"mh": mh, "sh": sh, "rid": np.array([p[0] for p in pieces], np.int64)[which], "pos": a + base[which], "n": n, "off": off})
        pieces, size = [], 0

    for r, text in zip(rid, texts, strict=True):
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        for at in range(0, max(len(data) - length + 1, 0), PIECE // 2):
            part = data[at : at + PIECE // 2 + length - 1]
            if size + len(part) > PIECE:
                flush()
            pieces.append((r, at, part))
            size += len(part)
    flush()
    return out


#: Kinds of blobs: entries by minimizer, ranges to go, entries spread by content, minimizers that are spread.
_HELD, _GONE, _LOOSE, _SPREAD = range(4)


def _run_sizes(values: np.ndarray) -> np.ndarray:
    """For each of some sorted values how many are equal to it."""
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    size = np.diff(np.concatenate([head, [len(values)]]))
    return np.repeat(size, size)


def _filed(rows: DataFrame, n: int, length: int, spread: int) -> DataFrame:
    """(bucket, kind, blob): entries, and what a task alone knows to go.

    Entries go to the bucket of their minimizer. Where a minimizer has over ``spread`` different
    segments in one gathering, those go to the bucket of their content instead, so that a line
    which most documents hold fills no bucket; the minimizer's own bucket is told of it.
    """

    def run(batches):
        held, size = [], 0

        def send():
            first, again = _first_of_equals(_join(held))
            out = []
            if len(again["rid"]):
                doc, a, b = _covered(again, length)
                out.append((int(doc[0] % n), _GONE, np.stack([doc, a, b]).astype("<i8").tobytes()))
            loose = _run_sizes(first["mh"]) > spread
            for kind, mine, key in ((_HELD, ~loose, "mh"), (_LOOSE, loose, "sh")):
                e = _take(first, mine)
                at = (e[key] % np.uint64(n)).astype(np.int64)
                order = np.lexsort((e["pos"], e["rid"], at))
                cuts = np.searchsorted(at[order], np.arange(n + 1))
                out += [(b, kind, _dump(_take(e, order[cuts[b] : cuts[b + 1]]))) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            known = np.unique(first["mh"][loose])
            for b in np.unique(known % np.uint64(n)).tolist():
                out.append((b, _SPREAD, known[known % np.uint64(n) == b].astype("<u8").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "blob"])

        for batch in batches:
            texts = batch.column(1).to_pylist()
            held += text_segments(batch.column(0).to_pylist(), texts, length)
            size += sum(len(t or "") for t in texts)
            if size >= GATHER and held:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return rows.mapInArrow(run, "bucket int, kind int, blob binary")


_PARTS = "rid long, start long, stop long, mh long, off int"


def _parts(doc, start, stop, mh=None, off=None) -> pa.RecordBatch:
    key = pa.nulls(len(doc), pa.int64()) if mh is None else pa.array(mh.view(np.int64))
    place = pa.nulls(len(doc), pa.int32()) if off is None else pa.array(off.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(stop), key, place], ["rid", "start", "stop", "mh", "off"])


def _sifted(filed: DataFrame, length: int, crowd: int) -> DataFrame:
    """(rid, start, stop, mh, off): repeats of equal segments (mh null), and segments to be sorted with others.

    ``off`` is the minimizer's place in the segment if over ``crowd`` segments share it or some
    task has spread its segments, else -1. What is spread always goes on to be sorted.
    """

    def run(batches):
        held, loose, known = [], [], [np.zeros(0, np.uint64)]
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == _GONE:
                    yield _parts(*np.frombuffer(blob.as_buffer(), "<i8").reshape(3, -1))
                elif kind == _SPREAD:
                    known.append(np.frombuffer(blob.as_buffer(), "<u8"))
                else:
                    (held if kind == _HELD else loose).append(_load(blob.as_buffer()))
        for entries, spread in ((held, False), (loose, True)):
            if not entries:
                continue
            first, again = _first_of_equals(_join(entries))
            entries.clear()
            yield _parts(*_covered(again, length))
            if not len(first["mh"]):
                continue
            size = _run_sizes(first["mh"])
            split = (size > crowd) | spread | np.isin(first["mh"], np.concatenate(known))
            off = np.where(split, first["off"].astype(np.int64), -1)
            some = (size > 1) | split
            first, off = _take(first, some), off[some]
            yield _parts(first["rid"], first["pos"], first["pos"] + first["n"].astype(np.int64) - 1 + length, first["mh"], off)

    return filed.mapInArrow(run, _PARTS)


def _split(data: bytes, off: int, length: int):
    """(first window, key, bytes) of the parts of a segment whose minimizer is at ``off``.

    The windows of a part have the minimizer at PART neighbouring places, so they share all
    but PART - 1 bytes; these make the key. Equal windows have it at the same place, so they
    get into parts with the same key. Different parts with one key differ in PART - 1 bytes at
    either end only, which bounds how many there are however many documents hold them.
    """
    n = len(data) - length + 1
    for q in range(max(off - n + 1, 0) // PART, off // PART + 1):
        lo, hi = max(off - PART * q - PART + 1, 0), min(off - PART * q, n - 1)
        shared = data[off - PART * q : off - PART * q + length - PART + 1]
        yield lo, int.from_bytes(hashlib.blake2b(shared + bytes([q]), digest_size=8).digest(), "little", signed=True), data[lo : hi + length]


def _fetched(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(mh, rid, start, stop, data) of the segments to be sorted; data is null for known repeats.

    Segments of crowded minimizers come in parts under finer keys. Of equal parts that a task
    meets before it holds FIRSTS bytes of different ones the first is sorted, the others are repeats.
    """
    lists = wanted.groupBy("rid").agg(F.collect_list(F.struct("start", "stop", "mh", "off")).alias("want"))  # those of one document
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        seen, size = {}, 0

        def packed(out):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["mh", "rid", "start", "stop", "data"])

        def firsts():
            return packed([(key, *here, here[1] + len(part), part) for (key, part), here in seen.items()])

        for batch in batches:
            out = []
            for rid, text, want in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for w in want:
                    data = raw[w["start"] : w["stop"]]
                    if w["off"] < 0:
                        out.append((w["mh"], rid, w["start"], w["stop"], data))
                        continue
                    for lo, key, part in _split(data, w["off"], length):
                        here = (rid, w["start"] + lo)
                        if (old := seen.get((key, part))) is not None:
                            here, old = max(here, old), min(here, old)
                            out.append((key, *here, here[1] + len(part), None))
                            here = old
                        else:
                            size += len(part)
                        seen[key, part] = here
            yield packed(out)
            if size >= FIRSTS:
                yield firsts()
                seen, size = {}, 0
        yield firsts()

    return rows.join(lists, "rid").select("rid", "text", "want").mapInArrow(run, "mh long, rid long, start long, stop long, data binary")


def _sorted_repeats(fetched: DataFrame, n: int, length: int) -> DataFrame:
    """(rid, start, stop, mh null): windows that the suffix sort of a minimizer's segments finds to be repeats."""

    def solve(held):
        sizes = np.array([len(x[3]) for x in held])
        starts = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(b"\0".join(x[3] for x in held) + b"\0", np.uint8).astype(np.int64) + 1
        data[starts + sizes] = 257
        d, p = repeated_windows(data, starts, sizes - length + 1, np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64), length)
        return _parts(*merge_runs(d, p, p + length))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            gone = batch.filter(pc.is_null(batch.column(4)))
            if gone.num_rows:
                yield _parts(*(gone.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)))
            batch = batch.filter(pc.is_valid(batch.column(4)))
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if size >= SORT and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return fetched.repartition(n, "mh").sortWithinPartitions("mh").mapInArrow(run, _PARTS)


def _numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text) with rid unique and rising with doc_id: doc_id itself if it can be."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    odd = rows.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return rows.filter("doc_id is not null").select(F.col("doc_id").alias("rid"), "doc_id", "text")
    placed = prefix_sums(ordered(rows, [F.col("doc_id"), F.xxhash64("text")], "suffix-rows"), {"rid": F.lit(1).cast("long")})
    return materialize(placed.select("rid", "doc_id", "text"), "suffix-docs")


def repeated_spans(rows: DataFrame, length: int = LENGTH, crowd: int = CROWD, spread: int = SPREAD) -> DataFrame:
    """(rid, start, stop): byte ranges of ``rows`` (rid, text) to be removed; they may overlap."""
    spark = rows.sparkSession
    python_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    filed = _filed(rows.select("rid", "text"), n, length, spread)
    parts = materialize(_sifted(filed.repartitionById(n, F.col("bucket")), length, crowd), "suffix-parts")
    python_batches(spark)
    found = materialize(_sorted_repeats(_fetched(rows, parts.filter("mh is not null"), length), n, length), "suffix-found")
    return parts.filter("mh is null").unionAll(found).select("rid", "start", "stop")


def _spans_of(want) -> np.ndarray:
    a = np.array([(w["start"], w["stop"]) for w in want or ()], np.int64).reshape(-1, 2)
    return np.stack(merge_runs(np.zeros(len(a), np.int64), a[:, 0], a[:, 1])[1:], axis=1) if len(a) else a


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and the kept bytes.

    Null texts are empty. Documents that share a doc_id, or have none, are documents of their
    own, in the order of a hash of their texts; so of two equal rows one is removed as a
    repeat. An empty table gives no rows.
    """
    rows = _numbered(docs)
    spans = repeated_spans(rows, length, crowd, spread).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("want"))  # those of one document
    python_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                cut = _spans_of(want).tolist()
                digest, at = hashlib.sha256(), 0
                for a, b in cut:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                for col, value in zip(out, (len(data), sum(b - a for a, b in cut), len(cut), digest.hexdigest()), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = rows.join(spans, "rid", "left").select("doc_id", "text", "want")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


