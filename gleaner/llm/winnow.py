"""Document fingerprints by winnowing: minima of windows of rolling k-gram hashes, with their positions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import materialize, python_batches

#: Code points of a gram and grams of a window; a passage of GRAM + WINDOW - 1 code points that two texts share is found in both.
GRAM, WINDOW = 12, 12
#: Windows hashed at once, so that long texts need no more memory.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """The hash of each run of ``k`` code points; of all of them if they are fewer; none of none.

    A gram is a polynomial in its code points modulo 2^64. All come from one running sum: that
    up to the gram's end less that up to its start, times a power of the base. The bits are
    mixed afterwards, so that their order is as good as random.
    """
    n = len(points)
    k = min(k, n)
    if not n:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _powers(_INVERSE, n), dtype=np.uint64, out=sums[1:])
    h = (sums[k:] - sums[: n - k + 1]) * _powers(_BASE, n)[k - 1 :]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _window_minima(hashes: np.ndarray, w: int) -> np.ndarray:
    """The place of each window's least hash (by its upper 32 bits), the rightmost of equal ones, each place once."""
    place = np.arange(len(hashes), dtype=np.uint64)
    key = (hashes & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - place)
    w = min(w, len(key))
    span = 1
    while 2 * span <= w:  # minima of 2, 4, 8, … neighbours, then of two such runs that overlap
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < w:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    chosen = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return chosen[np.flatnonzero(np.diff(chosen, prepend=-1))]


def select(text: str | None, k: int = GRAM, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) that winnowing keeps of a text. Null is the empty text, which has none."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    grams = max(1, len(points) - k + 1)
    places, values = [], []
    for start in range(0, max(1, grams - w + 1), PIECE):
        hashes = rolling_hashes(points[start : start + PIECE + w - 1 + k - 1], k)
        if not len(hashes):
            break
        at = _window_minima(hashes, w)
        places.append(at + start)
        values.append(hashes[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, value = np.concatenate(places), np.concatenate(values)
    keep = np.flatnonzero(np.diff(at, prepend=-1))  # a place may end one piece and begin the next
    return at[keep], value[keep]


def digest(hashes: np.ndarray) -> str:
    """The fingerprint as 32 hex digits: a hash of the kept hashes in text order."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of kept hashes; 1 if both are empty."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def fingerprints(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """doc_id, positions and hashes (as signed longs) that winnowing keeps of each text; nothing is shuffled.

    Null and empty texts have empty arrays; a text shorter than ``k`` is one gram.
    """
    python_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            kept = [select(t, k, w) for t in batch.column(1).to_pylist()]
            lists = [pa.array([x.view(np.int64) for x in part], pa.list_(pa.int64())) for part in zip(*kept, strict=True)] if kept else [pa.array([], pa.list_(pa.int64()))] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "positions", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, positions array<long>, hashes array<long>")


class _Document:
    def __init__(self, doc_id, text, k, w):
        self.doc_id, self.text, self.width = doc_id, text or "", (k, w)
        self.hashes = select(self.text, k, w)[1]

    def against(self, after: _Document) -> tuple:
        n = len(self.text)
        edited = self.text[: n - n // 2] + after.text[: n // 2]
        other = select(edited, *self.width)[1]
        return (
            self.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(self.hashes), digest(other),
            likeness(self.hashes, other), likeness(self.hashes, after.hashes), len(self.hashes),
        )


_REPORT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_kept", pa.int64()),
])
_EDGED = _REPORT.append(pa.field("edge", pa.string())).append(pa.field("slice", pa.int32())).append(pa.field("text", pa.string()))
_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_kept"]
_TYPES = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


def edit_report(docs: DataFrame, k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and its likeness to the next document's.

    The next document is the one with the next smaller doc_id, after the last the first. The
    edited text has the first code points of the next document in place of the last half. Texts
    are shuffled once, into ranges of doc_id, and read in order; only the first and last document
    of a range are written with their texts, to be matched across ranges.

    A null text is empty; empty texts have empty fingerprints, equal to each other (likeness 1).
    A null doc_id comes last; equal doc_ids are ordered by a hash of their texts, and repeated
    rows are documents of their own. A table with one row has itself as the next. An empty table
    gives no rows. Columns beyond doc_id and text are ignored.
    """
    python_batches(docs.sparkSession)

    def run(batches):
        pid, last = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here = _Document(doc_id, text, k, w)
                if last is None:
                    rows.append((doc_id, *[None] * 7, "first", pid, here.text))
                else:
                    rows.append((*last.against(here), None, pid, None))
                last = here
            yield _batch(rows, _EDGED)
        if last is not None:
            yield _batch([(last.doc_id, *[None] * 7, "last", pid, last.text)], _EDGED)

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranged = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.mapInArrow(run, f"{_TYPES}, edge string, slice int, text string"), "winnow-ranges")

    def across(batches):
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in range(4)]
            yield _batch([_Document(a, s, k, w).against(_Document(b, t, k, w)) for a, s, b, t in zip(*got, strict=True)], _REPORT)

    firsts = rows.filter("edge = 'first'").select("slice", F.col("doc_id").alias("next_id"), F.col("text").alias("next_text"))
    every = Window.orderBy("slice")  # a row a range
    turns = firsts.select("slice").withColumn("after", F.lead("slice").over(every)).withColumn("start", F.min("slice").over(every))
    turns = turns.select(F.col("slice").alias("at"), F.coalesce("after", "start").alias("slice"))
    lasts = rows.filter("edge = 'last'").select(F.col("slice").alias("at"), "doc_id", "text")
    met = lasts.join(turns, "at").join(firsts, "slice").select("doc_id", "text", "next_id", "next_text")
    return rows.filter("edge is null").select(*_COLUMNS).unionAll(met.mapInArrow(across, _TYPES))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
