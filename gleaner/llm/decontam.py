"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, ordered, prefix_sums, python_batches, unused

WINDOW = 13
#: Bytes of benchmark text in an automaton, which takes about 105 times as many; larger benchmarks take several passes.
AUTOMATON_BYTES = 4 << 20

_UPPER = bytes(range(0x41, 0x5B))
#: ASCII letters lower-cased; every other ASCII byte but digits a blank. Offsets stay as they are.
_FOLD = bytes(b + 32 if b in _UPPER else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class Scanner:
    """The automaton for the windows of some items, given as (id string or None, text).

    Of items of at least ``width`` words it holds every (width + 1) / 2 words in turn: each
    window has such a block whole. Where one occurs, the text's windows around it are looked
    up. Shorter items are patterns themselves.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW):
        import ahocorasick

        self.width, self.block = width, (width + 1) // 2
        self.of: dict[bytes, set[str]] = {}
        patterns: dict[bytes, list] = {}
        for key, text in items:
            words = fold(text).split()
            n = min(width, len(words))
            for i in range(len(words) - n + 1 if words else 0):
                keys = self.of.setdefault(b" ".join(words[i : i + n]), set())
                if key is not None:
                    keys.add(key)
            if 0 < n < width:
                patterns.setdefault(b" ".join(words), [n, False, False])[1] = True
            elif n:
                for i in range(0, len(words) - self.block + 1, self.block):
                    patterns.setdefault(b" ".join(words[i : i + self.block]), [self.block, False, False])[2] = True
        self.automaton = ahocorasick.Automaton()
        for pattern, what in patterns.items():
            self.automaton.add_word(f" {pattern.decode('latin-1')} ", tuple(what))
        if patterns:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged [first, end) word spans that are hit, and the ids of the items."""
        if not words or not self.of:
            return [], set()
        hay = f" {b' '.join(words).decode('latin-1')} "
        hits = list(self.automaton.iter(hay))
        if not hits:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(hay.encode("latin-1"), np.uint8) == 32)
        found, starts = set(), set()
        for end, (n, short, block) in zip(np.searchsorted(blanks, [at for at, _ in hits]).tolist(), (x for _, x in hits), strict=True):
            if short:
                found.add((end - n, end))
            if block:
                starts.update(range(max(0, end - self.width), min(end - n, len(words) - self.width) + 1))
        spans, items = [], set()
        for a, b in (*found, *((i, i + self.width) for i in starts)):
            if (keys := self.of.get(b" ".join(words[a:b]))) is not None:
                spans.append((a, b))
                items |= keys
        return merged(spans), items


def merged(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SCANNERS: dict = {}


def _scanner(key: str, broadcast, width: int) -> Scanner:
    """The scanner of a broadcast list of items, built once in a worker; ``key`` names the broadcast."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(broadcast.value, width)
    return _SCANNERS[key]


_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def benchmark_parts(benchmark: DataFrame, width: int = WINDOW, limit: int = AUTOMATON_BYTES) -> list[DataFrame]:
    """The benchmark as (key, text) frames of ``limit`` bytes or little more.

    Items with very many words come in runs of them that overlap by a word less than a window,
    so each window is in one. Repeated runs count once. Parts are cut by running sizes, so none
    exceeds ``limit`` by more than a run, however the sizes are spread.
    """
    words = F.regexp_extract_all("text", F.lit(f"({_WORD})"), 1)
    items = benchmark.select(F.col("item_id").cast("string").alias("key"), words.alias("w")).filter(F.size("w") > 0)
    size = max(1, limit // 64)
    at = F.sequence(F.lit(0), F.greatest(F.floor((F.size("w") - width) / size), F.lit(0)).cast("int"))
    runs = items.select("key", "w", F.explode(at).alias("r")).select("key", F.array_join(F.slice("w", F.col("r") * size + 1, F.lit(size + width - 1)), " ").alias("text")).distinct()
    total = runs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if total <= limit:
        return [runs]
    placed = prefix_sums(ordered(runs, [F.col("key"), F.col("text")], "decontam-items"), {"_from": F.octet_length("text").cast("long")})
    placed = materialize(placed.select("key", "text", F.floor(F.col("_from") / limit).cast("int").alias("part")), "decontam-parts")
    n = placed.agg(F.max("part").alias("n")).first()["n"] + 1
    return [placed.where(F.col("part") == k).select("key", "text") for k in range(n)]


def _broadcast(part: DataFrame):
    """(name, broadcast) of the items of one part, whose text is bounded."""
    return uuid.uuid4().hex, part.sparkSession.sparkContext.broadcast([(r["key"], r["text"]) for r in part.collect()])


_SPAN = pa.list_(pa.struct([(k, pa.int64()) for k in ("first_word", "end_word", "from_byte", "to_byte")]))
SCHEMA = "doc_id long, row_id long, n_words long, spans array<struct<first_word:long,end_word:long,from_byte:long,to_byte:long>>, items array<string>"


def _found(rows: DataFrame, part: DataFrame, width: int, only_hits: bool) -> DataFrame:
    """SCHEMA from (doc_id, text, row_id): one pass with the automaton of one part."""
    shared = _broadcast(part)

    def scan(batches):
        scanner = _scanner(*shared, width)
        for batch in batches:
            out = []
            for key, text, row in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = fold(text.as_py())
                words = raw.split()
                spans, items = scanner.scan(words)
                if spans or not only_hits:
                    out.append((key.as_py(), row.as_py(), len(words), _placed(raw, spans), sorted(items)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), _SPAN, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc_id", "row_id", "n_words", "spans", "items"])

    return rows.mapInArrow(scan, SCHEMA)


def _placed(raw: bytes, spans: list) -> list[dict]:
    """Spans with the byte offsets of their words in the folded text, which are those in the original."""
    if not spans:
        return []
    solid = np.frombuffer(b" " + raw + b" ", np.uint8) != 32
    first, end = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    return [{"first_word": a, "end_word": b, "from_byte": int(first[a]), "to_byte": int(end[b - 1])} for a, b in spans]


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, the spans of words that occur in a benchmark window, and the items.

    Spans are merged and carry word numbers and UTF-8 byte offsets in the original text. A
    benchmark of over ``limit`` bytes is split: each part is a further pass
    over the texts, done before the next part is read, and the spans of a document are gathered
    by the number that its row then gets.
    """
    python_batches(docs.sparkSession)
    parts = benchmark_parts(benchmark, width, limit)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(0).cast("long").alias("row_id"))
    if len(parts) == 1:
        return _found(rows, parts[0], width, False).drop("row_id")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "decontam-rows")
    found = materialize(_found(rows, parts[0], width, False), "decontam-found")
    for part in parts[1:]:
        found = found.unionAll(materialize(_found(rows, part, width, True), "decontam-found"))
    discard(rows)
    gathered = found.groupBy("row_id").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return gathered.drop("row_id")  # the lists are of one document


def hit_words(spans):
    """Distinct words in spans, which may overlap if they come from several passes."""
    ordered = F.array_sort(spans)
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end_word"] - F.greatest(s["first_word"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], s["end_word"]).alias("to")
    )
    zero = F.lit(0).cast("long")
    return F.aggregate(ordered, F.struct(zero.alias("n"), zero.alias("to")), step, lambda a: a["n"])


def contamination_report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """Per document the words hit, the items found and the verdict.

    Null texts have no words and are clean; items without words match nothing; words of
    items without an id are hit like any other, but such items aren't among those found;
    repeated rows count as they stand, repeated items once; ids of documents are whole numbers; an empty benchmark leaves all clean.
    """
    rows = find_passages(docs, benchmark, width, limit).withColumn("n_hit", hit_words(F.col("spans")))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` without contaminated documents, all columns as they are.

    With a benchmark of several automata, each is a pass that gives the numbers of rows that
    are hit; the verdict is on what all passes found.
    """
    python_batches(docs.sparkSession)
    parts = benchmark_parts(benchmark, width, limit)
    if len(parts) > 1:
        row = unused("row", docs.columns)
        rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
        slim = rows.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string"), F.col(row).alias("row_id"))
        found = [materialize(_found(slim, part, width, True), "decontam-found") for part in parts]
        found = reduce(DataFrame.unionAll, found).groupBy("row_id").agg(F.any_value("n_words").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"))
        dirty = found.filter(20 * hit_words(F.col("spans")) >= F.col("n")).select(F.col("row_id").alias(row))
        return rows.join(dirty, row, "left_anti").select(*docs.columns)
    shared, place = _broadcast(parts[0]), docs.columns.index("text")

    def clean(batches):
        scanner = _scanner(*shared, width)
        for batch in batches:
            keep = []
            for text in batch.column(place):
                words = fold(text.as_py()).split()
                hit = sum(b - a for a, b in scanner.scan(words)[0])
                keep.append(not hit or 20 * hit < len(words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
