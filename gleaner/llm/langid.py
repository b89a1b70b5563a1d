"""Language identification by cross-parsing texts with suffix automata of labelled text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import discard, materialize, python_batches

#: Bounds of the training sample: documents and characters of a language.
SAMPLE_DOCS, SAMPLE_CHARS = 64, 40_000
#: Shorter samples count as this long when phrases are weighted by the logarithm of the sample's length.
LEAST_CHARS = 4096
#: Bytes of full transition tables; languages beyond them have their transitions sorted by state and letter.
TABLE_BYTES = 128 << 20
#: Characters of the blocks of a text that are parsed side by side, and those before a block from which its start is guessed.
BLOCK, LEAD = 512, 64


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of ``codes``; state 0 is the start."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        state = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = state
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return go


def transitions(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(state times width plus letter, next state) in order, and the number of states, of the automaton of ``codes``."""
    go = suffix_automaton(codes)
    size = sum(map(len, go))
    keys = np.fromiter((s * width + c for s, out in enumerate(go) for c in out), np.int64, size)
    to = np.fromiter((t for out in go for t in out.values()), np.uint32, size)
    order = np.argsort(keys)
    return keys[order], to[order], len(go)


class Full:
    """Transitions as a table of all states and all letters of the sample."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, states: int, local: np.ndarray, width: int):
        # an entry is the next state times the width; the top bit marks that a phrase ended
        self.local = local
        root = np.zeros(width, np.uint32)
        first = keys < width
        root[keys[first]] = to[first] * np.uint32(width)
        self.table = np.tile(root | np.uint32(1 << 31), states)
        self.table[keys] = to * np.uint32(width)

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and 1 where a phrase ended."""
        to = self.table[states + self.local[codes]]
        return to & np.uint32(0x7FFFFFFF), to >> 31


class Sorted:
    """Transitions sorted by state and letter; their number is at most three times the sample's length."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, states: int, local: np.ndarray, width: int):
        self.keys, self.to, self.local, self.width = keys, to, local, width
        self.root = np.zeros(width, np.uint32)
        self.root[keys[keys < width]] = to[keys < width]

    def step(self, states: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.local[codes]
        want = states.astype(np.int64) * self.width + at
        i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        hit = self.keys[i] == want
        return np.where(hit, self.to[i], self.root[at]), (~hit).astype(np.uint32)


def _parse(tables: list, codes: np.ndarray, start: np.ndarray, length: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states in which pieces of ``codes`` end that start in ``states``, and the phrases that end in them, by table."""
    order = np.argsort(-length, kind="stable")
    start, states, counts = start[order], states[:, order], np.zeros(states.shape, np.uint32)
    alive = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")
    for j, m in enumerate(alive.tolist()):
        c = codes[start[:m] + j]
        for k, table in enumerate(tables):
            states[k, :m], ended = table.step(states[k, :m], c)
            counts[k, :m] += ended
    out = np.empty_like(states), np.empty(states.shape, np.int64)
    out[0][:, order], out[1][:, order] = states, counts
    return out


class CrossParser:
    """Phrase counts of texts against a sample text of each language.

    A phrase is the longest match of what is left of a text with any substring of the sample;
    a letter that the sample lacks is a phrase of its own. Runs of characters that aren't
    letters count as one blank, case is ignored.
    """

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(lang for lang, text in samples.items() if any(map(str.isalpha, text)))
        seen: dict[str, int] = {}
        for text in samples.values():
            for ch in text.lower():
                if ch.isalpha():
                    seen[ch] = seen.get(ch, 0) + 1
        self.code = {ch: i + 2 for i, ch in enumerate(sorted(seen))}
        self.table = np.fromiter((self._code(chr(c)) for c in range(65536)), np.uint32, 65536)
        self.built, self.scale = [], []
        for lang in self.langs:
            codes, _ = self.codes([samples[lang]])
            own, at = np.unique(codes, return_inverse=True)  # letters that the sample lacks share its last code
            local = np.full(len(self.code) + 2, len(own), np.uint32)
            local[own] = np.arange(len(own))
            self.built.append((*transitions(at, len(own) + 1), local, len(own) + 1))
            self.scale.append(np.log2(max(len(codes), LEAST_CHARS)))
        self._open()

    def _open(self):
        self.tables, left = [], TABLE_BYTES
        for built in self.built:
            size = 4 * built[2] * built[4]
            full = size <= left
            left -= size if full else 0
            self.tables.append((Full if full else Sorted)(*built))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def __setstate__(self, state):
        """Automata are built once and sent as sorted transitions; each worker fills its tables from them."""
        self.__dict__.update(state)
        self._open()

    def _code(self, ch: str) -> int:
        return self.code.get(ch.lower()[:1], 1) if ch.isalpha() else 0

    def codes(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, one after the other, and the length of each."""
        points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        owner = np.repeat(np.arange(len(points)), [len(p) for p in points])
        flat = np.concatenate(points) if points else np.zeros(0, np.uint32)
        out = self.table[np.minimum(flat, 65535)]
        if len(far := np.flatnonzero(flat > 65535)):
            kinds, which = np.unique(flat[far], return_inverse=True)
            out[far] = np.fromiter((self._code(chr(c)) for c in kinds.tolist()), np.uint32, len(kinds))[which]
        if len(out):
            keep = (out > 0) | np.concatenate([[True], (out[:-1] > 0) | (owner[1:] != owner[:-1])])
            out, owner = out[keep], owner[keep]
        return out, np.bincount(owner, minlength=len(points))

    def phrases(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text against each language, and whether it has a letter.

        A text's blocks are parsed side by side, each from the state that a parse of the few
        characters before it ends in. Parses that start at different places soon fall into
        step; a block whose guess isn't the state in which the block before it did end is
        parsed again from that one. So the counts are those of one parse of the whole text.
        """
        codes, sizes = self.codes(texts)
        ends = np.cumsum(sizes)
        n_blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = (ends - sizes)[owner] + nth * BLOCK
        length = np.minimum(BLOCK, ends[owner] - start)
        later = np.flatnonzero(nth > 0)
        begin = np.zeros((len(self.langs), len(owner)), np.uint32)
        begin[:, later], _ = _parse(self.tables, codes, start[later] - LEAD, np.full(len(later), LEAD), begin[:, later])
        end, counts = _parse(self.tables, codes, start, length, begin)
        total = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            while len(wrong := later[begin[k, later] != end[k, later - 1]]):
                begin[k, wrong] = end[k, wrong - 1]
                again = _parse([table], codes, start[wrong], length[wrong], begin[None, k, wrong])
                end[k, wrong], counts[k, wrong] = again[0][0], again[1][0]
            total[:, k] = np.bincount(owner, counts[k], minlength=len(texts)) + (sizes > 0)
        letters = np.bincount(np.repeat(np.arange(len(texts)), sizes), codes > 0, minlength=len(texts)) > 0
        return total, letters

    def predict(self, texts: list) -> list[tuple[str, float]]:
        """(language, score) of each text; score is by how much the best needs less than the next, 0 to 1."""
        counts, letters = self.phrases(texts)
        out = []
        for row, ok in zip(counts * np.array(self.scale), letters, strict=True):
            if not ok or not self.langs:
                out.append(("und", 0.0))
                continue
            best, *rest = np.argsort(row, kind="stable")[:2].tolist()
            out.append((self.langs[best], float(1 - row[best] / row[rest[0]]) if rest else 1.0))
        return out


def learn(labelled: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """A sample text of every language, from rows (doc_id, text, lang) with a language.

    The rows are the ``docs_per_lang`` with the smallest hashes of doc_id and text in each language,
    repeated ones once; texts are joined up to ``chars`` characters. Only hashes and languages are
    sorted for this.
    """
    slim = labelled.filter("lang is not null and text is not null").select("lang", "text", F.struct(F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("x")).alias("_h"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("_h"))
    ranked = slim.select("lang", "_h").withColumn("_k", place).filter(F.col("_k") <= docs_per_lang)
    bounds = materialize(ranked.groupBy("lang").agg(F.max("_h").alias("_top")), "lang-bounds")  # a row a language
    within = slim.join(bounds, "lang").filter(F.col("_h") <= F.col("_top"))
    rows = within.select("lang", "_h", F.substring("text", 1, chars).alias("text")).dropDuplicates(["lang", "_h"]).collect()
    discard(bounds)
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["_h"])):
        out[r["lang"]] = (out.get(r["lang"], "") + " " + r["text"])[: chars + 1]
    return out


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; ``und`` and 0 without a letter."""
    python_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(CrossParser(samples))  # bounded with the samples

    def run(batches):
        parser = shared.value
        for batch in batches:
            got = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def language_report(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learnt from those whose fold isn't 0.

    Nulls in text give ``und``; rows without lang don't teach; repeated rows come out each; an
    empty table gives no rows, and one without labels ``und`` throughout.
    """
    samples = learn(docs.filter(fold_of(F.col("doc_id")) != 0).select("doc_id", "text", "lang"))
    out = identify(docs, samples)
    return out.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")
