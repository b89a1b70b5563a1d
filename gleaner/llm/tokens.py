"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A file holds consecutive documents in ascending doc_id order:

    magic "EFTK", version and id width (2 x uint16), 6 x int64: partition, sequence,
    documents, ids, null doc_ids (first), smallest doc_id
    Elias-Fano list of the documents' end offsets in the id array
    Elias-Fano list of the doc_ids less the smallest
    the id array, 2 or 4 bytes an id, little-endian

and ends with a line feed that isn't part of it. An Elias-Fano list of n rising numbers below u
keeps the low floor(log2(u/n)) bits of each packed and the rest in unary, about 2 + log2(u/n)
bits a number, and every 256th one's bit position, so that a single number is found by a short scan.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import fresh_path, materialize, python_batches

MAGIC = b"EFTK"
SAMPLE = 256
HEAD = struct.Struct("<4sHH6q")
#: Ids in a file, after which the next document starts a new one.
FILE_IDS = 2_000_000
#: Distinct white-space chunks whose ids a worker remembers.
CACHE = 800_000


@dataclass
class EliasFano:
    """A list of rising numbers, each below 2^62."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.int64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        at = (v >> bits) + np.arange(n, dtype=np.int64)
        unary = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        unary[at] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.int64)) & 1).astype(np.uint8).ravel() if bits else np.zeros(0, np.uint8)
        return cls(n, bits, np.packbits(low, bitorder="little"), np.packbits(unary, bitorder="little"), at[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sampled bit on, count ones; then add the low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at // 8
        word = int(self.high[byte]) >> (at % 8) << (at % 8)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        return high << self.low_bits | self._low(i)

    def __iter__(self):
        """All numbers, one after the other."""
        i = 0
        for at in range(len(self.high)):
            byte = int(self.high[at])
            while byte:
                bit = byte & -byte
                yield (8 * at + bit.bit_length() - 1 - i) << self.low_bits | self._low(i)
                byte, i = byte ^ bit, i + 1

    def _low(self, i: int) -> int:
        """The low bits of the i-th number."""
        first = i * self.low_bits
        held = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes(), "little")
        return held >> (first & 7) & (1 << self.low_bits) - 1

    def dump(self) -> bytes:
        return struct.pack("<5q", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def load(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, bits, a, b, c = struct.unpack_from("<5q", data, at)
        at += 40
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, bits, low, high, np.frombuffer(data, "<u4", c, at + a + b)), at + a + b + 4 * c


def dump_file(partition: int, sequence: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    known = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    least = int(known[0]) if len(known) else 0
    head = HEAD.pack(MAGIC, 1, width, partition, sequence, len(doc_ids), len(ids), len(doc_ids) - len(known), least)
    return head + EliasFano.encode(np.cumsum(lengths)).dump() + EliasFano.encode(known - least).dump() + ids.astype(f"<u{width}").tobytes()


class TokenFile:
    """Reads one file; ``document(i)`` finds a document's ids by select, without a table of offsets."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, _, width, self.partition, self.sequence, self.documents, self.n_ids, self.nulls, self.least = HEAD.unpack_from(view, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.load(view, HEAD.size)
        self.keys, at = EliasFano.load(view, at)
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self):
        """The documents' ids, one after the other."""
        yield from repeat(None, self.nulls)
        for key in self.keys:
            yield key + self.least


class _Known(dict):
    """What ``learn`` gives for each key, computed when it first comes."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, key):
        got = self[key] = self.learn(key)
        return got


def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level models use for each byte: its own, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkEncoder:
    """Ids of texts, from the ids of their chunks between blanks.

    Right for tokenizers that never join or look across a blank, line feed, tab or carriage
    return; the tests compare with the tokenizer on whole texts. A chunk's ids are computed
    once and remembered, within a bound. Where the file describes NFC, lower case, a pattern
    and byte-level BPE, chunks of plain Latin letters and signs are cut by that pattern and
    their pieces go straight to the BPE model; all other chunks take the whole tokenizer.
    """

    def __init__(self, path: str, limit: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cut, *level = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        plain = steps == ["NFC", "Replace", "Lowercase"] and cut.get("behavior") == "Removed" and cut.get("invert")
        plain = plain and [(x.get("type"), x.get("add_prefix_space"), x.get("use_regex")) for x in level] == [("ByteLevel", False, False)]
        self.cut = regex.compile(cut["pattern"]["Regex"]).findall if plain else None
        self.latin = re.compile("[!-~\xa1-\xac\xae-\xff]+").fullmatch
        self.chars = _byte_chars()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.forget()

    def forget(self):
        self.chunks, self.pieces = _Known(self._chunk), _Known(self._piece)

    def _dump(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, piece: str) -> bytes:
        chars = piece if piece.isascii() else "".join(self.chars[b] for b in piece.encode())
        return self._dump([t.id for t in self.tokenizer.model.tokenize(chars)])

    def _chunk(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if self.cut and self.latin(chunk) and "<|" not in chunk:
            found = self.cut(chunk.lower())
            return self.pieces[found[0]] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))
        return self._dump(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> np.ndarray:
        if len(self.chunks) > self.limit or len(self.pieces) > self.limit:
            self.forget()
        words = (text or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, words)), self.kind)


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    """One encoder a worker, whose memory of chunks serves all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS) -> None:
    """Encode every text, append ``end_id``, and write files in ascending doc_id order (nulls first).

    Only Spark's own writer touches the target: a file is one value, written as it is.
    """
    spark = docs.sparkSession
    python_batches(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def encode(batches):
        from pyspark import TaskContext

        encoder, part, seq = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        width = 2 if encoder.kind == "<u2" and end_id < 65536 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        keys, lengths, data, total = [], [], [], 0

        def flush():
            ids = np.frombuffer(b"".join(data), f"<u{width}")
            return pa.RecordBatch.from_arrays([pa.array([dump_file(part, seq, keys, np.array(lengths, np.int64), ids, width)], pa.binary())], ["blob"])

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py())
                keys.append(key.as_py())
                data += [ids.astype(f"<u{width}", copy=False).tobytes(), end]
                lengths.append(len(ids) + 1)
                total += len(ids) + 1
                if total >= file_ids:
                    yield flush()
                    seq, keys, lengths, data, total = seq + 1, [], [], [], 0
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    order = [F.col("doc_id"), F.xxhash64("text")]  # rows of one id may be many; of equal rows it doesn't matter which is first
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    files = rows.mapInArrow(encode, "blob binary")
    files.select(F.col("blob").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def read_token_files(spark, path: str) -> DataFrame:
    """A row a document: doc_id, start, n_tokens, ids_crc32, from the files alone."""

    def decode(batches):
        for batch in batches:
            for blob in batch.column(0):
                f = TokenFile(blob.as_buffer())
                out, at = [], 0
                for i, key in enumerate(f.doc_ids()):
                    end = f.ends.select(i)
                    out.append((f.partition, f.sequence, key, at, end - at, zlib.crc32(f.ids[at:end].astype("<u4").tobytes())))
                    at = end
                    if len(out) == 8192 or i + 1 == f.documents:
                        cols = [pa.array([x[k] for x in out], pa.int64()) for k in range(6)]
                        yield pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])
                        out = []

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    python_batches(spark)
    rows = materialize(raw.mapInArrow(decode, "part long, seq long, doc_id long, at long, n_tokens long, ids_crc32 long"), "token-rows")
    python_batches(spark)
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    parts = files.groupBy("part").agg(F.sum("n").alias("m")).select("part", F.coalesce(F.sum("m").over(before("part")), F.lit(0)).alias("_part_at"))
    files = files.select("part", "seq", F.coalesce(F.sum("n").over(before("part", "seq")), F.lit(0)).alias("_file_at")).join(parts, "part")
    return rows.join(files, ["part", "seq"]).select("doc_id", (F.col("_part_at") + F.col("_file_at") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_report(docs: DataFrame, tokenizer: str, end_id: int = 1, file_ids: int = FILE_IDS) -> DataFrame:
    """Write the corpus as token files in the shared folder and describe it as read back.

    Null and empty texts are the end id alone; a null doc_id sorts first, rows that
    share an id go by a hash of their texts; repeated rows are written each; an empty table gives no file and no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, end_id, file_ids)
    return read_token_files(spark, path)


