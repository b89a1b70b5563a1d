"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators.numbering import discard, fresh_path, materialize, ordered, prefix_sums, shared_dir
from gleaner.session import BATCH_BYTES, python_batches

__all__ = ["BATCH_BYTES", "SPACES", "discard", "fresh_path", "let", "marked", "materialize", "ordered", "prefix_sums", "python_batches", "shared_dir", "slot", "slot_map", "unused", "words_of"]

SPACES = " \t\n\x0b\f\r"
#: Bits of a map of values that have a partner.
MAP_BITS = 1 << 23


def slot(column: str) -> Column:
    """The bit of a ``slot_map`` that a value has."""
    return F.pmod(F.xxhash64(column), F.lit(MAP_BITS))


def slot_map(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of hashed values, of MAP_BITS however many there are.

    It spares rows without a partner the way through a join's shuffle; the join still decides.
    """
    words = ids.select(slot(column).alias("s")).select(F.shiftright("s", 5).alias("w"), F.expr("shiftleft(1L, cast(s & 31 as int))").alias("b"))
    marks = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()  # at most MAP_BITS / 32 rows
    bits = np.zeros(MAP_BITS // 32, np.uint32)
    bits[marks.column(0).to_numpy()] = marks.column(1).to_numpy().astype(np.uint32)
    return bits


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return bits[at >> 5] >> (at & 31).astype(np.uint32) & 1 == 1


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row."""
    return F.transform(F.array(value), body)[0]


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; none for null."""
    flat = F.coalesce(text, F.lit(""))
    for blank in SPACES[1:]:
        flat = F.replace(flat, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")
