"""Lookup of names that may be misspelt: candidates that have two parts in common, then edit distance."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.operators.numbering import materialize

EDITS, PART = 2, 2
#: Known names that may meet under one key.
OFTEN = 1024


def deletions(name: Column, edits: int = EDITS) -> Column:
    """A name and what is left of it without up to ``edits`` of its characters."""
    drop = lambda s: F.when(s == "", F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s)))))
    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
    return out


def _layouts(edits: int) -> list[tuple[int, int, int, int, int]]:
    """(i, j, p, q, longer): all ways in which the first two untouched parts of a name can lie in one within ``edits``.

    Cut into edits + 2 parts, a name has at least two that no edit touches, i and j. They lie p and q
    characters further on in the other name, which is ``longer`` by so many. An insertion
    belongs to the part of the character after it (at the end to the last), so nothing but the parts
    before, between and behind can move them, and those before j other than i have an edit each.
    """
    out, parts = set(), edits + 2
    for i, j in combinations(range(parts), 2):
        least, room = (i, j - i - 1, 0), (i, j - i - 1, parts - 1 - j)
        for each in product(range(edits + 1), repeat=3):
            if sum(each) <= edits and all(e >= low and (e == 0 or have) for e, low, have in zip(each, least, room, strict=True)):
                out |= {(i, j, a, a + b, a + b + c) for a, b, c in product(*(range(-e, e + 1) for e in each))}
    return sorted(out)


def _places(length: Column, i, j, p, q, parts: int) -> list[tuple[Column, Column]]:
    """Where the parts i and j of a name of that length start and end in one where they lie p and q further on."""
    return [(F.floor(length * k / parts).cast("int") + by, F.floor(length * (k + 1) / parts).cast("int") + by) for k, by in ((i, p), (j, q))]


def _keys(text: Column, edits: int, q: int, layouts: list[tuple[int, int, int, int, int]], most: int) -> Column:
    """By layout a hash of the two parts that a text would share with another, null if it can't; then, of texts up to ``most``, hashes of what is left of them without up to ``edits`` characters."""
    parts = edits + 2

    def key(i: int, j: int, *moved: int) -> Column:
        length = F.length(text) - moved[2]
        places = _places(length, i, j, *moved[:2], parts)
        cond = length >= q * parts
        for (start, end), by in zip(places, moved[:2], strict=True):
            cond = cond & (start >= 0) if by < 0 else cond
            cond = cond & (end <= F.length(text)) if by > moved[2] else cond
        return F.when(cond, F.xxhash64(F.lit(i * parts + j), length, *[F.substr(text, start + 1, end - start) for start, end in places]))

    short = F.transform(deletions(text, edits), lambda x: F.xxhash64(F.lit(-1), x))
    return F.concat(F.array(*[key(*x) for x in layouts]), F.when(F.length(text) <= most, short).otherwise(F.array().cast("array<bigint>")))


def _rest(layouts: list[tuple[int, int, int, int, int]], parts: int) -> Column:
    """``text`` without the two parts of its ``layout``."""
    i, j, p, q, longer = (F.element_at(F.array(*[F.lit(x[k]) for x in layouts]), F.col("layout") + 1) for k in range(5))
    (a, b), (c, d) = _places(F.length("text") - longer, i, j, p, q, parts)
    return F.concat(F.substr("text", F.lit(1), a), F.substr("text", b + 1, c - b), F.substr("text", d + 1, F.length("text")))


def _close_pairs(asked: DataFrame, known: DataFrame, edits: int, q: int) -> DataFrame:
    """(name, match, distance) of ``close_names``, some more than once; asked and known: (name, text, under).

    Texts are names or what is left of them, and meet under equal keys only. Known texts that have ``q`` characters for each of
    edits + 2 parts meet by the two parts that edits can't have touched, shorter ones by what is left of both without up to
    ``edits`` characters. Where over OFTEN known texts have two parts in common, as addresses of
    one town have, their rests meet in the same way. Keys are hashes; they leave out no pair, the distance decides.
    """
    parts = edits + 2
    ways, whole = _layouts(edits), [(i, j, 0, 0, 0) for i, j in combinations(range(parts), 2)]

    def met(names: DataFrame, layouts: list, most: int) -> DataFrame:
        rows = names.select("name", "text", "under", F.posexplode(_keys(F.col("text"), edits, q, layouts, most)).alias("layout", "key"))
        return rows.where("key is not null").select("name", "text", "layout", F.xxhash64("under", "key").alias("key"))

    left, right = met(asked, ways, q * parts - 1 + edits), materialize(met(known, whole, q * parts - 1), "name-parts")
    often = materialize(right.where(F.col("layout") < len(whole)).groupBy("key").count().where(F.col("count") > OFTEN).select("key"), "name-parts-often")
    some = not often.isEmpty()
    if some:
        left = materialize(left, "name-parts-asked")
    rare = right.join(often, "key", "left_anti") if some else right
    pairs = left.select("name", "key").join(rare.select(F.col("name").alias("match"), "key"), "key").select("name", "match", F.levenshtein("name", "match", edits).alias("distance")).where(F.col("distance") >= 0)
    if some:
        rest = [rows.where(F.col("layout") < len(layouts)).join(often, "key", "left_semi").select("name", _rest(layouts, parts).alias("text"), F.col("key").alias("under")) for rows, layouts in ((left, ways), (right, whole))]
        pairs = pairs.unionAll(_close_pairs(*rest, edits, q))
    return pairs


def _names(rows: DataFrame) -> DataFrame:
    return rows.where("name is not null").select("name", F.col("name").alias("text"), F.lit(0).cast("long").alias("under"))


def close_names(asked: DataFrame, known: DataFrame, edits: int = EDITS, q: int = PART) -> DataFrame:
    """(name, match, distance): all names of ``known`` within ``edits`` edits of each name of ``asked``.

    Both have a column ``name``; nulls have no matches. ``q`` is the least length of the parts by
    which names meet; it changes no result.
    """
    return _close_pairs(_names(asked.select("name").distinct()), _names(known.select("name").distinct()), edits, q).distinct()


def _as_bytes(name: Column) -> Column:
    """A name whose characters stand for the bytes of ``name`` in UTF-8; keeps their order."""
    return F.decode(name.cast("binary"), "ISO-8859-1")


def lookup_tolerant(venues: DataFrame, gazetteer: DataFrame, edits: int = EDITS, by_bytes: bool = False) -> DataFrame:
    """(venue, address, distance, lat, long): the address (of gazetteer: address, lat, long) nearest to a venue's name; nulls beyond ``edits``.

    Of equally near ones the first in order. Exact names aren't compared with others. An edit is that
    of a character or, with ``by_bytes``, of a byte in UTF-8.
    """
    if by_bytes:
        got = lookup_tolerant(venues.select(_as_bytes(F.col("venue")).alias("venue")), gazetteer.withColumn("address", _as_bytes(F.col("address"))), edits)
        back = lambda name: F.decode(F.encode(name, "ISO-8859-1"), "UTF-8").alias(name)
        return got.select(back("venue"), back("address"), "distance", "lat", "long")
    names = venues.select(F.col("venue").alias("name")).distinct()
    places = gazetteer.groupBy(F.col("address").alias("match")).agg(F.min(F.struct("lat", "long")).alias("at"))
    exact = names.join(places.select(F.col("match").alias("name")), "name", "left_semi")
    close = _close_pairs(_names(names.join(exact, "name", "left_anti")), _names(places.select(F.col("match").alias("name"))), edits, PART)
    best = close.groupBy("name").agg(F.min(F.struct("distance", "match")).alias("b")).select("name", F.col("b.match").alias("match"), F.col("b.distance").alias("distance"))
    found = exact.select("name", F.col("name").alias("match"), F.lit(0).alias("distance")).unionAll(best).join(places, "match")
    got = names.join(found, "name", "left")
    return got.select(F.col("name").alias("venue"), F.col("match").alias("address"), "distance", "at.lat", "at.long")
