"""The element tree of a page as an array of intervals, and selectors over it.

``elements(html)`` has a struct for each element in document order: tag, depth, the place of its
start tag, its contents' first and last character, and its attributes as written. An element is
inside another exactly if its place lies between the other's, so selectors need no tree: they are
filters over the array. Explode it for a table of elements.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import html_to_text

#: Elements without an end tag, and elements that the next one of their kind ends.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
ENDED_BY_NEXT = frozenset(("dd", "dt", "li", "option", "p", "td", "th", "tr"))
ELEMENT = "struct<tag:string,depth:int,start:int,first:int,last:int,attributes:string>"
#: Pages whose elements are Python objects at once.
SLICE = 256

_TAG = re.compile(r"""<!--.*?-->|<(script|style)\b([^>]*)>.*?</\1\s*>|<(/?)([a-z][\w:-]*)((?:"[^"]*"|'[^']*'|[^'">])*+|[^>]*)>""", re.S | re.I)


def page_elements(html: str) -> list[list]:
    """[tag, depth, start, first, last, attributes] of each element, places counted from 1.

    An end tag ends the innermost open element of its name and all within it; one that fits none
    is ignored. What is never ended ends with the page. Scripts, styles and comments are no elements.
    """
    out: list[list] = []
    path: list[list] = []
    held: dict[str, int] = {}

    def end(until: int) -> None:
        gone = path.pop()
        held[gone[0]] -= 1
        gone[4] = until

    for m in _TAG.finditer(html):
        name = m[4]
        if not name:
            continue
        tag = name.lower()
        if m[3]:
            if held.get(tag):
                while path[-1][0] != tag:
                    end(m.start())
                end(m.start())
            continue
        if tag in ENDED_BY_NEXT and path and path[-1][0] == tag:
            end(m.start())
        written = m[5].strip()
        row = [tag, len(path), m.start() + 1, m.end() + 1, m.end(), written.rstrip("/").rstrip()]
        out.append(row)
        if tag not in VOID and not written.endswith("/"):
            path.append(row)
            held[tag] = held.get(tag, 0) + 1
    while path:
        end(len(html))
    return out


def _elements(pages: pa.Array) -> pa.Array:
    """Slice by slice: a page's elements take a multiple of its bytes as Python objects, and less as Arrow's."""
    return pa.concat_arrays([_slice_elements(pages.slice(i, SLICE)) for i in range(0, max(len(pages), 1), SLICE)])


def _slice_elements(pages: pa.Array) -> pa.Array:
    offsets, columns = [0], [[] for _ in range(6)]
    for html in pages:
        rows = page_elements(html.as_py() or "")
        offsets.append(offsets[-1] + len(rows))
        for row in rows:
            for column, value in zip(columns, row, strict=True):
                column.append(value)
    kinds = [pa.string(), *[pa.int32()] * 4, pa.string()]
    parts = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["tag", "depth", "start", "first", "last", "attributes"]))


def elements(html: Column) -> Column:
    """The elements of a page in document order, as array of ELEMENT; null and empty pages have none.

    Called nondeterministic so that the optimizer doesn't copy it into filters: each copy would be
    another Python worker in every task, and another pass over the pages.
    """
    return F.arrow_udf(_elements, f"array<{ELEMENT}>").asNondeterministic()(html)


@dataclass(frozen=True)
class Find:
    """Which elements: by tag, a class among theirs, an attribute that is or has a text, an id, the
    text within, inside which other elements (with ``of_first``, only the first of those)."""

    tag: str | None = None
    css: str | None = None
    css_part: str | None = None
    attribute: tuple[str, str] | None = None
    attribute_part: tuple[str, str] | None = None
    element_id: str | None = None
    says: str | None = None
    inside: Find | None = None
    of_first: bool = False


def attribute_of(element: Column, name: str) -> Column:
    """The value of an attribute; empty for one without a value, null where the element lacks it."""
    written = F.concat(F.lit(" "), element["attributes"])
    found = F.regexp_extract(written, rf"""(?is)^(?:"[^"]*"|'[^']*'|[^"'])*?\s{re.escape(name)}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    bare = F.when(found.rlike("^[\"']"), F.substring(found, 2, F.length(found) - 2)).otherwise(found)
    return F.when(found != "", bare).when(written.rlike(rf"(?is)\s{re.escape(name)}(?:\s|$)"), F.lit(""))


def inner(html: Column, element: Column) -> Column:
    """The markup within an element; null for no element."""
    return F.substr(html, element["first"], element["last"] - element["first"] + 1)


def text_of(html: Column, element: Column) -> Column:
    """The text within an element, line by line; null for no element."""
    return F.when(element.isNotNull(), html_to_text(inner(html, element)))


def _fits(html: Column, e: Column, find: Find) -> Column:
    out = F.lit(True)
    if find.tag:
        out = out & (e["tag"] == find.tag)
    if find.css:
        out = out & F.coalesce(F.array_contains(F.split(attribute_of(e, "class"), r"\s+"), find.css), F.lit(False))
    parts = [("class", find.css_part)] if find.css_part else []
    for name, part in [*parts, *([find.attribute_part] if find.attribute_part else [])]:
        out = out & F.coalesce(F.contains(attribute_of(e, name), F.lit(part)), F.lit(False))
    exact = [("id", find.element_id)] if find.element_id else []
    for name, value in [*exact, *([find.attribute] if find.attribute else [])]:
        out = out & F.coalesce(attribute_of(e, name) == value, F.lit(False))
    if find.says:
        out = out & F.contains(html_to_text(inner(html, e)), F.lit(find.says))
    return out


def find_all(html: Column, tree: Column, find: Find) -> Column:
    """All elements of ``tree`` that fit, in document order."""
    fitting = F.filter(tree, lambda e: _fits(html, e, find))
    if not find.inside:
        return fitting
    around = find_all(html, tree, find.inside)
    around = F.slice(around, 1, 1) if find.of_first else around
    held = lambda outer: F.filter(fitting, lambda e: F.exists(outer, lambda o: (o["start"] < e["start"]) & (e["start"] <= o["last"])))
    return F.transform(F.array(around), held)[0]


def find_first(html: Column, tree: Column, *finds: Find) -> Column:
    """The first element of the first selector that any element fits; null if none does."""
    return F.coalesce(*[F.get(find_all(html, tree, f), 0) for f in finds])


def leaf_texts(html: Column, tree: Column) -> Column:
    """(depth, text) of elements that hold no other element and are not empty, in document order."""
    ends = lambda e, i: F.coalesce(F.get(tree, i + 1)["start"] > e["last"], F.lit(True))
    leaves = F.filter(tree, ends)
    texts = F.transform(leaves, lambda e: F.struct(e["tag"].alias("tag"), e["depth"].alias("depth"), html_to_text(inner(html, e)).alias("text")))
    return F.filter(texts, lambda x: x["text"] != "")
