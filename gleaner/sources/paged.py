"""Listings behind an interface of pages, and details behind one of ids, as data sources.

``spark.read.format("listing_pages")`` and ``spark.readStream.format("listing_pages")`` read a listing
up to its first empty page; ``spark.read.format("listing_details")`` searches first and then fetches
details a chunk of ids at a time. How a page or a chunk is got is a function named in an option.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

#: Ids that one request for details names.
CHUNK = 20
#: Pages that one task reads, unless the option ``pages`` says otherwise, and pages or ids in a folder of a saved listing.
PAGES, FOLDER = 1, 256


def _runs(n: int, size: int) -> list[range]:
    return [range(i, min(i + size, n)) for i in range(0, n, size)]


def _function(name: str, root: str | None) -> Callable:
    module, _, attribute = name.rpartition(".")
    f = getattr(importlib.import_module(module), attribute)
    return (lambda x: f(x, root)) if root else f


def first_empty(page: Callable[[int], Iterable], known: int = 0) -> int:
    """The number of the first empty page from ``known`` on, by about 2 log2(n) requests: doubled steps, then halves."""
    full = lambda n: next(iter(page(n)), None) is not None
    if not full(known):
        return known
    low, step = known, 1  # page low has rows
    while full(low + step):
        low, step = low + step, 2 * step
    high = low + step
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if full(middle) else (low, middle)
    return high


class Pages(DataSource):
    """Pages of a listing, up to the first empty one.

    Options: ``fetch``, the dotted name of a function from a page number (and ``root``, if that is
    given) to rows (url, payload); ``pages``, how many consecutive ones make a partition. Only the end is looked for on the driver, by probing pages; each
    page is read by the task that has it. As a stream, the offset is the number of pages read: a
    batch ends before the page that is empty then, and pages that are added later come with later
    batches.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_pages"

    def schema(self) -> str:
        return "page int, seq int, url string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return PagesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PagesStream(self.options)


class _OnePage:
    def __init__(self, options):
        self.fetch, self.root, self.pages = options["fetch"], options.get("root"), int(options.get("pages", PAGES))

    def rows(self, pages: Iterable[int]):
        fetch = _function(self.fetch, self.root)
        for page in pages:
            for i, (url, payload) in enumerate(fetch(page)):
                yield page, i, url, payload

    def end(self, known: int = 0) -> int:
        return first_empty(_function(self.fetch, self.root), known)


class PagesReader(_OnePage, DataSourceReader):
    def partitions(self):
        return [InputPartition(x) for x in _runs(self.end(), self.pages)]

    def read(self, partition):
        return self.rows(partition.value) if partition.value is not None else iter(())


class PagesStream(_OnePage, DataSourceStreamReader):
    def __init__(self, options):
        super().__init__(options)
        self.known = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.known = self.end(self.known)
        return {"page": self.known}

    def partitions(self, start: dict, end: dict):
        # a run ends at a multiple of its size, so that no folder of pages is read by two tasks
        cuts = [start["page"], *range(start["page"] // self.pages * self.pages + self.pages, end["page"], self.pages), end["page"]]
        return [InputPartition(range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition):
        return self.rows(partition.value)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Chunk(InputPartition):
    """Pages of the search, or ids."""

    pages: Iterable[int] = ()
    ids: tuple[str, ...] = ()


class Details(DataSource):
    """(id, payload) of what a search finds.

    Options: ``search``, the dotted name of a function from a page number to rows (id, anything), and
    ``detail``, one from a list of at most ``chunk`` ids to rows (id, payload); both get ``root`` too,
    if it is given. A partition is a page of the search (or as many as the option ``pages`` says): its
    task fetches the details of the ids that it finds. Where the query names ids (=, IN), partitions are chunks of those and nothing is
    searched; this needs spark.sql.python.filterPushdown.enabled. Spark plans a loaded source once, so
    load it anew for a query that names other ids.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_details"

    def schema(self) -> str:
        return "id string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return DetailsReader(self.options)


class DetailsReader(DataSourceReader):
    def __init__(self, options):
        self.search, self.detail, self.root = options["search"], options["detail"], options.get("root")
        self.chunk, self.pages = int(options.get("chunk", CHUNK)), int(options.get("pages", PAGES))
        self.ids: list[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("id",):
                named = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.ids = [x for x in dict.fromkeys(named) if x is not None and (self.ids is None or x in self.ids)]
            else:
                yield f

    def partitions(self):
        if self.ids is not None:
            return [Chunk((), tuple(self.ids[i : i + self.chunk])) for i in range(0, len(self.ids), self.chunk)] or [Chunk()]
        return [Chunk(x) for x in _runs(first_empty(_function(self.search, self.root)), self.pages)] or [Chunk()]

    def read(self, partition):
        search, detail = _function(self.search, self.root), _function(self.detail, self.root)
        lists = [partition.ids] if partition.ids else (list(dict.fromkeys(row[0] for row in search(page))) for page in partition.pages)
        for ids in lists:
            for i in range(0, len(ids), self.chunk):
                yield from detail(list(ids[i : i + self.chunk]))


def _lines(folder: str) -> Iterable[str]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type != fs.FileType.Directory:
        return
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.base_name.startswith("part-"):
            with system.open_input_stream(info.path) as f:
                yield from f.read().decode().splitlines()


def saved_page(page: int, root: str) -> list[tuple[str, str]]:
    """A page of a listing that was saved as JSON lines (url, payload) under ``root``/page=N; empty beyond the last."""
    return [(row["url"], row.get("payload")) for row in map(json.loads, _lines(f"{root}/page={page}"))]


#: What the last folder of a kind that was read held, by page or id; a worker reads a run of pages folder by folder.
_LAST: dict[str, tuple[tuple, dict]] = {}


def _folder(folder: str, kind: str, key: str) -> dict:
    """The rows of a folder's JSON lines by their column ``key``; read anew if its files are others than the last time."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(path).type == fs.FileType.Directory
    state = (folder, *sorted((i.path, i.size, i.mtime_ns) for i in system.get_file_info(fs.FileSelector(path)) if i.base_name.startswith("part-"))) if found else (folder,)
    if kind not in _LAST or _LAST[kind][0] != state:
        rows: dict = {}
        for row in map(json.loads, _lines(folder)):
            rows.setdefault(row[key], []).append(row)
        _LAST[kind] = state, rows
    return _LAST[kind][1]


def foldered_page(page: int, root: str) -> list[tuple[str, str]]:
    """A page of a listing saved as JSON lines (page, url, payload), FOLDER pages to a folder ``root``/pages=N."""
    return [(row["url"], row.get("payload")) for row in _folder(f"{root}/pages={page // FOLDER}", "pages", "page").get(page, [])]


def foldered_details(ids: list[str], root: str) -> list[tuple[str, str]]:
    """Details saved as JSON lines (id, payload), those of 100 * FOLDER consecutive ids in a folder ``root``/ids=N."""
    held = lambda x: _folder(f"{root}/ids={int(x) // (100 * FOLDER)}", "ids", "id").get(x, [])
    return [(row["id"], row["payload"]) for x in sorted(set(ids), key=int) for row in held(x)]


def saved_details(ids: list[str], root: str) -> list[tuple[str, str]]:
    """Details saved as JSON lines (id, payload) under ``root``/bucket=B, B the last two digits of the id."""
    out, wanted = [], set(ids)
    for bucket in sorted({int(x) % 100 for x in ids}):
        out += [(row["id"], row["payload"]) for row in map(json.loads, _lines(f"{root}/bucket={bucket}")) if row["id"] in wanted]
    return out
