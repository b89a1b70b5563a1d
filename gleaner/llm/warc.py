"""Legacy ARC archives converted to WARC, with revisit records for repeated payloads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import discard, fresh_path, marked, materialize, python_batches, slot, slot_map

#: Uncompressed bytes in an archive file, after which the next record starts a new one.
ARCHIVE_BYTES = 16 << 20
#: The date of pages that come without one.
NO_DATE = "20000101000000"
#: Field names of the two versions of ARC, fixed by the format.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_FIELD = "X-Page-Id"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    content: bytes


def arc_record(version: int, fields: dict[str, str], content: bytes) -> bytes:
    values = fields | {"length": str(len(content))}
    return " ".join((values.get(k) or "-").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D") for k in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n" + content + b"\n"


def arc_head(version: int, name: str, date: str = NO_DATE) -> bytes:
    """The version block that opens an ARC file."""
    title = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    return arc_record(version, {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": date, "type": "text/plain", "result": "200", "filename": name}, f"{version} 0 gleaner\n{title}\n".encode())


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, the version block first.

    The block's second line says which fields a header line has; lengths are taken as declared.
    A header that doesn't fit or a length beyond the end raises ValueError.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogatepass").rstrip("\r").split(" ")
        if version is None:
            body = data[end + 1 : end + 256].split(b"\n")
            version = int(body[0].split(b" ")[0])
            if version not in ARC_FIELDS or not parts[0].startswith("filedesc://"):
                raise ValueError("no ARC version block")
        names = ARC_FIELDS[version]
        if end < 0 or len(parts) != len(names):
            raise ValueError(f"header line at byte {at} has {len(parts)} fields, version {version} has {len(names)}")
        values = dict(zip(names, parts, strict=True))
        size = int(values["length"])
        if size < 0 or end + 1 + size > len(data):
            raise ValueError(f"record at byte {at} is cut off")
        yield ArcRecord(version, values, data[end + 1 : end + 1 + size])
        at = end + 1 + size


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = b""
    payload_at: int = 0
    digest: str = ""
    http: dict[str, str] = field(default_factory=dict)

    @property
    def payload(self) -> bytes:
        return self.block[self.payload_at :]

    def dump(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.headers | {"Content-Length": str(len(self.block))}).items())
        return b"WARC/1.1\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + self.block + b"\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http_head(block: bytes) -> tuple[int, dict[str, str]]:
    end = block.find(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or end < 0:
        return 0, {}
    lines = block[:end].decode("latin-1").split("\r\n")[1:]
    return end + 4, {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def arc_to_warc(record: ArcRecord) -> WarcRecord:
    """The WARC record that an ARC record amounts to.

    Version blocks become warcinfo, HTTP messages response, all else resource. The date is
    written as ISO 8601; the identifier is a UUID derived from address, date and content, so a
    second conversion gives the same; block and payload digests are SHA-1 in base32.
    """
    f, block = record.fields, record.content
    at, http = _http_head(block)
    info = f["url"].startswith("filedesc://")
    kind = "warcinfo" if info else "response" if at else "resource"
    stamp = (f["date"] if f["date"].isdigit() else NO_DATE).ljust(14, "0")[:14]
    iso = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    own, digest = base32_sha1(block), base32_sha1(block[at:])
    name = hashlib.sha1("\0".join((f["url"], stamp, own)).encode("utf-8", "surrogatepass")).digest()[:16]
    headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>", "WARC-Date": iso}
    headers |= {"WARC-Filename": f["url"].removeprefix("filedesc://")} if info else {"WARC-Target-URI": f["url"]}
    if f["ip"] not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = f["ip"]
    headers |= {"WARC-Block-Digest": f"sha1:{own}", "WARC-Payload-Digest": f"sha1:{digest}"}
    headers["Content-Type"] = "application/http; msgtype=response" if at else "application/warc-fields" if info else f["type"]
    return WarcRecord(headers, block, at, digest, http)


def as_revisit(record: WarcRecord, refers_to: str, uri: str, date: str) -> WarcRecord:
    """The record without its payload, pointing at the one that has it."""
    head = record.block[: record.payload_at]
    headers = record.headers | {"WARC-Type": "revisit", "WARC-Profile": PROFILE, "WARC-Refers-To": refers_to, "WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date, "WARC-Block-Digest": f"sha1:{base32_sha1(head)}"}
    return WarcRecord(headers, head, len(head), record.digest, record.http)


def _members(data: bytes) -> Iterator[bytes]:
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            piece = data[at : at + 16384]
            if not piece:
                raise ValueError("gzip member is cut off")
            parts.append(member.decompress(piece))
            at += len(piece)
        at -= len(member.unused_data)
        yield b"".join(parts)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """The records of a WARC file, plain or with gzip members."""
    for plain in _members(data):
        at = 0
        while at < len(plain):
            end = plain.index(b"\r\n\r\n", at)
            lines = plain[at:end].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = int(headers["Content-Length"])
            block = plain[end + 4 : end + 4 + size]
            if plain[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
                raise ValueError(f"record at byte {at} doesn't end where it says")
            start, http = _http_head(block)
            yield WarcRecord(headers, block, start, headers.get("WARC-Payload-Digest", "").removeprefix("sha1:"), http)
            at = end + 8 + size


def page_arc(page_id, url, html, version: int) -> bytes:
    """A page as an ARC record; its id is a field of the HTTP head."""
    body = (html or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{PAGE_FIELD}: {'' if page_id is None else page_id}\r\n\r\n"
    return arc_record(version, {"url": url or "about:blank", "ip": "0.0.0.0", "date": NO_DATE, "type": "text/html", "result": "200", "checksum": "-", "location": "-", "offset": "0", "filename": "pages.arc"}, head.encode() + body)


def _converted(batch) -> Iterator[tuple[int, WarcRecord]]:
    """(row, record) of a batch of (row, page_id, url, html) laid out as ARC files of both versions, and converted."""
    for start in range(0, batch.num_rows, 64):
        part = batch.slice(start, 64)
        numbers, *columns = (part.column(i).to_pylist() for i in range(4))
        version = 1 + start // 64 % 2
        arc = arc_head(version, "pages.arc") + b"".join(page_arc(*row, version) for row in zip(*columns, strict=True))
        made = (arc_to_warc(record) for record in read_arc(arc))
        yield from zip(numbers, (r for r in made if r.headers["WARC-Type"] != "warcinfo"), strict=True)


def _page_id(record: WarcRecord):
    return int(record.http[PAGE_FIELD]) if record.http.get(PAGE_FIELD) else None


def _with_heads(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, html) with digest, size, record_id, uri and date of the record."""

    def run(batches):
        for batch in batches:
            got = [r for _, r in _converted(batch)]
            cols = [[r.digest for r in got], [len(r.payload) for r in got]] + [[r.headers[k] for r in got] for k in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date")]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*batch.schema.names, "digest", "size", "record_id", "uri", "date"])

    return pages.mapInArrow(run, "row long, page_id long, url string, html string, digest string, size long, record_id string, uri string, date string")


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """A WARC record per row of pages (page_id, url, html), in files of gzip members.

    Of records with equal payloads of at least ``min_payload`` bytes one is a response: that
    with the smallest page_id, null last, and of several the first row. Payloads are compared by
    SHA-1 and length; only those, ids and addresses are grouped, and a page meets its group's
    first by a number of its own. A file is one value of Spark's text writer, whose closing line
    is an empty gzip member.
    """
    python_batches(pages.sparkSession)
    pages = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages = materialize(_with_heads(pages), "warc-pages")  # so that numbers stay as they are
    heads = pages.select("row", "page_id", "digest", "size", "record_id", "uri", "date")
    first = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row", "record_id", "uri", "date")
    groups = heads.filter(F.col("size") >= min_payload).groupBy(F.col("digest").alias("_d"), F.col("size").alias("_s")).agg(F.min(first).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = heads.join(groups, (heads["digest"] == F.col("_d")) & (heads["size"] == F.col("_s"))).filter(F.col("row") != F.col("first.row"))
    refs = materialize(again.select("row", F.struct("first.record_id", "first.uri", "first.date").alias("ref")), "warc-refs")
    shared = pages.sparkSession.sparkContext.broadcast(slot_map(refs, "row"))  # only pages that may have a ref are shuffled

    def sort_out(may: bool):
        def run(batches):
            for batch in batches:
                yield batch.select(range(4)).filter(pa.array(marked(shared.value, batch.column(4).to_numpy()) == may))

        rows = pages.select("row", "page_id", "url", "html", slot("row").alias("slot"))
        return rows.mapInArrow(run, "row long, page_id long, url string, html string")

    def archive(batches):
        held, size, seq = [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["blob"])

        for batch in batches:
            for (_, record), ref in zip(_converted(batch), batch.column(4), strict=True):
                if ref := ref.as_py():
                    record = as_revisit(record, ref["record_id"], ref["uri"], ref["date"])
                if not held:
                    held.append(gzip.compress(arc_to_warc(next(read_arc(arc_head(1, f"pages-{seq}.warc")))).dump(), 1, mtime=0))
                data = record.dump()
                held.append(gzip.compress(data, 2, mtime=0))
                size += len(data)
                if size >= archive_bytes:
                    yield flush()
                    held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    alone = sort_out(False).withColumn("ref", F.lit(None).cast(refs.schema["ref"].dataType))
    rows = alone.unionAll(sort_out(True).join(refs, "row", "left").select("row", "page_id", "url", "html", "ref"))
    files = rows.mapInArrow(archive, "blob binary").select(F.col("blob").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).text(path)
    for done in (pages, refs):
        discard(done)


def read_archives(spark, path: str) -> DataFrame:
    """A row a response or revisit record: record_id, page_id, payload_bytes, payload_digest, record_type, refers.

    The payload of a response is hashed again and must have the digest it is filed under.
    """

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                got = [r for r in read_warc(blob.as_py()) if r.headers["WARC-Type"] in ("response", "revisit")]
                for r in got:
                    if r.headers["WARC-Type"] == "response" and base32_sha1(r.payload) != r.digest:
                        raise ValueError(f"payload of {r.headers['WARC-Record-ID']} isn't what was written")
                cols = [[r.headers["WARC-Record-ID"] for r in got], [_page_id(r) for r in got], [int(r.http["Content-Length"]) for r in got], [r.digest for r in got], [r.headers["WARC-Type"] for r in got], [r.headers.get("WARC-Refers-To") for r in got]]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["record_id", "page_id", "payload_bytes", "payload_digest", "record_type", "refers"])

    python_batches(spark)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    out = materialize(raw.mapInArrow(run, "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string"), "warc-rows")
    python_batches(spark)
    return out


def archive_report(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """Write ``pages`` as WARC archives in the shared folder and describe them as read back.

    Null html is an empty payload and null url about:blank. Rows that repeat a page_id, or have
    none, are records of their own; one of a group of equal payloads is the response. A revisit
    of a response without a page_id refers to null. An empty table gives no archive and no rows.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, min_payload)
    rows = read_archives(spark, path)
    named = rows.filter("record_type = 'response'").select(F.col("record_id").alias("_r"), F.col("page_id").alias("refers_to")).distinct()
    out = rows.join(named, F.col("refers") == F.col("_r"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
