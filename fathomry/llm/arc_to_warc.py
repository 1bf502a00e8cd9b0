"""Legacy archives to WARC: ARC files of versions 1 and 2 are parsed and written anew as WARC records.

An ARC file begins with a version block: a ``filedesc:`` line, a line with the version, and a line that names
the fields of every following header line (five in version 1, ten in version 2), of which the last is the
document's length. A header is split from the right by those names, as URLs may hold blanks. A
record's WARC identifier is a name-based UUID of file, place and header line, its date the 14 digits as a
timestamp, its type by the document (HTTP: response, else resource; ``filedesc:``: warcinfo), its digests SHA-256.
Of equal payloads the first becomes a response, later ones are revisits that refer to it and keep their HTTP head alone.

Spark reads files as binary rows and writes them as text rows of bytes: a row is a volume of gzip members, one a
record, of about ``volume_bytes``; a task holds one volume. A gzip member ends with a zero byte while its record has less than
16 MB (after longer ones an empty member follows), so that byte is the row separator and files come out exact.
Payloads are never shuffled: duplicates are found by digests, and only lists of revisits by file go to the join with the volumes.

Defined results: a null html is an empty payload; a null url is ``unknown:``; bytes up to 0x20 and 0x7F in
URLs are percent-encoded; a header line that doesn't parse is passed over; a document that is cut
short is kept as it is (``WARC-Truncated: length``); dates are filled up with the least digits, or else taken from the
version block, or 1970. Among equal payloads rows without a page_id come last and equal page_ids go by record identifier.
An empty table gives no records; other columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, stored

FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = b"X-Page-Id"


@dataclass(frozen=True)
class Options:
    least: int = 100  # bytes of a payload that can be revisited
    volume_bytes: int = 4 << 20
    date: str = "20000101000000"  # of archives that are written here
    listed_bytes: int = 8 << 20  # of revisits that are broadcast


# ---- bytes


def member(record: bytes) -> bytes:
    """A gzip member (two where the record is long) that ends with a zero byte."""
    z = zlib.compressobj(2, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + member(b"")


class Reader:
    """Bytes of a file, inflated piece by piece where it is gzipped; a broken member ends it.

    Pieces are short: what follows a member in its piece is copied by the decompressor.
    """

    def __init__(self, content: bytes, piece: int = 1 << 14):
        self.content, self.piece, self.next, self.buf, self.at = memoryview(content), piece, 0, bytearray(), 0
        self.z = zlib.decompressobj(31) if content[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while self.next < len(self.content):
            got = self.content[self.next : self.next + self.piece]
            self.next += len(got)
            if self.z:
                try:
                    got = self.z.decompress(got, 64 * self.piece)
                except zlib.error:
                    self.next = len(self.content)
                    return False
                self.next -= len(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
                if self.z.eof:
                    self.z = zlib.decompressobj(31)
            if len(got):
                self.buf += got
                return True
        return False

    def read(self, n: int) -> bytes:
        while len(self.buf) < n and self._more():
            pass
        out = bytes(self.buf[:n])
        del self.buf[:n]
        self.at += len(out)
        return out

    def line(self) -> bytes:
        """Up to and with the next line end; empty at the end of the file."""
        seen = 0
        while (i := self.buf.find(b"\n", seen)) < 0:
            seen = len(self.buf)
            if not self._more():
                return self.read(len(self.buf))
        return self.read(i + 1)


def head_and_body(doc: bytes) -> tuple[bytes, bytes]:
    """An HTTP message in two; a message without an empty line is all head."""
    ends = [(i, i + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := doc.find(e)) >= 0]
    cut = min(ends)[1] if ends else len(doc)
    return doc[:cut], doc[cut:]


def field(head: bytes, name: bytes) -> str | None:
    """The value of a header field, None where there is none."""
    for x in head.split(b"\n")[1:]:
        key, colon, value = x.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip().decode("utf-8", "replace")
    return None


def moment(digits: str, other: str = "") -> str:
    """An ARC date as a WARC date."""
    for d in (digits, other, "19700101000000"):
        if d.isdigit() and 4 <= len(d) <= 14:
            try:
                return datetime.strptime(d + "00000101000000"[len(d) :], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
            except ValueError:
                continue
    return "1970-01-01T00:00:00Z"


# ---- ARC


def arc_head(version: int, url: str, date: str, kind: str, offset: int, name: str, length: int) -> bytes:
    middle = f"200 - - {offset} {name} " if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {kind} {middle}{length}\n".encode()


def arc_first(version: int, date: str, name: str) -> bytes:
    """The version block."""
    body = f"{version} 0 fathomry\n{FIELDS[version]}\n\n".encode()
    return arc_head(version, f"filedesc://{name}", date, "text/plain", 0, name, len(body)) + body


def arc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, bytes, bool]]:
    """(offset, fields, header line, document, whole) of each record of an ARC file, its version block included."""
    r = Reader(content)
    names = FIELDS[1].lower().split()
    while line := r.line():
        at = r.at - len(line)
        if first := line.startswith(b"filedesc:"):
            length = line.split()[-1]
            values = line.decode("utf-8", "replace").split()[:3]
        else:
            values = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
            length = values[-1].encode()
        if not length.isdigit() or len(values) < (3 if first else len(names)) or not values[2].isdigit():
            continue
        doc = r.read(int(length))
        if first:
            told = doc.decode("utf-8", "replace").split("\n")
            given = told[1].lower().split() if len(told) > 1 else []
            names = given if given[-1:] == ["archive-length"] else FIELDS[2 if told[0].startswith("2") else 1].lower().split()
        yield at, dict(zip(FIELDS[1].lower().split() if first else names, values, strict=False)), line, doc, len(doc) == int(length)


# ---- WARC


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of a WARC file."""
    r = Reader(content)
    while line := r.line():
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := r.line()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        length = headers.get("content-length", "")
        yield headers, r.read(int(length) if length.isdigit() else 0)


@dataclass(slots=True)
class Record:
    """An ARC record as what becomes of it."""

    id: str
    kind: str
    uri: str
    date: str
    ip: str
    content_type: str
    head: bytes
    payload: bytes
    whole: bool

    @classmethod
    def of(cls, file: str, offset: int, f: dict[str, str], line: bytes, doc: bytes, whole: bool, date: str) -> Record:
        rid = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset} ' + line.decode('utf-8', 'replace'))}>"
        kind, mime, head, payload = "resource", f.get("content-type", ""), b"", doc
        if f["url"].startswith("filedesc:"):
            kind, mime = "warcinfo", "application/warc-fields"
            told = doc.decode("utf-8", "replace").split("\n")[0].split(" ")
            payload = "".join(f"{k}: {v}\r\n" for k, v in (("software", "fathomry"), ("format", "WARC File Format 1.0"), ("arc-version", told[0]), ("arc-origin", told[-1]))).encode()
        elif doc.startswith(b"HTTP/"):
            kind, mime = "response", "application/http; msgtype=response"
            head, payload = head_and_body(doc)
        elif "/" not in mime:
            mime = "application/octet-stream"
        return cls(rid, kind, f["url"].strip(), moment(f["archive-date"], date), f["ip-address"], mime, head, payload, whole)

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.payload).hexdigest()

    def warc(self, info: str, refers_to: str | None = None) -> bytes:
        kind = "revisit" if refers_to else self.kind
        block = self.head if refers_to else self.head + self.payload
        h = [("WARC-Type", kind), ("WARC-Record-ID", self.id), ("WARC-Date", self.date)]
        if kind != "warcinfo":
            h += [("WARC-Target-URI", self.uri), ("WARC-Payload-Digest", f"sha256:{self.digest}")]
            h += [("WARC-Warcinfo-ID", info)] if info else []
            h += [("WARC-IP-Address", self.ip)] if self.ip not in ("0.0.0.0", "-", "") else []
        h += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers_to)] if refers_to else []
        h += [("WARC-Truncated", "length")] if not self.whole else []
        return warc_record([*h, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", self.content_type)], block)


def parsed(file: str, content: bytes) -> Iterator[tuple[int, Record, str]]:
    """(offset, record, identifier of its file's first record) of an ARC file."""
    date = info = ""
    for at, f, line, doc, whole in arc_records(content):
        r = Record.of(file, at, f, line, doc, whole, date)
        if r.kind == "warcinfo":
            date, info = f["archive-date"], r.id
        yield at, r, info


# ---- Spark


def _named(path: str) -> str:
    return path.rpartition("/")[2]


def write_volumes(volumes: DataFrame, path: str) -> str:
    """A file for each row (value: bytes that end with a zero byte) below path."""
    rows = volumes.select(F.expr("substring(value, 1, length(value) - 1)").cast("string").alias("value"))
    rows.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)
    return path


def read_volumes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below path, of at most 2 GB each."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _row(value: bytes | bytearray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bytes(value)], pa.binary())], names=["value"])


def arc_volumes(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """Pages (page_id, url, html) as ARC files (value), of versions 1 and 2 in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, at, held, name = TaskContext.get().partitionId(), 0, 0, bytearray(), ""
        for b in batches:
            for i in range(b.num_rows):  # one page at a time
                page, url, html = (b.column(c)[i] for c in range(3))
                body = html.as_buffer().to_pybytes() if html.is_valid else b""
                known = b"%s: %d\r\n" % (PAGE, page.as_py()) if page.is_valid else b""
                doc = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(body), known) + body
                where = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url.as_py() or "") or "unknown:"
                version = 1 + (part + n) % 2
                if not held:
                    name = f"pages-{part}-{n}.arc.gz"
                    first = arc_first(version, o.date, name)
                    at = len(first)
                    held += member(first)
                record = arc_head(version, where, o.date, "text/html", at, name, len(doc)) + doc + b"\n"
                at += len(record)
                held += member(record)
                if len(held) >= o.volume_bytes:
                    yield _row(held)
                    held, n = bytearray(), n + 1
        if held:
            yield _row(held)

    small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary")


def index(arcs: DataFrame) -> DataFrame:
    """Of ARC files (path, content) each document's place, identifier, digest and length, and the page_id of its HTTP head: no payloads; stored."""
    schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("id", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("page_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path = b.column(0)[i].as_py()
                rows = [(path, at, r.id, r.digest, len(r.payload), _page(r.head)) for at, r, _ in parsed(_named(path), b.column(1)[i].as_buffer().to_pybytes()) if r.kind != "warcinfo"]
                for k in range(0, len(rows), 5000):
                    part = zip(*rows[k : k + 5000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(part, schema, strict=True)], schema=schema)

    small_batches(arcs.sparkSession)
    return stored(arcs.mapInArrow(run, "path string, at long, id string, digest string, bytes long, page_id long"), "arc-index")


def _page(head: bytes) -> int | None:
    v = field(head, PAGE)
    return int(v) if v and v.lstrip("-").isdigit() else None


def revisits(places: DataFrame, o: Options = Options()) -> DataFrame:
    """(path, at, refers_to) of ``index``'s documents that repeat an earlier one's payload of at least ``least`` bytes."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "id", "path", "at"))
    firsts = places.where(F.col("bytes") >= o.least).groupBy("digest", "bytes").agg(first.alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", "bytes", F.col("f.id").alias("refers_to"), F.col("f.path").alias("f_path"), F.col("f.at").alias("f_at"))
    # many to one: AQE splits the documents of a digest that very many have
    return places.join(firsts, ["digest", "bytes"]).where("path <> f_path OR at <> f_at").select("path", "at", "refers_to")


def warc_volumes(arcs: DataFrame, repeats: DataFrame, o: Options = Options()) -> DataFrame:
    """ARC files (path, content) as WARC files (value), those of ``repeats`` as revisits."""
    spark = arcs.sparkSession
    small_batches(spark)
    # no more rows for a file than it has records
    listed = stored(repeats.groupBy("path").agg(F.collect_list(F.struct("at", "refers_to")).alias("repeats"), F.sum(F.length("refers_to") + 16).alias("bytes")), "revisits")
    size = listed.agg(F.sum("bytes")).first()[0] or 0
    listed = listed.drop("bytes")
    joined = arcs.join(F.broadcast(listed) if size <= o.listed_bytes else listed, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bytearray()
        for b in batches:
            for i in range(b.num_rows):
                refers = {x["at"]: x["refers_to"] for x in b.column(2)[i].as_py() or []}
                for at, r, info in parsed(_named(b.column(0)[i].as_py()), b.column(1)[i].as_buffer().to_pybytes()):
                    held += member(r.warc(info, refers.get(at)))
                    if len(held) >= o.volume_bytes:
                        yield _row(held)
                        held = bytearray()
        if held:
            yield _row(held)

    return joined.select("path", "content", "repeats").mapInArrow(run, "value binary")


def convert(spark: SparkSession, arcs: str, warcs: str, o: Options = Options()) -> str:
    """The ARC files below `arcs` as WARC files below `warcs`."""
    volumes = read_volumes(spark, arcs)
    return write_volumes(warc_volumes(volumes, revisits(index(volumes), o), o), warcs)


def records(warcs: DataFrame, with_payload: bool = False) -> DataFrame:
    """Of WARC files (path, content): id, type, uri, date, refers_to_id, page_id, bytes and digest of the payload that is there, declared digest; the payload on demand."""
    names = {"id": pa.string(), "type": pa.string(), "uri": pa.string(), "date": pa.string(), "refers_to_id": pa.string(), "page_id": pa.int64(), "bytes": pa.int64(), "digest": pa.string(), "declared": pa.string()}
    schema = pa.schema([*names.items(), *([("payload", pa.binary())] if with_payload else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows: list[tuple] = []
                size = 0
                for h, block in warc_records(b.column(1)[i].as_buffer().to_pybytes()):
                    head, payload = head_and_body(block) if h.get("content-type", "").startswith("application/http") else (b"", block)
                    declared = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                    row = (h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), _page(head), len(payload), hashlib.sha256(payload).hexdigest(), declared)
                    rows.append((*row, payload) if with_payload else row)
                    size += 400 + len(payload) * with_payload
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    small_batches(warcs.sparkSession)
    kinds = "id string, type string, uri string, date string, refers_to_id string, page_id long, bytes long, digest string, declared string" + ", payload binary" * with_payload
    return warcs.mapInArrow(run, kinds)


def resolved(read: DataFrame) -> DataFrame:
    """A row per page of ``records``: page_id, payload_bytes, payload_digest, record_type, refers_to; a revisit has the payload of the record it names."""
    read = stored(read.select("id", "type", "refers_to_id", "page_id", "bytes", "digest"), "warc-records")
    whole = read.where("type = 'response'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    targets = read.where("type = 'response'").select(F.col("id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"))
    again = read.where("type = 'revisit'").select("refers_to_id", "page_id", F.col("type").alias("record_type")).join(targets, "refers_to_id", "left")
    return whole.unionByName(again.select(whole.columns))


def archived(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """Pages written as ARC files, converted, and read back from the WARC files: ``resolved``'s columns."""
    spark = pages.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/fathomry/archives-{uuid.uuid4().hex}"
    write_volumes(arc_volumes(pages, o), f"{where}/arc")
    convert(spark, f"{where}/arc", f"{where}/warc", o)
    return resolved(records(read_volumes(spark, f"{where}/warc")))


_D = Options()
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') html FROM pages),
b AS (SELECT page_id, html, octet_length(encode(html)) payload_bytes, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) k, first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) f FROM p)
SELECT page_id, payload_bytes, sha256(html) payload_digest, CASE WHEN payload_bytes >= {_D.least} AND k > 1 THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN payload_bytes >= {_D.least} AND k > 1 THEN f END refers_to FROM b
"""
