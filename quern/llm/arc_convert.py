"""Legacy ARC archives to WARC.

An ARC file is a series of records: one header line, the declared number of bytes, a line feed. A version
block (url ``filedesc:``) says which fields the header lines that follow have: version 1 has url, IP, date,
type and length; version 2 adds result code, checksum, location, offset and file name. The converter
follows the declared lengths, so payloads may hold anything, and a new version block inside a file (archives
are often concatenated) switches the fields from there.

Each network record becomes a WARC record with a synthesised identifier (a name-based UUID over the archive file, the
record's place in it, url, date and digest, so equal records have their own), an ISO timestamp, a type, the address
and content type of its header line and SHA-1 digests of block and payload. Version blocks become `warcinfo` records.
Records with equal payloads of
at least `least` bytes keep one response, that with the smallest page id; the others become revisits without
a payload, which refer to it and keep the HTTP head.

In files of both formats each record is a gzip member of its own, so a reader can start at any record. A file is one
row of the text sink, cut when its members reach FILE_BYTES (or hold one longer record); the sink's line end is a
zero byte, which gzip takes as padding. Files are read with the binary file source, member by member. Blocks cross
the one shuffle, the join with the digests, deflated.

Defined results: a null payload is empty; a null or unfit url is written as ``urn:none`` or percent-escaped.
Rows that repeat a page id are records of their own; if they are the smallest of their payload, all of them
are responses. A null page id is never the smallest. An empty table gives empty archives. Extra columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.scratch import Scratch

ARC_V1 = ("url", "ip", "date", "type", "length")
ARC_V2 = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")
FIELD_LINES = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Bytes of a file after compression, and of blocks that a task hands on at a time.
FILE_BYTES, SEGMENT = 32 << 20, 4 << 20
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


# ---- ARC


def version_block(version: int = 1, name: str = "quern") -> bytes:
    body = b"%d 0 quern\n%s\n" % (version, FIELD_LINES[version])
    head = ["filedesc://%s.arc" % name, "0.0.0.0", "20240101000000", "text/plain"]
    if version == 2:
        head += ["200", "-", "-", "0", "%s.arc" % name]
    return " ".join([*head, str(len(body))]).encode() + b"\n" + body


def arc_record(url: str | None, date: str, block: bytes, version: int = 1, mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    """A header line and the block, without the line feed that ends the record."""
    head = [quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else "urn:none", ip, date, mime]
    if version == 2:
        head += ["200", "-", "-", "0", "quern.arc"]
    return " ".join([*head, str(len(block))]).encode() + b"\n" + block


def parse_arc(raw: bytes, fields: list[tuple] | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record, version blocks (url ``filedesc:``) included; `fields` holds the names in force and is kept up to date."""
    fields = [ARC_V1] if fields is None else fields
    at = 0
    while at < len(raw):
        if raw[at] in b"\r\n":
            at += 1
            continue
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError(f"an ARC header line at byte {at} has no end")
        values = raw[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        is_version = values[0].startswith("filedesc:")
        if is_version:
            names = ARC_V2 if len(values) >= len(ARC_V2) else ARC_V1
        else:
            names = fields[0]
        if len(values) < len(names) or not values[-1].isdigit():
            raise ValueError(f"the ARC header line at byte {at} has {len(values)} fields: {values[:3]}")
        # a url may hold blanks: the last fields are fixed in number, what stands before them is the url
        extra = len(values) - len(names)
        head = dict(zip(names, [" ".join(values[: extra + 1]), *values[extra + 1 :]], strict=True))
        size = int(head["length"])
        block = raw[end + 1 : end + 1 + size]
        if len(block) < size:
            raise ValueError(f"the ARC record at byte {at} declares {size} bytes and has {len(block)}")
        at = end + 1 + size
        if is_version:
            fields[0] = ARC_V2 if block.split(b" ", 1)[0].strip() == b"2" else ARC_V1
        yield head, block


# ---- members


def member(record: bytes) -> bytes:
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def members_of(raw) -> Iterator[bytes]:
    """What each gzip member holds; zero bytes between members or at the end are padding."""
    at = 0
    while at < len(raw):
        if raw[at] == 0:
            at += 1
            continue
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if at >= len(raw):
                raise ValueError("the last gzip member has no end")
            chunk = raw[at : at + 65536]
            parts.append(one.decompress(chunk))
            at += len(chunk) - len(one.unused_data)
        yield b"".join(parts)


def _file_rows(members: Iterator[bytes], first: bytes = b"") -> Iterator[pa.RecordBatch]:
    """Members as rows of one file each; `first` opens every file."""
    held, size = [], 0
    for one in members:
        if held and size + len(one) > FILE_BYTES:
            yield pa.record_batch([pa.array([first + b"".join(held)], pa.binary())], names=["value"])
            held, size = [], 0
        held.append(one)
        size += len(one)
    if held:
        yield pa.record_batch([pa.array([first + b"".join(held)], pa.binary())], names=["value"])


def _write(rows: DataFrame, path: str) -> None:
    rows.select(F.col("value").cast("string").alias("value")).write.options(lineSep="\0", maxRecordsPerFile=1).text(path)


# ---- conversion


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(date: str) -> str:
    """ARC's 14 digits (or a shorter prefix of them) as an ISO timestamp."""
    d = (re.sub(r"\D", "", date) + "00000101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")


def http_field(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode("utf-8", "replace") if found else None


def record_id(file: str, place: int, url: str, date: str, digest: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{file} {place} {url} {date} {digest}')}>"


def warc_record(kind: str, rid: str, url: str, date: str, digest: str | None, head: bytes, payload: bytes, refers_to: str | None = None, ip: str = "", mime: str = "") -> bytes:
    """A whole record with the two line ends that close it."""
    block = head if kind == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {iso_date(date)}"]
    lines.append(f"WARC-Filename: {url.removeprefix('filedesc://')}" if kind == "warcinfo" else f"WARC-Target-URI: {url}")
    # 0.0.0.0 stands for an address that is not known
    if re.fullmatch(r"[0-9a-fA-F.:]{3,45}", ip) and ip != "0.0.0.0":
        lines.append(f"WARC-IP-Address: {ip}")
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {refers_to}"]
    typed = mime if re.fullmatch(r"[\w!#$&^.+-]+/[\w!#$&^.+-]+(;.*)?", mime) else ""
    if head and typed:
        lines.append(f"WARC-Identified-Payload-Type: {typed}")
    if digest:
        lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Type: {'application/http;msgtype=response' if head else typed or 'application/octet-stream'}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record."""
    at = 0
    while at < len(raw):
        if not raw.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
        size = int(head["content-length"])
        block = raw[end + 4 : end + 4 + size]
        at = end + 4 + size
        if len(block) < size or raw[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a WARC record does not end where it says")
        at += 4
        yield head, block


# ---- on Spark


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", version: int | None = None) -> None:
    """Pages as ARC archives of HTTP responses that carry the page id in a field of their head; without a version, tasks take turns with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = version or 1 + TaskContext.get().partitionId() % 2

        def records() -> Iterator[bytes]:
            for batch in batches:
                for page, url, html in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                    payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                    named = b"" if not page.is_valid else b"X-Page-Id: %d\r\n" % page.as_py()
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), named)
                    yield member(arc_record(url.as_py(), "20240101000000", head + payload, own) + b"\n")

        yield from _file_rows(records(), member(version_block(own) + b"\n"))

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.encode(html_col, "UTF-8"))
    _write(rows.mapInArrow(run, "value binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _per_row(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_HEAD = pa.schema([("page_id", pa.int64()), ("digest", pa.string()), ("bytes", pa.int64()), ("rid", pa.string())])
_WHOLE = pa.schema([*_HEAD, ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("block", pa.binary())])


def read_arc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """(page_id, digest, bytes, rid[, url, date, ip, mime, block]) of every record, block deflated; the digest of a version block is null."""
    schema = _WHOLE if blocks else _HEAD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size, place, names = [], 0, 0, [ARC_V1]
                for raw in members_of(memoryview(content.as_buffer())):
                    for fields, block in parse_arc(raw, names):
                        place += 1
                        info = fields["url"].startswith("filedesc:")
                        head, payload = (b"", block) if info else split_http(block)
                        digest, page = None if info else sha1_base32(payload), http_field(head, b"X-Page-Id")
                        row = (int(page) if page else None, digest, len(payload), record_id(file, place, fields["url"], fields["date"], digest))
                        held.append((*row, fields["url"], fields["date"], fields["ip"], fields["type"], zlib.compress(block, 1)) if blocks else row)
                        size += len(block)
                        if size >= SEGMENT:
                            yield _per_row(held, schema)
                            held, size = [], 0
                if held:
                    yield _per_row(held, schema)

    ddl = "page_id long, digest string, bytes long, rid string" + (", url string, date string, ip string, mime string, block binary" if blocks else "")
    return _files(spark, path).mapInArrow(run, ddl)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = 0) -> None:
    """Every record of the ARC files as a WARC record."""
    heads = read_arc(spark, arc_path, blocks=False).where((F.col("bytes") >= least) & F.col("digest").isNotNull())
    firsts = heads.groupBy(F.col("digest").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "rid"))).alias("first"))
    shared = firsts.where("n > 1 and first is not null").select("d", "first.*").toDF("d", "first_id", "first_rid")
    records = read_arc(spark, arc_path).join(shared, F.col("digest") == F.col("d"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[bytes]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    for r in batch.slice(at, 500).to_pylist():
                        info, block = r["digest"] is None, zlib.decompress(r["block"])
                        head, payload = (b"", block) if info else split_http(block)
                        again = r["first_id"] is not None and r["page_id"] != r["first_id"]
                        kind = "warcinfo" if info else "revisit" if again else "response" if head else "resource"
                        yield member(warc_record(kind, r["rid"], r["url"], r["date"], r["digest"], head, payload, r["first_rid"] if again else None, r["ip"], r["mime"]))

        yield from _file_rows(made())

    _write(records.select("page_id", "rid", "url", "date", "ip", "mime", "digest", "block", "first_rid", "first_id").mapInArrow(run, "value binary"), warc_path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, rid, record_type, payload_bytes, payload_digest, refers_to_rid); digests of stored payloads are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("rid", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_rid", pa.string())])
        for batch in batches:
            for content in batch.column(1):
                rows = []
                for fields, block in (r for raw in members_of(memoryview(content.as_buffer())) for r in parse_warc(raw)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind = fields["warc-type"]
                    if kind != "revisit" and sha1_base32(payload) != digest:
                        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
                    size = int(http_field(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
                    page = http_field(head, b"X-Page-Id")
                    rows.append((int(page) if page else None, fields["warc-record-id"], kind, size, digest, fields.get("warc-refers-to")))
                if rows:
                    yield _per_row(rows, schema)

    return _files(spark, path).mapInArrow(run, "page_id long, rid string, record_type string, payload_bytes long, payload_digest string, refers_to_rid string")


def op4_arc_to_warc(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and back from the WARC files."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    arc, warc = scratch.path("arc"), scratch.path("warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    scratch.delete(arc)
    back = scratch.cut(read_warc(spark, warc), "records")
    scratch.delete(warc)
    asked = back.where("refers_to_rid is not null").select(F.col("refers_to_rid").alias("r")).distinct()
    named = back.where("refers_to_rid is null").join(asked, F.col("rid") == F.col("r")).select("r", F.col("page_id").alias("refers_to")).distinct()
    return back.join(named, F.col("refers_to_rid") == F.col("r"), "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
