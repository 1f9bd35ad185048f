"""WARC/1.1 archives as a PySpark Python data source, for reading and writing.

Reading plans one partition per archive file (writers roll over to a new file before `max_bytes`). Filters on
record_type, record_id, target_uri, payload_digest and page_id are pushed down: a task parses the header block of each
record first, and where the header fails a pushed filter it goes on to the next record without decoding the block. In plain
archives it skips by Content-Length. In `.gz` archives each record is a gzip member of its own; written here, a member says its length in the
'sl' extra field, so an unwanted one is skipped after its first bytes; others are inflated to find their end, and dropped.
The option payload says what is decoded of the wanted ones: full (the body), digest (its length and SHA-1 only), or none.
The body of a response or request is what follows the HTTP header, without chunked transfer coding; other records' is the block.

Any archive can be read: a file, or the `.warc` and `.warc.gz` files of a folder. Writing takes rows of (page_id, record_type,
target_uri, payload, payload_digest, payload_bytes, refers_to). Responses are HTTP responses. Revisits have no body and
name their response by WARC-Refers-To. Every task writes files of its own, named by a random part, and the driver's commit
lists the files of successful tasks in a manifest. Where a folder has one, readers go by it, so files of failed or
repeated tasks don't count.

Paths are opened through Arrow's file systems (file:, hdfs:, s3:, gs:), so they need to be shared by all executors.

Edge cases: a null payload is written as an empty body. A null page_id or refers_to has no header; archives from elsewhere have
neither. A record that is cut off or lacks a version line, colon or Content-Length raises an error with the file and
offset. An empty table gives a manifest without files and reads back as no rows. Rows that are wholly equal make records
with one WARC-Record-ID.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from .common import Scratch, small, text_of

SCHEMA = "page_id long, record_type string, target_uri string, record_id string, payload binary, payload_digest string, payload_bytes long, refers_to long"
#: Column and header of each field that filters can be pushed to.
HEADERS = {"record_type": b"warc-type", "target_uri": b"warc-target-uri", "record_id": b"warc-record-id", "payload_digest": b"warc-payload-digest", "page_id": b"x-page-id", "refers_to": b"x-refers-to-page-id"}
NUMBERS = ("page_id", "refers_to")
MANIFEST = "_manifest"
MAX_BYTES = 256 << 20
ROWS = 512
BATCH_BYTES = 16 << 20
#: Bytes of a gzip member, or of a header, that are read at first.
FIRST = 1 << 13
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _record_id(page: int | None, digest: str, uri: str, kind: str) -> str:
    """Of a response by its page and payload, so that revisits can tell it; of others by all they have."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}' if kind == 'response' and page is not None else f'{kind}:{page}:{digest}:{uri}')}>"


def record(row: dict, date: str = EPOCH) -> bytes:
    """One WARC/1.1 record. Responses hold an HTTP response; revisits have its header only."""
    kind, page, refers, digest = row["record_type"], row["page_id"], row["refers_to"], row["payload_digest"]
    body = row["payload"] or b""
    uri = "".join((row["target_uri"] or "").split())
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page, digest, uri, kind)}", f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {row['payload_bytes']}"]
    lines += [f"X-Page-ID: {page}"] * (page is not None)
    if refers is not None:
        lines += [f"WARC-Refers-To: {_record_id(refers, digest, '', 'response')}", f"X-Refers-To-Page-ID: {refers}"]
    lines += [f"WARC-Profile: {REVISIT}"] * (kind == "revisit")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + (b"" if kind == "revisit" else body)
    return "\r\n".join([*lines, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A record as a gzip member that says its own length and that of the record in an extra field."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    total = 12 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.most, self.date = options["path"], int(options.get("max_bytes", MAX_BYTES)), options.get("date", EPOCH)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for batch in small(iterator, 16):
            for row in batch.to_pylist():
                if out is None or size >= self.most:
                    if out:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                size += out.write(data := member(record(row, self.date))) or len(data)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, base = _open(self.path)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write("\n".join(f for m in messages if m for f in m.files).encode())

    def abort(self, messages: list) -> None:
        system, base = _open(self.path)
        for m in messages:
            for f in m.files if m else ():
                system.delete_file(f"{base}/{f}")


@dataclass
class Archive(InputPartition):
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "full")
        #: Column and the values it may have; None is any value.
        self.wanted: list[tuple[str, tuple | None]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership and presence on header columns; the others stay with Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.append((name, (f.value,)))
            elif name in HEADERS and isinstance(f, In):
                self.wanted.append((name, tuple(v for v in f.value if v is not None)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        system, base = _open(self.path)
        if system.get_file_info(f"{base}/{MANIFEST}").type == arrow_fs.FileType.File:
            with system.open_input_stream(f"{base}/{MANIFEST}") as f:
                return [Archive(f"{base}/{x}") for x in f.read().decode().split("\n") if x] or [Archive("")]
        if system.get_file_info(base).type == arrow_fs.FileType.File:
            return [Archive(base)]
        found = system.get_file_info(arrow_fs.FileSelector(base, recursive=True))
        return [Archive(x.path) for x in found if x.path.endswith((".warc", ".warc.gz"))] or [Archive("")]

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        rows, held = [], 0
        with _open(self.path)[0].open_input_file(partition.file) as f:
            for head, block in records(f, partition.file, self._wanted, self.payload != "none"):
                rows.append(self._row(head, block))
                held += len(rows[-1][4] or b"")
                if len(rows) >= ROWS or held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _wanted(self, head: dict) -> bool:
        for name, values in self.wanted:
            value = _field(head, name)
            if value is None or (values is not None and value not in values):
                return False
        return True

    def _row(self, head: dict, block: bytes | None) -> list:
        payload, digest, size = None, _field(head, "payload_digest"), int(head[b"x-payload-length"]) if b"x-payload-length" in head else None
        if block is not None and head.get(b"warc-type") != b"revisit":
            body = http_body(block) if head.get(b"content-type", b"").startswith(b"application/http") else block
            digest, size = base32(hashlib.sha1(body).digest()), len(body)
            payload = body if self.payload == "full" else None
        return [_field(head, "page_id"), _field(head, "record_type"), _field(head, "target_uri"), _field(head, "record_id"), payload, digest, size, _field(head, "refers_to")]

    def _batch(self, rows: list[list]) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split()[1]]) for x, c in zip(SCHEMA.split(", "), zip(*rows, strict=True), strict=True)], names=names)


def _field(head: dict, name: str):
    value = head.get(HEADERS[name])
    if value is None:
        return None
    text = value.decode("utf-8", "replace")
    return int(text) if name in NUMBERS else text.removeprefix("sha1:") if name == "payload_digest" else text


def http_body(block: bytes) -> bytes:
    """What follows the header of an HTTP message, without chunked transfer coding."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n")):
        return body
    out, at = [], 0
    while (stop := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:stop].split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            break
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size + 2
    return b"".join(out)


def parsed(raw: bytes, where: str) -> tuple[dict, int]:
    """Header fields by lower-case name, and the length of the block."""
    lines = raw.split(b"\r\n")
    try:
        head = {k.strip().lower(): v.strip() for k, v in (line.split(b":", 1) for line in lines[1:])}
        length = int(head[b"content-length"])
    except (ValueError, KeyError):
        raise ValueError(f"{where} has a malformed header") from None
    if not lines[0].startswith(b"WARC/") or length < 0:
        raise ValueError(f"{where} is not whole")
    return head, length


def records(f: pa.NativeFile, name: str, wanted, with_block: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Header and block of each record that is wanted by its header; other blocks are not decoded."""
    end, at = f.size(), 0
    while at < end:
        where = f"{name}: the record at {at}"
        step = _from_member if f.read_at(2, at) == b"\x1f\x8b" else _from_plain
        head, block, at = step(f, at, end, where, wanted, with_block)
        if head is not None:
            yield head, block


def _from_plain(f: pa.NativeFile, at: int, end: int, where: str, wanted, with_block: bool):
    raw, n = b"", FIRST
    while (stop := raw.find(b"\r\n\r\n")) < 0:
        if at + len(raw) >= end:
            raise ValueError(f"{where} has no end of header")
        raw, n = f.read_at(n, at), n * 2
    head, length = parsed(raw[:stop], where)
    begin = at + stop + 4
    if begin + length > end:
        raise ValueError(f"{where} is not whole")
    if not wanted(head):
        return None, None, begin + length + 4
    return head, f.read_at(length, begin) if with_block else None, begin + length + 4


def _from_member(f: pa.NativeFile, at: int, end: int, where: str, wanted, with_block: bool):
    """As _from_plain, of a gzip member: inflated as far as needed, and skipped by its own length where it says it."""
    first = f.read_at(FIRST, at)
    skip = None
    if len(first) >= 24 and first[3] & 4 and first[12:16] == b"sl\x08\x00":
        skip = at + struct.unpack("<I", first[16:20])[0]
    packed, out, offset = zlib.decompressobj(31), b"", at

    def more(most: int) -> bytes:
        nonlocal offset, first
        try:
            if packed.unconsumed_tail:
                return packed.decompress(packed.unconsumed_tail, most)
            chunk, first = first or f.read_at(FIRST * 8, offset), b""
            if not chunk:
                raise ValueError(f"{where} is not whole")
            offset += len(chunk)
            return packed.decompress(chunk, most)
        except zlib.error:
            raise ValueError(f"{where} is not whole") from None

    while (stop := out.find(b"\r\n\r\n")) < 0:
        if packed.eof:
            raise ValueError(f"{where} has no end of header")
        out += more(FIRST)
    head, length = parsed(out[:stop], where)
    keep = wanted(head)
    if skip is not None and skip <= end and not (keep and with_block):
        return (head if keep else None), None, skip
    if keep and with_block:
        parts = [out]
        while not packed.eof:
            parts.append(more(FIRST * 64))
        out = b"".join(parts)
    else:
        while not packed.eof:
            more(FIRST * 64)
    if keep and with_block and len(out) < stop + 4 + length:
        raise ValueError(f"{where} is not whole")
    return (head if keep else None), out[stop + 4 : stop + 4 + length] if keep and with_block else None, offset - len(packed.unused_data)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def plan_records(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows for the writer: of equal payloads of at least least_bytes that of the largest page_id is the response.

    Equal means equal SHA-1 and length. Rows that share the largest page_id are all responses; a group without any
    page_id has responses only. The digests are grouped as a narrow table and joined back by page_id and digest.
    """
    payload = F.encode(text_of(html), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    digests = scratch.cut(rows.select("page_id", "sha1", "payload_bytes"), "digests")
    groups = digests.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    again = groups.filter((F.col("n") > 1) & (F.col("payload_bytes") >= least_bytes)).select("sha1", "first_id")
    repeats = digests.filter(F.col("page_id").isNotNull()).join(again, "sha1").filter("page_id <> first_id").select("page_id", "sha1", "first_id").distinct()
    out = rows.join(repeats, ["page_id", "sha1"], "left")
    revisit = F.col("first_id").isNotNull()
    return out.select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.when(~revisit, F.col("payload")).alias("payload"),
        _base32(F.hex("sha1")).alias("payload_digest"), "payload_bytes", F.col("first_id").alias("refers_to"),
    )


def _base32(hexed):
    """Upper-case base32 of 40 hexadecimal digits: eight groups of 5 digits, each 4 base32 digits."""
    number = lambda k: F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("long")
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    one = lambda k, j: F.substring(F.lit(digits), (F.shiftright(number(k), 15 - 5 * j).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*(one(k, j) for k in range(8) for j in range(4)))


def write(records: DataFrame, path: str, max_bytes: int = MAX_BYTES, date: str | None = None) -> None:
    """date: of all records, by default the present one."""
    register(records.sparkSession)
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    records.write.format("warc").option("path", path).option("max_bytes", str(max_bytes)).option("date", when).mode("append").save()


def load(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)
