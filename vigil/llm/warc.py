"""WARC records in ZIP packages: writing, locating members, range-reading records.

A package is a ZIP file whose members are stored, not compressed: an archive of
WARC records, each record a gzip member of its own, and a CDX index that names
every record's offset and length in the archive. A reader parses the end
record, the ZIP64 locator where there is one, and the central directory; it
then reads the index member and fetches single records by byte ranges. No
member is ever extracted.

Records with equal payloads of at least ``revisit_from`` bytes are written
once: the one with the largest page_id is the response and all others are
revisits that refer to it. Spark finds them by digest (one row per digest
after a partial aggregation), so that payloads are shuffled once only, and
tasks write packages of about ``package_bytes`` each.

Defined results: a null html is an empty payload; a null page_id sorts below
every other; rows with equal payload and the same largest page_id are all
responses; a null url becomes the empty URI; an empty table gives no package.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import common

# Signatures and lengths of the ZIP format.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
END_SIZE, LOCATOR_SIZE, END64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 56, 46, 30
MAX16, MAX32, ZIP64_FIELD = 0xFFFF, 0xFFFFFFFF, 1
WARC_DATE = "2024-01-01T00:00:00Z"

READ_AHEAD = 1 << 20
Fetch = Callable[[int, int], bytes]


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; a bare path is local."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(uri)


# --- ZIP ---------------------------------------------------------------------


@dataclass
class Member:
    name: str
    method: int
    size: int
    header_at: int
    crc: int


class PackageWriter:
    """Stored members one after the other; sizes follow from the central directory.

    A member's length and checksum are known only at its end, so the local
    header leaves them to a data descriptor. ``zip64`` forces the large forms.
    """

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.members = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.members.append(Member(name, 0, 0, self.at, 0))
        raw = name.encode()
        self._put(LOCAL + struct.pack("<5H3I2H", 45, 0x0808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> int:
        """Append to the open member; returns the offset within it."""
        member = self.members[-1]
        at = member.size
        member.size += len(data)
        member.crc = zlib.crc32(data, member.crc)
        self._put(data)
        return at

    def end(self) -> None:
        member = self.members[-1]
        large = self.zip64 or member.size >= MAX32
        self._put(b"PK\x07\x08" + struct.pack("<I2Q" if large else "<3I", member.crc, member.size, member.size))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            raw, extra = m.name.encode(), b""
            size, at = m.size, m.header_at
            if self.zip64 or size >= MAX32 or at >= MAX32:
                extra = struct.pack("<2H3Q", ZIP64_FIELD, 24, size, size, at)
                size = at = MAX32
            self._put(
                CENTRAL
                + struct.pack("<6H3I5H2I", 45, 45, 0x0808, 0, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at)
                + raw
                + extra
            )
        size, count = self.at - start, len(self.members)
        if self.zip64 or start >= MAX32 or count >= MAX16:
            here = self.at
            self._put(END64 + struct.pack("<Q2H2I4Q", END64_SIZE - 12, 45, 45, 0, 0, count, count, size, start))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, here, 1))
            count, size, start = min(count, MAX16), MAX32, MAX32
        self._put(END + struct.pack("<4H2IH", 0, 0, count, count, size, start, 0))


def directory(fetch: Fetch, length: int) -> list[Member]:
    """Members named by the central directory, small or ZIP64."""
    tail_at = max(0, length - END_SIZE - MAX16)
    tail = fetch(tail_at, length - tail_at)
    found = tail.rfind(END)
    while found >= 0 and found + END_SIZE + int.from_bytes(tail[found + 20 : found + 22], "little") != len(tail):
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("no end of central directory: not a whole ZIP file")
    count, size, start = struct.unpack_from("<H2I", tail, found + 10)
    locator = found - LOCATOR_SIZE
    if locator >= 0 and tail[locator : locator + 4] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, locator + 8)
        record = fetch(at, END64_SIZE)
        if record[:4] != END64:
            raise ValueError("the ZIP64 locator points to no ZIP64 end record")
        count, size, start = struct.unpack_from("<3Q", record, 32)
    data, members, at = fetch(start, size), [], 0
    for _ in range(count):
        if data[at : at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack_from("<H", data, at + 10)[0]
        crc, packed, whole = struct.unpack_from("<3I", data, at + 16)
        names, extras, comments = struct.unpack_from("<3H", data, at + 28)
        (header_at,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + names].decode()
        field, last = at + CENTRAL_SIZE + names, at + CENTRAL_SIZE + names + extras
        while field + 4 <= last:
            kind, width = struct.unpack_from("<2H", data, field)
            if kind == ZIP64_FIELD:
                wide = iter(struct.unpack_from(f"<{width // 8}Q", data, field + 4))
                whole = next(wide) if whole == MAX32 else whole
                packed = next(wide) if packed == MAX32 else packed
                header_at = next(wide) if header_at == MAX32 else header_at
            field += 4 + width
        if method == 0 and packed != whole:
            raise ValueError(f"{name}: a stored member of two sizes")
        members.append(Member(name, method, packed, header_at, crc))
        at = last + comments
    return members


def member_start(fetch: Fetch, member: Member) -> int:
    """Offset of a stored member's data; its local header may differ from the directory."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: records can't be read by range")
    header = fetch(member.header_at, LOCAL_SIZE)
    if header[:4] != LOCAL:
        raise ValueError(f"{member.name}: no local header")
    names, extras = struct.unpack_from("<2H", header, 26)
    return member.header_at + LOCAL_SIZE + names + extras


# --- WARC --------------------------------------------------------------------


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def warc_record(kind: str, page_id: int | None, url: str, digest: str, payload: bytes, size: int, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP head alone."""
    block = http_head(size) + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest} {kind}')}>"),
        ("WARC-Date", WARC_DATE),
        ("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Page-ID", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("Refers-To-Page-ID", str(refers_to)))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields in lower case and the offset after the blank line."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def parse_record(data: bytes) -> dict:
    """What a record says, its payload's size and digest taken from the payload where it has one."""
    fields, at = parse_head(data)
    block = data[at : at + int(fields["content-length"])]
    http, body = parse_head(block)
    size, digest = int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response":
        payload = block[body:]
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{fields['warc-record-id']}: damaged payload")
    return {
        "page_id": int(fields["page-id"]) if fields["page-id"] else None,
        "url": unquote(fields["warc-target-uri"]) if "%" in fields["warc-target-uri"] else fields["warc-target-uri"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": int(fields["refers-to-page-id"]) if fields.get("refers-to-page-id") else None,
    }


# --- Spark -------------------------------------------------------------------

PACKAGES = pa.schema([("package", pa.string()), ("package_bytes", pa.int64()), ("records", pa.int64())])
LOCATED = pa.schema(
    [("package", pa.string()), ("first_at", pa.int64()), ("span", pa.int64()), ("lengths", pa.list_(pa.int64()))]
)
RECORDS = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
        ("package", pa.string()),
        ("record_at", pa.int64()),
    ]
)
SQL_TYPES = {pa.string(): "string", pa.int64(): "long", pa.list_(pa.int64()): "array<long>"}


def sql_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL_TYPES[f.type]}" for f in schema)


def with_roles(pages: DataFrame, revisit_from: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= revisit_from
    repeated = (
        rows.where(large).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1")
    )
    # as a table of its own, so that a digest with very many pages can be split in the join
    repeated = common.settle(repeated.select("digest", "newest"), "digests")
    revisits = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest"))
    return rows.join(repeated, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(revisits, F.col("newest")).alias("refers_to")
    )


def write_packages(pages: DataFrame, folder: str, *, revisit_from: int = 1000, package_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """Write all pages into packages below ``folder``; one row per package.

    Every attempt of a task writes files of its own under a new name. The rows
    returned name the files to use, so keep them (``archive`` writes them to a
    table): files that a lost attempt left are never read.
    """

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = opened(folder)
        rows = (row for batch in batches for piece in common.batches_of(iter([batch]), 8 << 20, "html") for row in piece.to_pylist())
        row = next(rows, None)
        while row is not None:
            files.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            index, count = io.BytesIO(), 0
            with files.open_output_stream(f"{base}/{name}") as out:
                zipped = PackageWriter(out, zip64)
                zipped.begin("archive/data.warc.gz")
                while row is not None and zipped.at < package_bytes:
                    payload = row["html"].encode()
                    kind = "response" if row["refers_to"] is None else "revisit"
                    record = warc_record(kind, row["page_id"], row["url"], row["digest"], payload, len(payload), row["refers_to"])
                    packed = gzip.compress(record, compresslevel=4, mtime=0)
                    index.write(b"%d %d %s\n" % (zipped.write(packed), len(packed), quote(row["url"]).encode()))
                    count += 1
                    row = next(rows, None)
                zipped.end()
                zipped.begin("indexes/index.cdx")
                zipped.write(index.getvalue())
                zipped.end()
                zipped.close()
            yield common.pack(PACKAGES, [f"{folder}/{name}"], [zipped.at], [count])

    return with_roles(pages, revisit_from).mapInArrow(written, sql_schema(PACKAGES))


def fetcher(source) -> Fetch:
    def fetch(at: int, size: int) -> bytes:
        source.seek(at)
        data = source.read(size)
        if len(data) != size:
            raise ValueError("the file ends early")
        return data

    return fetch


def locate_records(packages: DataFrame, span: int = READ_AHEAD) -> DataFrame:
    """Ranges of records in every package, from its directory and index alone.

    A range holds neighbouring records of about ``span`` bytes, or one longer record.
    """

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for package in batch.column(0).to_pylist():
                files, path = opened(package)
                with files.open_input_file(path) as source:
                    fetch = fetcher(source)
                    members = {m.name: m for m in directory(fetch, source.size())}
                    for name, member in members.items():
                        if not name.startswith("indexes/") or not name.endswith(".cdx"):
                            continue
                        start = member_start(fetch, members["archive/data.warc.gz"])
                        lines = fetch(member_start(fetch, member), member.size).split(b"\n")[:-1]
                        ranges, held, total = [], [], 0
                        for line in lines:
                            at, size = (int(x) for x in line.split(b" ")[:2])
                            if held and total + size > span:
                                ranges.append((first, total, held))
                                held, total = [], 0
                            if not held:
                                first = start + at
                            held.append(size)
                            total += size
                        if held:
                            ranges.append((first, total, held))
                        if ranges:
                            yield common.pack(LOCATED, [package] * len(ranges), *map(list, zip(*ranges, strict=True)))

    return packages.select("package").mapInArrow(located, sql_schema(LOCATED))


def read_records(located: DataFrame) -> DataFrame:
    """One row per record, each range read by one request."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = opened(row["package"])
                with files.open_input_file(path) as source:
                    data = fetcher(source)(row["first_at"], row["span"])
                out, at = [], 0
                for size in row["lengths"]:
                    record = parse_record(gzip.decompress(data[at : at + size]))
                    out.append(record | {"package": row["package"], "record_at": row["first_at"] + at})
                    at += size
                yield pa.RecordBatch.from_pylist(out, schema=RECORDS)

    return located.mapInArrow(read, sql_schema(RECORDS))


def archive(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write packages to the scratch folder all executors share, and return their table."""
    return common.settle(write_packages(pages, common.fresh_folder(spark, "warc"), **options), "packages")


def read_back(packages: DataFrame) -> DataFrame:
    """All records of the packages; ranges are dealt out evenly before they are read.

    The number of parts is given, as their rows are small and would be put together otherwise.
    """
    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return read_records(locate_records(packages).repartition(parts, "package", "first_at"))
