"""WARC records in ZIP-packaged archives: writing, and reading by ranges.

An archive is a ZIP file with a stored (uncompressed) member of WARC records
and a stored index member, one JSON line per record with its offset and length.
Because members are stored, a record is a plain byte range of the archive. The
reader never extracts: it reads the end of the file for the central directory
(with the ZIP64 records where a size or offset does not fit 32 bits), finds the
members' places, reads the index (or, without one, walks the record headers),
and hands out (file, offset, length) ranges, which Spark deals out anew so that
one large archive does not hold up one task.

Every task writes its own archives, streaming, into the shared folder; names
are fresh in every attempt, and only the files that finished tasks report are
read back, so a lost executor leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scour.llm.common import stage
from scour.session import scratch_path

# fixed values: signatures and layouts of the ZIP format
END, END64, LOCATOR64, ENTRY, LOCAL = (b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07",
                                       b"PK\x01\x02", b"PK\x03\x04")
NO16, NO32 = 0xFFFF, 0xFFFFFFFF
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdxj"
#: An archive is closed when its records reach this many bytes.
ARCHIVE_BYTES = 1 << 30
#: Bytes of an index or a gzip member read at once, and ranges handed on at once.
CHUNK, RANGES = 1 << 20, 20_000
#: Revisits up to this many are broadcast (under 100 bytes each).
BROADCAST_ROWS = 500_000


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it; a path without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_value(text: str | None) -> str:
    """A value that fits on a header line: control characters are escaped."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """One WARC record: a response, or a revisit that leaves out the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
             f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}",
             f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Streams records into one archive; the index follows them."""

    def __init__(self, path: str):
        system, inner = open_fs(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        self.path, self.out = path, system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(WARC_MEMBER, "w", force_zip64=True)
        self.offset, self.index = 0, []

    def add(self, data: bytes) -> None:
        self.member.write(data)
        self.index.append((self.offset, len(data)))
        self.offset += len(data)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX_MEMBER, "w", force_zip64=True) as index:
            for offset, length in self.index:
                index.write(json.dumps({"offset": offset, "length": length}).encode() + b"\n")
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.offset


def directory(file: pa.NativeFile) -> list[tuple[str, int, int, int]]:
    """(name, method, offset of the data, stored size) of every member, from the
    central directory alone; ZIP64 sizes and offsets are followed."""
    size = file.size()
    tail_at = max(0, size - (22 + 0xFFFF))
    tail = read_range(file, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if NO16 == count or NO32 in (length, start):
        locator = read_range(file, tail_at + at - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator missing")
        end64 = read_range(file, struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("ZIP64 end of central directory missing")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    data, at, members = read_range(file, start, length), 0, []
    for _ in range(count):
        if data[at:at + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", data, at + 10)
        packed, full = struct.unpack_from("<II", data, at + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", data, at + 28)
        local, = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:                           # the ZIP64 field holds what did not fit
            kind, n = struct.unpack_from("<HH", data, extra)
            if kind == 1:
                field, big = extra + 4, []
                for value in (full, packed, local):
                    if value == NO32:
                        value, = struct.unpack_from("<Q", data, field)
                        field += 8
                    big.append(value)
                full, packed, local = big
            extra += 4 + n
        head = read_range(file, local, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        n_name2, n_extra2 = struct.unpack_from("<HH", head, 26)
        members.append((name, method, local + 30 + n_name2 + n_extra2, packed))
        at = end + n_comment
    return members


def read_range(file: pa.NativeFile, offset: int, length: int) -> bytes:
    file.seek(offset)
    data = file.read(length)
    if len(data) != length:
        raise ValueError("archive is cut short")
    return data


def head_of(data: bytes) -> tuple[dict[str, str], int]:
    """Header fields (names in lower case) of a record or message, and where its
    block begins; (…, -1) if the header does not end within ``data``."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return {}, -1
    fields = {}
    for line in data[:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def walk(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the member, length) of its records, from their headers."""
    at = 0
    while at < size:
        take = 4096
        while True:
            head = read_range(file, start + at, min(take, size - at))
            fields, block = head_of(head)
            if block >= 0:
                break
            if take >= size - at:
                raise ValueError("broken WARC record")
            take *= 4
        length = block + int(fields["content-length"]) + 4
        yield at, length
        at += length


def inflated(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(end of the read part, text) pieces of a gzip member of the archive, streaming;
    the text is empty at the end of each of its gzip streams."""
    at, rest, stream = 0, b"", zlib.decompressobj(31)
    while at < size or rest:
        if not rest:
            rest = read_range(file, start + at, min(CHUNK, size - at))
            at += len(rest)
        text = stream.decompress(rest, CHUNK)
        rest = stream.unused_data if stream.eof else stream.unconsumed_tail
        if text:
            yield at - len(rest), text
        if stream.eof:
            yield at - len(rest), b""
            stream = zlib.decompressobj(31)


def walk_gzip(file: pa.NativeFile, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset in the member, length) of its gzip streams, of a record each."""
    at = 0
    for end, text in inflated(file, start, size):
        if not text:
            yield at, end - at
            at = end
    if at < size:
        raise ValueError("gzip stream is cut short")


def index_lines(file: pa.NativeFile, name: str, start: int, size: int) -> Iterator[dict]:
    """The entries of an index member, plain or gzip, streaming: JSON lines, or CDXJ lines
    (a key and a time before the JSON); others, as headers, are left out."""
    def pieces() -> Iterator[bytes]:
        if name.endswith(".gz"):
            yield from (text for _, text in inflated(file, start, size))
        else:
            for at in range(0, size, CHUNK):
                yield read_range(file, start + at, min(CHUNK, size - at))

    rest = b""
    for piece in pieces():
        *lines, rest = (rest + piece).split(b"\n")
        yield from filter(None, map(entry_of, lines))
    yield from filter(None, [entry_of(rest)])


def entry_of(line: bytes) -> dict | None:
    brace = line.find(b"{")
    if brace < 0 or line.startswith(b"!"):
        return None
    entry = json.loads(line[brace:])
    return entry if "offset" in entry and "length" in entry else None


def ranges_of(path: str) -> Iterator[tuple[str, int, int]]:
    """(path, offset in the file, length) of every record of an archive.

    A stored ``.warc`` or ``.warc.gz`` member (a gzip stream per record) is read by the index
    entries that name it, or that name no file where it is the only one; a member
    without entries is walked. A member that the archive compresses raises, as its
    records are no ranges of the file; so do two members that an entry could mean."""
    system, inner = open_fs(path)
    with system.open_input_file(inner) as file:
        members = directory(file)
        archives = {m[0]: m for m in members if m[0].endswith((".warc", ".warc.gz"))}
        short: dict[str, str] = {}
        for name in archives:
            if short.setdefault(name.rsplit("/", 1)[-1], name) != name:
                raise ValueError(f"two members are called {name.rsplit('/', 1)[-1]}")
        indexes = [m for m in members if m[0].startswith("indexes/") and not m[0].endswith(".idx")]
        for name, method, _, _ in [*archives.values(), *(indexes if archives else [])]:
            if method:
                raise ValueError(f"{name} is compressed; members must be stored")
        listed = set()
        for name, _, start, size in indexes if archives else []:
            for entry in index_lines(file, name, start, size):
                if "filename" in entry:
                    owner = short.get(entry["filename"].rsplit("/", 1)[-1])
                else:
                    owner = next(iter(archives)) if len(archives) == 1 else None
                if owner is None:
                    raise ValueError(f"{name} has an entry of no member: {entry}")
                listed.add(owner)
                yield path, archives[owner][2] + int(entry["offset"]), int(entry["length"])
        for name, _, start, size in archives.values():
            if name not in listed:
                for offset, length in (walk_gzip if name.endswith(".gz") else walk)(file, start, size):
                    yield path, start + offset, length


def page_number(name: str | None) -> int | None:
    """The page_id in a record id of this writer; null in others."""
    own = re.fullmatch(r"<urn:x-page:(-?\d+)>", name or "")
    return int(own[1]) if own else None


def parse(data: bytes) -> tuple:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)
    of a record, plain or gzip. The payload of a revisit is null and its size what its HTTP
    header says; that of a response is the body of its HTTP message, that of another record
    its block. page_id and refers_to are null in records of other writers, a digest
    that is not given is computed. A payload that does not match its SHA-1 raises."""
    if data[:2] == b"\x1f\x8b":
        data = zlib.decompress(data, 31)
    fields, block = head_of(data)
    body = data[block:block + int(fields["content-length"])]
    kind, given = fields["warc-type"], fields.get("warc-payload-digest")
    http, start = head_of(body) if body.startswith(b"HTTP/") else ({}, 0)
    start = max(start, 0)
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    page = page_number(fields.get("warc-record-id"))
    digest = given.removeprefix("sha1:") if given else None
    payload = None
    if kind != "revisit":
        payload = body[start:]
        own = base32_sha1(payload)
        broken = kind == "response" and given and given.startswith("sha1:") and own != digest
        if broken or (page is not None and len(payload) != size):
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
        size, digest = len(payload), digest or own
    return (page, fields.get("warc-target-uri"), kind, page_number(fields.get("warc-refers-to")),
            size, digest, payload)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """path, n_records, n_bytes of the archives written under ``folder``.

    Of records with equal payloads of at least ``min_revisit_bytes``, the one
    with the smallest page_id is a response and the others revisit it. Rows that
    repeat that page_id are responses too; a null page_id is always one."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    keys = rows.filter(F.octet_length("html") >= min_revisit_bytes).select("digest", "page_id")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"),
                                       F.max("page_id").alias("last")).filter("last > refers_to")
    again = keys.join(first.select("digest", "refers_to"), "digest").filter(
        "page_id > refers_to").distinct()
    again = stage(again, "warc-revisits")
    if again.count() <= BROADCAST_ROWS:                   # else the pages are shuffled
        again = F.broadcast(again)
    joined = rows.join(again, ["page_id", "digest"], "left").select(
        "page_id", "url", "html", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, writer = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, refers = (c[i].as_py() for c in batch.columns)
                payload = html.encode("utf-8", "surrogatepass")
                if writer is None:
                    writer = ArchiveWriter(f"{folder.rstrip('/')}/{uuid.uuid4().hex}.wacz")
                writer.add(record(page, url, payload, base32_sha1(payload), refers))
                if writer.offset >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        cols = list(zip(*done, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.int64())], ["path", "n_records", "n_bytes"])

    return stage(joined.mapInArrow(run, "path string, n_records long, n_bytes long"), "warc-files")


def read_archives(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and
    (if asked) payload of every record of the archives in column ``path``."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for some in batched(ranges_of(path), RANGES):
                    cols = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
                         pa.array(cols[2], pa.int64())], ["path", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
                 pa.binary()][:7 if with_payload else 6]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
                 "payload"][:len(kinds)]
        opened: dict[str, pa.NativeFile] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        try:
            for batch in batches:
                rows, size = [], 0
                for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if path not in opened:
                        if len(opened) >= 64:
                            opened.pop(next(iter(opened))).close()
                        system, inner = open_fs(path)
                        opened[path] = system.open_input_file(inner)
                    rows.append(parse(read_range(opened[path], offset, length))[:len(kinds)])
                    size += length if with_payload else 64
                    if size > 16_000_000:
                        yield out(rows)
                        rows, size = [], 0
                yield out(rows)
        finally:
            for file in opened.values():
                file.close()

    spots = files.select("path").repartition("path").mapInArrow(
        locate, "path string, offset long, length long")
    dealt = spots.repartition(F.col("path"), F.expr("offset div 16777216")).sortWithinPartitions(
        "path", "offset")
    shape = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, "
             "payload_digest string" + ", payload binary" * with_payload)
    return dealt.mapInArrow(fetch, shape)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """A record per page written and read back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null and empty pages have the empty payload; a null url is an empty one;
    columns besides page_id, url and html are not read; no pages, no archives."""
    files = write_archives(pages, scratch_path(spark, "warc"), min_revisit_bytes=min_revisit_bytes)
    return read_archives(files, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
