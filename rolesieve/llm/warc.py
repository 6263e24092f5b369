"""WARC records in ZIP archives: written by Spark tasks, read back by range without extraction.

An archive is a ZIP file whose members are stored as they are: ``archive/data.warc.gz``, every
record a gzip member of its own, and ``indexes/index.cdxj``, a line per record with its place. The
reader parses the end record and the central directory, in the ZIP64 form where there is one, finds
the stored members, reads the index, deals its lines over tasks by row, and reads each record's
bytes where they lie; one huge archive is therefore read by many tasks. Neither reader nor writer
ever holds an archive or a member whole.

Folders are URIs of any store that Arrow knows (file, hdfs, s3, gs). A task writes under a name of
its own attempt, and only names in the written manifest count, so a task that runs twice does no
harm.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import n_partitions, shared_folder, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Where members of any archive stand.
ARCHIVES, INDEXES = "archive/", "indexes/"
#: Bytes of records after which a task begins another archive; ZIP64 is used beyond 4 GiB.
ARCHIVE_BYTES = 1 << 30
#: Records that are apart by no more are read together, up to so many bytes.
GAP, READ_BYTES = 1 << 16, 8 << 20
LEVEL = 1
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0

# Fixed values of the ZIP format: signatures and record layouts.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FORM, LOCATOR64_FORM = "<4sQ2H2I4Q", "<4sIQI"
DESCRIPTOR = b"PK\x07\x08"
GZIP = b"\x1f\x8b"
MOST16, MOST32 = 0xFFFF, 0xFFFFFFFF


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ---------------------------------------------------------------- writing


class ZipWriter:
    """Stored members, one after the other, whose sizes are known only at their end: the local
    header announces a ZIP64 descriptor behind the data."""

    def __init__(self, sink, zip64_from: int = MOST32):
        self.sink, self.at, self.members, self.zip64_from, self.open = sink, 0, [], zip64_from, False

    def write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)
        if self.open:
            self.crc = zlib.crc32(data, self.crc)

    def begin(self, name: str) -> None:
        self.open = False
        self.name, self.start, self.crc = name.encode(), self.at, 0
        # bit 3: sizes follow the data; version 45: ZIP64
        wide = struct.pack("<2H2Q", 1, 16, 0, 0)
        self.write(struct.pack(LOCAL_FORM, LOCAL, 45, 8, 0, 0, 0x21, 0, MOST32, MOST32, len(self.name), len(wide)) + self.name + wide)
        self.data, self.open = self.at, True

    def end(self) -> None:
        self.open = False
        size = self.at - self.data
        self.write(struct.pack("<4sIQQ", DESCRIPTOR, self.crc, size, size))
        self.members.append((self.name, self.start, self.crc, size))

    def close(self) -> None:
        directory = self.at
        for name, start, crc, size in self.members:
            extra = b""
            if max(size, start) >= self.zip64_from:
                extra = struct.pack("<2H3Q", 1, 24, size, size, start)
                size = start = MOST32
            self.write(struct.pack(CENTRAL_FORM, CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, size, size, len(name), len(extra), 0, 0, 0, 0, start) + name + extra)
        length, n = self.at - directory, len(self.members)
        if max(length, directory) >= self.zip64_from:
            end64 = self.at
            self.write(struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, length, directory))
            self.write(struct.pack(LOCATOR64_FORM, LOCATOR64, 0, end64, 1))
            n, length, directory = MOST16, MOST32, MOST32
        self.write(struct.pack(END_FORM, END, 0, 0, n, n, length, directory, 0))
        self.sink.close()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    url = "".join(c for c in url or "" if c not in "\r\n")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if not response:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all ``pages``; returns the manifest (path, records), itself a written table.

    Of records with equal payloads of at least ``least_bytes`` bytes the one with the largest page id
    is the response, others are revisits of it; of several rows with that id the one that the scan
    numbers last is, so ``pages`` should be a table that is read or was written down. Null html is an
    empty payload; a null page id counts as smaller than any other. The digests of all pages are
    reduced to a row per payload before they meet the pages again, so a payload that a third of the
    pages share costs each task one row. An empty table writes no archive.
    """
    spark = pages.sparkSession
    folder = folder or shared_folder(spark)
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                        F.monotonically_increasing_id().alias("row"), F.sha1(payload).alias("digest"))
    top = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("top"), F.count("*").alias("n"))
    # payloads travel once, to the digest's task, which adaptive execution splits where it is large
    joined = rows.join(top.where("n > 1").hint("merge"), "digest", "left").select(
        "id", "url", "payload", "digest", F.col("top.id").alias("top_id"), F.col("n").isNotNull().alias("shared"),
        (F.col("row") == F.col("top.row")).alias("first"))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, done = None, []
        for batch in batches:
            for i in range(len(batch)):
                row = {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}
                if out is None:
                    name = f"{root.rstrip('/')}/pages-{uuid.uuid4().hex}.wacz"
                    out, lines = ZipWriter(store.open_output_stream(name)), []
                    out.begin(DATA)
                body = row["payload"]
                response = not row["shared"] or row["first"] or len(body) < least_bytes
                data = _gzip(record(row["id"], row["url"], body, base64.b32encode(bytes.fromhex(row["digest"])).decode(), response, row["top_id"]))
                lines.append((out.at - out.data, len(data)))
                out.write(data)
                if out.at >= archive_bytes:
                    done.append((_close(out, lines), name))
                    out = None
        if out is not None:
            done.append((_close(out, lines), name))
        yield pa.RecordBatch.from_pydict({"path": pa.array([n for _, n in done], pa.string()), "records": pa.array([k for k, _ in done], pa.int64())})

    return stored(joined.mapInArrow(archive, "path string, records long"))


def _close(out: ZipWriter, lines: list[tuple[int, int]]) -> int:
    out.end()
    out.begin(INDEX)
    for offset, length in lines:
        out.write((json.dumps({"offset": offset, "length": length}) + "\n").encode())
    out.end()
    out.close()
    return len(lines)


# ---------------------------------------------------------------- reading


def members(source, size: int) -> dict[str, tuple[int, int]]:
    """(offset, length) of the data of each stored member of a ZIP file that can seek."""
    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return source.read(n)

    tail_at = max(0, size - struct.calcsize(END_FORM) - MOST16)
    tail = read(tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from(END_FORM, tail, at)
    locator = tail_at + at - struct.calcsize(LOCATOR64_FORM)
    if locator >= 0 and (raw := read(locator, struct.calcsize(LOCATOR64_FORM)))[:4] == LOCATOR64:
        raw = read(struct.unpack(LOCATOR64_FORM, raw)[2], struct.calcsize(END64_FORM))
        n, length, start = struct.unpack(END64_FORM, raw)[7:]
    directory, at, out = read(start, length), 0, {}
    for _ in range(n):
        entry = struct.unpack_from(CENTRAL_FORM, directory, at)
        method, packed, whole, name_n, extra_n, note_n, local = entry[4], entry[8], entry[9], entry[10], entry[11], entry[12], entry[16]
        at += struct.calcsize(CENTRAL_FORM)
        name, extra = directory[at:at + name_n].decode(), directory[at + name_n:at + name_n + extra_n]
        at += name_n + extra_n + note_n
        if method:
            continue  # not stored
        wide = _zip64(extra)
        whole, packed, local = (wide.pop(0) if value == MOST32 and wide else value for value in (whole, packed, local))
        head = struct.unpack(LOCAL_FORM, read(local, struct.calcsize(LOCAL_FORM)))
        out[name] = (local + struct.calcsize(LOCAL_FORM) + head[9] + head[10], packed)
    return out


def _zip64(extra: bytes) -> list[int]:
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if kind == 1:
            return list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
        extra = extra[4 + n:]
    return []


def places(manifest: DataFrame, folder: str) -> DataFrame:
    """path, offset and length of every record, from the stored indexes of each archive.

    Every stored member under ``indexes/`` is an index, gzipped or not. Its lines are JSON, bare or
    behind a key and a time stamp; lines that start with ``!`` and blank ones say nothing. The ``filename``
    of a line names a member under ``archive/``; an archive with one such member may leave it out.
    A record that several lines name is read once; one in a member that is absent is an error.
    """
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        for path in (p for b in batches for p in b.column(0).to_pylist()):
            with store.open_input_file(path) as source:
                found = members(source, source.size())
                data = {name.removeprefix(ARCHIVES): at for name, (at, _) in found.items() if name.startswith(ARCHIVES)}
                for at, left in (place for name, place in found.items() if name.startswith(INDEXES)):
                    for lines in _lines(source, at, left):
                        rows = [json.loads(x[x.index(b"{"):]) for x in lines if x.strip() and not x.startswith(b"!")]
                        starts = [_start(data, row.get("filename"), path) + int(row["offset"]) for row in rows]
                        yield pa.RecordBatch.from_pydict({
                            "path": pa.array([path] * len(rows), pa.string()), "offset": pa.array(starts, pa.int64()),
                            "length": pa.array([int(row["length"]) for row in rows], pa.int64())})

    return manifest.select("path").mapInArrow(listed, "path string, offset long, length long")


def _start(data: dict[str, int], filename: str | None, path: str) -> int:
    if filename is None and len(data) == 1:
        return next(iter(data.values()))
    name = (filename or "").removeprefix(ARCHIVES)
    if name not in data:
        raise ValueError(f"{path} has no stored member for {filename!r}")
    return data[name]


def _lines(source, at: int, left: int) -> Iterator[list[bytes]]:
    """Lines of a member, a block at a time; the last one may lack its end."""
    source.seek(at)
    rest, packed = b"", None
    while left:
        block = source.read(min(left, READ_BYTES))
        if not block:
            raise ValueError("a member ends early")
        left -= len(block)
        if packed is None:
            packed = block.startswith(GZIP)
            unpacker = zlib.decompressobj(31)
        if not packed:
            *lines, rest = (rest + block).split(b"\n")
            yield lines
        while packed and block:  # a gzip file may have several parts
            *lines, rest = (rest + unpacker.decompress(block, READ_BYTES)).split(b"\n")
            yield lines
            block = unpacker.unconsumed_tail
            if unpacker.eof:
                block, unpacker = unpacker.unused_data, zlib.decompressobj(31)
    if packed:
        rest += unpacker.flush()
    yield rest.split(b"\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC header fields in lower case, HTTP header (empty where the record holds no HTTP), and
    payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.lower()] = value.strip()
    block = rest[:int(fields["content-length"])]
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, b"", block
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


def _row(data: bytes, payloads: bool, where: str) -> tuple:
    """One record as a row of ``READ_SCHEMA``; ``data`` is a gzip member or plain."""
    fields, http, body = parse(zlib.decompress(data, 31) if data.startswith(GZIP) else data)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
    whole = kind != "revisit"
    if whole and digest and digest.lower().startswith("sha1:") and base32_sha1(body) != digest[5:].upper():
        raise ValueError(f"payload digest of {where}")
    stated = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    size = len(body) if whole else stated[0] if stated else None
    page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    if digest is None:
        digest = base32_sha1(body) if whole else None
    elif digest.lower().startswith("sha1:"):
        digest = digest[5:]
    return (None if page is None else int(page), fields.get("warc-target-uri"), kind, None if refers is None else int(refers),
            size, digest, body if whole and payloads else None)


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Every indexed record of the archives, read by range: page_id, url, record_type, refers_to,
    payload_bytes and payload_digest of the full payload, and the payload (null for a revisit).

    Archives need not be our own: page ids are null where a record has none, a digest that is lacking
    is worked out, the size of a revisit is what its HTTP header says, or null. A payload that does
    not match its own SHA-1 digest is an error, and so is a record cut short.
    """
    spark = manifest.sparkSession
    found = stored(places(manifest, folder).distinct())
    wanted = found.count()

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        path, source, held, start = None, None, b"", 0
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for i, row in enumerate(rows):
                if row["path"] != path:
                    source, path, held, start = store.open_input_file(row["path"]), row["path"], b"", 0
                end = row["offset"] + row["length"]
                if not start <= row["offset"] <= end <= start + len(held):
                    start, upto = row["offset"], end
                    for after in rows[i + 1:]:  # neighbours come in the same read
                        if after["path"] != path or not upto <= after["offset"] <= upto + GAP or after["offset"] + after["length"] - start > READ_BYTES:
                            break
                        upto = after["offset"] + after["length"]
                    source.seek(start)
                    held = source.read(upto - start)
                out.append(_row(held[row["offset"] - start:end - start], payloads, f"{path} at {row['offset']}"))
                if len(out) == 256:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    dealt = found.repartitionByRange(n_partitions(spark, wanted, 20_000), "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(fetch, READ_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * 7
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
