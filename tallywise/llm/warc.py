"""WARC records in ZIP packages: a writer, and a reader that fetches byte ranges.

The writer's packages are ZIPs with stored members: ``archive/data.warc.gz`` (each record a gzip
member of its own) and ``indexes/index.cdxj`` (one JSON line per record: id, offset, length).  The
reader is given only a function ``read(offset, length)`` and the size.  It finds the end-of-directory
record, the ZIP64 one where there is one, the central directory and the members, and then fetches
each record by its range; nothing is extracted.  It takes any number of ``archive/*.warc`` and
``*.warc.gz`` members, which must be stored, and any ``indexes/*`` of CDXJ lines (key, timestamp and JSON, or
JSON alone; also gzipped or deflated).  Of an archive member that no index names, all records are
found by reading through it; other members are passed over.

Packages travel as rows of a table in the shared folder, so any store that Spark reads will do, and
a lost task only repeats its own packages.  Of package files, tasks get (path, offset, length) rows
and read just these ranges, so files may be of any size; where Arrow cannot open the store, files
come whole through ``binaryFile``, which takes up to 2 GiB each.

Records of other writers have a null page_id; their payload is what follows the HTTP head (the whole
block of records that are not HTTP), and their digest is taken as it is, or computed where absent.

Payloads are the html in UTF-8; null is empty.  Of equal payloads of at least ``min_bytes`` bytes,
that of the smallest page_id is the response (of all rows that repeat this page_id too), the others
are revisits of it.  A null page_id sorts last and is never referred to unless alone.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywise.llm.common import slices, split_join
from tallywise.sources.staging import staged

#: A package is closed once its records have this many bytes; members are read through, and ranges dealt to tasks, by so many.
PACKAGE_BYTES, CHUNK, DEALT_BYTES = 8 << 20, 1 << 20, 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format: signatures, and the layout of the records that follow them.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_FORM, CENTRAL_FORM, END_FORM = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH"
END64_FORM, LOCATOR64_FORM = "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP of stored members; sizes and offsets go to ZIP64 fields where they need to, or if asked."""
    out, directory = bytearray(), bytearray()
    for name, content in members:
        at, crc, title = len(out), zlib.crc32(content), name.encode()
        large = zip64 or max(len(content), at) >= FULL32
        size = FULL32 if large else len(content)
        extra = struct.pack("<2H2Q", 1, 16, len(content), len(content)) if large else b""
        out += struct.pack(LOCAL_FORM, LOCAL, 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(title), len(extra)) + title + extra + content
        extra = struct.pack("<2H3Q", 1, 24, len(content), len(content), at) if large else b""
        directory += struct.pack(CENTRAL_FORM, CENTRAL, 45, 45 if large else 20, 0x800, 0, 0, 33, crc, size, size, len(title), len(extra), 0, 0, 0, 0, FULL32 if large else at) + title + extra
    start, n = len(out), len(members)
    out += directory
    large = zip64 or n >= FULL16 or len(out) >= FULL32
    if large:
        end64 = len(out)
        out += struct.pack(END64_FORM, END64, 44, 45, 45, 0, 0, n, n, len(directory), start)
        out += struct.pack(LOCATOR64_FORM, LOCATOR64, 0, end64, 1)
    out += struct.pack(END_FORM, END, 0, 0, *((FULL16, FULL16, FULL32, FULL32) if large else (n, n, len(directory), start)), 0)
    return bytes(out)


def zip_directory(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int, int]]:
    """The members: name to (compression method, offset of the local header, packed length)."""
    tail_at = max(0, size - 22 - FULL16)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END)
    if end < 0:
        raise ValueError("not a ZIP: no end of central directory")
    count, length, start = struct.unpack_from(END_FORM, tail, end)[4:7]
    if FULL16 == count or FULL32 in (length, start):
        signature, _, at, _ = struct.unpack(LOCATOR64_FORM, read(tail_at + end - 20, 20))
        if signature != LOCATOR64:
            raise ValueError("not a ZIP64: no locator")
        fields = struct.unpack(END64_FORM, read(at, 56))
        if fields[0] != END64:
            raise ValueError("not a ZIP64: no end record")
        count, length, start = fields[7:10]
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        f = struct.unpack_from(CENTRAL_FORM, directory, at)
        if f[0] != CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, plain, n_name, n_extra, n_note, offset = f[4], f[8], f[9], f[10], f[11], f[12], f[16]
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if f[3] & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            extra = extra[4 + n :]
        found[name] = (method, offset, packed)
        at += 46 + n_name + n_extra + n_note
    return found


def member_bytes(read: Callable[[int, int], bytes], offset: int) -> int:
    """Where the bytes of the member with this local header begin."""
    n_name, n_extra = struct.unpack("<2H", read(offset + 26, 4))
    return offset + 30 + n_name + n_extra


def zip_members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """Where the bytes of each stored member are: name to (offset, length)."""
    return {name: (member_bytes(read, offset), packed) for name, (method, offset, packed) in zip_directory(read, size).items() if not method}


def _chunks(read: Callable[[int, int], bytes], at: int, n: int) -> Iterator[bytes]:
    for i in range(0, n, CHUNK):
        yield read(at + i, min(CHUNK, n - i))


def _unpacked(chunks: Iterator[bytes], form: int) -> Iterator[bytes]:
    """What is in a deflated stream, or in gzip members one behind another (form as ``wbits`` of zlib)."""
    z = zlib.decompressobj(form)
    for data in chunks:
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                if form < 0:
                    return
                z = zlib.decompressobj(form)


def _lines(chunks: Iterator[bytes]) -> Iterator[bytes]:
    rest = b""
    for data in chunks:
        *whole, rest = (rest + data).split(b"\n")
        yield from whole
    yield rest


def gzip_ranges(read: Callable[[int, int], bytes], at: int, n: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each gzip member of a range."""
    z, start, done = zlib.decompressobj(31), at, at
    for data in _chunks(read, at, n):
        done += len(data)
        while data:
            z.decompress(data)
            data = z.unused_data
            if z.eof:
                yield start, done - len(data) - start
                z, start = zlib.decompressobj(31), done - len(data)
    if start < at + n:
        raise ValueError("a gzip member is cut off")


def warc_ranges(read: Callable[[int, int], bytes], at: int, n: int) -> Iterator[tuple[int, int]]:
    """Offset and length of each record of an uncompressed WARC member."""
    end = at + n
    while at < end:
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            if at + len(head) >= end:
                raise ValueError("a WARC record is cut off")
            head += read(at + len(head), min(4096, end - at - len(head)))
        length = cut + 4 + int(re.search(rb"\ncontent-length:\s*(\d+)", head[:cut], re.I)[1])
        length = min(length + 4, end - at)
        yield at, length
        at += length


def record_ranges(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[int, int]]:
    """Offset and length in the package of each record."""
    found = zip_directory(read, size)
    archives = {}
    for name, (method, offset, n) in found.items():
        if re.fullmatch(r"archive/.*\.warc(\.gz)?", name, re.I):
            if method:
                raise ValueError(f"member {name} is not stored")
            archives[name] = (member_bytes(read, offset), n)
    named = set()
    for name, (method, offset, n) in found.items():
        if not re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name, re.I):
            continue
        if method not in (0, 8):
            raise ValueError(f"member {name} is neither stored nor deflated")
        chunks = _chunks(read, member_bytes(read, offset), n)
        chunks = _unpacked(chunks, -15) if method else chunks
        for line in _lines(_unpacked(chunks, 31) if name.lower().endswith(".gz") else chunks):
            said = line.strip() if line[:1] == b"{" else line.strip().partition(b" ")[2].partition(b" ")[2]
            if line[:1] in (b"!", b"@", b"#") or said[:1] != b"{":
                continue
            entry = json.loads(said)
            file = entry.get("filename")
            if file is None and len(archives) != 1:
                raise ValueError(f"{name} does not say which of the archive members it means")
            member = next(iter(archives)) if file is None else file if file in archives else f"archive/{file}"
            if member not in archives:
                raise ValueError(f"{name} names {file}, which is not in the package")
            at, length = archives[member]
            if int(entry["offset"]) + int(entry["length"]) > length:
                raise ValueError(f"{name} goes beyond the end of {member}")
            named.add(member)
            yield at + int(entry["offset"]), int(entry["length"])
    for member, (at, n) in archives.items():
        if member not in named:
            yield from (gzip_ranges if member.lower().endswith(".gz") else warc_ranges)(read, at, n)


def _line(value: object) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) keeps the full payload's digest and length but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _line(url or ""),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "X-Payload-Length": len(payload),
        "X-Page-Id": "" if page_id is None else page_id,
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-Id": refers_to}
    lines = "".join(f"{k}: {v}\r\n" for k, v in (head | {"Content-Length": len(block)}).items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload (empty for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    plain = {k.lower(): v for k, v in headers.items()}
    block = rest[: int(plain["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2] if plain.get("content-type", "").lower().startswith("application/http") else block


def package(records: list[tuple[int | None, bytes]]) -> bytes:
    data, index = bytearray(), []
    for page_id, record in records:
        packed = gzip.compress(record, 1, mtime=0)
        index.append(json.dumps({"page_id": page_id, "offset": len(data), "length": len(packed)}))
        data += packed
    return zip_stored([(DATA, bytes(data)), (INDEX, "\n".join(index).encode())])


def read_package(read: Callable[[int, int], bytes], size: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of a package, fetched by range."""
    for at, n in record_ranges(read, size):
        yield read_record(read(at, n))


def read_record(record: bytes) -> tuple[dict[str, str], bytes]:
    return parse_record(gzip.decompress(record) if record[:2] == b"\x1f\x8b" else record)


def write_packages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Packages (one per row, column ``package``) with a record for each row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    keys = staged(pages.select("page_id", "sha", F.octet_length("html").alias("n")))
    large = keys.filter(F.col("n") >= min_bytes)
    groups = staged(large.groupBy("sha").agg(F.min("page_id").alias("winner"), F.count(F.lit(1)).alias("times")).filter("times > 1 AND winner IS NOT NULL"))
    decided = split_join(large, groups, ["sha"], "times", keys.count()).filter("NOT page_id <=> winner")
    decided = staged(decided.select(F.col("page_id").alias("p"), F.col("sha").alias("s"), F.col("winner").alias("refers_to")).distinct())
    marked = pages.join(decided.hint("merge"), pages["page_id"].eqNullSafe(decided["p"]) & (pages["sha"] == decided["s"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, bytes]] = []
        weight = 0
        for batch in batches:
            for part in slices(batch, "html"):
                for page_id, url, html, refers_to in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = html.encode()
                    record = warc_record(page_id, url, payload, payload_digest(payload), refers_to)
                    held.append((page_id, record))
                    weight += len(record)
                    if weight >= PACKAGE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], ["package"])
                        held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([package(held)], pa.binary())], ["package"])

    return marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "package binary")


_NAMES = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_KINDS = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _row(headers: dict[str, str], payload: bytes) -> tuple:
    """A record's row; records of our writer are checked."""
    head = {k.lower(): v for k, v in headers.items()}
    number = lambda name: int(head[name]) if head.get(name) else None
    digest, n = head.get("warc-payload-digest"), number("x-payload-length")
    whole = head["warc-type"] != "revisit"
    digest = digest.removeprefix("sha1:") if digest is not None else payload_digest(payload) if whole else None
    if n is not None and head["warc-type"] == "response" and (len(payload) != n or payload_digest(payload) != digest):
        raise ValueError(f"the payload of page {head['x-page-id']} is damaged")
    return number("x-page-id"), head.get("warc-target-uri"), payload, len(payload) if n is None and whole else n, digest, head["warc-type"], number("x-refers-to-page-id")


def _batches(records: Iterator[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)
    rows, weight = [], 0
    for head, payload in records:
        rows.append(_row(head, payload))
        weight += len(payload)
        if weight >= PACKAGE_BYTES // 4:
            yield made(rows)
            rows, weight = [], 0
    if rows:
        yield made(rows)


def read_packages(packages: DataFrame, column: str = "package") -> DataFrame:
    """One row per record: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    ``payload_bytes`` and ``payload_digest`` are of the full payload, and are checked where the record holds it and is
    of our writer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(column):
                view = memoryview(item.as_buffer())
                yield from _batches(read_package(lambda at, n, view=view: bytes(view[at : at + n]), len(view)))

    return packages.select(column).mapInArrow(run, _SCHEMA)


def open_ranges(path: str) -> Callable[[int, int], bytes]:
    """``read(offset, length)`` of a file in a store that Arrow opens."""
    local = re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path)
    system, inside = (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(path)
    file = system.open_input_file(inside)
    return lambda at, n: file.read_at(n, at)


def read_package_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of package files, read by range, or whole where Arrow cannot open the store."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("path").first()
    try:
        if first:
            open_ranges(first["path"])
    except (OSError, ValueError, NotImplementedError):
        return read_packages(files, "content")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                held = []
                for r in record_ranges(open_ranges(name), size):
                    held.append((name, *r))
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["path", "offset", "length"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held, strict=True)], ["path", "offset", "length"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for batch in batches:

            def records(batch: pa.RecordBatch = batch) -> Iterator[tuple[dict[str, str], bytes]]:
                nonlocal last, read
                for name, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                    if name != last:
                        last, read = name, open_ranges(name)
                    yield read_record(read(at, n))

            yield from _batches(records())

    ranges = staged(files.select("path", "length").mapInArrow(find, "path string, offset long, length long"))
    parts = 1 + (ranges.agg(F.sum("length")).first()[0] or 0) // DEALT_BYTES
    return ranges.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(fetch, _SCHEMA)


def archived_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes a record per page, reads the packages back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_packages(staged(write_packages(pages, min_bytes))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(sha, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY sha) AS w FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = w THEN NULL ELSE w END AS refers_to
FROM b
"""
