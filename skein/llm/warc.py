"""WARC records in ZIP packages, written and read back by byte range.

A package holds stored (not deflated) members: ``archive/data.warc.gz``, a WARC file of
single-record gzip members, and ``indexes/index.cdxj``, a line a record with its sortable
address, time stamp, and offset and length in the WARC file. Records are HTTP responses, or
revisits that keep the response's HTTP header. The reader parses the end-of-central-directory record, its
ZIP64 form and the central directory, finds the members through their local headers,
and range-reads records; nothing is extracted.

Packages are written by the tasks into the cluster's shared folder, through pyarrow's
file systems. A retried task writes a package of a new name; the manifest, a Spark
table, names the packages that count.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import new_path, prepare, stage

REVISIT_BYTES = 1000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Payload bytes of a package, about; records that the reader takes in one range.
PACKAGE_BYTES, RANGE_BYTES = 32 << 20, 4 << 20
#: Fixed values of the ZIP format: signatures, and sizes from which a field needs ZIP64.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF
#: ZIP's date of 1980-01-01, and the date of every record, as pages have none.
_DATE = 0x21
RECORD_DATE = "2000-01-01T00:00:00Z"


class PackageWriter:
    """Stored members one after the other, then the central directory. zip64: write ZIP64 records even where not needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> None:
        raw, crc, start = name.encode(), zlib.crc32(data), self.at
        big = self.zip64 or len(data) >= _MAX32
        size = _MAX32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        self._put(_LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, _DATE, crc, size, size, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append((raw, crc, len(data), start))

    def close(self) -> None:
        start = self.at
        for raw, crc, n, offset in self.members:
            big = self.zip64 or max(n, offset) >= _MAX32
            size, at = (_MAX32, _MAX32) if big else (n, offset)
            extra = struct.pack("<HHQQQ", 1, 24, n, n, offset) if big else b""
            self._put(_CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, _DATE, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, at) + raw + extra)
        size, n, end = self.at - start, len(self.members), self.at
        if self.zip64 or max(size, start) >= _MAX32 or n >= _MAX16:
            self._put(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._put(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
            n, size, start = min(n, _MAX16), _MAX32, _MAX32
        self._put(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def read_at(f, offset: int, n: int) -> bytes:
    """Exactly the n bytes at offset of an open random-access file."""
    f.seek(offset)
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{n} bytes expected at {offset}, {len(data)} found")
    return data


def directory(f, size: int) -> dict[str, tuple[int, int]]:
    """Offset and length of the data of every stored member of the package f of that size."""
    tail_at = max(0, size - 22 - _MAX16)
    tail = read_at(f, tail_at, size - tail_at)
    end = tail.rfind(_END)
    while end >= 0 and (len(tail) - end < 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
        end = tail.rfind(_END, 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == _MAX16 or _MAX32 in (length, start):
        locator = read_at(f, tail_at + end - 20, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        record = read_at(f, struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != _END64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    found, at, central = {}, 0, read_at(f, start, length)
    for _ in range(count):
        if central[at : at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        method, packed, full, n_name, n_extra, n_note, offset = struct.unpack_from("<10xH8xIIHHH8xI", central, at)[0:7]
        name = central[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = central[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_note
        k = 0
        while k + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, k + 4))
                full = next(values) if full == _MAX32 else full
                packed = next(values) if packed == _MAX32 else packed
                offset = next(values) if offset == _MAX32 else offset
            k += 4 + n
        if method == 0:
            local = read_at(f, offset, 30)
            if local[:4] != _LOCAL:
                raise ValueError("damaged local header")
            found[name] = (offset + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
    return found


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    always = [("WARC-Date", RECORD_DATE), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, *always])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    data = gzip.decompress(member)
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return headers, block


def http_header(n: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()


def http_parse(block: bytes) -> tuple[int, bytes]:
    """Length of the payload by its header, and the payload as far as it is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    return int(fields[b"Content-Length"]), body


def sortable(url: str) -> str:
    """The address as indexes sort it: host parts reversed, then path and query; no blanks."""
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(.*)", url, re.S)
    key = f"{','.join(reversed(m[1].lower().split('.')))}){m[2] or '/'}" if m else url
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", key) or "-"


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def _open(uri: str):
    return fs.FileSystem.from_uri(uri)


def _writer(folder: str):
    def run(batches):
        warc, index, rows, size = io.BytesIO(), [], 0, 0

        def flush():
            nonlocal warc, index, rows, size
            if rows:
                out, path = _open(folder)
                name = f"{path}/{uuid.uuid4().hex}.wacz"
                out.create_dir(path, recursive=True)
                with out.open_output_stream(name) as f:
                    package = PackageWriter(f)
                    package.add(DATA, warc.getvalue())
                    package.add(INDEX, "".join(sorted(index)).encode())
                    package.close()
                    total = package.at
                yield pa.RecordBatch.from_pydict({"package": [f"{folder}/{name.rsplit('/', 1)[1]}"], "n_bytes": [total], "n_records": [rows]})
            warc, index, rows, size = io.BytesIO(), [], 0, 0

        for b in batches:
            for page_id, url, payload, digest, kept in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "kept")), strict=True):
                revisit = kept is not None and kept != page_id
                headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Target-URI", _one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
                if revisit:
                    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{kept}>")]
                member = record("revisit" if revisit else "response", headers, http_header(len(payload)) + (b"" if revisit else payload))
                line = {"url": _one_line(url), "digest": f"sha1:{digest}", "mime": "warc/revisit" if revisit else "text/html", "filename": DATA.rsplit("/", 1)[1], "offset": str(warc.tell()), "length": str(len(member))}
                index.append(f"{sortable(url or '')} {re.sub('[^0-9]', '', RECORD_DATE)} {json.dumps(line)}\n")
                warc.write(member)
                rows, size = rows + 1, size + len(payload)
                if size >= PACKAGE_BYTES:
                    yield from flush()
        yield from flush()

    return run


def write_packages(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) to packages in folder; returns the manifest (package, n_bytes, n_records).

    Of equal payloads of at least `least` bytes the one with the largest page_id is a response, as are all rows of that
    page_id; the others are revisits. A null html is an empty payload, a null url an empty address; null page_ids are
    written as None and never kept. Very long pages are written whole, in a package of their own if need be.
    """
    prepare(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    big = F.octet_length("payload") >= least
    kept = rows.where(big).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("c")).where("c > 1").drop("c")
    rows = rows.join(stage(kept.withColumnRenamed("digest", "same"), "warc-kept"), F.col("digest") == F.col("same"), "left")
    return stage(rows.select("page_id", "url", "payload", "digest", F.when(big, F.col("kept")).alias("kept")).mapInArrow(_writer(folder), "package string, n_bytes long, n_records long"), "warc-manifest")


def _ranges(index: list[dict]):
    """Consecutive records, as many as fit RANGE_BYTES."""
    at = 0
    while at < len(index):
        end = at + 1
        while end < len(index) and index[end]["offset"] + index[end]["length"] - index[at]["offset"] <= RANGE_BYTES:
            end += 1
        yield index[at:end]
        at = end


def _reader(batches):
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    page = lambda v: None if v in (None, "<urn:page:None>") else int(v[len("<urn:page:") : -1])
    for b in batches:
        for package, size in zip(b.column("package").to_pylist(), b.column("n_bytes").to_pylist(), strict=True):
            system, path = _open(package)
            with system.open_input_file(path) as f:
                members = directory(f, size)
                data_at, _ = members[DATA]
                index = [json.loads(line.split(b" ", 2)[2]) for line in read_at(f, *members[INDEX]).split(b"\n")[:-1]]
                index = sorted((x | {k: int(x[k]) for k in ("offset", "length")} for x in index), key=lambda x: x["offset"])
                for part in _ranges(index):
                    first = part[0]["offset"]
                    chunk, rows = read_at(f, data_at + first, part[-1]["offset"] + part[-1]["length"] - first), []
                    for x in part:
                        headers, block = parse(chunk[x["offset"] - first : x["offset"] - first + x["length"]])
                        digest, (n, body) = headers["WARC-Payload-Digest"].removeprefix("sha1:"), http_parse(block)
                        if headers["WARC-Type"] == "response":
                            if len(body) != n or hashlib.sha1(body).hexdigest() != digest:
                                raise ValueError(f"record {headers['WARC-Record-ID']} isn't what was written")
                        rows.append((page(headers["WARC-Record-ID"]), x["url"], n, digest, headers["WARC-Type"], page(headers.get("WARC-Refers-To"))))
                    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read_packages(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record in the manifest's packages (package, n_bytes)."""
    prepare(manifest.sparkSession)
    tasks = max(1, min(manifest.count(), 10_000))
    spread = manifest.select("package", "n_bytes").repartition(tasks)
    return spread.mapInArrow(_reader, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to packages in the shared folder and read the records back.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url (null: empty), one row per row of pages. Repeated
    rows of the largest page_id of their payload are responses all. Extra columns are not read. No rows give no rows.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")

