"""Media columns: content-defined chunks in a store, ordered chunk lists that rebuild them.

Texts become 8-bit mono samples in WAV form. A gear hash over the last 32 bytes cuts a
file where its leading bits are zero; chunks are named by digest. Tasks write the chunks
new to them, in compressed blocks, to pack files in the cluster's shared folder, and
return where each lies. Spark joins on the digests choose one place for every chunk;
files are lists of places. Reading back takes byte ranges of the packs in order, so
payloads are never shuffled; equal files are read once.

A retried task writes a pack of a new name; only packs that the index names are read.
Tasks know only their own chunks, so a chunk may be in several packs at first. compact()
writes the chosen copies of packs with more than WASTE of unread bytes anew, and deletes
these packs once the table of new places is written.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.runtime import new_path, prepare, stage

UNIT, RATE = 64, 8000
#: Bytes of a chunk, least, about, most; bytes of a compressed block; of a pack; read in one range.
LEAST, BITS, MOST = 1024, 12, 32768
BLOCK_BYTES, PACK_BYTES, RANGE_BYTES = 128 << 10, 64 << 20, 1 << 20
WINDOW = 32
#: Share of a pack's bytes that copies chosen elsewhere may take before it is written anew.
WASTE = 0.0
#: Gear table: a fixed pseudo-random number for each byte.
GEAR = np.random.default_rng(10).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> bytes:
    """The text in UTF-8, with bytes 0 up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % UNIT if data else UNIT)


def to_wav(samples: bytes) -> bytes:
    """8-bit unsigned mono samples as a WAV file."""
    head = b"RIFF" + struct.pack("<I", 36 + len(samples)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data" or struct.unpack_from("<HHIIHH", media, 20) != (1, 1, RATE, RATE, 1, 8):
        raise ValueError("no 8-bit mono WAV file")
    n = struct.unpack_from("<I", media, 40)[0]
    if len(media) != 44 + n:
        raise ValueError("cut-off WAV file")
    return media[44:]


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash of the WINDOW bytes up to each byte, by doubling the window."""
    h, w = GEAR[data], 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data: where the hash's leading bits are zero, LEAST to MOST bytes apart; the last may be shorter."""
    n, out, at = len(data), [], 0
    marks = np.flatnonzero(rolling(np.frombuffer(data, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1 if n > LEAST else np.empty(0, np.int64)
    while n - at > LEAST:
        k = np.searchsorted(marks, at + LEAST)
        end = min(int(marks[k]) if k < len(marks) else n, at + MOST, n)
        out.append(end)
        at = end
    if at < n or not out:
        out.append(n)
    return out


class PackWriter:
    """Chunks in compressed blocks, one after the other."""

    def __init__(self, folder: str):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}.pack"
        self.file = self.system.open_output_stream(f"{path}/{self.name}")
        self.at, self.size, self.buffer, self.waiting = 0, 0, bytearray(), []
        self.places: list[tuple] = []
        self.known: set[bytes] = set()
        self.zstd = zstandard.ZstdCompressor(level=3)

    def add(self, digest: bytes, chunk: bytes) -> None:
        if digest in self.known:
            return
        self.known.add(digest)
        self.waiting.append((digest, len(self.buffer), len(chunk)))
        self.buffer += chunk
        self.size += len(chunk)
        if len(self.buffer) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            block = self.zstd.compress(bytes(self.buffer))
            self.file.write(block)
            self.places += [(d, self.name, self.at, len(block), start, n) for d, start, n in self.waiting]
            self.at += len(block)
            self.buffer, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.flush()
        self.file.close()
        return self.places


_PLACE = ["digest", "pack", "block", "block_bytes", "start", "n"]
_FILE = ["doc_id", "n_bytes", "media_sha256", "chunks"]


def _write(folder: str, kind: pa.DataType):
    """Texts to packs; returns rows of two kinds: files (doc_id, n_bytes, media_sha256, chunks), and places of chunks."""
    types = [kind, pa.int64(), pa.string(), pa.list_(pa.binary()), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch(files, places):
        cols = list(zip(*files, strict=True)) if files else [[]] * 4
        more = list(zip(*places, strict=True)) if places else [[]] * 6
        none, null = [None] * len(places), [None] * len(files)
        return pa.RecordBatch.from_arrays([pa.array([*c, *none], t) for c, t in zip(cols, types[:4], strict=True)] + [pa.array([*null, *c], t) for c, t in zip(more, types[4:], strict=True)], [*_FILE, *_PLACE])

    def run(batches):
        writer = None
        for b in batches:
            files, places = [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = payload(text)
                media, at, chunks = to_wav(raw), 0, []
                writer = writer or PackWriter(folder)
                for end in chunk_ends(media):
                    piece = media[at:end]
                    digest = hashlib.sha256(piece).digest()[:20]
                    writer.add(digest, piece)
                    chunks.append(digest)
                    at = end
                files.append((doc_id, len(text.encode("utf-8", "replace")) if text else 0, hashlib.sha256(media).hexdigest(), chunks))
                if writer.size >= PACK_BYTES:
                    places += writer.close()
                    writer = None
            yield batch(files, places)
        if writer:
            yield batch([], writer.close())

    return run


class PackReader:
    """Chunks by place; keeps one range of a pack and the last blocks, as places come mostly in order."""

    def __init__(self, folder: str):
        self.system, self.path = fs.FileSystem.from_uri(folder)
        self.name, self.file, self.range, self.range_at = None, None, b"", 0
        self.blocks: dict[tuple, bytes] = {}
        self.zstd = zstandard.ZstdDecompressor()

    def _range(self, pack: str, at: int, n: int) -> bytes:
        if pack != self.name:
            if self.file:
                self.file.close()
            self.name, self.file, self.range, self.range_at = pack, self.system.open_input_file(f"{self.path}/{pack}"), b"", 0
        if not self.range_at <= at <= at + n <= self.range_at + len(self.range):
            self.range, self.range_at = self.file.read_at(max(n, RANGE_BYTES), at), at
        return self.range[at - self.range_at : at - self.range_at + n]

    def chunk(self, pack: str, block: int, block_bytes: int, start: int, n: int) -> bytes:
        key = (pack, block)
        if key not in self.blocks:
            if len(self.blocks) >= 16:
                self.blocks.pop(next(iter(self.blocks)))
            self.blocks[key] = self.zstd.decompress(self._range(pack, block, block_bytes))
        return self.blocks[key][start : start + n]


def feature(samples: bytes) -> str:
    """Mean, root mean square about the middle, crossings of the middle, and the loudest of eight stretches."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    energy = [int((p * p).sum()) for p in np.array_split(x, 8)]
    return f"mean={x.sum() / len(x) + 128:.4f};rms={(sum(energy) / len(x)) ** 0.5:.4f};crossings={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())};loudest={int(np.argmax(energy))}"


def _read(folder: str):
    names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"]
    types = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        reader = PackReader(folder)
        for b in batches:
            rows = []
            for name, places in zip(b.column("media").to_pylist(), b.column("places").to_pylist(), strict=True):
                media = b"".join([reader.chunk(p["pack"], p["block"], p["block_bytes"], p["start"], p["n"]) for p in places])
                if hashlib.sha256(media).digest() != name:
                    raise ValueError(f"file {name.hex()} isn't what was stored")
                samples = from_wav(media)
                rows.append((name, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), len(media), feature(samples)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _rewrite(folder: str):
    """Rows (pack, live: places of the chosen chunks in order) to packs of these chunks only; returns their new places."""

    def run(batches):
        reader = PackReader(folder)
        for b in batches:
            for pack, live in zip(b.column("pack").to_pylist(), b.column("live").to_pylist(), strict=True):
                writer = PackWriter(folder)
                for x in live:
                    writer.add(x["digest"], reader.chunk(pack, x["block"], x["block_bytes"], x["start"], x["n"]))
                cols = zip(*writer.close(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), *[pa.int64()] * 4), strict=True)], _PLACE)

    return run


def _delete(folder: str):
    def run(batches):
        system, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                info = system.get_file_info(f"{path}/{name}")
                if info.type != fs.FileType.NotFound:  # a retried task may have been here before
                    system.delete_file(f"{path}/{name}")
            yield b

    return run


def compact(places: DataFrame, written: DataFrame, folder: str, waste: float = WASTE) -> DataFrame:
    """places (one for each chunk) after packs with more than waste of unread bytes are gone: new packs hold their chosen copies.

    written: pack and n of all copies written. A pack is one task's work, of bounded size. The new places are a table before
    anything is deleted, so executors that are lost in between only leave packs that nothing names. With waste 0 every
    chunk is stored once.
    """
    spark = prepare(places.sparkSession)
    chosen = places.select("digest", "place.*")
    sums = written.groupBy("pack").agg(F.sum("n").alias("all")).join(chosen.groupBy("pack").agg(F.sum("n").alias("read")), "pack", "left")
    poor = stage(sums.where(F.coalesce("read", F.lit(0)) < F.col("all") * (1 - waste)).select("pack"), "media-poor")
    live = chosen.join(poor, "pack").groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("block", "start", "block_bytes", "n", "digest"))).alias("live"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = "digest binary, pack string, block long, block_bytes long, start long, n long"
    new = stage(live.repartition(tasks, "pack").mapInArrow(_rewrite(folder), schema), "media-compacted")
    poor.repartition(tasks, "pack").mapInArrow(_delete(folder), "pack string").write.format("noop").mode("overwrite").save()
    return chosen.join(poor, "pack", "left_anti").select(*_PLACE).unionByName(new).select("digest", F.struct(*_PLACE[1:]).alias("place"))


def store(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store every text of docs in folder: files (doc_id, n_bytes, media_sha256, chunks), one place for every chunk, and all copies written (pack, n)."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = f"doc_id {kind.simpleString()}, n_bytes long, media_sha256 string, chunks array<binary>, digest binary, pack string, block long, block_bytes long, start long, n long"
    wrote = stage(docs.select("doc_id", "text").mapInArrow(_write(folder, to_arrow_type(kind)), schema), "media-index")
    places = wrote.where("digest is not null").groupBy("digest").agg(F.min(F.struct(*_PLACE[1:])).alias("place"))
    return wrote.where("digest is null").select(*_FILE), places, wrote.where("digest is not null").select("pack", "n")


def rebuild(files: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """media (the SHA-256 of media_sha256, as bytes), payload_bytes, payload_sha256, tail_crc32, media_bytes, feature of every distinct file, from its stored chunks."""
    spark = prepare(files.sparkSession)
    distinct = files.groupBy(F.unhex("media_sha256").alias("media")).agg(F.first("chunks").alias("chunks"))
    refs = distinct.select("media", F.posexplode("chunks").alias("k", "digest")).join(places, "digest")
    lists = refs.groupBy("media").agg(F.sort_array(F.collect_list(F.struct("k", "place"))).alias("l"))
    lists = lists.select("media", F.transform("l", lambda x: x["place"]).alias("places"))
    lists = lists.withColumn("at", F.struct(F.col("places")[0]["pack"].alias("p"), F.col("places")[0]["block"].alias("b"), F.col("places")[0]["start"].alias("s")))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = stage(lists, "media-lists").repartitionByRange(tasks, "at").sortWithinPartitions("at").select("media", "places")
    return laid.mapInArrow(_read(folder), "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every row of docs.

    A null text is stored like an empty one. Equal texts have equal values. Repeated rows each keep a row; a null doc_id
    stays; further columns are not read. No rows give no rows.
    """
    folder = new_path(docs.sparkSession, "media")
    files, places, written = store(docs, folder)
    places = compact(places, written, folder)
    read = stage(rebuild(files, places, folder), "media-read")
    own = files.select("doc_id", "n_bytes", "media_sha256", F.unhex("media_sha256").alias("media"))
    return own.join(read, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
