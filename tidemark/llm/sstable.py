"""Token ids in sorted-string-table shards: written by Spark tasks in key order, looked up by binary search.

A shard: magic; data blocks; block index; Bloom filter; footer. A key is the doc_id as
eight big-endian bytes with the sign bit turned, so that bytes sort as ids do (a null id is
the empty key). In a block a key is stored as the number of leading bytes it shares with
the key before it and the rest; the first key of a block is whole. The index has a line for
each block only. A value is a width (2 or 4) and the ids in that many little-endian bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.textvec import mixed
from tidemark.session import materialize, scratch_path

MAGIC = b"TMSST001"
ENTRY = struct.Struct("<BBI")
LINE = struct.Struct("<B8sB8sQIIIQ")
FOOTER = struct.Struct("<QIQIQQI8s")
#: A block is closed once it has so many bytes; a longer value makes a longer block.
BLOCK = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: A shard is closed once it has so many bytes or entries, and its task goes on with another: so index and Bloom filter stay small.
SHARD_BYTES, SHARD_ENTRIES = 256 << 20, 1 << 20
#: Keys that are put into the Bloom filter at once.
BLOOM_KEYS = 1 << 16


#: Names that Hadoop has for stores which Arrow knows by other names.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "abfs://": "abfss://", "dbfs:/": "file:///dbfs/"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it, and the path there."""
    for theirs, ours in SCHEMES.items():
        if path.startswith(theirs):
            path = ours + path[len(theirs) :].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = mixed(keys), mixed(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return (a[:, None] + b[:, None] * np.arange(BLOOM_HASHES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes (doc_id, ids as little-endian unsigned 32-bit bytes) in ascending order to a stream."""

    def __init__(self, out):
        self.out, self.at = out, out.write(MAGIC)
        self.block, self.first, self.last, self.held, self.held_ids = [], b"", b"", 0, 0
        self.lines: list[bytes] = []
        self.keys = array("q")
        self.entries = self.ids = self.bytes = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key, value = key_of(doc_id), np.frombuffer(ids, "<u4")
        wide = 4 if len(value) and int(value.max()) > 0xFFFF else 2
        body = bytes([wide]) + (ids if wide == 4 else value.astype("<u2").tobytes())
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += [ENTRY.pack(shared, len(key) - shared, len(body)), key[shared:], body]
        self.last, self.held, self.held_ids = key, self.held + 1, self.held_ids + len(value)
        self.bytes += ENTRY.size + len(key) - shared + len(body)
        if doc_id is not None:
            self.keys.append(doc_id)
        if self.bytes >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        data = b"".join(self.block)
        self.lines.append(LINE.pack(len(self.first), self.first, len(self.last), self.last, self.at, len(data), zlib.crc32(data), self.held, self.held_ids))
        self.at += self.out.write(data)
        self.entries, self.ids = self.entries + self.held, self.ids + self.held_ids
        self.block, self.bytes, self.held, self.held_ids = [], 0, 0, 0

    def close(self) -> None:
        if self.block:
            self._close_block()
        index = b"".join(self.lines)
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom, keys = np.zeros(bits, np.uint8), np.frombuffer(self.keys, np.int64).astype(np.uint64)
        for i in range(0, len(keys), BLOOM_KEYS):
            bloom[_bloom_places(keys[i : i + BLOOM_KEYS], bits).ravel().astype(np.int64)] = 1
        packed = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(index)
        self.out.write(packed)
        self.out.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), self.entries, self.ids, zlib.crc32(index), MAGIC))


class Reader:
    """Reads a shard: all of it in order, or one key through the Bloom filter and the index."""

    def __init__(self, path: str):
        system, inner = opened(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        at, length, bloom_at, bloom_length, self.entries, self.ids, crc, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        index = self.file.read_at(length, at)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError(f"{path} isn't a whole shard")
        self.lines = [LINE.unpack_from(index, i) for i in range(0, length, LINE.size)]
        self.last = [x[3][: x[2]] for x in self.lines]
        packed = self.file.read_at(bloom_length, bloom_at)
        self.bits, self.bloom = struct.unpack_from("<Q", packed)[0], np.frombuffer(packed, np.uint8, offset=8)

    def _block(self, line) -> Iterator[tuple[int | None, np.ndarray]]:
        data = self.file.read_at(line[5], line[4])
        if zlib.crc32(data) != line[6]:
            raise ValueError("a block is damaged")
        at, key = 0, b""
        for _ in range(line[7]):
            shared, rest, length = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield id_of(key), np.frombuffer(data, "<u2" if data[at] == 2 else "<u4", (length - 1) // data[at], at + 1).astype("<u4")
            at += length

    def __iter__(self):
        for line in self.lines:
            yield from self._block(line)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry of a key, in the order written; none for an absent key."""
        key = key_of(doc_id)
        if doc_id is not None:
            at = _bloom_places(np.array([doc_id], np.int64).astype(np.uint64), self.bits)[0].astype(np.int64)
            if not (self.bloom[at >> 3] >> (7 - (at & 7)) & 1).all():
                return []
        found = []
        for line in self.lines[bisect_left(self.last, key) :]:
            if line[1][: line[0]] > key:
                break
            found += [ids for k, ids in self._block(line) if k == doc_id]
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, shard_bytes: int = SHARD_BYTES, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """Encode every whole text and write shards below ``folder``; returns the manifest.

    One range shuffle brings rows into the order of doc_id, then of a hash of the text and
    the text itself, so that repeated ids have one order too; nulls come first. Each task
    encodes its range and writes it as files under names of their own, so a task that runs
    again does no harm: only files named in the manifest (shard, part, path, n_entries, n_ids,
    low, high) count. A file is closed at ``shard_bytes`` or ``shard_entries``, whichever comes
    first, so what a task and a reader hold of it (keys, index, filter) doesn't grow with the
    range; entries of one id may then be in several files, and :func:`lookup` opens them all.
    A null text is empty and still has the end id; a long one is a long value of one block. Columns other than doc_id and text are ignored, whatever their names. An
    empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "shards")
    vocabulary = vocabulary or tokens.vocabulary_path()
    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)

    kind = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_entries", pa.int64()), ("n_ids", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, writer, low, high = TaskContext.get().partitionId(), 0, None, None, None
        encoder = tokens.encoder(vocabulary)

        def finished() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            row = {"shard": [shard], "part": [part], "path": [path], "n_entries": [writer.entries], "n_ids": [writer.ids], "low": [low], "high": [high]}
            return pa.RecordBatch.from_pydict(row, kind)

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                if writer is None:
                    path = f"{folder}/shard-{shard:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                    there, at = opened(path)
                    writer, low = Writer(there.open_output_stream(at)), doc_id
                writer.add(doc_id, ids)
                high = doc_id
                if writer.at + writer.bytes >= shard_bytes or writer.entries + writer.held >= shard_entries:
                    yield finished()
                    writer, part = None, part + 1
        if writer is not None:
            yield finished()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    written = ordered.select("doc_id", "text").mapInArrow(write, "shard int, part int, path string, n_entries long, n_ids long, low long, high long")
    return materialize(written, "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Read every entry back from the files: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids before the entry over all shards: a running sum over the
    manifest, which has one row per file, plus a running sum while a file is read.
    """
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start")).repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist()):
                reader, rows = Reader(path), []
                for doc_id, ids in reader:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _rows(rows)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kind = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=kind)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """The ids stored for one key: only shards whose range holds it are opened."""
    same = F.col("low").isNull() if doc_id is None else (F.coalesce("low", F.lit(doc_id)) <= doc_id) & (F.col("high") >= doc_id)
    found = []
    for row in manifest.where(same).orderBy("shard", "part").collect():
        reader = Reader(row["path"])
        found += reader.get(doc_id)
        reader.close()
    return found
