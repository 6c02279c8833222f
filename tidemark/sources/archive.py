"""Company-facts archives: one ZIP of a document a company, as a Spark data source.

The central directory is read once, when the scan is planned; partitions are runs of entries of
about equal compressed size. A task opens the archive at an entry's offset and inflates that
entry alone, so what isn't asked for is never read. Paths are those of Arrow's file systems (file, hdfs, s3, gs, abfss).
"""

from __future__ import annotations

import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from tidemark.sources.facts import COMPANY, changed_files

LISTING = "cik string, name string, size long, compressed long, offset long, crc long, method int"
#: Compressed bytes of a partition.
PARTITION_BYTES = 64 << 20
#: Names that Hadoop has for stores which Arrow knows by other names.
_SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "abfs://": "abfss://"}
_NAME = re.compile(r"(?:^|/)CIK(\d{10})\.json$", re.IGNORECASE)
_HEADER = struct.Struct("<4s22xHH")


def opened(path: str) -> pa.NativeFile:
    for theirs, ours in _SCHEMES.items():
        if path.startswith(theirs):
            path = ours + path[len(theirs) :]
    system, inner = pafs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def directory(path: str) -> list[tuple]:
    """The archive's entries that are company documents, as :data:`LISTING` has them; only the directory at its end is read."""
    with opened(path) as file, zipfile.ZipFile(file) as archive:
        return [(m[1], e.filename, e.file_size, e.compress_size, e.header_offset, e.CRC, e.compress_type) for e in archive.infolist() if (m := _NAME.search(e.filename))]


def inflate(file: pa.NativeFile, offset: int, compressed: int, size: int, crc: int, method: int) -> bytes:
    """One entry's bytes. Raises ValueError if it is damaged or packed by a method other than stored or deflated."""
    mark, name, extra = _HEADER.unpack(file.read_at(_HEADER.size, offset))
    if mark != b"PK\x03\x04":
        raise ValueError("no entry begins here")
    data = file.read_at(compressed, offset + _HEADER.size + name + extra)
    if method == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompress(data, -15, size)
        except zlib.error as e:
            raise ValueError(str(e)) from None
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"packed by method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("length or checksum differ")
    return data


@dataclass
class Entries(InputPartition):
    path: str
    rows: list[tuple]


class _Reader(DataSourceReader):
    def __init__(self, path: str, documents: bool, partition_bytes: int):
        self.path, self.documents, self.partition_bytes = path, documents, partition_bytes
        self.wanted: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        parts, held, size = [], [], 0
        for entry in directory(self.path):
            if self.wanted is None or entry[0] in self.wanted:
                held.append(entry)
                size += entry[3] if self.documents else 100
                if size >= self.partition_bytes:
                    parts.append(Entries(self.path, held))
                    held, size = [], 0
        return [*parts, Entries(self.path, held)] if held or not parts else parts

    def read(self, partition: Entries) -> Iterator[tuple]:
        if not self.documents:
            yield from partition.rows
            return
        with opened(partition.path) as file:
            for entry in partition.rows:
                yield (*entry, *_document(file, *entry[2:]))


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Filters on cik choose entries while the scan is planned; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("cik",):
                self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
            elif isinstance(f, In) and f.attribute == ("cik",):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
            else:
                yield f


def _document(file: pa.NativeFile, size: int, compressed: int, offset: int, crc: int, method: int) -> tuple[str | None, str | None]:
    try:
        return inflate(file, offset, compressed, size, crc, method).decode("utf-8"), None
    except ValueError as e:
        return None, str(e)


class CompanyArchive(DataSource):
    """``spark.read.format("company_archive").load(path)``: a row for each company document of the archive.

    Option ``documents`` (true): whether documents are inflated, or only listed. A document that is damaged is null and
    has its ``error``. Option ``partitionBytes``: compressed bytes a task inflates. Option ``pushdown``: filters on cik choose
    entries before any is read; Spark allows it only where ``spark.sql.python.filterPushdown.enabled`` is set.
    """

    @classmethod
    def name(cls) -> str:
        return "company_archive"

    def schema(self) -> str:
        return LISTING + (", document string, error string" if self._documents() else "")

    def _documents(self) -> bool:
        return self.options.get("documents", "true").lower() == "true"

    def reader(self, schema) -> DataSourceReader:
        kind = _FilteringReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["path"], self._documents(), int(self.options.get("partitionBytes", PARTITION_BYTES)))


def read_archive(spark: SparkSession, path: str, documents: bool = True, **options: str) -> DataFrame:
    """The archive's documents, or their listing."""
    spark.dataSource.register(CompanyArchive)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("company_archive").options(documents=str(documents).lower(), pushdown=pushdown, **options).load(path)


def scan_changes(spark: SparkSession, path: str, state: DataFrame, allowed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """The listing with ``change`` (new, changed, same) against the ``state`` (cik, size) of the last run; with ``allowed`` (cik) of these only.

    Of entries that repeat a cik the last one counts. Unchanged entries are left out unless ``force``.
    """
    listing = read_archive(spark, path, documents=False)
    last = listing.groupBy("cik").agg(F.max_by(F.struct(*[c for c in listing.columns if c != "cik"]), "offset").alias("e")).select("cik", "e.*")
    if allowed is not None:
        last = last.join(allowed.select("cik").distinct(), "cik", "left_semi")
    return changed_files(last, state, force)


def read_changes(changes: DataFrame, path: str) -> DataFrame:
    """The entries of :func:`scan_changes` inflated in tasks, each alone: its columns, document and error."""
    spread = changes.repartition(F.xxhash64("cik"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(path) as file:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = batch.slice(i, 1)
                    document, error = _document(file, *(row[c][0].as_py() for c in ("size", "compressed", "offset", "crc", "method")))
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([document], pa.string()), pa.array([error], pa.string())], [*row.schema.names, "document", "error"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema.fields)
    return spread.mapInArrow(read, f"{kinds}, document string, error string")


def companies_of(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as companies (the columns of ``facts.read_companies``), and those that can't be read: (cik, name, error).

    ``error`` says what was wrong with an entry, or that its text isn't such a JSON object.
    """
    parsed = documents.withColumn("__d", F.from_json("document", f"{COMPANY}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    bad = F.col("__d").isNull() | F.col("__d.__bad").isNotNull() | F.col("__d.facts").isNull()
    good = parsed.where(~bad).select(F.coalesce(F.nullif("__d.cik", F.lit("")), "cik").alias("cik"), "__d.entityName", "__d.facts")
    return good, parsed.where(bad).select("cik", "name", F.coalesce("error", F.lit("no company document")).alias("error"))
