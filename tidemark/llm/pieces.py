"""SentencePiece ids and decoded texts through a table of distinct chunks.

No piece of the vocabulary has a white-space marker behind another character, nor holds a
line feed, so merges never cross the start of a marker run or of a line. A text is thus a
sequence of chunks, each segmented on its own: every distinct chunk is segmented once, and
its ids go back to the places it stands at.

Documents are read in blocks (a stretch of one input partition). A block names each of its
distinct chunks once; the chunks of all blocks meet by their text, are segmented, and return
to the blocks that named them, where a document's ids are looked up place by place. Texts
are never shuffled, and a chunk that is everywhere makes one row for each block only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sstable import opened
from tidemark.session import scratch_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: A block ends with the document that brings it to so many characters: at most about half a million distinct chunks.
BLOCK_CHARS = 1 << 25
#: Chunks meet in so many buckets, four for each input partition, so a bucket doesn't grow with the input until there are
#: MOST_BUCKETS. A task holds one bucket's chunks; should they be more than MOST_HELD it starts over, and some are segmented again.
LEAST_BUCKETS, MOST_BUCKETS, MOST_HELD = 256, 1 << 16, 1_000_000
#: Rows of an Arrow batch that lists chunks.
BATCH = 64

#: A model that rewrites characters or white space before it segments can't pass these.
PROBES = ("a b", "a\nb", " \n a", "a  b ", "   ", "\t\u3000a", "\ufb01 e\u0301")

_RUNS = re.compile(r" +[^ \n]*|\n[^ \n]*")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def chunks(text: str | None) -> list[str]:
    """The chunks of a whole text; none if it's null or empty.

    A chunk starts at a run of markers or at a line feed. The first marker of a run isn't
    written, so ``word`` stands for a marked word and the empty chunk for a marker alone.
    """
    if not text:
        return []
    text = text.replace(MARK, " ")
    if text[0] != " " and "  " not in text:
        return text.replace("\n", " \n").split(" ")
    return [c[1:] if c[0] == " " else c for c in _RUNS.findall(" " + text)]


def joined(parts: list[str]) -> str:
    """The text that ``parts`` are the chunks of."""
    return " ".join(parts).replace(" \n", "\n")


class Segmenter:
    """Segments chunks with the library; refuses a vocabulary whose pieces cross chunk starts."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK) or ("\n" in p)]
        self.mark, self.end = self.model.piece_to_id(MARK), self.model.eos_id()
        if crossing or self.mark == self.model.unk_id() or any(self.by_chunks(t) != self.model.encode(t) for t in PROBES):
            raise ValueError(f"this model joins what lies across white space, as in {crossing[:3]}: chunks can't be segmented one by one")

    def by_chunks(self, text: str) -> list[int]:
        """Ids of a text by its chunks, without the end id."""
        return [int(i) for told in self.segment(chunks(text))[0] for i in told.split(" ")]

    def segment(self, distinct: list[str]) -> tuple[list[str], list[str | None]]:
        """Decimal ids of each chunk joined by a space, and its decoded text where that isn't the chunk itself."""
        told, odd = [], []
        found = self.model.encode(distinct)
        for chunk, ids, decoded in zip(distinct, found, self.model.decode(found)):
            if not chunk:
                ids = [self.mark]
            elif chunk[0] == "\n":
                # the library put a marker before the line feed, which no piece joins with it
                ids = ids[1:]
            told.append(" ".join(map(str, ids)))
            odd.append(None if decoded == chunk else decoded)
        return told, odd


_segmenters: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """The worker's segmenter for a model file."""
    if path not in _segmenters:
        _segmenters[path] = Segmenter(path)
    return _segmenters[path]


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list, list]]:
    """The documents of a partition in the order read, as (block, ids, texts) a batch: equal for equal rows.

    A block is named by its partition and the number of blocks before it there.
    """
    part, number, held = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        ids, texts, start = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), 0
        for i, text in enumerate(texts):
            held += len(text or "")
            if held >= size:
                yield (part << 24) + number, ids[start : i + 1], texts[start : i + 1]
                number, held, start = number + 1, 0, i + 1
        if start < len(texts):
            yield (part << 24) + number, ids[start:], texts[start:]


def distinct_chunks(docs: DataFrame, buckets: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(block, bucket, chunks): each chunk once for every block that holds it.

    Chunks are dealt to buckets by a hash; those of a block and bucket stand sorted in one string, between markers,
    which no chunk holds.
    """

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, set()
        for block, _, texts in blocks(batches, block_chars):
            if block != current:
                yield from _named(current, seen, buckets)
                current, seen = block, set()
            for text in texts:
                seen.update(chunks(text))
        yield from _named(current, seen, buckets)

    return docs.mapInArrow(name, "block long, bucket int, chunks string")


def _named(block: int | None, seen: set[str], buckets: int) -> Iterator[pa.RecordBatch]:
    dealt: dict[int, list[str]] = {}
    for chunk in seen:
        dealt.setdefault(crc32(chunk.encode()) % buckets, []).append(chunk)
    numbers = sorted(dealt)
    for i in range(0, len(numbers), BATCH):
        some = numbers[i : i + BATCH]
        joined_chunks = [MARK.join(sorted(dealt.pop(n))) for n in some]
        yield pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(joined_chunks, pa.string())], ["block", "bucket", "chunks"])


def segment_chunks(named: DataFrame, model: str) -> DataFrame:
    """Adds ``ids`` (a line a chunk) and ``decoded`` (where it differs) to each list: a bucket's chunks meet, and each is segmented once."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, current, table = segmenter(model), None, {}
        for batch in batches:
            ids, decoded = [], []
            for bucket, listed in zip(batch["bucket"].to_pylist(), batch["chunks"].to_pylist()):
                if bucket != current or len(table) > MOST_HELD:
                    current, table = bucket, {}
                parts = listed.split(MARK)
                fresh = [c for c in parts if c not in table]
                table.update(zip(fresh, zip(*own.segment(fresh))) if fresh else ())
                told = [table[c] for c in parts]
                ids.append("\n".join([t[0] for t in told]))
                decoded.append(MARK.join([c if t[1] is None else t[1] for c, t in zip(parts, told)]) if any(t[1] is not None for t in told) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["block", "bucket", "chunks", "ids", "decoded"])

    met = named.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(segment, "block long, bucket int, chunks string, ids string, decoded string")


def read_block(system: pafs.FileSystem, folder: str, block: int) -> tuple[dict[str, str], dict[str, str]]:
    """A block's chunks with their ids, and those whose decoded text differs."""
    ids: dict[str, str] = {}
    odd: dict[str, str] = {}
    for file in system.get_file_info(pafs.FileSelector(f"{folder}/block={block}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(batch_size=256, columns=["chunks", "ids", "decoded"]):
                    for listed, told, decoded in zip(*(c.to_pylist() for c in batch.columns)):
                        parts = listed.split(MARK)
                        ids.update(zip(parts, told.split("\n")))
                        if decoded is not None:
                            odd.update((c, d) for c, d in zip(parts, decoded.split(MARK)) if c != d)
    return ids, odd


def encode(docs: DataFrame, model: str | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every whole text encoded and decoded: doc_id, n_tokens, ids, decoded.

    Ids are decimal, joined by one space, the end id last. A null or empty text is the end id alone and decodes
    to the empty text; a long text or a long run without white space is encoded whole; every repeated row and
    every row of a null id keeps its own. Columns other than doc_id and text are ignored, whatever their names;
    an empty table gives an empty result.

    The partitions of ``docs`` are read twice and must hold the same rows in the same order each time, as those
    of files do: pass a written table. A document that comes with a chunk its block didn't name raises
    an error rather than give other ids.
    """
    model = model or model_path()
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    folder = scratch_path(docs.sparkSession, "chunks")
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 4 * docs.rdd.getNumPartitions()))
    table = segment_chunks(distinct_chunks(docs, buckets, block_chars), model)
    table.repartition("block").write.partitionBy("block").option("compression", "zstd").parquet(folder)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        end, current, ids, odd = segmenter(model).end, None, {}, {}
        for block, doc_ids, texts in blocks(batches, block_chars):
            if block != current:
                current, (ids, odd) = block, read_block(system, inner, block)
            yield from _placed(doc_ids, (chunks(text) for text in texts), ids, odd, end)

    return docs.mapInArrow(place, "doc_id long, n_tokens long, ids string, decoded string")


#: Rows go back to Spark once their ids and texts have so many characters.
OUT_CHARS = 1 << 22
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])


def _placed(doc_ids: list, parts: Iterable[list[str]], ids: dict[str, str], odd: dict[str, str], end: int) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for doc_id, found in zip(doc_ids, parts):
        told = " ".join([*map(ids.__getitem__, found), str(end)])
        if odd and not odd.keys().isdisjoint(found):
            found = [odd.get(c, c) for c in found]
        decoded = joined(found)
        rows.append((doc_id, told.count(" ") + 1, told, decoded))
        held += len(told) + len(decoded)
        if held >= OUT_CHARS:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)
