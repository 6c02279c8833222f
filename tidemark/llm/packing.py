"""Best-fit packing of token sequences after a linear grouping of the long pieces."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.session import materialize

CAPACITY = 4096
#: Pieces of at least this many tokens are packed by configurations, the others by best fit.
LARGE = 1024
#: The long pieces of a shard are cut into so many groups of equal number, each rounded up to its longest; with no more
#: different lengths than that each is a group of its own and nothing is rounded.
GROUPS = 40
#: Configurations are improved in so many rounds at most; any round leaves a valid choice.
ROUNDS = 300
#: Pieces are dealt to shards of about so many; each shard is packed by one task call.
#: A shard can waste about one sequence of its thousands.
SHARD = 16_384


def cut_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Tokenise every whole text once: doc_id, piece, start, length, ids_crc32 (and ``ids``), and a row number.

    A document's ids end with the end id; only documents of more than ``capacity`` ids are
    cut. A null text counts as empty and gives the end id alone.
    """
    vocabulary = vocabulary or tokens.vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                    part = body[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names) if rows else pa.RecordBatch.from_pylist([], pa.schema(list(zip(names, kinds))))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id())


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Every piece with its place: cut_pieces' columns, sequence_id and offset.

    Offsets in a sequence are gapless from 0 and a sequence has at most ``capacity`` tokens.
    Pieces are dealt to shards by a hash of their row number, so neither a hot document
    nor repeated rows meet in one task, and a shard's size doesn't depend on the input's.

    A null or empty text is a piece of one id, null and repeated ids keep a row for each of
    theirs, a long text gives as many pieces as it fills. Pieces of equal length are taken in
    order of their row. Columns other than doc_id and text are ignored, whatever their names;
    an empty table gives an empty result.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, ids), "pieces")
    shards = max(1, -(-pieces.count() // SHARD))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        bins, offset = pack_lengths(rows["length"].to_numpy(), capacity)
        told = rows.select(["row"] if ids else names)
        return told.append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + bins)).append_column("offset", pa.array(offset))

    if ids:
        placed = dealt.select("row", "length", "shard").groupBy("shard").applyInArrow(place, "row long, sequence_id long, offset long")
        return pieces.join(placed, "row").drop("row")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(place, schema)


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1 to ``capacity``), in as few bins as the scheme finds.

    The large lengths in descending order form groups of equal number, each counted as its
    longest: few sizes. Which configurations of these sizes to use how often is a linear
    programme, and its whole uses are taken. Actual pieces take the places of their group.
    The few large pieces left over and then the small ones, the longest first, go where they
    fit best, into what rounding left free or into new bins.

    Where lengths spread so widely that rounding up costs more than configurations gain, the same
    best fit of all pieces without configurations takes fewer bins and is the answer instead: the result is never
    worse than best fit decreasing.
    """
    order = np.argsort(-lengths, kind="stable")
    big = int((lengths >= large).sum())
    plain = best_fit(lengths, [], order, capacity)
    bins = plain
    if big and len(plain) > -(-int(lengths.sum()) // capacity):
        chosen, rest = grouped(lengths, order[:big], capacity, groups)
        bins = min(best_fit(lengths, chosen, np.concatenate([rest, order[big:]]), capacity), plain, key=len)
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, members in enumerate(bins):
        place[members] = b
        offset[members] = np.cumsum(lengths[members]) - lengths[members]
    return place, offset


def grouped(lengths: np.ndarray, big: np.ndarray, capacity: int, groups: int) -> tuple[list[list[int]], np.ndarray]:
    """Bins of the large pieces (in descending order) by configurations, and those left over, the longest first."""
    if len(np.unique(lengths[big])) <= groups:
        edges = np.concatenate([[0], np.flatnonzero(np.diff(lengths[big])) + 1, [len(big)]])
    else:
        edges = np.unique(np.linspace(0, len(big), groups + 1).round().astype(int))
    queues: dict[int, list[int]] = {}
    for a, b in zip(edges[:-1], edges[1:]):
        queues.setdefault(int(lengths[big[a]]), []).extend(big[a:b].tolist())
    sizes = np.array(list(queues))
    bins = []
    for chosen, times in configurations(sizes, np.array([len(queues[s]) for s in sizes.tolist()]), capacity):
        for _ in range(times):
            bins.append([queues[s].pop() for s, k in zip(sizes.tolist(), chosen.tolist()) for _ in range(k)])
    return bins, np.array(sorted((i for q in queues.values() for i in q), key=lambda i: -lengths[i]), dtype=np.int64)


def best_fit(lengths: np.ndarray, bins: list[list[int]], rest: np.ndarray, capacity: int) -> list[list[int]]:
    """``bins`` after every piece of ``rest``, in its order, went to the fullest bin that has room, or to a new one."""
    bins = [list(members) for members in bins]
    # bins by free space, and a bit for each space that some bin has
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, members in enumerate(bins):
        by_space[capacity - int(lengths[members].sum())].append(b)
    has = sum(1 << s for s in range(capacity + 1) if by_space[s])
    for i, size in zip(rest.tolist(), lengths[rest].tolist()):
        fitting = has >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                has ^= 1 << space
        else:
            b, space = len(bins), capacity
            bins.append([])
        bins[b].append(i)
        by_space[space - size].append(b)
        has |= 1 << (space - size)
    return bins


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """How many pieces of each size a bin takes, and for how many bins: the whole part of the best fractional choice.

    Column generation: prices of the sizes follow from the configurations in use, the
    configuration worth most at these prices replaces one of them, until none is worth more
    than a bin. As many configurations as sizes are in use, so what their fractions leave
    over is less than a bin for each size.
    """
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        fresh = worth_most(prices, sizes, capacity)
        if fresh @ prices <= 1 + 1e-9:
            break
        use, change = np.linalg.solve(basis, np.column_stack([counts, fresh])).T
        leaves = np.where(change > 1e-9, np.maximum(use, 0) / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, leaves.argmin()] = fresh
    use = np.linalg.solve(basis, counts)
    chosen = [(basis[:, j].round().astype(int), int(np.floor(u + 1e-6))) for j, u in enumerate(use)]
    left, told = counts.copy(), []
    for config, times in sorted(chosen, key=lambda c: -c[1]):
        # rounding errors of the solution must not use more pieces than there are
        times = min([times, *(left[config > 0] // config[config > 0])])
        if times > 0:
            left = left - config * times
            told.append((config, int(times)))
    return told


def worth_most(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The numbers of pieces of each size that fit into ``capacity`` together and are worth most."""
    best, before = np.zeros(capacity + 1), []
    for price, size in zip(prices, sizes.tolist()):
        before.append(best)
        if price > 0:
            best = best.copy()
            for k in range(1, capacity // size + 1):
                np.maximum(best[k * size :], before[-1][: -k * size] + k * price, out=best[k * size :])
    told, room = np.zeros(len(sizes), int), capacity
    for j in range(len(sizes) - 1, -1, -1):
        if prices[j] > 0:
            k = np.arange(room // sizes[j] + 1)
            told[j] = int((before[j][room - k * sizes[j]] + k * prices[j]).argmax())
            room -= told[j] * sizes[j]
    return told
