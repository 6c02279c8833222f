"""Near-duplicates by MinHash signatures and a multi-index Hamming join, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, components, if_small
from tidemark.llm.textvec import shingle_sets, texts_of
from tidemark.session import discard, materialize, row_count_at_most

WIDTH = 5
#: Similarity as a fraction of whole numbers: 100 * intersection >= 75 * union.
AT_LEAST = 75
#: A signature has CHUNKS chunks of LANES values of 8 bits.
CHUNKS, LANES = 16, 6
#: A chunk may differ in one value. Two signatures that differ in at most CHUNKS * 2 - 1 = 31
#: of their 96 values agree in a chunk but for one value at most, so they are always found.
#: At the least similarity 24 values differ on average (standard deviation 4.2); with what
#: the chunks find beyond 31 a pair of exactly that similarity is missed once in 200,000.
ALLOWED = 1
#: Found pairs that differ in more values than this aren't confirmed: 6 deviations above the mean.
FARTHEST = 50
#: A set's bitmap has BITMAP words of 64 bits. A bit that only one of two bitmaps has stands for a shingle that
#: only that set has, so the bitmaps bound the similarity from above and rule out pairs without any error.
BITMAP = 16
#: Before all pairs are compared, parts meet through representatives in so many rounds at most;
#: in a round a part tries the so many other parts with which it shares most keys.
ROUNDS, TRIES = 3, 2
#: A bucket of more rows than this is divided by the keys of the other chunks before its pairs are compared. Either way the
#: same pairs are: those with a chunk that differs in one value at most and another in two at most. All pairs that differ in
#: at most 31 values are such; of those of the least similarity that share a bucket all but one in 10**11 are.
BUCKET = 2_000
#: A document that stands in more pairs than this has its set sent to several tasks.
PAIRS_A_TASK = 512
#: Documents whose keys one task makes; tables of keys, parts and pairs are written by as many tasks, and by as many as run
#: at once at least. A shuffle has a fixed number of partitions, mostly far more than such a table fills, and each one that is
#: read by a task and written as a file of its own costs more than its rows. What tasks compare is left to Spark's partitions.
DOCUMENTS_A_TASK = 20_000

_rng = np.random.Generator(np.random.PCG64(5))
_A = _rng.integers(1, 2**63, CHUNKS * LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, CHUNKS * LANES, dtype=np.uint64)
SIGNATURE = [f"c{j}" for j in range(CHUNKS)]
BITS = [f"b{j}" for j in range(BITMAP)]


def signature(hashes: np.ndarray) -> np.ndarray:
    """The 96 minima of a set under as many hash functions, 8 bits of each, a chunk in an integer."""
    least = np.full(len(_A), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * _A + _B).min(0), out=least)
    lanes = ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).reshape(CHUNKS, LANES)
    return (lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(8))).sum(1, dtype=np.uint64).astype(np.int64)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each hash: BITMAP words."""
    bits = np.zeros(BITMAP * 64, np.uint8)
    bits[(hashes % np.uint64(BITMAP * 64)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit fingerprint of the set (f0, f1), its signature and its bitmap, from whole texts."""
    names = ["doc_id", "n_shingles", "f0", "f1", *SIGNATURE, *BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((len(names) - 1, batch.num_rows), np.int64)
            for i, s in enumerate(shingle_sets(*texts_of(batch["text"]), WIDTH)):
                if len(s):
                    rows[0, i] = len(s)
                    rows[1, i] = s.sum(dtype=np.uint64).astype(np.int64)
                    rows[2, i] = np.bitwise_xor.reduce(s * np.uint64(0xD6E8FEB86659FD93) ^ (s >> np.uint64(31))).astype(np.int64)
                    rows[3 : 3 + CHUNKS, i] = signature(s)
                    rows[3 + CHUNKS :, i] = bitmap(s)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), *map(pa.array, rows)], names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and its whole shingle set as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [pa.array(s.view(np.int64)) for s in shingle_sets(*texts_of(batch["text"]), WIDTH)]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = pa.concat_arrays(sets) if sets else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


#: The places of a chunk that a key leaves out: one, or two where a large bucket is divided.
_ONE = [(d,) for d in range(LANES)]
_TWO = list(combinations(range(LANES), 2))


def chunk_keys(skip: Column | None = None) -> Column:
    """The keys of a signature: each chunk with each of its values left out in turn.

    A key is the chunk's number, the number of the place left out and the values that stay,
    in one integer. With ``skip``, the number of a chunk, the keys are those of the other
    chunks with two values left out: two signatures that differ in at most 31 values share
    one of these, since 15 chunks with three differences each would be 45.
    """
    keys = []
    for j in range(CHUNKS):
        for i, places in enumerate(_ONE if skip is None else _TWO):
            mask = 2**48 - 1 - sum(0xFF << (8 * d) for d in places)
            key = F.col(f"c{j}").bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((j << 52) | (i << 48)))
            keys.append(key if skip is None else F.when(skip != j, key))
    every = F.array(*keys)
    return every if skip is None else F.filter(every, lambda k: k.isNotNull())


def differing(a: str, b: str) -> Column:
    """In how many of the 96 values two signatures differ, as integer arithmetic."""
    counts = []
    for c in SIGNATURE:
        x = f"({a}.{c} ^ {b}.{c})"
        for shift, mask in ((4, 0x0F0F0F0F0F0F), (2, 0x030303030303), (1, 0x010101010101)):
            x = f"(({x} | shiftrightunsigned({x}, {shift})) & {mask}L)"
        counts.append(f"bit_count({x})")
    return F.expr(" + ".join(counts))


def confirm(pairs: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough, in ``tasks`` partitions; ``pairs`` and ``sets`` are tables.

    Only the sets of documents that stand in a pair are shuffled; which they are is broadcast if a
    count allows it.
    """
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().coalesce(tasks), "confirm-ids")
    some = sets.join(if_small(wanted), "doc_id", "left_semi")
    both = _attached(pairs, some, F.col("shingles"), "x", "y", tasks)
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(shared * 100 >= (F.size("x") + F.size("y") - shared) * AT_LEAST).select("a", "b").distinct().coalesce(tasks)


def _attached(pairs: DataFrame, table: DataFrame, value: Column, x: str, y: str, tasks: int) -> DataFrame:
    """The pairs (a, b), a table, with what ``table`` has for a as ``x`` and for b as ``y``.

    A document in many pairs is no hot key: they are dealt to as many parts as they fill, each
    with a copy of its value. Where there is no such document, nothing is dealt. What has the
    first value is dealt anew for the second by ``tasks`` tasks.
    """
    ends = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("doc_id")) for s in "ab"])).alias("e")
    hot = pairs.select(ends).groupBy("e.side", "e.doc_id").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("parts")).where("parts > 1")
    hot = materialize(hot.coalesce(tasks), "hot-documents")
    few = None if hot.isEmpty() else row_count_at_most(hot, BROADCAST_ROWS)
    rows = pairs
    for side, name in (("a", x), ("b", y)):
        copied = table.select(F.col("doc_id").alias(side), value.alias(name))
        if few is None:
            rows = rows.join(copied, side)
            rows = rows.coalesce(tasks) if side == "a" else rows
            continue
        many = hot.where(F.col("side") == side).select(F.col("doc_id").alias(side), "parts")
        many = F.broadcast(many) if few else many
        parts = F.coalesce("parts", F.lit(1))
        dealt = rows.join(many, side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), parts)).drop("parts")
        copied = copied.join(many, side, "left")
        copied = copied.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        rows = dealt.join(copied, [side, "part"]).drop("part")
        rows = rows.coalesce(tasks) if side == "a" else rows
    return rows


def _close(a: str, b: str) -> Column:
    sizes = F.expr(f"100 * least({a}.n_shingles, {b}.n_shingles) >= {AT_LEAST} * greatest({a}.n_shingles, {b}.n_shingles)")
    total = f"{AT_LEAST} * ({a}.n_shingles + {b}.n_shingles)"  # 100 I >= 75 (a + b - I), so 175 I >= 75 (a + b)
    only = lambda x, y: " + ".join(f"bit_count({x}.{w} & ~{y}.{w})" for w in BITS)
    bound = " and ".join(f"{100 + AT_LEAST} * ({x}.n_shingles - ({only(x, y)})) >= {total}" for x, y in ((a, b), (b, a)))
    return sizes & (differing(a, b) <= FARTHEST) & F.expr(bound)


def link(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts with the same set are one class, named by its smallest doc_id. Classes meet in the
    buckets of their chunk keys. First parts (at the start a class each) meet through one
    representative in each bucket, and what is confirmed is joined to larger parts: a group
    of near copies, however large, costs a few comparisons for each member. Then buckets that
    still hold several parts are compared across them, all pairs that the signatures allow,
    so no link that could join two parts is left out. A bucket too large for that is divided
    by the keys of the other chunks; a pair inside one part needs no comparison.

    Empty and null texts and null ids link with nothing; a null doc_id has a null component
    and is kept. Long texts are read whole, in parts of bounded memory. Rows that repeat a
    doc_id share its component, each with its own n_shingles; equal similarities need no
    order, as a component's name is its smallest doc_id. An empty table gives an empty
    result, and columns other than doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = materialize(sign(docs), "signatures")
    tasks = max(spark.sparkContext.defaultParallelism, -(-signed.count() // DOCUMENTS_A_TASK))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("f0", "f1", "n_shingles").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in (*SIGNATURE, *BITS)])
    classes = materialize(classes.coalesce(tasks), "classes")
    keyed = classes.select("doc_id", *SIGNATURE).repartition(tasks).select("doc_id", F.explode(chunk_keys()).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(counts, "key").coalesce(tasks), "shared-keys")
    popular = materialize(shared.groupBy("doc_id").agg(F.sum("n").alias("popular")).coalesce(tasks), "popular")
    popular = if_small(popular)
    buckets = shared.join(popular, "doc_id")
    # the texts that share a bucket with another are cut into shingles again, once
    sets = materialize(full_sets(docs.join(popular.select("doc_id"), "doc_id", "left_semi")).where("size(shingles) > 0"), "shingle-sets")

    parts = None
    for _ in range(ROUNDS):
        tries = materialize(_representatives(_placed(buckets, parts), classes, tasks), "tries")
        edges = materialize(confirm(tries, sets, tasks), "edges")
        discard(tries)
        if edges.isEmpty():
            break
        parts = _parts(edges, parts, tasks)
        discard(edges)
    more = _across(_placed(shared, parts), classes, tasks)
    if more is not None:
        fresh = materialize(confirm(more, sets, tasks), "more-edges")
        discard(more)
        parts = _parts(fresh, parts, tasks)
    discard(shared)
    discard(sets)
    if parts is None:
        parts = spark.createDataFrame([], "node long, component long")
    named = classes.select("f0", "f1", "n_shingles", F.col("doc_id").alias("node")).join(parts, "node", "left")
    named = named.select("f0", "f1", "n_shingles", F.coalesce("component", "node").alias("component"))
    told = signed.select("doc_id", "n_shingles", "f0", "f1").join(named, ["f0", "f1", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    told = told.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
    return told.coalesce(tasks)


def _parts(edges: DataFrame, parts: DataFrame | None, tasks: int) -> DataFrame:
    """The parts (node, component), a table, once documents are also joined by ``edges``."""
    known = edges if parts is None else edges.union(parts.select("node", "component"))
    return materialize(components(known).coalesce(tasks), "parts")


def _placed(buckets: DataFrame, parts: DataFrame | None) -> DataFrame:
    """The rows of the buckets with the part of their document."""
    if parts is None:
        return buckets.withColumn("part", F.col("doc_id"))
    placed = buckets.join(if_small(parts).withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return placed.select(*buckets.columns, F.coalesce("component", "doc_id").alias("part"))


def _representatives(placed: DataFrame, classes: DataFrame, tasks: int) -> DataFrame:
    """Pairs (a, b) of documents that stand for two parts that share buckets, with close signatures.

    In a bucket the document of each part whose buckets are fullest stands for it, and is
    paired with the one whose buckets are fullest of all: in a group of edited copies that is
    the text they were made from, or nearest to it. Of the other parts a part meets so, it
    tries the TRIES with most buckets in common. Members are counted down to one row for each
    bucket and part before anything is joined, so a large part isn't carried along.
    """
    stands = materialize(placed.groupBy("key", "part").agg(F.min(F.struct(-F.col("popular"), "doc_id")).alias("s")).coalesce(tasks), "standing")
    head = stands.groupBy("key").agg(F.min(F.struct("s", "part")).alias("h"), F.count("*").alias("parts")).where("parts > 1")
    head = head.select("key", F.struct(F.col("h.part").alias("part"), F.col("h.s.doc_id").alias("a")).alias("h"))
    met = stands.select("key", "part", F.col("s.doc_id").alias("a")).join(head, "key").where("part <> h.part").coalesce(tasks)
    met = met.groupBy("part", F.col("h.part").alias("other"), "a", F.col("h.a").alias("b")).agg(F.count("*").alias("m")).coalesce(tasks)
    best = met.groupBy("part", "other").agg(F.sum("m").alias("m"), F.max_by(F.struct("a", "b"), F.struct("m", -F.col("a"), -F.col("b"))).alias("pair")).coalesce(tasks)
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("m"), "other"))).where(f"r <= {TRIES}").coalesce(tasks)
    tried = materialize(best.select("pair.*").distinct().coalesce(tasks), "tried")
    near = _attached(tried, classes, F.struct("n_shingles", *SIGNATURE, *BITS), "s", "t", tasks)
    return near.where(_close("s", "t")).select("a", "b").distinct().coalesce(tasks)


def _once() -> Column:
    """Whether a shared bucket of x and y is the first one they share, where alone the pair counts.

    That is the first chunk with one difference at most, and in it the key that leaves out
    the differing value, or the first key if nothing differs; in a divided bucket likewise
    the first other chunk with two differences at most. In an undivided one there must be
    such another chunk too, so that it makes no difference whether a bucket was divided.
    """
    xors = "array(" + ", ".join(f"x.{c} ^ y.{c}" for c in SIGNATURE) + ")"
    fold = "v"
    for shift, mask in ((4, 0x0F0F0F0F0F0F), (2, 0x030303030303), (1, 0x010101010101)):
        fold = f"(({fold} | shiftrightunsigned({fold}, {shift})) & {mask}L)"
    counts = f"transform({xors}, v -> bit_count({fold}))"
    chunk, place = "shiftright(x.key, 52)", "(shiftright(x.key, 48) & 15)"
    first = f"""
      array_position(transform({counts}, n -> n <= 1), true) - 1 = {chunk}
      and ({place} = 0 or get({counts}, cast({chunk} as int)) = 1)"""
    other, left_out = "shiftright(x.second, 52)", "(shiftright(x.second, 48) & 15)"
    lane = f"cast((length(hex(get({xors}, cast({other} as int)))) - 1) div 2 as int)"
    second = f"""
      array_position(transform({counts}, (n, i) -> n <= 2 and i <> {chunk}), true) - 1 = {other}
      and case get({counts}, cast({other} as int)) when 0 then {left_out} = 0 when 1 then {left_out} = greatest({lane} - 1, 0) else true end"""
    alike = f"size(filter({counts}, n -> n <= 2)) > 1"
    return F.expr(f"({first}) and if(x.second = -1, {alike}, {second})")


def _across(placed: DataFrame, classes: DataFrame, tasks: int) -> DataFrame | None:
    """Pairs of different parts that share a bucket and have close signatures, as a table; None if no bucket holds two parts."""
    main = _main(placed, tasks, "key")
    rest = materialize(placed.join(main.select("key"), "key").select("key", "doc_id", "n", "part").coalesce(tasks), "mixed-buckets")
    if rest.isEmpty():
        return None
    seen = classes.select("doc_id", "n_shingles", *SIGNATURE, *BITS)
    small = rest.where(f"n <= {BUCKET}").select("key", F.lit(-1).cast("long").alias("second"), "doc_id", "part")
    large = rest.where(f"n > {BUCKET}").join(seen.select("doc_id", *SIGNATURE), "doc_id").select(
        "key", F.explode(chunk_keys(F.shiftright("key", 52))).alias("second"), "doc_id", "part"
    )
    both = materialize(small.unionByName(large), "divided-buckets")
    rows = both.join(_main(both, tasks, "key", "second"), ["key", "second"]).join(seen, "doc_id")
    rows = materialize(rows.coalesce(tasks), "open-buckets")
    x, y = rows.where("part <> main").alias("x"), rows.alias("y")
    apart = F.expr("x.part <> y.part and (y.part = y.main or x.doc_id < y.doc_id)")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.second") == F.col("y.second"))
    pairs = x.join(y, same & apart & _close("x", "y") & _once()).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    found = materialize(pairs.coalesce(tasks), "across")
    for table in (rest, both, rows):
        discard(table)
    return found


def _main(rows: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """The largest part of each bucket that holds several (keys, main)."""
    sizes = rows.groupBy(*keys, "part").agg(F.count("*").alias("m")).coalesce(tasks)
    main = sizes.groupBy(*keys).agg(F.max(F.struct("m", "part")).getField("part").alias("main"), F.count("*").alias("parts"))
    return main.where("parts > 1").drop("parts")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, without those of other members.

    Of rows that repeat a doc_id one stays: that of the smallest SHA-256 of the text (a null
    text first), then the smallest hash of the whole row. The ids to drop are few, so the
    texts are shuffled only if these are too many to broadcast. Rows of a null doc_id stay,
    and so do empty and null texts. All columns are kept under their names; an empty table
    gives an empty result.
    """
    names = docs.columns
    gone = materialize(link(docs).where("not kept").select("doc_id").distinct(), "dropped-ids")
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    rest = docs.join(if_small(gone), "doc_id", "left_anti")
    if not again.isEmpty():
        order = F.struct(F.sha2(F.encode(F.col("text"), "UTF-8"), 256).alias("t"), F.xxhash64(*names).alias("r"))
        twice = rest.join(if_small(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*names), order).alias("__row"))
        rest = rest.join(if_small(again), "doc_id", "left_anti").select(*names).unionByName(twice.select("__row.*"))
    return rest.select(*names)


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN ws ELSE ws[i:i + 4] END AS shingle
  FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * common >= 75 * (x.n + y.n - common)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  WITH RECURSIVE t(node, reached) AS (
    SELECT doc_id, doc_id FROM documents UNION SELECT t.node, d.b FROM t JOIN d ON d.a = t.reached)
  SELECT node, min(reached) AS component_id FROM t GROUP BY node)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, documents.doc_id = component_id AS kept
FROM documents JOIN r ON r.node = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
