"""A Merkle manifest of a dataset: leaves by language, a subroot for each, one root, and a proof for every row.

Every run of 2 consecutive nodes becomes one (the last run of a level may be a single node); this goes on
within a language until one node, its subroot, remains, and among the subroots in the same way.

Blocks of 2 ** BLOCK_LEVELS consecutive nodes are reduced by one task call each, in as many
rounds as it takes to leave at most TOP nodes. Only these come to the driver, which builds
the upper tree and broadcasts each node's way to the root. Then the rounds are gone through
downwards: a block rebuilds its inner levels, puts its own siblings before the way it got,
and at the leaves each row's proof is hashed and its leaf folded up to the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import CRC_TABLE, crc32_sql
from tidemark.session import materialize, row_count_at_most

#: A block has so many levels: 1024 nodes.
BLOCK_LEVELS = 10
#: At most so many nodes come to the driver; their ways to the root, some 70 bytes a level, are broadcast (about 4 MB).
TOP = 4096

ALONE, LEFT, RIGHT = "-", "<", ">"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels until ``n`` nodes have become one."""
    return max(n - 1, 0).bit_length()


def levels(nodes: list[str], most: int) -> list[list[str]]:
    """The nodes and the levels above them: ``most`` of them or until one node remains."""
    told = [nodes]
    for _ in range(most):
        below = told[-1]
        told.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return told


def way(tree: list[list[str]], i: int) -> str:
    """The steps from node ``i`` of the lowest level to the highest: a side and the sibling, or a mark for none."""
    steps = []
    for level in tree[:-1]:
        other = i ^ 1
        steps.append(ALONE if other >= len(level) else (RIGHT if other > i else LEFT) + level[other])
        i >>= 1
    return "".join(steps)


def steps(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        side = path[at]
        to = at + 1 if side == ALONE else at + 65
        yield side, path[at + 1 : to]
        at = to


def fold(node: str, path: Iterable[tuple[str, str]]) -> str:
    """The node at the end of the way."""
    for side, sibling in path:
        node = digest(sibling, node) if side == LEFT else digest(node, sibling)
    return node


def field(name: str | Column) -> Column:
    """A value as it enters a leaf: '-' if null, else its UTF-8 byte count, a colon and itself."""
    value = (F.col(name) if isinstance(name, str) else name).cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_of(n_chars: Column) -> Column:
    return F.sha2(F.concat(field("doc_id"), field("source"), field("lang"), field(n_chars), field("text")), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered): g is the language behind a letter, empty for null; tampered is null where nothing was done."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("v"), "lang"), F.lit("")).alias("g"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(F.col("n_chars")).alias("leaf"),
        F.when(hit, leaf_of(F.col("n_chars") + 1)).alias("tampered"),
    )


def indexed(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds ``idx``, the place of a row in its group by ``order``, and ``n``, the size of the group.

    One range shuffle puts the rows in order; a task counts along its range, and the numbers
    before each range come from a table of one row for each range and group in it. Equal rows are told apart
    by where they were read, so any number of them spreads over ranges too.
    """
    keys = [group, *order, "_at"]
    sorted_rows = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
    schema = pa.schema([("_part", pa.int32()), ("_pos", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, last, pos = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for g in batch[group].to_pylist():
                last, pos = g, pos + 1 if g == last else 0
                places.append(pos)
            own = [pa.repeat(pa.scalar(part, pa.int32()), len(places)), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialize(sorted_rows.mapInArrow(count, f"{kinds}, _part int, _pos long"), label)
    parts = placed.groupBy(group, "_part").agg(F.count("*").alias("c"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        parts.select(group, "_part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_start"), F.sum("c").over(Window.partitionBy(group)).alias("n")), f"{label}-starts"
    )
    starts = F.broadcast(starts) if row_count_at_most(starts, 10 * TOP) else starts
    return placed.join(starts, [group, "_part"]).select(*rows.columns, (F.col("_start") + F.col("_pos")).alias("idx"), "n")


def block_roots(nodes: DataFrame, block_levels: int) -> DataFrame:
    """Each block of consecutive nodes (g, idx, n, node) reduced: (g, idx, n, node) of the next round."""

    def reduce(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        n = rows["n"][0].as_py()
        top = levels(rows["node"].to_pylist(), min(block_levels, height(n)))[-1][0]
        return pa.table({"g": [key[0].as_py()], "idx": [key[1].as_py()], "n": [-(-n >> block_levels) if n > 1 << block_levels else 1], "node": [top]}, _NODES)

    return nodes.withColumn("block", F.shiftright("idx", block_levels)).groupBy("g", "block").applyInArrow(reduce, "g string, idx long, n long, node string")


_NODES = pa.schema([("g", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("node", pa.string())])


def upper_tree(nodes: list[tuple[str, int, int, str]]) -> tuple[dict[tuple[str, int], tuple[str | None, str]], str | None]:
    """On the driver: (g, idx) -> (subroot, way to the root) for the nodes left, and the root (None without nodes)."""
    groups: dict[str, list[str]] = {}
    for g, _, _, node in sorted(nodes):
        groups.setdefault(g, []).append(node)
    if not groups:
        return {}, None
    own = {g: levels(found, height(len(found))) for g, found in groups.items()}
    over = levels([tree[-1][0] for tree in own.values()], height(len(own)))
    told = {}
    for at, (g, tree) in enumerate(own.items()):
        for i in range(len(tree[0])):
            told[g, i] = (tree[-1][0], way(tree, i) + way(over, at))
    return told, over[-1][0]


def manifest(docs: DataFrame, block_levels: int = BLOCK_LEVELS, top: int = TOP) -> DataFrame:
    """Every row with its leaf, subroot, root, proof and fold: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified.

    A null field enters a leaf as ``-``; rows of a null language form a group of their own, the first; null ids
    come first in theirs, rows of one id follow their leaf's digest, and rows equal in all have equal leaves, each with a place
    and a proof of its own (which of them gets which makes no difference to the set of rows returned). Long
    texts are hashed whole. Columns other than doc_id, source, lang, n_chars and text are ignored, whatever
    their names; an empty table gives an empty result.

    No task holds more than a block; the driver holds at most ``top`` nodes, and a table of so many
    languages that their subroots alone are more takes further rounds among these.
    """
    spark = docs.sparkSession
    hashed = materialize(leaves(docs.select("doc_id", "source", "lang", "n_chars", "text")), "leaves")
    base = indexed(hashed, "g", ["doc_id", "leaf"], "ordered-leaves").withColumnRenamed("leaf", "node")
    rounds, nodes = [base], base
    while True:
        nodes = materialize(block_roots(nodes.select("g", "idx", "n", "node"), block_levels), "block-roots")
        if row_count_at_most(nodes, top):
            break
        if row_count_at_most(nodes.where("n > 1"), 0):
            # subroots alone: they are the leaves of one further tree
            subroots = nodes.select(F.lit("").alias("over"), "g", "node")
            nodes = indexed(subroots, "over", ["g"], "subroots").select(F.lit("").alias("g"), "idx", "n", "node", F.col("g").alias("lower"))
        rounds.append(nodes)
    ways, root = upper_tree([tuple(r) for r in nodes.select("g", "idx", "n", "node").collect()])
    known: Broadcast | DataFrame = spark.sparkContext.broadcast(ways)
    for lower in rounds[:0:-1]:
        known = materialize(_below(lower, known, block_levels, *_ways_in("lower" in lower.columns)), "ways")
    return _below(base, known, block_levels, *_proofs(root))


def _below(nodes: DataFrame, known: Broadcast | DataFrame, block_levels: int, told: Callable, schema: str) -> DataFrame:
    """``told(rows, tree, (subroot, way))`` for each block of ``nodes``, given what is known of the block's root."""

    def block(key: tuple, rows: pa.Table, found: tuple[str, str]) -> pa.Table:
        rows = rows.sort_by("idx")
        return told(key[0].as_py(), rows, levels(rows["node"].to_pylist(), min(block_levels, height(rows["n"][0].as_py()))), found)

    blocks = nodes.withColumn("block", F.shiftright("idx", block_levels)).groupBy("g", "block")
    if isinstance(known, DataFrame):

        def met(key: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
            return block(key, rows, (found["subroot"][0].as_py(), found["way"][0].as_py()))

        return blocks.cogroup(known.withColumnRenamed("idx", "block").groupBy("g", "block")).applyInArrow(met, schema)
    return blocks.applyInArrow(lambda key, rows: block(key, rows, known.value[key[0].as_py(), key[1].as_py()]), schema)


def _ways_in(ranked: bool) -> tuple[Callable, str]:
    """Each node's way to the root; of ranked subroots, as the only node of their language."""
    kind = pa.schema([("g", pa.string()), ("idx", pa.int64()), ("subroot", pa.string()), ("way", pa.string())])

    def told(g: str, rows: pa.Table, tree: list[list[str]], found: tuple[str, str]) -> pa.Table:
        ways = [way(tree, i) + found[1] for i in range(len(tree[0]))]
        n = len(ways)
        if ranked:
            return pa.Table.from_arrays([rows["lower"], pa.array([0] * n, pa.int64()), rows["node"], pa.array(ways, pa.string())], schema=kind)
        return pa.Table.from_arrays([pa.array([g] * n, pa.string()), rows["idx"], pa.array([found[0]] * n, pa.string()), pa.array(ways, pa.string())], schema=kind)

    return told, "g string, idx long, subroot string, way string"


def _proofs(root: str | None) -> tuple[Callable, str]:
    """Each leaf's proof, and the root that its row folds to as it is now."""
    names = ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in names[1:-1]), ("verified", pa.bool_())])

    def told(g: str, rows: pa.Table, tree: list[list[str]], found: tuple[str, str]) -> pa.Table:
        upper = list(steps(found[1]))
        above = "".join(sibling for _, sibling in upper)
        proofs, folded = [], []
        for i, (leaf, now) in enumerate(zip(tree[0], rows["tampered"].to_pylist())):
            inner = list(steps(way(tree, i)))
            proofs.append(digest(*(sibling for _, sibling in inner), above))
            folded.append(fold(fold(now or leaf, inner), upper))
        n = len(proofs)
        same = [[g[1:] if g else None] * n, rows["node"].to_pylist(), [found[0]] * n, [root] * n, proofs, folded, [f == root for f in folded]]
        return pa.Table.from_arrays([rows["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(same, kind.types[1:]))], schema=kind)

    return told, "doc_id long, lang string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _field_sql(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::varchar))::varchar || ':' || ({value})::varchar, '-')"


_NEXT_LEVEL = "[sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) for i in range((len(nodes) + 1) // 2)]"
_STEP = "case when {o} >= len(nodes) then '-' when {o} > {i} then '>' || nodes[{o} + 1] else '<' || nodes[{o} + 1] end"

#: DuckDB SQL for the rows of the query.
SQL = f"""
with recursive {CRC_TABLE},
raw as (
  select doc_id, lang, {crc32_sql("coalesce(doc_id, 0)::varchar")} % 7 = 0 and doc_id is not null as hit,
    sha256({_field_sql("doc_id")} || {_field_sql("source")} || {_field_sql("lang")} || {_field_sql("n_chars")} || {_field_sql("text")}) as leaf,
    sha256({_field_sql("doc_id")} || {_field_sql("source")} || {_field_sql("lang")} || {_field_sql("n_chars + 1")} || {_field_sql("text")}) as changed
  from documents, tab),
leaves as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as idx, dense_rank() over (order by lang nulls first) - 1 as g from raw),
tree(g, lvl, nodes) as (
  select g, 0, list(leaf order by idx) from leaves group by g
  union all select g, lvl + 1, {_NEXT_LEVEL} from tree where len(nodes) > 1),
subroots as (select g, nodes[1] as subroot from tree where len(nodes) = 1),
over_tree(lvl, nodes) as (
  select 0, list(subroot order by g) from subroots
  union all select lvl + 1, {_NEXT_LEVEL} from over_tree where len(nodes) > 1),
steps as (
  select g, idx, lvl, {_STEP.format(o="xor(idx >> lvl, 1)", i="(idx >> lvl)")} as step from leaves join tree using (g) where len(nodes) > 1
  union all
  select g, idx, 100 + lvl, {_STEP.format(o="xor(g >> lvl, 1)", i="(g >> lvl)")} from leaves, over_tree where len(nodes) > 1),
ways as (select g, idx, list(step order by lvl) as way from steps group by g, idx),
told as (
  select doc_id, lang, leaf, subroot, (select nodes[1] from over_tree where len(nodes) = 1) as root,
    sha256(coalesce(list_aggregate(list_transform(way, lambda s: s[2:]), 'string_agg', ''), '')) as proof_sha256,
    list_reduce(list_prepend(case when hit then changed else leaf end, coalesce(way, [])), lambda a, s: case when s[1] = '<' then sha256(s[2:] || a) else sha256(a || s[2:]) end) as folded_root
  from leaves join subroots using (g) left join ways using (g, idx))
select doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from told
"""
