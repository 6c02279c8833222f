"""How a similarity graph falls apart: its maximum spanning forest, the merges that the forest gives, and what breaks off.

Components at a threshold are the same in a graph and in its maximum spanning forest, so
everything after the forest works on fewer edges than there are groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.structure import LENSES, components, top_tokens
from tidemark.session import discard, materialize

#: Levels of a threshold: 0 to STEPS hundredths.
STEPS = 100
#: Each round of :func:`merge_tree` divides a range of levels by FAN; FAN ** ROUNDS levels are told apart.
FAN, ROUNDS = 5, 3
#: A piece counts as major from this size on; pieces and tokens that are shown.
LEAST_MAJOR, MAJOR_SHARE, SHOWN_PIECES, SHOWN_BRIDGES = 10, 0.02, 4, 8


def weighted(pairs: DataFrame, lens: str = "jaccard") -> DataFrame:
    """(a, b, weight) of the pairs of positive similarity; rounded at the twelfth place, as sums differ in the last one."""
    return pairs.select("a", "b", F.round(LENSES[lens], 12).alias("weight")).where("weight > 0")


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The maximum spanning forest of ``edges`` (a, b, weight), by Boruvka rounds.

    In each round every component takes its heaviest outgoing edge (ties to the smaller ends, so that
    no circle can close), and components that are joined become one. Edges within a component go, and of parallel
    ones between two components the heaviest stays. The number of components at least halves a round.
    """
    order = F.struct("weight", -F.col("a"), -F.col("b"))
    plain = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").where("a <> b")
    current = materialize(plain.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "b", "weight"), "outgoing")
    forest = None
    while not current.isEmpty():
        both = current.select("x", "y", "a", "b", "weight").union(current.select(F.col("y"), F.col("x"), "a", "b", "weight"))
        taken = materialize(both.groupBy("x").agg(F.max_by(F.struct("y", "a", "b", "weight"), order).alias("e")).select("x", "e.*"), "taken")
        chosen = taken.select("a", "b", "weight").distinct()
        forest = chosen if forest is None else forest.union(chosen)
        labels = components(taken.select(F.col("x").alias("a"), F.col("y").alias("b")))
        x, y = (labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_")) for c in "xy")
        moved = current.join(x, "x").join(y, "y").where("x_ <> y_")
        least = moved.groupBy(F.least("x_", "y_").alias("x"), F.greatest("x_", "y_").alias("y")).agg(F.max_by(F.struct("a", "b", "weight"), order).alias("e"))
        following = materialize(least.select("x", "y", "e.*"), "outgoing")
        discard(current)
        current = following
    return forest if forest is not None else plain.limit(0)


def merge_tree(forest: DataFrame) -> DataFrame:
    """The merges of the forest as the threshold falls: (level, child, child_size, born, parent, parent_size).

    At ``level`` hundredths the cluster ``child``, which was there from level ``born`` on, goes up in ``parent``; both are named
    by their smallest node, and ``born`` is STEPS + 1 for a single node. Edges are cut into ranges of levels; a range's
    nodes are the clusters of the levels above it, so the ranges of a round are graphs of their own, solved together, with
    the forest's edges once (FAN - 1 times while a range is cut).
    """
    level = F.least(F.lit(STEPS), F.floor(F.col("weight") * STEPS)).cast("int")
    edges = materialize(forest.select(F.lit(0).alias("seg"), "a", "b", level.alias("level")), "tree-edges")
    ends = lambda df: df.select("seg", F.explode(F.array("a", "b")).alias("node")).distinct()
    sizes = ends(edges).withColumn("size", F.lit(1).cast("long"))
    for width in (FAN**k for k in range(ROUNDS - 1, -1, -1)):
        part = F.floor(F.col("level") / width).cast("int") % FAN
        cut = edges.withColumn("part", part)
        above = cut.where("part > 0").select("seg", F.explode(F.sequence(F.lit(1), "part")).alias("cut"), "a", "b")
        labels = components(above, ("seg", "cut"))
        grown = materialize(labels.join(sizes, ["seg", "node"]).withColumn("size", F.sum("size").over(Window.partitionBy("seg", "cut", "label"))), "grown")
        for c in "ab":
            named = grown.select("seg", (F.col("cut") - 1).alias("part"), F.col("node").alias(c), F.col("label").alias("__l"))
            cut = cut.join(named, ["seg", "part", c], "left").withColumn(c, F.coalesce("__l", c)).drop("__l")
        edges = materialize(cut.select((F.col("seg") * FAN + F.col("part")).alias("seg"), "a", "b", "level", F.col("seg").alias("was"), "part"), "tree-edges")
        nodes = edges.select("seg", "was", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
        bigger = grown.select(F.col("seg").alias("was"), (F.col("cut") - 1).alias("part"), F.col("label").alias("node"), F.col("size").alias("grown_size")).distinct()
        before = sizes.select(F.col("seg").alias("was"), "node", "size")
        sizes = materialize(
            nodes.join(bigger, ["was", "part", "node"], "left").join(before, ["was", "node"], "left").select("seg", "node", F.coalesce("grown_size", "size").alias("size")), "tree-sizes"
        )
        edges = edges.drop("was", "part")
    # a range is one level now
    joined = components(edges, ("seg",)).join(sizes, ["seg", "node"])
    whole = Window.partitionBy("seg", "label")
    merges = joined.select(F.col("seg").alias("level"), F.col("node").alias("child"), F.col("size").alias("child_size"), F.col("label").alias("parent"), F.sum("size").over(whole).alias("parent_size"))
    # the parent bears its smallest child's name: what that name stood for ends and begins anew at the level
    earlier = F.lag("level").over(Window.partitionBy("child").orderBy(F.desc("level")))
    return merges.withColumn("born", F.coalesce(earlier, F.lit(STEPS + 1)))


def sweep(found: DataFrame, tree: DataFrame) -> DataFrame:
    """At each of the thresholds 0 to 1: families, largest, second, singletons, sum of squares and mean size of the others.

    Every cluster is there from the level at which it came to be down to the one above that at which it goes up in another. The
    two largest sizes of each such span are enough, and spans are few.
    """
    spark = found.sparkSession
    last = Window.partitionBy("parent", "level")
    came = tree.withColumn("__r", F.row_number().over(last.orderBy("child"))).where("__r = 1").select(F.col("parent").alias("name"), F.col("level").alias("born"), F.col("parent_size").alias("size"))
    went = tree.select(F.col("child").alias("name"), "born", F.col("level").alias("ends"))
    spans = came.join(went, ["name", "born"], "left").select("size", "born", F.coalesce(F.col("ends") + 1, F.lit(0)).alias("to"))
    top = spans.groupBy("born", "to", "size").agg(F.count("*").alias("n"))
    alive = top.where("born >= to").select("size", "n", F.explode(F.sequence("to", "born")).alias("t"))
    merged = alive.groupBy("t", "size").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("r", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("size"))))
    told = ranked.groupBy("t").agg(
        F.sum("n").alias("k"), F.sum(F.col("n") * F.col("size")).alias("m"), F.max("size").alias("largest"),
        F.coalesce(F.max(F.when((F.col("r") == 1) & (F.col("n") > 1), F.col("size"))), F.max(F.when(F.col("r") == 2, F.col("size")))).alias("second"),
        (F.sum(F.col("n") * F.col("size") * F.col("size")) - F.pow(F.max("size"), F.lit(2)).cast("long")).alias("squares"),
    )
    total = found.agg(F.count("*").alias("g"))
    every = spark.range(STEPS + 1).select(F.col("id").cast("int").alias("t")).join(F.broadcast(told), "t", "left").crossJoin(F.broadcast(total))
    lone = F.col("g") - F.coalesce("m", F.lit(0))
    largest = F.coalesce("largest", F.when(F.col("g") > 0, 1).otherwise(0))
    alone = F.when(F.col("largest").isNotNull(), lone).otherwise(F.greatest(lone - 1, F.lit(0)))
    squares, finite = F.coalesce("squares", F.lit(0)) + alone, F.col("g") - largest
    return every.select(
        (F.col("t") / STEPS).alias("threshold"), (F.coalesce("k", F.lit(0)) + lone).alias("families"), largest.cast("long").alias("largest"),
        F.coalesce("second", F.when(alone > 0, 1).otherwise(0)).cast("long").alias("second"), lone.alias("singletons"),
        squares.alias("second_moment"), F.when(finite > 0, squares / finite).otherwise(0.0).alias("mean_finite_size"),
    )


def cut(found: DataFrame, forest: DataFrame, threshold: float) -> DataFrame:
    """(idx, label): the families at a threshold, from the forest alone; singletons are their own."""
    labels = components(forest.where(F.col("weight") >= threshold))
    return found.select("idx").join(labels.withColumnRenamed("node", "idx"), "idx", "left").select("idx", F.coalesce("label", "idx").alias("label"))


def split(stats: DataFrame, first: bool = False) -> tuple[float, float] | None:
    """The thresholds before and at a split: where the mean finite size is largest (the lowest such), or with ``first``
    where the largest family first shrinks while a second one is there. None if there's none."""
    w = Window.orderBy("threshold")
    near = stats.withColumns({"before": F.coalesce(F.lag("threshold").over(w), "threshold"), "was": F.lag("largest").over(w)})
    order = ["threshold"] if first else [F.desc("mean_finite_size"), "threshold"]
    row = near.where((F.col("largest") < F.col("was")) & (F.col("second") > 0) if first else F.lit(True)).orderBy(*order).select("before", "threshold").first()
    return tuple(row) if row else None


def pieces(found: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(piece, idx): what the largest family of ``before`` (the one with the smallest name, if several) is in ``after``.

    Pieces are numbered by size, then name. The families' table has one row a family and only its first row is taken.
    """
    largest = before.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1).select(F.col("label").alias("largest"))
    inside = before.join(F.broadcast(largest), F.col("label") == F.col("largest")).select("idx").join(after, "idx")
    counted = inside.groupBy("label").agg(F.count("*").alias("n"))
    # one row a piece, of one family
    ranked = counted.withColumn("piece", F.row_number().over(Window.orderBy(F.desc("n"), "label"))).select("label", "piece")
    return inside.join(ranked, "label").select("piece", "idx")


def _shares(found: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of ``members`` (keys, idx) and token the share of entities in that state."""
    rows = members.join(found.select("idx", "size", "tokens"), "idx")
    total = rows.groupBy(*keys).agg(F.sum("size").alias("entities"))
    held = rows.select(*keys, "size", F.explode("tokens").alias("token")).groupBy(*keys, "token").agg(F.sum("size").alias("n"))
    joined = held.join(total, keys) if keys else held.crossJoin(F.broadcast(total))
    return joined.select(*keys, "token", (F.col("n") / F.col("entities")).alias("share"))


def piece_contrast(found: DataFrame, broken: DataFrame) -> DataFrame:
    """The five commonest tokens of the four largest pieces against the family they broke off: share, baseline share, lift, and
    contrast, the share less the largest share in another major piece.

    A piece is major from max(10, 2 % of the family's groups) groups on.
    """
    broken = materialize(broken, "pieces")
    counts = broken.groupBy("piece").agg(F.count("*").alias("groups"))
    family = counts.agg(F.greatest(F.lit(LEAST_MAJOR), F.ceil(F.sum("groups") * MAJOR_SHARE)).alias("least"))
    major = counts.crossJoin(F.broadcast(family)).where(F.col("groups") >= F.col("least")).select("piece")
    own = materialize(_shares(found, broken, ["piece"]), "piece-shares")
    base = _shares(found, broken.select("idx"), []).withColumnRenamed("share", "baseline_share")
    # the two largest shares among major pieces: the first, or for the piece that holds it the second
    ranks = Window.partitionBy("token").orderBy(F.desc("share"), "piece")
    best = own.join(F.broadcast(major), "piece", "left_semi").withColumn("r", F.row_number().over(ranks)).where("r <= 2").groupBy("token").agg(
        F.max(F.when(F.col("r") == 1, F.col("piece"))).alias("holder"), F.max("share").alias("first"), F.max(F.when(F.col("r") == 2, F.col("share"))).alias("second")
    )
    top = top_tokens(found, broken.where(F.col("piece") <= SHOWN_PIECES).select("idx", F.col("piece").alias("label"))).withColumnRenamed("label", "piece")
    told = top.join(own, ["piece", "token"]).join(base, "token").join(best, "token", "left")
    other = F.greatest(F.lit(0.0), F.coalesce(F.when(F.col("holder") == F.col("piece"), F.col("second")).otherwise(F.col("first")), F.lit(0.0)))
    return told.select("piece", "rank", "token", "entities", "groups", "share", "baseline_share", (F.col("share") / F.col("baseline_share")).alias("lift"), (F.col("share") - other).alias("contrast"))


def hamming_audit(found: DataFrame, pairs: DataFrame, broken: DataFrame, threshold: float) -> DataFrame:
    """Whether pieces hold together by another measure: per piece its groups, entities, mean Hamming similarity of all its pairs
    (null for one group), and the sub-clusters that the threshold leaves in it.

    Only pairs within a piece count, and all pieces are solved together. Pairs that agree in nothing aren't in ``pairs``; they
    count as 0 in the mean.
    """
    broken = materialize(broken, "pieces")
    side = lambda c: broken.select(F.col("idx").alias(c), F.col("piece").alias(f"p{c}"))
    inside = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where("pa = pb").select(F.col("pa").alias("piece"), "a", "b", "hamming"), "inner-pairs")
    labels = components(inside.where(F.col("hamming") >= threshold), ("piece",))
    clusters = broken.join(labels.withColumnRenamed("node", "idx"), ["piece", "idx"], "left").groupBy("piece", F.coalesce("label", "idx").alias("label")).agg(F.count("*").alias("n"))
    sizes = clusters.groupBy("piece").agg(F.count("*").alias("subclusters"), F.max("n").alias("largest_subcluster"), F.count_if(F.col("n") == 1).alias("singletons"))
    summed = inside.groupBy("piece").agg(F.sum("hamming").alias("total"))
    told = broken.join(found.select("idx", "size"), "idx").groupBy("piece").agg(F.count("*").alias("groups"), F.sum("size").alias("entities")).join(sizes, "piece").join(summed, "piece", "left")
    n = F.col("groups")
    return told.select(
        "piece", "groups", "entities", F.when(n > 1, F.coalesce("total", F.lit(0.0)) / (n * (n - 1) / 2)).alias("mean_hamming"), "subclusters", "largest_subcluster",
        (F.col("largest_subcluster") / n).alias("largest_share"), "singletons",
    )


def broken_bridges(found: DataFrame, edges: DataFrame, broken: DataFrame, before: float, after: float) -> DataFrame:
    """The eight tokens shared by most of the edges that held a family together and are gone: edges, share, baseline share, lift, mean weight.

    ``edges`` are those of the graph (a, b, weight), not of its forest: every lost edge between two pieces counts.
    """
    side = lambda c: broken.select(F.col("idx").alias(c), F.col("piece").alias(f"p{c}"))
    lost = edges.where((F.col("weight") >= before) & (F.col("weight") < after)).join(side("a"), "a").join(side("b"), "b").where("pa <> pb")
    lost = materialize(lost.select("a", "b", "weight"), "lost-edges")
    tokens = found.select("idx", F.explode("tokens").alias("token"))
    shared = lost.join(tokens.withColumnRenamed("idx", "a"), "a").join(tokens.withColumnRenamed("idx", "b"), ["b", "token"])
    counted = shared.groupBy("token").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))
    total, base = lost.agg(F.count("*").alias("bridges")), _shares(found, broken.select("idx"), []).withColumnRenamed("share", "baseline_share")
    told = counted.crossJoin(F.broadcast(total)).join(base, "token").withColumn("share", F.col("edges") / F.col("bridges"))
    shown = told.orderBy(F.desc("edges"), F.desc(F.round("weight", 9)), "token").limit(SHOWN_BRIDGES)
    return shown.select("token", "edges", "bridges", "share", "baseline_share", (F.col("share") / F.col("baseline_share")).alias("lift"), (F.col("weight") / F.col("edges")).alias("mean_weight"))
