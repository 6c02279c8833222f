"""Market structure: groups of entities in one state, their similarity, and how the graph falls apart as the threshold rises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import discard, if_small, materialize

#: The cap of a token's weight; the neighbours and least weight of the sparse graph.
IDF_CAP, TOP_NEIGHBOURS, LEAST_WEIGHT = 3.0, 14, 0.08
LENSES = {"jaccard": "jaccard", "idf": "idf_jaccard", "hamming": "hamming"}


def directional(signal_key: Column) -> Column:
    return ~signal_key.startswith("mixed_")


def state_vectors(signals: DataFrame, questions: list[tuple[str, str]]) -> DataFrame:
    """Per entity the sorted vector ``factor.axis=state`` over all questions, ``missing`` where there is none, and its directional tokens."""
    keys = F.array(*[F.struct(F.lit(f).alias("factor"), F.lit(a).alias("axis")) for f, a in questions])
    answers = signals.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(".", "factor", "axis"), "signal_key"))).alias("m"))
    name = lambda k: F.concat_ws(".", k["factor"], k["axis"])
    told = answers.withColumn("keys", keys)
    vector = F.array_sort(F.transform("keys", lambda k: F.concat(name(k), F.lit("="), F.coalesce(F.col("m")[name(k)], F.lit("missing")))))
    tokens = F.array_sort(F.filter(F.transform("keys", lambda k: F.when(directional(F.col("m")[name(k)]), F.concat_ws(".", name(k), F.col("m")[name(k)]))), lambda t: t.isNotNull()))
    return told.select("entity", vector.alias("state_vector"), tokens.alias("tokens"))


def groups(vectors: DataFrame) -> DataFrame:
    """Entities with the same full vector are one group: its key (12 hex digits of SHA-1), index, vector, tokens and size.

    ``idx`` numbers groups by size, then key: ranges of that order are numbered apart, from
    the counts of the ranges before them.
    """
    found = vectors.groupBy("state_vector").agg(F.count("*").alias("size"), F.first("tokens").alias("tokens"), F.min("entity").alias("sample"))
    keyed = found.withColumn("group_key", F.substring(F.sha1(F.encode(F.concat_ws("|", "state_vector"), "UTF-8")), 1, 12))
    return numbered(keyed, [F.desc("size"), F.asc("group_key")], "idx")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``, the place of each row in ``order``, from 0, without a task that sees all rows.

    One range shuffle; what comes before a range is a sum over one row a range.
    """
    ranged = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(F.broadcast(starts), "__part").withColumn(name, (F.col("__start") + own - 1).cast("long")).drop("__part", "__start")


def token_weights(found: DataFrame) -> DataFrame:
    """(token, df, weight): min(ln(1 + groups / df), 3)."""
    total = found.agg(F.count("*").alias("g"))
    df = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.least(F.log(1 + F.col("g") / F.col("df")), F.lit(IDF_CAP)).alias("weight"))


#: Groups of one state that a task meets with each other.
GROUPS_A_TASK = 1000


def pair_similarity(found: DataFrame) -> DataFrame:
    """Pairs of groups that are in one state in some question: a < b, shared and union counts of tokens, Jaccard, its weighted form, Hamming.

    Pairs meet by state, directional or not; a pair that agrees in no question has similarity
    0 in every lens and isn't made (:func:`histogram` counts these by arithmetic). Sums run
    per pair before anything else is joined. Groups of a common state are dealt to parts that
    meet each other, so no task holds all of its pairs.
    """
    weights = token_weights(found)
    token = lambda s: F.regexp_replace(s, "=", ".")
    states = found.select("idx", "tokens", F.explode("state_vector").alias("state"))
    states = states.select("idx", "state", F.when(F.array_contains("tokens", token(F.col("state"))), token(F.col("state"))).alias("token"))
    states = materialize(states.join(if_small(weights), "token", "left").select("idx", "state", "weight"), "states")
    sizes = states.groupBy("idx").agg(F.count("weight").alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), F.count("*").alias("questions"))
    parts = if_small(states.groupBy("state").agg(F.ceil(F.count("*") / GROUPS_A_TASK).alias("parts")))
    dealt = states.join(parts, "state")
    x = dealt.withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts"))).alias("x")
    y = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    same = (F.col("x.state") == F.col("y.state")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.idx") < F.col("y.idx"))
    met = x.join(y, same).groupBy(F.col("x.idx").alias("a"), F.col("y.idx").alias("b")).agg(
        F.count("*").alias("agree"), F.count("x.weight").alias("shared"), F.coalesce(F.sum("x.weight"), F.lit(0.0)).alias("shared_weight")
    )
    side = lambda i: if_small(sizes.select(F.col("idx").alias(i), *[F.col(c).alias(c + i) for c in ("n", "w", "questions")]))
    both = met.join(side("a"), "a").join(side("b"), "b")
    longest = F.greatest("questionsa", "questionsb")
    different = (longest - F.col("agree")).cast("int")
    union, weight = F.col("na") + F.col("nb") - F.col("shared"), F.col("wa") + F.col("wb") - F.col("shared_weight")
    return both.select(
        "a", "b", "shared", union.alias("union"), F.when(union > 0, F.col("shared") / union).otherwise(0.0).alias("jaccard"),
        F.when(F.col("shared") > 0, F.col("shared_weight") / weight).otherwise(0.0).alias("idf_jaccard"),
        (1 - different / longest).alias("hamming"), different.alias("different"),
    )


def histogram(found: DataFrame, pairs: DataFrame, column: str = "hamming", buckets: int = 20) -> DataFrame:
    """(bucket, n, share) for every bucket from 0 to ``buckets``, empty ones too, over all pairs of ``found``: those not made are in bucket 0."""
    spark = pairs.sparkSession
    counted = pairs.groupBy(F.least(F.lit(buckets), F.floor(F.col(column) * buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    every = spark.range(buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counted), "bucket", "left").fillna(0, ["n"])
    total = found.agg(((F.count("*") * (F.count("*") - 1)) / 2).cast("long").alias("total"))
    made = every.withColumn("made", F.sum("n").over(Window.partitionBy())).crossJoin(F.broadcast(total))
    told = made.withColumn("n", F.col("n") + F.when(F.col("bucket") == 0, F.col("total") - F.col("made")).otherwise(0))
    return told.select("bucket", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"))


def components(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, label): connected components of edges (keys, a, b), the label the smallest node.

    Each round takes the least label of a node's neighbours and then the label of that
    label, so long chains shrink quickly; rounds are written tables, and end when nothing
    changes. With ``keys``, as many graphs as there are keys are solved in the same rounds.
    """
    k = list(keys)
    both = materialize(edges.select(*k, "a", "b").union(edges.select(*k, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    labels = materialize(both.groupBy(*k, F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*k, "b"]).groupBy(*k, F.col("a").alias("node")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, [*k, "node"]).select(*k, "node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        root = labels.select(*k, F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(hooked.join(root, [*k, "label"]).select(*k, "node", F.least("label", "up").alias("label"), "old"), "labels")
        done = step.where("label <> old").isEmpty()
        discard(labels)
        labels = step.drop("old")
        if done:
            return labels


def families(found: DataFrame, pairs: DataFrame, threshold: float, lens: str = "jaccard") -> DataFrame:
    """(idx, label): the components of groups whose similarity is above 0 and at least ``threshold``; singletons are their own."""
    weight = F.col(LENSES[lens])
    labels = components(pairs.where((weight > 0) & (weight >= threshold)))
    return found.select("idx").join(labels.withColumnRenamed("node", "idx"), "idx", "left").select("idx", F.coalesce("label", "idx").alias("label"))


def threshold_candidates(stats: DataFrame, total: int) -> DataFrame:
    """Where a second family of weight appears, where it is gone again, and where the largest drops most after that.

    ``stats`` has one row per threshold. Weight is max(10, 2 % of the groups); the defaults
    where nothing is found are 0.4, 0.7 and 0.75.
    """
    size = max(10, -(-total // 50))
    emerged = stats.agg(F.min(F.when(F.col("second") >= size, F.col("threshold"))).alias("e")).select(F.coalesce("e", F.lit(0.4)).alias("emergence"))
    w = Window.orderBy("threshold")
    after = stats.withColumn("drop", F.lag("largest").over(w) - F.col("largest")).crossJoin(F.broadcast(emerged))
    later = F.col("threshold") > F.col("emergence")
    return after.agg(
        F.max("emergence").alias("secondary_emergence"),
        F.coalesce(F.min(F.when(later & (F.col("second") < size), F.col("threshold"))), F.lit(0.7)).alias("secondary_disappearance"),
        F.coalesce(F.max_by("threshold", F.when(later & (F.col("drop") > 0), F.struct("drop", -F.col("threshold")))), F.lit(0.75)).alias("giant_collapse"),
    )


def percolation_peak(stats: DataFrame) -> DataFrame:
    """The threshold with the largest mean finite size, the lowest if several; and the first at which the largest family shrinks."""
    w = Window.orderBy("threshold")
    return stats.withColumn("shrinks", F.col("largest") < F.lag("largest").over(w)).agg(
        F.max_by("threshold", F.struct("mean_finite_size", -F.col("threshold"))).alias("peak"), F.min(F.when(F.col("shrinks"), F.col("threshold"))).alias("first_drop")
    )


def bridges(pairs: DataFrame, before: DataFrame, after: DataFrame, low: float, high: float, lens: str = "jaccard") -> DataFrame:
    """Edges that are lost between two thresholds and joined different families of the higher one: (a, b, weight, label_a, label_b, parent)."""
    weight = F.col(LENSES[lens])
    lost = pairs.where((weight > 0) & (weight >= low) & (weight < high)).select("a", "b", weight.alias("weight"))
    name = lambda df, n, l: df.select(F.col("idx").alias(n), F.col("label").alias(l))
    return (
        lost.join(if_small(name(after, "a", "label_a")), "a").join(if_small(name(after, "b", "label_b")), "b").join(if_small(name(before, "a", "parent")), "a")
        .where("label_a <> label_b").select("a", "b", "weight", "label_a", "label_b", "parent")
    )


def bridge_tokens(found: DataFrame, bridge: DataFrame, pairs_count: int) -> DataFrame:
    """Per token its share among bridges (both ends hold it) and the lift over its share among all groups."""
    tokens = found.select("idx", F.explode("tokens").alias("token"))
    base = tokens.groupBy("token").agg((F.count("*") / F.lit(float(max(1, pairs_count)))).alias("base_share"))
    x, y = tokens.withColumnRenamed("idx", "a"), tokens.withColumnRenamed("idx", "b")
    total = bridge.agg(F.count("*").alias("bridges"))
    on = bridge.join(x, "a").join(y, ["b", "token"]).groupBy("token").agg(F.count("*").alias("n"))
    return on.crossJoin(F.broadcast(total)).join(base, "token").select("token", "n", (F.col("n") / F.col("bridges")).alias("share"), (F.col("n") / F.col("bridges") / F.col("base_share")).alias("lift"))


def top_tokens(found: DataFrame, labels: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` commonest tokens of each family: by entities, then groups, then token."""
    flat = found.join(labels, "idx").select("label", "size", F.explode("tokens").alias("token"))
    counted = flat.groupBy("label", "token").agg(F.sum("size").alias("entities"), F.count("*").alias("groups"))
    w = Window.partitionBy("label").orderBy(F.desc("entities"), F.desc("groups"), "token")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def nearest_groups(found: DataFrame, pairs: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most similar groups of each: Jaccard, then size, both descending, then index."""
    both = pairs.select("a", "b", "jaccard").union(pairs.select(F.col("b"), F.col("a"), F.col("jaccard")))
    sized = both.join(if_small(found.select(F.col("idx").alias("b"), F.col("size").alias("size_b"))), "b")
    w = Window.partitionBy("a").orderBy(F.desc("jaccard"), F.desc("size_b"), "b")
    return sized.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("a", "rank", "b", "jaccard")


def sparse_graph(pairs: DataFrame, k: int = TOP_NEIGHBOURS, least: float = LEAST_WEIGHT) -> DataFrame:
    """(a, b, weight): the ``k`` heaviest edges of each node that weigh at least ``least``, an edge kept if either end keeps it."""
    some = pairs.where(F.col("idf_jaccard") >= least).select("a", "b", F.col("idf_jaccard").alias("weight"))
    both = some.union(some.select(F.col("b"), F.col("a"), F.col("weight")))
    w = Window.partitionBy("a").orderBy(F.desc("weight"), "b")
    kept = both.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight").distinct()


def adjusted_rand(labels: DataFrame, x: str, y: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The adjusted Rand index of two labelings of the same rows, per key; 0 where its denominator is 0."""
    k = list(keys)
    choose = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = labels.groupBy(*k, x, y).agg(F.count("*").alias("n"))
    total = lambda by: cells.groupBy(*k, by).agg(F.sum("n").alias("n")).groupBy(*k).agg(F.sum(choose("n")).alias(by + "_pairs"))
    both = cells.groupBy(*k).agg(F.sum(choose("n")).alias("cell_pairs"), F.sum("n").alias("rows"))
    join = lambda a, b: a.join(b, k) if k else a.crossJoin(b)
    told = join(join(both, total(x)), total(y))
    all_pairs = choose("rows")
    expected = F.when(all_pairs > 0, F.col(x + "_pairs") * F.col(y + "_pairs") / all_pairs).otherwise(0.0)
    most = (F.col(x + "_pairs") + F.col(y + "_pairs")) / 2
    return told.select(*k, F.when(most - expected != 0, (F.col("cell_pairs") - expected) / (most - expected)).otherwise(0.0).alias("adjusted_rand"))


def partition_grid(found: DataFrame, pairs: DataFrame, left: list[float], right: list[float]) -> DataFrame:
    """The adjusted Rand index of Jaccard and Hamming families for each pair of thresholds."""

    def labelled(thresholds: list[float], lens: str, name: str) -> DataFrame:
        spark = found.sparkSession
        steps = spark.createDataFrame([(t,) for t in thresholds], f"{name} double")
        w = F.col(LENSES[lens])
        edges = pairs.where(w > 0).join(F.broadcast(steps), w >= F.col(name)).select(name, "a", "b")
        labels = components(edges, (name,)).withColumnRenamed("node", "idx")
        every = found.select("idx").crossJoin(F.broadcast(steps))
        return every.join(labels, [name, "idx"], "left").select(name, "idx", F.coalesce("label", "idx").alias(f"{name}_label"))

    both = labelled(left, "jaccard", "jaccard_t").join(labelled(right, "hamming", "hamming_t"), "idx")
    return adjusted_rand(both, "jaccard_t_label", "hamming_t_label", ("jaccard_t", "hamming_t"))


def state_diversity(vectors: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` questions whose commonest state is least dominant: (question, states, dominant_share)."""
    flat = vectors.select(F.explode("state_vector").alias("s")).select(F.substring_index("s", "=", 1).alias("question"), F.substring_index("s", "=", -1).alias("state"))
    counted = flat.groupBy("question", "state").agg(F.count("*").alias("n"))
    told = counted.groupBy("question").agg(F.count("*").alias("states"), (F.max("n") / F.sum("n")).alias("dominant_share"))
    return told.orderBy("dominant_share", "question").limit(n)


def share_by(rows: DataFrame, key: str, n: int, total: int | None = None) -> DataFrame:
    """The ``n`` commonest values of ``key`` with their share; ties by name."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("name")).agg(F.count("*").alias("n"))
    whole = F.lit(float(total)) if total else F.sum("n").over(Window.partitionBy())
    return counted.withColumn("share", F.col("n") / whole).orderBy(F.desc("n"), "name").limit(n)


def feature_audit(features: DataFrame, member: Column, least: int = 5) -> DataFrame:
    """Per feature how far a family's median lies from the others', in their interquartile ranges; five largest."""
    told = features.withColumn("__m", member).groupBy("factor", "axis", "feature_key").agg(
        F.percentile(F.when(F.col("__m"), F.col("feature_value")), 0.5).alias("inside"), F.count(F.when(F.col("__m"), F.col("feature_value"))).alias("n"),
        *[F.percentile(F.when(~F.col("__m"), F.col("feature_value")), p).alias(a) for p, a in ((0.5, "outside"), (0.25, "q1"), (0.75, "q3"))],
    )
    spread = F.col("q3") - F.col("q1")
    scored = told.where(F.col("n") >= least).withColumn("shift", F.when(spread > 0, (F.col("inside") - F.col("outside")) / spread)).where("shift is not null")
    return scored.orderBy(F.desc(F.abs("shift")), "factor", "axis", "feature_key").limit(5)


def top_members(members: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Each group's ``n`` largest members (ticker, market_cap) by capitalisation, unknown ones last, then by ticker; ``place`` counts from 1."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce("market_cap", F.lit(-1.0)).desc(), "ticker")
    return members.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def extremes(items: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Per group the tickers of the ``n`` items of largest absolute value and of the ``n`` nearest to their threshold, as sorted arrays.

    ``items``: ticker, value, threshold; a null value is in neither, a null threshold in the
    first only. Ties go to the smaller ticker.
    """
    far = Window.partitionBy(*keys).orderBy(F.abs("value").desc_nulls_last(), "ticker")
    near = Window.partitionBy(*keys).orderBy(F.abs(F.col("value") - F.col("threshold")).asc_nulls_last(), "ticker")
    ranked = items.withColumns({"far": F.when(F.col("value").isNotNull(), F.row_number().over(far)), "near": F.when((F.col("value") - F.col("threshold")).isNotNull(), F.row_number().over(near))})
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) <= n, F.struct(c, "ticker")))), lambda x: x["ticker"])
    return ranked.where((F.col("far") <= n) | (F.col("near") <= n)).groupBy(*keys).agg(pick("far").alias("outliers"), pick("near").alias("near_threshold"))


def best_cell(grid: DataFrame) -> tuple[float, float] | None:
    """The pair of thresholds of :func:`partition_grid` that agrees best, the lowest thresholds if several do."""
    row = grid.orderBy(F.desc(F.round("adjusted_rand", 12)), "jaccard_t", "hamming_t").select("jaccard_t", "hamming_t").first()
    return tuple(row) if row else None


def ranked_families(labels: DataFrame) -> DataFrame:
    """(label, family, groups): families numbered from 1 by size, then label."""
    counted = labels.groupBy("label").agg(F.count("*").alias("groups"))
    return numbered(counted, [F.desc("groups"), F.asc("label")], "__at").select("label", (F.col("__at") + 1).alias("family"), "groups")


def matched_families(found: DataFrame, left: DataFrame, right: DataFrame, n: int = 8, tokens: int = 5) -> DataFrame:
    """The ``n`` largest overlaps between the families of two partitions (idx, label): by groups, then entities, then family numbers.

    Each with its shares of either family and of their union, whether the two are each other's largest overlap, and the overlap's
    commonest tokens. Only cells that hold a group exist, so the table of cells has at most a row a group.
    """
    x, y = materialize(ranked_families(left), "left-families"), materialize(ranked_families(right), "right-families")
    named = lambda df, ranks, side: df.join(if_small(ranks), "label").select("idx", F.col("family").alias(side), F.col("groups").alias(f"{side}_groups"))
    both = materialize(named(left, x, "left_family").join(named(right, y, "right_family"), "idx").join(found.select("idx", "size", "tokens"), "idx"), "overlaps")
    cells = both.groupBy("left_family", "right_family", "left_family_groups", "right_family_groups").agg(F.count("*").alias("overlap"), F.sum("size").alias("entities"))
    best = lambda side, other: F.row_number().over(Window.partitionBy(side).orderBy(F.desc("overlap"), F.desc("entities"), other)) == 1
    cells = cells.withColumn("mutual_best", best("left_family", "right_family") & best("right_family", "left_family"))
    order = [F.desc("overlap"), F.desc("entities"), F.asc("left_family"), F.asc("right_family")]
    top = materialize(cells.orderBy(*order).limit(n), "top-overlaps").withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    inside = both.join(F.broadcast(top.select("left_family", "right_family", "rank")), ["left_family", "right_family"])
    held = top_tokens(inside.select("idx", "size", "tokens"), inside.select("idx", F.col("rank").alias("label")), tokens)
    shown = held.groupBy(F.col("label").alias("rank_")).agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("t"))
    n_, union = F.col("overlap"), F.col("left_family_groups") + F.col("right_family_groups") - F.col("overlap")
    return top.join(shown, top["rank"] == shown["rank_"], "left").select(
        top["rank"], "left_family", "right_family", "overlap", "entities", (n_ / F.col("left_family_groups")).alias("share_of_left"), (n_ / F.col("right_family_groups")).alias("share_of_right"),
        (n_ / union).alias("overlap_jaccard"), "mutual_best", F.coalesce(F.transform("t", lambda x: x["token"]), F.array().cast("array<string>")).alias("top_tokens"),
    )
