"""Market structure at many dates and scopes in one job, and a store that keeps what doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.structure import GROUPS_A_TASK, IDF_CAP, components, directional
from tidemark.session import FEATURES_A_TASK, dealt, if_small, materialize

#: The scopes of a timeline and the axes they look at; a scope without axes looks at all.
SCOPES = {"all": None, "fundamentals": ("fundamentals_based",), "price_linked": ("market_price", "etf_exposure")}
#: A snapshot is told apart by these.
KEYS = ["scope", "as_of"]
#: Tokens shown of the largest family.
CORE = 5


def scoped(signals: DataFrame, scopes: dict[str, tuple[str, ...] | None] = SCOPES) -> DataFrame:
    """Each signal once for every scope that looks at its axis."""
    names = [F.when(F.lit(True) if axes is None else F.col("axis").isin(*axes), F.lit(scope)) for scope, axes in scopes.items()]
    return signals.withColumn("scope", F.explode(F.filter(F.array(*names), lambda s: s.isNotNull())))


def gated(signals: DataFrame, policies: DataFrame, statuses: tuple[str, ...] = ("use", "review")) -> DataFrame:
    """Signals of the questions (factor, axis) whose policy is active and of one of the ``statuses``."""
    open_ = policies.where(F.col("is_active") & F.col("status").isin(*statuses)).select("factor", "axis").distinct()
    return signals.join(if_small(open_), ["factor", "axis"], "left_semi")


def state_groups(signals: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Per snapshot the groups of entities in one state: idx (by size, then state), state, size, directional tokens.

    An entity's state is what it answers; an unanswered question isn't in it. A snapshot's groups are at most as many as its entities.
    """
    name = F.concat_ws(".", "factor", "axis")
    own = signals.groupBy(*keys, "entity").agg(
        F.array_sort(F.collect_set(F.concat(name, F.lit("="), F.col("signal_key")))).alias("state"),
        F.array_sort(F.collect_set(F.when(directional(F.col("signal_key")), F.concat_ws(".", name, "signal_key")))).alias("tokens"),
    )
    found = own.groupBy(*keys, "state").agg(F.count("*").alias("size"), F.first("tokens").alias("tokens"))
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), F.concat_ws("|", "state"))
    return found.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def weighted_tokens(found: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Adds ``weights``, each group's (token, weight), the rarest first: min(ln(1 + groups / groups with the token), 3)."""
    total = found.groupBy(*keys).agg(F.count("*").alias("__g"))
    flat = found.select(*keys, "idx", F.explode("tokens").alias("token"))
    df = flat.groupBy(*keys, "token").agg(F.count("*").alias("__df"))
    weights = df.join(if_small(total), keys).select(*keys, "token", F.round(F.least(F.log(1 + F.col("__g") / F.col("__df")), F.lit(IDF_CAP)), 12).alias("weight"))
    listed = flat.join(if_small(weights), [*keys, "token"]).groupBy(*keys, "idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))).alias("l"))
    some = F.transform("l", lambda x: F.struct(x["token"].alias("token"), (-x["w"]).alias("weight")))
    return found.join(listed.select(*keys, "idx", some.alias("weights")), [*keys, "idx"], "left")


def similar_pairs(weighted: DataFrame, least: float, keys: list[str] = KEYS) -> DataFrame:
    """(keys, a, b, weight) for all pairs of groups whose weighted Jaccard similarity is at least ``least`` (above 0), and no others.

    A pair as similar as that shares one of the tokens that each group has before the rest of its weight is
    below ``least`` of the whole; only these meet, rarest first, and totals further apart than ``least`` don't. Groups
    that meet by a token are dealt to parts, so that no task holds all pairs of a common one.
    """
    sums = F.aggregate("weights", F.lit(0.0), lambda t, x: t + x["weight"])
    w = weighted.where(F.size("weights") > 0).select(*keys, "idx", "weights", sums.alias("total"))
    left = lambda i: F.aggregate(F.slice("weights", F.lit(1), i), F.col("total"), lambda t, x: t - x["weight"])
    first = F.filter(F.transform("weights", lambda x, i: F.when(left(i) >= least * F.col("total") - 1e-9, x["token"])), lambda t: t.isNotNull())
    rows = materialize(w.withColumn("token", F.explode(first)), "prefixes")
    parts = if_small(rows.groupBy(*keys, "token").agg(F.ceil(F.count("*") / GROUPS_A_TASK).alias("parts")))
    apart = rows.join(parts, [*keys, "token"])
    named = lambda df, n: df.select(*keys, "token", "part", F.col("idx").alias(n), F.col("weights").alias(f"w{n}"), F.col("total").alias(f"t{n}"))
    x = named(apart.withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts"))), "a")
    y = named(apart.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))), "b")
    met = x.join(y, [*keys, "token", "part"]).where((F.col("a") < F.col("b")) & (F.least("ta", "tb") >= least * F.greatest("ta", "tb") - 1e-9))
    shared = F.aggregate(F.array_intersect("wa", "wb"), F.lit(0.0), lambda t, x: t + x["weight"])
    scored = met.withColumn("s", shared).select(*keys, "a", "b", F.round(F.col("s") / (F.col("ta") + F.col("tb") - F.col("s")), 9).alias("weight"))
    return scored.where(F.col("weight") >= least).distinct()


def snapshot_rows(signals: DataFrame, threshold: float = 0.6, keys: list[str] = KEYS) -> DataFrame:
    """One row a snapshot: entities, groups, directional tokens, families at the threshold, the largest family and its core.

    All snapshots go through the same joins, told apart by their keys. The largest family has the most groups, then the smallest
    index; its core are the tokens that most of its entities hold.
    """
    # an entity's signals are short when shuffled and long as state; by rows, not bytes, a task's states are bounded
    groups = materialize(state_groups(dealt(signals, FEATURES_A_TASK, *keys, "entity"), keys), "state-groups")  # read five times for the weights
    found = materialize(weighted_tokens(groups, keys), "snapshot-groups")
    labels = components(similar_pairs(found, threshold, keys), tuple(keys))
    member = found.join(labels.withColumnRenamed("node", "idx"), [*keys, "idx"], "left").withColumn("label", F.coalesce("label", "idx"))
    families = member.groupBy(*keys, "label").agg(F.count("*").alias("groups"), F.sum("size").alias("entities"))
    by_size = F.struct(F.col("groups"), -F.col("label"))
    facts = families.groupBy(*keys).agg(F.sum("entities").alias("entities"), F.sum("groups").alias("groups"), F.count("*").alias("families"), F.max_by(F.struct("label", "groups", "entities"), by_size).alias("l"))
    dims = found.select(*keys, F.explode("tokens").alias("t")).groupBy(*keys).agg(F.count_distinct("t").alias("dimensions"))
    largest = facts.select(*keys, F.col("l.label").alias("label"))
    inside = member.join(if_small(largest), [*keys, "label"]).select(*keys, "size", F.explode("tokens").alias("token"))
    held = inside.groupBy(*keys, "token").agg(F.sum("size").alias("n"), F.count("*").alias("g"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("g"), "token")
    top = held.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CORE).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "token", "n"))).alias("top"))
    told = facts.join(dims, keys, "left").join(top, keys, "left")
    core = F.transform("top", lambda x: F.struct(x["token"].alias("token"), (x["n"] / F.col("l.entities")).alias("share")))
    return told.select(
        *keys, "entities", "groups", F.coalesce("dimensions", F.lit(0)).alias("dimensions"), "families", F.col("l.groups").alias("largest_groups"), F.col("l.entities").alias("largest_entities"),
        F.coalesce(core, F.array().cast("array<struct<token:string,share:double>>")).alias("core"),
    )


class SnapshotStore:
    """Snapshots in a folder with a partition for each scope and date; an update builds those that are missing or whose signals changed.

    A partition holds the mark of the signals it was built from, so marks and rows can't part. An
    update that is stopped before it commits leaves the partitions as they were; one writer at a time.
    """

    SCHEMA = "entities long, groups long, dimensions long, families long, largest_groups long, largest_entities long, core array<struct<token:string,share:double>>, mark long, scope string, as_of date"

    def __init__(self, spark: SparkSession, path: str, threshold: float = 0.6):
        self.spark, self.path, self.threshold = spark, path, threshold
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)

    def rows(self) -> DataFrame:
        there = self._at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(self._at)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)

    def marks(self, signals: DataFrame) -> DataFrame:
        """(scope, as_of, mark): a checksum of each snapshot's signals, whatever their order; repeated rows count."""
        row = F.xxhash64("entity", "factor", "axis", "signal_key", F.lit(self.threshold))
        return signals.withColumn("__h", row).groupBy(*KEYS).agg((F.expr("bit_xor(__h)") + F.count("*") * F.lit(1_000_003)).alias("mark"))

    def stale(self, signals: DataFrame) -> DataFrame:
        """The marks of the snapshots to build."""
        return self.marks(signals).join(self.rows().select(*KEYS, "mark"), [*KEYS, "mark"], "left_anti")

    def update(self, signals: DataFrame) -> int:
        """Build what is missing or changed of ``signals`` (scope, as_of, entity, factor, axis, signal_key); returns how many snapshots that was.

        Snapshots that ``signals`` doesn't name stay. Reading starts over from the marks each time: nothing is
        taken from the run before.
        """
        fresh = materialize(self.stale(signals), "stale-snapshots")
        n = fresh.count()
        if n:
            some = signals.join(if_small(fresh.select(*KEYS)), KEYS, "left_semi")
            built = materialize(snapshot_rows(some, self.threshold).join(if_small(fresh), KEYS), "built-snapshots")
            names = [c.split()[0] for c in self.SCHEMA.split(", ")]
            built.select(*names).repartition(*KEYS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(self.path)
        return n
