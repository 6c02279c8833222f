"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import WORD, if_small
from tidemark.session import materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"

#: The source rates are broadcast up to so many sources; beyond that they are joined by shuffle.
SOURCES_BROADCAST = 100_000


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Targets for ``totals`` (source, source_size): adds ``target`` and ``rate``.

    Sources in code-point order, the null source last, take ``weights`` in turn. ``share``
    of all sizes is dealt by weight; a source stops at ``most`` times its size and what it
    cannot take goes to the others by weight. With the sources ordered by limit / weight the
    level at which the water stops is found from running sums, without iterating. A source
    of size 0 has target 0 and rate 0. The windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    filling = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = (F.row_number().over(ordered) - 1) % len(weights) + 1
    weighed = (
        totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    )
    before = F.coalesce(F.sum("limit").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    level = weighed.withColumn("level", (F.col("total") - before) / left)
    reached = level.withColumn("water", F.max(F.expr("if(level <= ratio, level, null)")).over(everything))
    target = F.least(F.col("water") * F.col("weight"), F.col("limit"))
    return (
        reached.withColumn("target", F.coalesce(target, F.col("limit")))
        .withColumn("rate", F.expr("if(source_size > 0, target / source_size, 0D)"))
        .select("source", "source_size", "target", "rate")
    )


def coin(seed: str = SEED):
    """A number in [0, 1) fixed by ``seed``, the doc_id and the text: 52 bits of an MD5 digest."""
    own = F.md5(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), own))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def plan_mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken.

    Size is the number of words (runs free of white space); a null text has none. Every document is emitted
    floor(rate) times, and once more if the coin that ``seed``, its doc_id and its text toss
    falls below the fraction, so reruns agree; rows that are equal in both share their coin,
    rows of a null doc_id don't. Long texts are counted whole, sources of equal ratio go by
    name. An empty table gives an empty result; columns beyond doc_id, text and source are
    ignored, whatever their names.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sized = materialize(docs.select("doc_id", "source", size.alias("size"), coin(seed).alias("coin")), "mix-sizes")
    return _with_rates(sized, sized, weights, share, most).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document repeated as :func:`plan_mix` says, with the columns of ``docs`` under their names.

    A document without words is emitted as its source's rate says. A source whose documents
    hold no word has rate 0 and goes. Edge cases are those of :func:`plan_mix`.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rated = _with_rates(docs.select("doc_id", "source", size, coin(seed).alias("coin"), whole), docs.select("source", size), weights, share, most)
    repeated = rated.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select("whole.*")


def _with_rates(rows: DataFrame, sized: DataFrame, weights, share, most) -> DataFrame:
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = materialize(source_targets(totals, weights, share, most), "mix-rates")
    known = if_small(rates.withColumnRenamed("source", "__source"), SOURCES_BROADCAST)
    fraction = F.col("rate") - F.floor("rate")
    return (
        rows.join(known, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copies", (F.floor("rate") + (F.col("coin") < fraction).cast("long")).cast("int"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


#: The same mix in the SQL of another engine, for the rows of :func:`plan_mix`.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight,
         source_size * 2.0::DOUBLE AS "limit", CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total
  FROM s),
r AS (SELECT *, "limit" / weight AS ratio FROM w),
l AS (
  SELECT *, (total - coalesce(sum("limit") OVER (ORDER BY ratio, source ASC NULLS LAST
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source ASC NULLS LAST
                                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
m AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, coalesce(least(water * weight, "limit"), "limit") AS target FROM m),
u AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
c AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.rate,
         CAST(floor(rate) AS INT) + CASE WHEN
           CAST(('0x' || substr(digest, 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE
           < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, round(target, 6) AS target, round(rate, 9) AS rate, copies, size * copies AS taken FROM c
"""
