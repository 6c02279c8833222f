"""Communities of a weighted graph of groups: label flow, Markov clustering, one level of Louvain; modularity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialize

#: Fixed values of the methods.
FLOW_ROUNDS, MARKOV_ROUNDS, INFLATION, ROW_LIMIT, LEAST_VALUE, SWEEPS = 24, 14, 1.8, 24, 0.0005, 8


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), F.col("weight")))


def label_flow(nodes: DataFrame, edges: DataFrame, rounds: int = FLOW_ROUNDS) -> DataFrame:
    """(idx, label) by synchronous weighted propagation: the label with most weight around a node, its own on a
    tie, else the smallest; a node without neighbours keeps its own. Rounds end when nothing changes."""
    both = materialize(_both(edges), "flow-edges")
    labels = nodes.select("idx", F.col("idx").alias("label"))
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("idx", "b"), "b").groupBy(F.col("a").alias("idx"), F.col("label").alias("vote")).agg(F.round(F.sum("weight"), 12).alias("w"))
        own = labels.join(votes, "idx", "left").groupBy("idx", "label").agg(
            F.max(F.struct("w", -F.col("vote"))).alias("best"), F.max(F.when(F.col("vote") == F.col("label"), F.col("w"))).alias("mine")
        )
        mine, best = F.coalesce("mine", F.lit(0.0)), F.col("best")
        smaller = (best["w"] > mine) | ((best["w"] == mine) & (-best["col2"] < F.col("label")))
        step = own.select("idx", F.when(smaller, -best["col2"]).otherwise(F.col("label")).alias("label"), F.col("label").alias("old"))
        step = materialize(step, "flow")
        labels = step.drop("old")
        if step.where("label <> old").isEmpty():
            break
    return labels


def markov(nodes: DataFrame, edges: DataFrame, rounds: int = MARKOV_ROUNDS) -> DataFrame:
    """(idx, label) by Markov clustering: expand, inflate, keep the largest of each row, normalise; the label is a row's largest column.

    The sparse product is a join and a sum; a row keeps at most ROW_LIMIT values.
    """

    def normalised(m: DataFrame) -> DataFrame:
        total = F.sum("v").over(Window.partitionBy("i"))
        return m.withColumn("v", F.col("v") / total)

    start = nodes.select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(1.0).alias("v")).union(_both(edges))
    m = materialize(normalised(start), "markov")
    for _ in range(rounds):
        x, y = m.alias("x"), m.alias("y")
        product = x.join(y, F.col("x.j") == F.col("y.i")).groupBy(F.col("x.i").alias("i"), F.col("y.j").alias("j")).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("v"))
        inflated = product.withColumn("v", F.pow("v", F.lit(INFLATION))).where(F.col("v") >= LEAST_VALUE)
        top = inflated.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc(F.round("v", 12)), "j"))).where(F.col("r") <= ROW_LIMIT).drop("r")
        m = materialize(normalised(top), "markov")
    best = m.groupBy(F.col("i").alias("idx")).agg(F.max(F.struct(F.round("v", 9), -F.col("j"))).alias("b"))
    return nodes.select("idx").join(best, "idx", "left").select("idx", F.coalesce(-F.col("b.col2"), F.col("idx")).alias("label"))


def louvain(nodes: DataFrame, edges: DataFrame, sweeps: int = SWEEPS) -> DataFrame:
    """(idx, label) by one level of greedy modularity moves in node order, at most ``sweeps`` sweeps.

    A move depends on all moves before it, so a connected part of the graph is one task;
    parts don't influence each other but for the total weight, and are solved side by side.
    """
    from tidemark.operators.structure import components

    total = edges.agg(F.sum("weight")).first()[0] or 0.0
    parts = components(edges)
    tagged = edges.join(parts.select(F.col("node").alias("a"), F.col("label").alias("part")), "a").select("part", "a", "b", "weight")

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        around: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in rows[["a", "b", "weight"]].itertuples(index=False):
            around.setdefault(a, []).append((b, w))
            around.setdefault(b, []).append((a, w))
        label = {n: n for n in around}
        degree = {n: sum(w for _, w in e) for n, e in around.items()}
        held = dict(degree)
        for _ in range(sweeps):
            moved = False
            for n in sorted(around):
                toward = {label[n]: 0.0}
                for m, w in around[n]:
                    toward[label[m]] = toward.get(label[m], 0.0) + w
                held[label[n]] -= degree[n]
                best = min(toward, key=lambda c: (-round(toward[c] - degree[n] * held[c] / (2 * total), 12), c))
                moved |= best != label[n]
                label[n] = best
                held[best] += degree[n]
            if not moved:
                break
        return pd.DataFrame({"idx": list(label), "label": list(label.values())})

    solved = tagged.groupBy("part").applyInPandas(solve, "idx long, label long")
    return nodes.select("idx").join(solved, "idx", "left").select("idx", F.coalesce("label", "idx").alias("label"))


def modularity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the sum over labels of internal / total - (degrees / twice the total) squared; 0 for a graph without edges."""
    total = edges.agg(F.sum("weight").alias("total"))
    at = labels.select("idx", "label")
    degrees = _both(edges).join(at.withColumnRenamed("idx", "a"), "a").groupBy("label").agg(F.sum("weight").alias("degree"))
    inner = edges.join(at.select(F.col("idx").alias("a"), F.col("label")), "a").join(at.select(F.col("idx").alias("b"), F.col("label").alias("other")), "b")
    inside = inner.where("label = other").groupBy("label").agg(F.sum("weight").alias("inside"))
    each = degrees.join(inside, "label", "left").crossJoin(F.broadcast(total))
    term = F.coalesce("inside", F.lit(0.0)) / F.col("total") - F.pow(F.col("degree") / (2 * F.col("total")), 2)
    return each.agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("modularity"), F.count("*").alias("communities"))


def summaries(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community: nodes, internal edges and weight, density."""
    at = labels.select("idx", "label")
    nodes = at.groupBy("label").agg(F.count("*").alias("nodes"))
    inner = edges.join(at.select(F.col("idx").alias("a"), "label"), "a").join(at.select(F.col("idx").alias("b"), F.col("label").alias("other")), "b").where("label = other")
    told = nodes.join(inner.groupBy("label").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight")), "label", "left").fillna(0, ["edges", "weight"])
    possible = F.col("nodes") * (F.col("nodes") - 1) / 2
    return told.withColumn("density", F.when(possible > 0, F.col("edges") / possible).otherwise(0.0))
