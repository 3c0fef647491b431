"""Usual tasks: communities, partitions and link prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from diffusio.functions.math import safe_div
from diffusio.functions.measures import Conductance
from diffusio.graph import Graph, Signal
from diffusio.operators.filters import SLOTS, GraphFilter, rank_slots
from diffusio.operators.pairs import best_of_two
from diffusio.operators.postprocess import Normalize, Threshold
from diffusio.plans.optimize import optimize
from diffusio.plans.ranker import Ranker
from diffusio.session import written


def detect_community(graph: Graph, ranker: Ranker, seeds: Signal, tol: float = 0.01) -> Signal:
    """1 for members of the seeds' community: the threshold with the least conductance."""
    scores = Normalize().transform(ranker.rank(graph, seeds)).stored()
    measure = Conductance(graph)
    best = optimize(lambda t: min(measure(Threshold(t[0]).transform(scores)), 1e9), [1.0], [0.0], deviation_tol=tol, parameter_tol=tol, divide_range=2, partitions=5)
    return Threshold(best[0]).transform(scores)


def group_scores(graph: Graph, ranker: Ranker, groups: DataFrame) -> DataFrame:
    """group_id, id, value for each group (group_id, id): SLOTS groups a state where the ranker can do so, else one run each.

    The groups' names come to the driver; their members don't.
    """
    groups = written(groups.join(graph.nodes, "id", "left_semi").select("group_id", "id").distinct(), "groups")
    names = [r[0] for r in groups.select("group_id").distinct().orderBy("group_id").collect()]
    together = isinstance(ranker, GraphFilter) and ranker.ranks_many()
    out: DataFrame | None = None
    for at in range(0, len(names), SLOTS if together else 1):
        some = names[at : at + (SLOTS if together else 1)]
        if together:
            inside = F.array(*[F.max((F.col("group_id") == g).cast("double")) for g in some])
            ranks, _ = rank_slots([ranker] * len(some), graph, groups.where(F.col("group_id").isin(some)).groupBy("id").agg(inside.alias("p")))
            rows = ranks.select("id", F.posexplode("value").alias("k", "value"))
            rows = rows.select(F.array(*[F.lit(g) for g in some])[F.col("k")].alias("group_id"), "id", "value")
        else:
            rows = ranker.rank(graph, Signal.of(graph, groups.where(F.col("group_id") == some[0]).select("id"))).df.select(F.lit(some[0]).alias("group_id"), "id", "value")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else groups.select("group_id", "id", F.lit(0.0).alias("value"))


def partition(scores: DataFrame) -> DataFrame:
    """id and the group_id with its highest value; ties go to the first group."""
    best = scores.groupBy("id").agg(F.max(F.struct("value", F.col("group_id"))).alias("m"), F.max("value").alias("top"))
    first = scores.join(best.select("id", "top"), "id").where("value = top").groupBy("id").agg(F.min("group_id").alias("group_id"))
    return first


def predict_links(graph: Graph, scores: DataFrame, k: int = 10, kind: str = "cos") -> DataFrame:
    """For each node, the k most similar nodes two steps away that it isn't linked to: src, dst, similarity, place."""
    if kind not in ("cos", "dot"):
        raise ValueError(f"no similarity {kind}")
    names = [r[0] for r in scores.select("group_id").distinct().orderBy("group_id").collect()]
    value = lambda g: F.coalesce(F.sum(F.when(F.col("group_id") == g, F.col("value"))), F.lit(0.0))
    features = scores.groupBy("id").agg(F.array(*[value(g) for g in names if g is not None] or [F.lit(0.0)]).alias("x"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    if kind == "cos":
        features = features.withColumn("x", F.transform("x", lambda v: safe_div(v, F.col("n"))))
    width = max(1, len([g for g in names if g is not None]))
    features = graph.nodes.join(features, "id", "left").select("id", F.coalesce("x", F.array_repeat(F.lit(0.0), width)).alias("x"))
    rows = best_of_two(graph, features, k).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("score").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("u").orderBy(F.col("similarity").desc(), "v"))
    return rows.withColumn("place", place).where(F.col("place") <= k).select(F.col("u").alias("src"), F.col("v").alias("dst"), "similarity", "place")


def predictions(features: DataFrame) -> DataFrame:
    """id and the place of the highest of its features (softmax keeps it)."""
    return features.select("id", (F.array_position("features", F.array_max("features")) - 1).cast("long").alias("label"))


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """The share of labels (id, label) that predicted (id, label) gives."""
    both = labels.join(predicted.select("id", F.col("label").alias("p")), "id", "left")
    return both.agg(F.avg(F.coalesce(F.col("label") == F.col("p"), F.lit(False)).cast("double")).alias("value"))
