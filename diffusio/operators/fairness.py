"""Fairness-aware operators: scores or edges are changed so that a sensitive group gets its share."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from diffusio.functions.math import conv, safe_div, safe_inv
from diffusio.functions.measures import AM, TNR, TPR, MannWhitneyParity, Mabs, Mistreatment, PRule, Supervised, of_slots
from diffusio.functions.order import running
from diffusio.graph import Graph, Signal
from diffusio.operators.convergence import Convergence
from diffusio.operators.filters import GraphFilter, rank_slots
from diffusio.operators.postprocess import Postprocessor
from diffusio.plans.optimize import optimize
from diffusio.plans.ranker import Ranker
from diffusio.session import scope, written


def _taken_evenly(df: DataFrame, mass: float) -> DataFrame:
    """df (id, value) after taking mass in equal parts from positive values, none below 0.

    With positive values sorted upwards s_1..s_n, the level is (mass - sum of s_i, i < k) / (n - k + 1)
    for the first k at which it is at most s_k. Sums over values are made by distinct value.
    """
    steps = df.where("value > 0").groupBy("value").agg(F.count("id").alias("n"))
    total = steps.agg(F.sum("n")).first()[0] or 0
    sums = running(running(steps, ["value"], "n", "counted"), ["value"], F.col("n") * F.col("value"), "before")
    levels = sums.select("value", ((F.lit(mass) - F.col("before")) / (F.lit(total) - F.col("counted"))).alias("level"))
    found = levels.where("level <= value").agg(F.min(F.struct("value", "level")).alias("m")).first()["m"]
    level = found["level"] if found is not None else float("inf")
    return df.select("id", F.greatest(F.col("value") - F.lit(level), F.lit(0.0)).alias("value"))


class AdHocFairness(Postprocessor):
    """Sum-normalized scores in which the group has the share phi = its size (times target) of the total.

    method O (or LFPRO): missing mass is taken evenly from the other side and given evenly;
    method B (or mult): both sides are scaled.
    """

    inputs = ("sensitive",)

    def __init__(self, base: Ranker | None = None, method: str = "O", target: float = 1.0):
        if method.upper() not in ("O", "LFPRO", "B", "MULT"):
            raise ValueError(f"no method {method}")
        self.base, self.method, self.target = base, method.upper(), target

    def rank(self, graph, signal=None, sensitive: Any = None, **more):
        self.checked(more)
        out = Signal.of(graph, signal) if self.base is None else self.base.passed(graph, signal, {**more, "sensitive": sensitive})
        return self.transform(out, sensitive=sensitive)

    def transform(self, signal, sensitive: Any = None, **more):
        graph = signal.graph
        s = Signal.of(graph, sensitive)
        total = signal.sum()
        both = signal.df.join(s.df.withColumnRenamed("value", "s"), "id").withColumn("value", F.col("value") / (total or 1.0))
        both = written(both, "fair")
        v, x = F.col("value"), F.col("s")
        n, group, red, blue = (float(c or 0) for c in both.agg(F.count("id"), F.sum("s"), F.sum(v * x), F.sum(v * (1 - x))).first())
        phi = group / n * self.target
        if self.method in ("B", "MULT"):
            return Signal(graph, both.select("id", (safe_div(v * x * phi, F.lit(red)) + safe_div(v * (1 - x) * (1 - phi), F.lit(blue))).alias("value")))
        gains, mass, size = ("s = 1", phi - red, group) if red < phi else ("s <> 1", (1 - phi) - blue, n - group)
        given = both.where(gains).select("id", (v + (mass / size if size else 0.0)).alias("value"))
        return Signal(graph, given.union(_taken_evenly(both.where(f"NOT ({gains})").select("id", "value"), mass)))


class FairWalk(Ranker):
    """The base ranker on edges weighted by 1 / phi in the group and 1 / (1 - phi) outside, by source."""

    inputs = ("sensitive",)

    def __init__(self, base: Ranker):
        self.base = base

    def rank(self, graph, signal=None, sensitive: Any = None, **more):
        s = Signal.of(graph, sensitive)
        phi = s.sum() / graph.number_of_nodes()
        side = s.df.select(F.col("id").alias("src"), safe_inv(F.col("value") * phi + (1 - F.col("value")) * (1 - phi)).alias("side"))
        edges = graph.edges.join(side, "src").select("src", "dst", (F.col("w") * F.col("side")).alias("w"))
        fair = Graph(edges, graph.directed, graph.nodes)
        p = Signal.of(graph, signal)
        self.checked(more)
        out = self.base.passed(fair, p.df, more)
        return Signal(graph, out.df)

    def transform(self, signal, **more):
        raise TypeError("fair walks change edges and can't transform scores")


class FairPersonalizer(Ranker):
    """Searches for an edit of the personalization whose ranks are fair and stay near the original ones.

    The edit has four parameters a bucket and one residual weight. parity: impact (pRule),
    U (Mann-Whitney), TPR or TNR (the difference between groups, of all nodes as known ones),
    mistreatment (the mean of TPR of all nodes and TNR of the personalization) or a function
    of the ranks. Each candidate is one run of the base.
    """

    inputs = ("sensitive",)

    def __init__(self, base: Ranker, target: float = 1.0, buckets: int = 1, retain_weight: float = 1.0, prule_weight: float = 1.0, max_residual: float = 1.0, skew: bool = False, error: Callable = Mabs, parity: str | Callable = "impact", tol: float = 1e-6):
        self.base, self.target, self.buckets, self.retain_weight, self.prule_weight = base, target, buckets, retain_weight, prule_weight
        self.max_residual, self.skew, self.error, self.parity, self.tol = max_residual, skew, error, parity, tol

    def rows(self, p: Signal, s: Signal, ranks: Signal) -> DataFrame:
        """id, value (personalization), s (sensitive) and r (ranks over their maximum)."""
        top = ranks.max() or 1.0
        return p.df.join(s.df.withColumnRenamed("value", "s"), "id").join(ranks.df.select("id", (F.col("value") / top).alias("r")), "id")

    def edit(self, params: list[float]) -> Column:
        """The edited personalization of rows()."""
        gap = F.col("r") - F.col("value")
        gap = gap if self.skew else F.abs(gap)
        out = F.lit(0.0) if self.buckets else F.col("r")
        for i in range(self.buckets):
            q = params[4 * i : 4 * i + 4]
            a, b = F.col("s") * (q[0] - q[1]) + q[1], F.col("s") * (q[2] - q[3]) + q[3]
            out = out + (1 - a) * F.exp(b * gap) + a * F.exp(-b * gap)
        return (1 - params[-1]) * out + params[-1] * F.col("value")

    def edited(self, p: Signal, s: Signal, ranks: Signal, params: list[float]) -> Signal:
        return Signal(p.graph, self.rows(p, s, ranks).select("id", self.edit(params).alias("value")))

    def rank(self, graph, signal=None, sensitive: Any = None, **more):
        p, s = Signal.of(graph, signal).stored(), Signal.of(graph, sensitive).stored()
        self.checked(more)
        base, ranks = self.base, self.base.passed(graph, p, more)
        original = ranks.stored()
        if isinstance(getattr(base, "convergence", None), Convergence):  # as many steps for each candidate
            base = base.with_(convergence=Convergence(error="iters", max_iters=ranks.iterations))
        kinds = {
            "impact": lambda: PRule(s),
            "U": lambda: MannWhitneyParity(s),
            "TPR": lambda: Mistreatment(None, s, measure=TPR),
            "TNR": lambda: Mistreatment(None, s, measure=TNR),
            "mistreatment": lambda: AM([Mistreatment(None, s, measure=TPR), Mistreatment(p, s, measure=TNR)]),
        }
        fair = kinds[self.parity]() if isinstance(self.parity, str) else self.parity
        error = self.error(original)

        def loss(params: list[float]) -> float:
            ranks = base.passed(graph, self.edited(p, s, original, params), more).stored()
            return -self.retain_weight * error(ranks) * error.direction - self.prule_weight * min(self.target, fair(ranks))

        measures = [error, fair]
        together = isinstance(base, GraphFilter) and base.ranks_many() and all(isinstance(m, Supervised) and m.exclude is None for m in measures) and not more
        if together:
            before = written(self.rows(p, s, original), "before")
            y = [m.rows(original).select("id", F.col("y").alias(f"y{j}")) for j, m in enumerate(measures)]
            known = written(y[0].join(y[1], "id").select("id", F.array("y0", "y1").alias("y")), "known")

        def many(candidates: list[list[float]]) -> list[float]:
            """The candidates of a turn are slots of one state, and one job measures them."""
            with scope(graph.spark):
                edits = before.select("id", F.array(*[self.edit(c) for c in candidates]).alias("p"))
                ranks, _ = rank_slots([base] * len(candidates), graph, edits)
                found = of_slots(measures, ranks, known, len(candidates))
            return [-self.retain_weight * e * error.direction - self.prule_weight * min(self.target, f) for e, f in zip(*found, strict=True)]

        best = optimize(loss, [1, 1, 5, 5] * self.buckets + [self.max_residual], [0, 0, -5, -5] * self.buckets + [0], deviation_tol=self.tol, divide_range=2, partitions=10, many=many if together else None)
        return base.passed(graph, self.edited(p, s, original, best), more)


def group_flow(graph: Graph, sensitive: Signal) -> DataFrame:
    """How much of each node's incoming weight comes from the group (red) and from others (blue)."""
    both = sensitive.df.select("id", F.col("value").alias("red"), (1 - F.col("value")).alias("blue"))
    return conv(graph.edges, both, "red", "blue")
