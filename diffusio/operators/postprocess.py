"""Postprocessors: signal to signal, alone (transform) or after a base ranker (rank)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from diffusio.functions.math import safe_div
from diffusio.functions.order import placed
from diffusio.graph import Graph, Signal
from diffusio.operators.convergence import NotConverged
from diffusio.plans.ranker import Ranker
from diffusio.session import written


def _ordered(signal: Signal) -> DataFrame:
    """id, value and place (1 is the highest; ties by id)."""
    return placed(signal.df, [F.col("value").desc(), "id"]).select("id", "value", "place")


class Postprocessor(Ranker):
    base: Ranker | None = None

    def transform(self, signal: Signal, **more: Any) -> Signal:
        raise NotImplementedError

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        signal = Signal.of(graph, signal)
        out = signal if self.base is None else self.base.passed(graph, signal, more)
        return self.transform(out, personalization=signal)

    def after(self, base):
        return self.with_(base=base if self.base is None else self.base.after(base))

    def describe(self):
        own = super().describe()
        return own if self.base is None else f"{self.base.describe()}, then {own}"


class Tautology(Postprocessor):
    """The same signal."""

    def __init__(self, base: Ranker | None = None):
        self.base = base

    def transform(self, signal, **more):
        return signal


class MabsMaintain(Postprocessor):
    """Scaled to the personalization's absolute sum."""

    def __init__(self, base: Ranker | None = None):
        self.base = base

    def transform(self, signal, personalization=None, **more):
        n = signal.norm()
        return signal * (personalization.norm() / n) if n else signal


class Normalize(Postprocessor):
    """Divided by the maximum (max), sum or length (L2), or moved and scaled to 0..1 (range)."""

    def __init__(self, base: Ranker | str | None = None, method: str = "max"):
        self.base, self.method = (None, base) if isinstance(base, str) else (base, method)

    def transform(self, signal, **more):
        v = F.col("value")
        if self.method not in ("max", "sum", "range", "L2"):
            raise ValueError(f"no method {self.method}")
        top = {"max": F.max(v), "range": F.max(v), "sum": F.sum(v), "L2": F.sqrt(F.sum(v * v))}[self.method]
        hi, lo = signal.aggregate(top, F.min(v))
        lo = lo if self.method == "range" else 0.0
        return signal if not signal.df.take(1) or hi == lo else signal.map(lambda x: (x - lo) / (hi - lo))


class Ordinals(Postprocessor):
    """1 for the highest, 2 for the next; ties by id."""

    def __init__(self, base: Ranker | None = None):
        self.base = base

    def transform(self, signal, **more):
        return Signal(signal.graph, _ordered(signal).select("id", F.col("place").alias("value")))


class Transformer(Postprocessor):
    """A function of each value: of columns, or (vectorized=True) of pandas series."""

    def __init__(self, base: Ranker | None = None, expr: Callable = F.exp, vectorized: bool = False):
        if base is not None and not isinstance(base, Ranker):
            base, expr = None, base
        self.base, self.expr, self.vectorized = base, expr, vectorized

    def transform(self, signal, **more):
        if not self.vectorized:
            return signal.map(self.expr)
        f = self.expr

        @F.pandas_udf("double")
        def apply(x: pd.Series) -> pd.Series:
            return pd.Series(f(x)).astype(float)

        return signal.map(apply)


class Top(Postprocessor):
    """1 for values not below the k-th highest (a share of nodes if k < 1), else 0."""

    def __init__(self, base: Ranker | float | None = None, k: float = 1):
        self.base, self.k = (base, k) if base is None or isinstance(base, Ranker) else (None, base)

    def transform(self, signal, **more):
        k = int(self.k if self.k >= 1 else self.k * signal.df.count())
        least = _ordered(signal).where(F.col("place") == max(k, 1)).first()
        if least is None:
            return signal.map(lambda x: F.lit(1.0))
        return signal.map(lambda x: F.when(x >= least["value"], 1.0).otherwise(0.0))


class Threshold(Postprocessor):
    """1 above the threshold (or at it if inclusive), else 0. "gap": below the largest relative drop."""

    def __init__(self, base: Ranker | float | str | None = None, threshold: float | str = "gap", inclusive: bool = False):
        self.base, self.threshold = (base, threshold) if base is None or isinstance(base, Ranker) else (None, base)
        self.inclusive = inclusive

    def transform(self, signal, **more):
        t = self.threshold
        if t == "gap":
            o = _ordered(signal)
            prev = o.select((F.col("place") + 1).alias("place"), F.col("value").alias("prev"))
            drops = o.join(prev, "place").where("prev > 0").select("place", "value", ((F.col("prev") - F.col("value")) / F.col("prev")).alias("drop"))
            # of equal drops the first
            found = drops.where("drop > 0").agg(F.max(F.struct("drop", (-F.col("place")).alias("p"), "value")).alias("m")).first()["m"]
            t = found["value"] if found is not None else 0.0
        return signal.map(lambda x: F.when((x >= t) if self.inclusive else (x > t), 1.0).otherwise(0.0))


class _AgainstUniform(Postprocessor):
    """Compares with the base's (or another ranker's) scores of an even personalization, kept for the graph."""

    def __init__(self, base: Ranker | None = None, uniform: Ranker | None = None):
        self.base, self.uniform = base, uniform

    def _even(self, graph: Graph) -> Signal:
        ranker = self.uniform or self.base
        if ranker is None:
            raise ValueError("a ranker of even personalizations is needed")
        return graph.remembered(("uniform", id(ranker), ranker), lambda: ranker.rank(graph).stored())


class Sweep(_AgainstUniform):
    """Values over 1e-12 plus the even scores."""

    def transform(self, signal, **more):
        return signal.zip(self._even(signal.graph), lambda x, u: x / (1e-12 + u))


class LinearSweep(_AgainstUniform):
    """Values minus the even scores."""

    def transform(self, signal, **more):
        return signal - self._even(signal.graph)


class SeparateNormalization(Postprocessor):
    """Both sides of a 0/1 (or graded) separator get the sum 1."""

    def __init__(self, base: Ranker | None = None, separator: Any = None):
        self.base, self.separator = (base, separator) if base is None or isinstance(base, Ranker) else (None, base)

    def transform(self, signal, **more):
        s = Signal.of(signal.graph, self.separator)
        both = signal.df.join(s.df.withColumnRenamed("value", "s"), "id")
        v, t = F.col("value"), F.col("s")
        a, b = both.agg(F.sum(v * t), F.sum(v * (1 - t))).first()
        out = both.select("id", (safe_div(v * t, F.lit(float(a or 0))) + safe_div(v * (1 - t), F.lit(float(b or 0)))).alias("value"))
        return Signal(signal.graph, out)


class Subgraph(Postprocessor):
    """The signal on the graph induced by its non-zero nodes, which remembers its parent."""

    def __init__(self, base: Ranker | None = None):
        self.base = base

    def transform(self, signal, **more):
        kept = written(signal.df.where("value <> 0"), "subgraph")
        graph = signal.graph.subgraph(kept.select("id"))
        graph.parent = getattr(signal.graph, "parent", signal.graph)
        return Signal(graph, kept)


class Supergraph(Postprocessor):
    """Back on the parent graph, 0 for its other nodes."""

    def __init__(self, base: Ranker | None = None):
        self.base = base

    def transform(self, signal, **more):
        parent = getattr(signal.graph, "parent", None)
        if parent is None:
            raise ValueError("the graph isn't a subgraph")
        out = parent.nodes.join(signal.df, "id", "left")
        return Signal(parent, out.select("id", F.coalesce("value", F.lit(0.0)).alias("value")))


def assert_binary(signal: Signal) -> None:
    if signal.df.where(~F.col("value").isin(0.0, 1.0)).take(1):
        raise ValueError("all values must be 0 or 1")


def _least_of_seeds(scores: Signal, seeds: Signal) -> float:
    return scores.df.join(seeds.df.where("value = 1").select("id"), "id", "left_semi").agg(F.min("value")).first()[0]


class SeedOversampling(Ranker):
    """Ranks again with more seeds: nodes that score as the lowest seed (safe), the top nodes, or neighbours of seeds."""

    def __init__(self, base: Ranker, method: str = "safe"):
        if method not in ("safe", "top", "neighbors"):
            raise ValueError(f"no method {method}")
        self.base, self.method = base, method

    def rank(self, graph, signal=None, **more):
        seeds = Signal.of(graph, signal)
        assert_binary(seeds)
        if self.method == "neighbors":
            near = graph.neighbors().join(seeds.df.where("value = 1").select("id"), "id", "left_semi").select(F.col("neighbor").alias("id"))
            return self.base.passed(graph, Signal.of(graph, near.union(seeds.df.where("value = 1").select("id")).distinct()), more)
        scores = self.base.passed(graph, seeds, more).stored()
        if self.method == "safe":
            least = _least_of_seeds(scores, seeds)
            return self.base.passed(graph, scores.map(lambda x: F.when(x >= least, 1.0).otherwise(0.0)), more)
        n = graph.number_of_nodes()
        top = min(n, int(n * n / graph.number_of_edges()))
        least = _ordered(scores).where(F.col("place") == max(top, 1)).first()["value"]
        return self.base.passed(graph, scores.zip(seeds, lambda x, s: F.when((x >= least) | (s == 1), 1.0).otherwise(0.0)), more)


class BoostedSeedOversampling(Ranker):
    """Adds weighted scores of oversampled seeds until the weight settles; raises if it doesn't within max_iters."""

    def __init__(self, base: Ranker, objective: str = "partial", source: str = "previous", tol: float = 0.001, max_iters: int = 100):
        if objective not in ("partial", "naive") or source not in ("previous", "original"):
            raise ValueError("objective is partial or naive, source previous or original")
        self.base, self.objective, self.source, self.tol, self.max_iters = base, objective, source, tol, max_iters

    def rank(self, graph, signal=None, **more):
        seeds = Signal.of(graph, signal)
        top = seeds.max()
        start = seeds.map(lambda x: x / top) if top else seeds
        total = self.base.passed(graph, start, more).stored()
        now, last = start, 1.0
        for _ in range(self.max_iters - 1):
            least = _least_of_seeds(total, now if self.source == "previous" else seeds)
            now = total.map(lambda x, t=least: F.when(x >= t, 1.0).otherwise(0.0)).stored()
            new = self.base.passed(graph, now, more).stored()
            both = now.df.join(new.df.withColumnRenamed("value", "n"), "id").join(total.df.withColumnRenamed("value", "t"), "id")
            r, n, t = F.col("value"), F.col("n"), F.col("t")
            a, b, square = both.agg(F.sum(r * n * n), F.sum(r * t * n), F.sum(n * n)).first()
            weight = (a - b) / square if self.objective == "partial" else 0.5 - 0.5 * b / square
            total = total.zip(new, lambda x, y, w=weight: x + w * y).stored()
            if abs(weight - last) <= self.tol:
                return total
            last = weight
        raise NotConverged(f"the weight of boosting has not settled within {self.max_iters} iterations")
