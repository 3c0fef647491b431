"""Comparison of many rankers on many datasets, and what to do with the resulting table."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from statistics import NormalDist
from time import perf_counter
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from diffusio.functions.measures import AUC, Measure
from diffusio.graph import Graph, Signal
from diffusio.operators.filters import AbsorbingWalks, HeatKernel, PageRank
from diffusio.operators.postprocess import LinearSweep, Normalize, Ordinals, SeedOversampling, Sweep, Tautology
from diffusio.plans.ranker import Ranker
from diffusio.plans.tuning import halves


class Time:
    """Stands for the seconds of a run in a benchmark's measures."""


def many_filters(**options: Any) -> dict[str, Ranker]:
    """PageRank, heat kernels and absorbing walks with both usual normalizations."""
    out: dict[str, Ranker] = {}
    for n in ("col", "symmetric"):
        out |= {f"PPR{a} {n}": PageRank(a, normalization=n, **options) for a in (0.5, 0.85, 0.9, 0.99)}
        out |= {f"HK{t} {n}": HeatKernel(t, normalization=n, **options) for t in (2, 3, 5, 7)}
        out |= {f"Absorb{a} {n}": AbsorbingWalks(a, normalization=n, **options) for a in (0.5, 0.85, 0.9, 0.99)}
    return out


def variations(rankers: dict[str, Ranker], kinds: dict[str, Callable[[Ranker], Ranker]] | None = None) -> dict[str, Ranker]:
    """Every ranker in every way."""
    kinds = kinds or {"": lambda r: r >> Tautology(), "+Sweep": lambda r: r >> Sweep(uniform=r), "+LinearSweep": lambda r: r >> LinearSweep(uniform=r), "+Oversampling": SeedOversampling, "+Ordinals": lambda r: r >> Ordinals(), "+Normalize": lambda r: r >> Normalize()}
    return {f"{name}{kind}": make(r) for kind, make in kinds.items() for name, r in rankers.items()}


def benchmark(spark: SparkSession, rankers: dict[str, Ranker], datasets: Iterable[tuple[str, Graph, Any]], measures: dict[str, Any] | Callable[..., Measure] = AUC, shares: Iterable[float] = (0.5,), seeds: Iterable[int] = (0,), sensitive: Any = None) -> DataFrame:
    """dataset, share, seed, algorithm, measure, value: one row a run and measure."""
    measures = measures if isinstance(measures, dict) else {"": measures}
    rows = []
    for name, graph, group in datasets:
        p = Signal.of(graph, group).stored()
        for share in shares:
            for seed in seeds:
                training, test = (p, p) if share == 1 else halves(p, share, seed)
                for algorithm, r in rankers.items():
                    start = perf_counter()
                    scores = (r.rank(graph, training) if sensitive is None else r.rank(graph, training, sensitive=sensitive)).stored()
                    took = perf_counter() - start
                    for m, make in measures.items():
                        value = took if make is Time else make(test, exclude=None if share == 1 else training)(scores)
                        rows.append((name, float(share), int(seed), algorithm, m, float(value)))
    return spark.createDataFrame(rows, "dataset string, share double, seed int, algorithm string, measure string, value double")


def table(results: DataFrame) -> DataFrame:
    """One row a dataset, share, seed and measure, one column an algorithm."""
    return results.groupBy("dataset", "share", "seed", "measure").pivot("algorithm").agg(F.first("value"))


def ranks(results: DataFrame) -> DataFrame:
    """Ranks of algorithms (1 is the highest value, equal ones share their mean) within each row of the table."""
    row = ["dataset", "share", "seed", "measure"]
    order = Window.partitionBy(*row).orderBy(F.col("value").desc())
    same = Window.partitionBy(*row, "value")
    return results.withColumn("value", F.rank().over(order) + (F.count("value").over(same) - 1) / 2)


def average(results: DataFrame) -> DataFrame:
    """results with the mean over datasets as one more dataset."""
    mean = results.groupBy("share", "seed", "algorithm", "measure").agg(F.avg("value").alias("value")).withColumn("dataset", F.lit("Average"))
    return results.unionByName(mean)


def scores(results: DataFrame) -> DataFrame:
    """The values alone."""
    return results.select("value")


def studentized_range(q: float, k: int) -> float:
    """The probability that k standard normal values lie within a range of q (quadrature by Simpson's rule)."""
    if q <= 0:
        return 0.0
    z = np.linspace(-9.0, 9.0, 2001)
    normal = np.array([NormalDist().cdf(x) for x in z])
    below = np.array([NormalDist().cdf(x - q) for x in z])
    weights = np.ones(len(z))
    weights[1:-1:2], weights[2:-1:2] = 4, 2
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return float(min(1.0, k * (weights * density * (normal - below) ** (k - 1)).sum() * (z[1] - z[0]) / 3))


def range_quantile(p: float, k: int) -> float:
    """The range within which k standard normal values lie with probability p."""
    low, high = 0.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if studentized_range(middle, k) < p else (low, middle)
    return high


def nemenyi(results: DataFrame, level: float = 0.05) -> DataFrame:
    """algorithm, other, difference of their mean ranks, least (the critical difference), p (the probability of such a difference by chance), differ: the Nemenyi test.

    There is a row for each pair of algorithms, so algorithms are few: their mean ranks come to the driver.
    """
    ranked = ranks(results)
    mean = sorted(tuple(r) for r in ranked.groupBy("algorithm").agg(F.avg("value"), F.count("value")).collect())
    k = len(mean)
    if k < 2:
        raise ValueError("a comparison needs two algorithms")
    quantile, rows = range_quantile(1 - level, k), []
    for i, (a, rank, n) in enumerate(mean):
        error = math.sqrt(k * (k + 1) / (12.0 * n))  # ranges are of values with this deviation
        for b, far, _ in mean[i + 1 :]:
            gap = abs(rank - far)
            rows.append((a, b, gap, quantile * error, 1 - studentized_range(gap / error, k), gap > quantile * error))
    return results.sparkSession.createDataFrame(rows, "algorithm string, other string, difference double, least double, p double, differ boolean")


def as_dict(results: DataFrame) -> dict[str, dict[str, float]]:
    """value by dataset and algorithm."""
    out: dict[str, dict[str, float]] = {}
    for r in results.collect():
        out.setdefault(r["dataset"], {})[r["algorithm"]] = r["value"]
    return out


def printed(results: DataFrame, width: int = 14, between: str = "", end: str = "\n", digits: int = 2) -> str:
    """The table as text, with columns of a fixed width or separated (for LaTeX: between=" & ", end=" \\\\\\\\\\n")."""
    rows = table(results).orderBy("dataset", "share", "seed", "measure").collect()
    names = [c for c in rows[0].asDict() if c not in ("share", "seed", "measure")] if rows else []
    lines = [names, *[[f"{r[c]:.{digits}f}" if isinstance(r[c], float) else str(r[c]) for c in names] for r in rows]]
    return "".join(between.join(x.ljust(0 if between else width) for x in line) + end for line in lines)
