"""When an iteration stops."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from statistics import NormalDist
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from diffusio.functions.math import EPSILON
from diffusio.functions.order import placed

#: Errors between the last and the new values, as aggregates.
ERRORS: dict[str, Callable[[Column, Column], Column]] = {
    "mabs": lambda a, b: F.avg(F.abs(a - b)),
    "max": lambda a, b: F.max(F.abs(a - b)),
    "l1": lambda a, b: F.sum(F.abs(a - b)),
    "l2": lambda a, b: F.sum((a - b) * (a - b)),
    "msq": lambda a, b: F.avg((a - b) * (a - b)),
    "rmabs": lambda a, b: F.sum(F.abs(a - b)) / F.sum(F.abs(a)),
}


class NotConverged(Exception):
    """The most iterations were reached."""


@dataclass
class Convergence:
    """Stops when the error is at most tol; makes max_iters - 1 steps at most, and raises if that isn't enough.

    error: a name of ERRORS, or "iters" for exactly max_iters - 1 steps without checks.
    every: check only each so many iterations. raises: False stops quietly.
    """

    tol: float | None = 1e-6
    error: str = "mabs"
    max_iters: int = 100
    every: int = 1
    raises: bool = True
    iteration: int = field(default=0, compare=False)

    def start(self) -> None:
        self.iteration = 0

    def wanted(self, old: str, new: str) -> dict[str, Column]:
        """What the job that writes a step's values may compute for stop()."""
        return {} if self.error == "iters" else {"error": ERRORS[self.error](F.col(old), F.col(new))}

    def stop(self, state: DataFrame, old: str | None, new: str, seen: dict[str, Any] | None = None) -> bool:
        """Whether to stop before another step; state has the values before (none at first) and after the last one.

        seen: what wanted() has asked for, if it is known.
        """
        self.iteration += 1
        if self.iteration >= self.max_iters:
            if self.error == "iters" or not self.raises:
                return True
            raise NotConverged(f"no convergence within {self.max_iters} iterations")
        if old is None or self.error == "iters" or self.iteration % self.every:
            return False
        error = seen["error"] if seen and "error" in seen else state.agg(ERRORS[self.error](F.col(old), F.col(new))).first()[0]
        return error is not None and error <= (0 if self.tol is None else max(self.tol, EPSILON))


@dataclass
class RankOrder:
    """Stops when so large a share of walks of PageRank(alpha) is made that the order of nodes is settled."""

    alpha: float = 0.85
    confidence: float = 0.98
    criterion: str = "rank_gap"
    iteration: int = field(default=0, compare=False)

    def start(self) -> None:
        self.iteration = 0

    def needed(self, state: DataFrame, new: str) -> float:
        if self.criterion == "fraction_of_walks":
            return self.confidence
        if self.criterion != "rank_gap":
            raise ValueError(f"no criterion {self.criterion}")
        values = placed(state.select(F.col(new).alias("v")).distinct(), ["v"])
        gaps = values.join(values.select(F.col("v").alias("last"), (F.col("place") + 1).alias("place")), "place").select((F.col("v") - F.col("last")).alias("g"))
        hi, lo, spread, n = gaps.agg(F.max("g"), F.min("g"), F.stddev_pop("g"), F.count("g")).first()
        if n < 2:
            return 1.0
        return 1 - (hi - lo) / (NormalDist().inv_cdf(self.confidence) * spread * n) if spread else -math.inf if hi > lo else 1.0

    def wanted(self, old: str, new: str) -> dict[str, Column]:
        return {}

    def stop(self, state: DataFrame, old: str | None, new: str, seen: dict[str, Any] | None = None) -> bool:
        self.iteration += 1
        walks = sum(self.alpha**n / n for n in range(1, self.iteration + 1)) / -math.log(1 - self.alpha)
        return walks >= self.needed(state, new)


AnyConvergence: Any = (Convergence, RankOrder)
