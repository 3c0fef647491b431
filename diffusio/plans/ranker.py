"""Rankers: immutable plans that map a graph and a signal to a signal, and their combinations."""

from __future__ import annotations

import copy
from typing import Any

from pyspark.sql import DataFrame

from diffusio.graph import Graph, Signal
from diffusio.operators.convergence import AnyConvergence
from diffusio.operators.normalize import Normalization


class Ranker:
    """A plan. ``r(graph, signal)`` or ``r | signal`` runs it.

    ``a >> b`` feeds a into b: a postprocessor b gets a as its base, a filter b gets a as a
    transform of its personalization. ``filter + x`` sets a convergence, a normalization or
    a quotient. ``a & b`` adds outputs and ``~a`` negates. Operands are never changed.
    """

    #: Names of further options of rank().
    inputs: tuple[str, ...] = ()

    def rank(self, graph: Graph, signal: Any = None, **more: Any) -> Signal:
        raise NotImplementedError

    def known(self) -> set[str]:
        """Options that rank() or that of any ranker inside takes."""
        out = set(self.inputs)
        for v in vars(self).values():
            for part in v if isinstance(v, (list, tuple)) else [v]:
                if isinstance(part, Ranker):
                    out |= part.known()
        return out

    def checked(self, more: dict[str, Any]) -> None:
        """Raise for options that nothing in the plan takes."""
        if unknown := sorted(set(more) - self.known()):
            raise TypeError(f"{type(self).__name__} takes no {', '.join(unknown)}")

    def passed(self, graph: Graph, signal: Any, more: dict[str, Any]) -> Signal:
        """rank() with those of the options that it takes."""
        return self.rank(graph, signal, **{k: v for k, v in more.items() if k in self.known()})

    def __call__(self, graph: Graph, signal: Any = None, **more: Any) -> Signal:
        return self.rank(graph, signal, **more)

    def __or__(self, signal: Signal) -> Signal:
        return self.rank(signal.graph, signal)

    def __rshift__(self, other: Ranker) -> Ranker:
        return other.after(self)

    def after(self, base: Ranker) -> Ranker:
        return Chain(base, self)

    def __and__(self, other: Ranker) -> Ranker:
        return Add(self, other)

    def __invert__(self) -> Ranker:
        return Neg(self)

    def with_(self, **changed: Any) -> Ranker:
        """A copy with some attributes changed."""
        out = copy.copy(self)
        for k, v in changed.items():
            if not hasattr(out, k):
                raise TypeError(f"{type(self).__name__} has no {k}")
            setattr(out, k, v)
        return out

    def describe(self) -> str:
        """The plan in words."""
        return " ".join([type(self).__name__, *(f"{k}={v}" for k, v in sorted(vars(self).items()) if isinstance(v, (int, float, str)) and not k.startswith("_"))])

    def propagate(self, graph: Graph, features: DataFrame) -> DataFrame:
        """Each value column of features (id, ...) ranked by itself; all move in one state where the ranker can do so."""
        if (many := getattr(self, "ranks_many", None)) and many():
            whole = graph.nodes.join(features, "id", "left")
            return self.rank_many(graph, whole.fillna(0.0, [c for c in whole.columns if c != "id"]))
        out = graph.nodes
        for c in (c for c in features.columns if c != "id"):
            got = self.rank(graph, Signal.of(graph, features.select("id", features[c].alias("value"))))
            out = out.join(got.df.withColumnRenamed("value", c), "id", "left")
        return out


class Chain(Ranker):
    """One ranker's output is the next one's input."""

    def __init__(self, *steps: Ranker):
        self.steps = steps

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        for s in self.steps:
            signal = s.passed(graph, signal, more)
            graph = signal.graph
        return signal

    def describe(self):
        return ", then ".join(s.describe() for s in self.steps)


class Add(Ranker):
    def __init__(self, *parts: Ranker):
        self.parts = parts

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        first, *rest = (p.passed(graph, signal, more) for p in self.parts)
        for r in rest:
            first = first + r
        return first

    def describe(self):
        return " plus ".join(p.describe() for p in self.parts)


class Neg(Ranker):
    def __init__(self, base: Ranker):
        self.base = base

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        return -self.base.passed(graph, signal, more)

    def describe(self):
        return f"minus ({self.base.describe()})"


def configured(filter_: Ranker, x: Any) -> Ranker:
    """filter + x."""
    if isinstance(x, AnyConvergence):
        return filter_.with_(convergence=x)
    if isinstance(x, Normalization):
        return filter_.with_(normalization=x)
    if isinstance(x, Ranker) or x is None or isinstance(x, bool):
        return filter_.with_(quotient=x)
    raise TypeError(f"can't add {x!r}")
