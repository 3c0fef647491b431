"""Tuners: rankers that pick a ranker or its parameters for each personalization."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from diffusio.functions.measures import AUC, Cos, Measure, Supervised, of_columns, of_slots, products
from diffusio.graph import Graph, Signal
from diffusio.operators.blocks import Blocks
from diffusio.operators.filters import GenericFilter, GraphFilter, HeatKernel, HopStore, PageRank, arnoldi, in_hops, moved_hops, rank_slots
from diffusio.operators.normalize import Normalization
from diffusio.operators.postprocess import Normalize, Tautology
from diffusio.plans.optimize import optimize
from diffusio.plans.ranker import Ranker
from diffusio.session import scope, written


#: Hops from which on edges are put into blocks first.
MANY = 8


def halves(signal: Signal, share: float, seed: int = 0) -> tuple[Signal, Signal]:
    """Seeds dealt by hash into (training, the rest)."""
    order = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) < int(1000 * share)
    a = signal.df.select("id", F.when(order, F.col("value")).otherwise(0.0).alias("value"))
    b = signal.df.select("id", F.when(order, 0.0).otherwise(F.col("value")).alias("value"))
    return Signal(signal.graph, a).stored(), Signal(signal.graph, b).stored()


def demo_filters(**options: Any) -> dict[str, Ranker]:
    return {**{f"PPR{a}": PageRank(a, **options) for a in (0.85, 0.9, 0.95)}, **{f"HK{t}": HeatKernel(t, **options) for t in (3, 5, 7)}}


class Tuner(Ranker):
    """rank() is the tuned ranker on the personalization that tune() returns with it."""

    def tune(self, graph: Graph, signal: Any = None, **more: Any) -> tuple[Ranker, Signal]:
        raise NotImplementedError

    def rank(self, graph, signal=None, **more):
        ranker, p = self.tune(graph, signal, **more)
        return ranker.passed(graph, p, more)


class Selection(Tuner):
    """The ranker whose worst measure over shares of training seeds is best."""

    def __init__(self, rankers: Sequence[Ranker] | None = None, measure: Callable[..., Measure] = AUC, shares: Sequence[float] = (0.8,), seed: int = 0):
        self.rankers = list(rankers or demo_filters().values())
        self.measure, self.shares, self.seed = measure, shares, seed

    def tune(self, graph, signal=None, **more):
        p = Signal.of(graph, signal).stored()
        worst = [float("inf")] * len(self.rankers)
        for share in self.shares:
            training, validation = halves(p, share, self.seed)
            measure = self.measure(validation, exclude=training)
            for i, r in enumerate(self.rankers):
                worst[i] = min(worst[i], measure.direction * measure(r.passed(graph, training, more).stored()))
        return self.rankers[int(np.argmax(worst))], p


class ParameterTuner(Tuner):
    """Parameters of make(params) by coordinate descent against a held-out share of seeds.

    By default make gives hop weights (the first is 1). Their hops are propagated once for
    each fold and kept as columns; each candidate is then one linear combination.
    hops: a store in which the hops are kept for other runs on the same seeds.
    combined: rank with all seeds in the end, not with those of the last fold's training alone.
    """

    def __init__(self, make: Callable[[list[float]], Ranker] | None = None, highest: Sequence[float] = (1.0,) * 40, lowest: Sequence[float] | None = None, measure: Callable[..., Measure] = AUC, training: float = 0.9, folds: int = 1, optimizer: Callable = optimize, normalization: Normalization | str = "auto", seed: int = 0, combined: bool = True, hops: HopStore | None = None, **options: Any):
        self.combined, self.hops = combined, hops
        self.make, self.highest, self.lowest = make, list(highest), lowest
        self.measure, self.training, self.folds, self.optimizer, self.normalization, self.seed = measure, training, folds, optimizer, normalization, seed
        self.options = {"deviation_tol": 1e-6, **options}

    def rank(self, graph, signal=None, **more):
        ranker, p, moved = self._tuned(graph, signal, **more)
        return ranker.passed(graph, p, more) if moved is None else Normalize().transform(Signal(graph, moved))

    def tune(self, graph, signal=None, **more):
        return self._tuned(graph, signal, **more)[:2]

    def _tuned(self, graph: Graph, signal: Any, **more: Any) -> tuple[Ranker, Signal, DataFrame | None]:
        """The ranker, its personalization and, if hops have been moved for all of it, the mixture of them (id, value) that the ranker normalizes."""
        p = Signal.of(graph, signal).stored()
        found, moved = [], None
        for fold in range(self.folds):
            training, validation = halves(p, self.training, self.seed + fold)
            measure = self.measure(validation, exclude=training)
            together = self.optimizer is optimize and isinstance(measure, Supervised) and type(measure).of_products is not None
            if self.make is None and self.hops is None and together:
                norms, hops, n = *_parts(graph, self.normalization, [training, validation], [training], len(self.highest) + 1), len(self.highest) + 1
                many = _mixtures(measure, hops, [f"h{k}_0" for k in range(n)], lambda w: np.array([1.0, *w]))
                found.append(optimize(lambda w, many=many: many([w])[0], self.highest, self.lowest, many=many, **self.options))
                moved = [(f"h{k}_0", norms[0]) for k in range(n)], [(f"h{k}_1", norms[1]) for k in range(n)], hops
                continue
            if self.make is None:
                n = len(self.highest) + 1
                hops = GenericFilter(normalization=self.normalization, hops=self.hops).hop_columns(graph, training, n).select("id", *[f"h{i}" for i in range(n)])
                rows = written(measure.rows(hops.select("id", F.lit(0.0).alias("value"))).select("id", "y").join(hops, "id"), "hops")
                loss = lambda w, rows=rows, m=measure: -m.direction * float(m.of(rows.select("id", "y", _mixed([1.0, *w]).alias("x"))).first()[0] or 0.0)
            else:
                loss = lambda w, t=training, m=measure: -m.direction * m(self.make(w).passed(graph, t, more).stored())
            options = self.options
            if self.make is not None and self.optimizer is optimize and _in_slots(self.make(list(self.highest))) and isinstance(measure, Supervised) and not more:
                options = {"many": _filters_in_hops(self.make, self.highest, graph, training, measure) if together else _candidates(self.make, graph, training, measure), **options}
            if self.make is None and self.optimizer is optimize:
                options = {"many": lambda ws, rows=rows, m=measure: [-m.direction * v for v in of_columns(m, rows, [_mixed([1.0, *w]) for w in ws])], **options}
            found.append(self.optimizer(loss, self.highest, self.lowest, **options))
        best = [float(x) for x in np.mean(found, axis=0)]
        ranker = self.make(best) if self.make else GenericFilter([1.0, *best], normalization=self.normalization, error="iters", max_iters=len(best) + 2) >> Normalize()
        mixture = None
        if moved is not None:
            own, rest, hops = moved
            weights = [1.0, *best]
            terms = [*zip(weights, own, strict=True), *(zip(weights, rest, strict=True) if self.combined else ())]
            mixture = hops.select("id", reduce(lambda a, b: a + b, [F.col(c) * (w * n) for w, (c, n) in terms]).alias("value"))
        return ranker, p if self.combined else training, mixture


def _parts(graph: Graph, normalization: Normalization | str, parts: Sequence[Signal], scaled: Sequence[Signal], n: int) -> tuple[list[float], DataFrame]:
    """Signals as slots of one state, moved n - 1 times: by what each is multiplied to be itself again, and the hops. Those of scaled are moved over their norms."""
    norms = [(s.norm() or 1.0) if any(s is x for x in scaled) else 1.0 for s in parts]
    slots = F.array(*[F.col(f"v{i}") / m for i, m in enumerate(norms)])
    both = reduce(lambda a, b: a.join(b, "id"), [s.df.select("id", F.col("value").alias(f"v{i}")) for i, s in enumerate(parts)])
    n_ = normalization if isinstance(normalization, Normalization) else Normalization(normalization)
    table = both.select("id", slots.alias("p"))
    if n < MANY:
        return norms, moved_hops(graph, n_, table, len(parts), n)
    return norms, graph.remembered(("blocks", n_), lambda: Blocks(graph, n_)).hops(table, len(parts), n)


def _mixtures(measure: Supervised, hops: DataFrame, names: list[str], mix: Callable[[list[float]], np.ndarray]) -> Callable[[list[list[float]]], list[float]]:
    """Losses of candidates that are mixtures of columns: from the products of columns, so that one job serves all turns."""
    rows = measure.rows(hops.select("id", F.lit(0.0).alias("value"))).select("id", "y").join(hops, "id")
    g = products(rows, [*names, "y"])
    xx, xy, yy = g[:-1, :-1], g[:-1, -1], float(g[-1, -1])
    return lambda ws: [-measure.direction * type(measure).of_products(float(c @ xx @ c), float(c @ xy), yy) for c in map(mix, ws)]


def _filters_in_hops(make: Callable[[list[float]], Ranker], highest: list[float], graph: Graph, training: Signal, measure: Supervised) -> Callable[[list[list[float]]], list[float]]:
    """Losses of filters that weight hops with two or more steps of their own; of other filters as _candidates gives them."""
    lead = make(list(highest))
    if in_hops(lead, [1.0] * lead.convergence.max_iters) is None or lead.convergence.max_iters < 3:  # a single step is left to slots
        return _candidates(make, graph, training, measure)
    n = lead.convergence.max_iters
    norms, hops = _parts(graph, lead.normalization, [training], [training], n)
    names = [f"h{k}_0" for k in range(n)]
    sums = [float(v or 0.0) for v in hops.agg(*[F.sum(c) for c in names]).first()]
    others: list[Callable] = []

    def mix(w: list[float]) -> np.ndarray:
        f = make(w)
        return in_hops(f, sums) * (norms[0] if f.preserve_norm else 1.0)

    mixed = _mixtures(measure, hops, names, mix)

    def many(candidates: list[list[float]]) -> list[float]:
        if all((f := make(w)).normalization == lead.normalization and in_hops(f, sums) is not None for w in candidates):
            return mixed(candidates)
        if not others:
            others.append(_candidates(make, graph, training, measure))
        return others[0](candidates)

    return many


def _in_slots(ranker: Ranker) -> bool:
    return isinstance(ranker, GraphFilter) and ranker.ranks_many()


def _candidates(make: Callable[[list[float]], Ranker], graph: Graph, training: Signal, measure: Supervised) -> Callable[[list[list[float]]], list[float]]:
    """Losses of a turn's candidates: each is a slot of one state, with its own coefficients."""
    known = written(measure.rows(training).select("id", F.array("y").alias("y")), "known")

    def many(candidates: list[list[float]]) -> list[float]:
        with scope(graph.spark):
            p = training.df.select("id", F.array_repeat("value", len(candidates)).alias("p"))
            ranks, _ = rank_slots([make(w) for w in candidates], graph, p)
            return [-measure.direction * v for v in of_slots([measure], ranks, known, len(candidates))[0]]

    return many


def _mixed(weights: Sequence[float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"h{i}") * float(w) for i, w in enumerate(weights)])


class HopTuner(Tuner):
    """A hop's weight is how well it alone, from one half of the training seeds, predicts the seeds kept apart.

    basis: hops themselves ("krylov") or an orthonormal basis of them ("arnoldi").
    autoregression: each hop's measures are replaced by what so many later ones predict, with
    one set of coefficients that is fitted by least squares.
    offset: a measure; the number from 0 to 1 that added to all weights gives most of it.
    """

    def __init__(self, measure: Callable[..., Measure] = Cos, hops: int = 20, basis: str = "krylov", autoregression: int = 0, offset: Callable[..., Measure] | None = None, normalization: Normalization | str = "auto", seed: int = 0):
        if basis not in ("krylov", "arnoldi"):
            raise ValueError(f"no basis {basis}")
        self.measure, self.hops, self.basis, self.autoregression, self.offset, self.normalization, self.seed = measure, hops, basis, autoregression, offset, normalization, seed

    def _columns(self, graph: Graph, signal: Signal) -> DataFrame:
        """id, h0, h1, ...: the signal's terms in the basis."""
        n_terms = self.hops + self.autoregression
        if self.basis == "krylov":
            return GenericFilter(normalization=self.normalization).hop_columns(graph, signal, n_terms)
        n = self.normalization if isinstance(self.normalization, Normalization) else Normalization(self.normalization)
        base, _ = arnoldi(n.edges(graph), signal.df.withColumnRenamed("value", "v0"), n_terms)
        return base.select("id", *[F.col(c).alias(f"h{c[1:]}") for c in base.columns if c != "id"])

    def rank(self, graph, signal=None, **more):
        if self.basis != "krylov" or self.offset is not None:
            return super().rank(graph, signal, **more)
        self.checked(more)
        return self._together(graph, Signal.of(graph, signal).stored())

    def _together(self, graph: Graph, p: Signal) -> Signal:
        """The parts that measures need and the rest of the seeds are moved in one state; what the weights make of all seeds is the sum over parts."""
        training, validation = halves(p, 0.8, self.seed)
        parts = halves(training, 0.5, self.seed + 1)
        norms, hops = _parts(graph, self.normalization, [*parts, validation], parts, self.hops + self.autoregression)
        terms, values = range(self.hops + self.autoregression), []
        for i, part in enumerate(parts):
            values.append(self._measured(self.measure(validation, exclude=part), hops, [F.col(f"h{k}_{i}") for k in terms]))
        weights = self._weights(values)
        value = reduce(lambda a, b: a + b, [F.col(f"h{k}_{i}") * float(w * m) for k, w in enumerate(weights) for i, m in enumerate(norms)])
        return Signal(graph, hops.select("id", value.alias("value")))

    def _weights(self, values: list[list[float]]) -> np.ndarray:
        weights = _smoothed(np.array(values).T, self.autoregression)[: self.hops]
        return weights / np.abs(weights).mean() if np.abs(weights).sum() else weights

    def tune(self, graph, signal=None, **more):
        p = Signal.of(graph, signal).stored()
        training, validation = halves(p, 0.8, self.seed)
        values = []
        for part in halves(training, 0.5, self.seed + 1):
            columns = self._columns(graph, part)
            values.append(self._measured(self.measure(validation, exclude=part), columns, [F.col(c) for c in columns.columns if c != "id"]))
        weights = _smoothed(np.array(values).T, self.autoregression)[: self.hops]
        if self.offset is not None:
            top, columns, m = max(weights) or 1.0, self._columns(graph, training), self.offset(validation, exclude=training)
            weights = weights / top
            added = lambda ts: [-m.direction * v for v in self._measured(m, columns, [_mixed(weights + t[0]) for t in ts])]
            weights = weights + optimize(lambda t: added([t])[0], [1.0], [0.0], deviation_tol=0.005, parameter_tol=1.0, divide_range=1.1, many=added)[0]
        if np.abs(weights).sum():
            weights = weights / np.abs(weights).mean()
        if self.basis == "krylov":
            return GenericFilter(list(weights), normalization=self.normalization, error="iters", max_iters=len(weights) + 1), p
        return Tautology(), Signal(graph, self._columns(graph, p).select("id", _mixed(weights).alias("value")))

    def _measured(self, m: Measure, columns: DataFrame, scores: list[Column]) -> list[float]:
        rows = written(m.rows(columns.select("id", F.lit(0.0).alias("value"))).select("id", "y").join(columns, "id"), "hops")
        return of_columns(m, rows, scores)


def _smoothed(values: np.ndarray, lag: int) -> np.ndarray:
    """The mean of measures (hop, part) over parts, after each is predicted by the lag ones after it, if there are any."""
    mean = values.mean(axis=0)
    off = values - mean
    if lag and len(off) > lag + 1:
        later = np.stack([off[1 + j : len(off) - lag + 1 + j] for j in range(lag)], axis=-1)  # hop, part, lag
        window = np.linalg.lstsq(later.reshape(-1, lag), off[: len(off) - lag].reshape(-1), rcond=None)[0]
        off = np.concatenate([later @ window, off[len(off) - lag :]])
    return off.mean(axis=1) + mean.mean()
