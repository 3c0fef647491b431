"""Graph filters: diffusion of a personalization over the edges.

Each step is one join of the state with the edges by source, one grouped sum by target, and
one projection with the filter's formula; the state is written to the shared folder, which
keeps plans short and recoverable. Edges lie in buckets by source and aren't shuffled. Sums
and errors of a step come from the job that writes it; the state before the last is deleted.
Plans hold no state of a run: what a run carries is in its table.
"""

from __future__ import annotations

import copy
from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from diffusio.functions.math import Adjacency, conv, safe_div, safe_inv
from diffusio.graph import Graph, Signal
from diffusio.operators.convergence import ERRORS, Convergence, NotConverged
from diffusio.operators.normalize import Normalization
from diffusio.plans.ranker import Ranker, configured
from diffusio.session import Steps, written


#: A column by its name: of the state, or of one slot of it.
At = Callable[[str], Column]
#: Signals that are moved in one state at most; more are moved in several.
SLOTS = 64


def dropped(edges: DataFrame, share: float, k: int, seed: int = 0) -> DataFrame:
    """edges without a share of them, the rest weighted up. Which go depends on (source, target, k, seed) alone.

    The draw is the first 32 bits of the MD5 of these, joined by tabs, so any retry and any layout give the same.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("\t", "src", "dst", F.lit(str(k)), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long")
    return edges.where(draw >= int(share * (1 << 32))).withColumn("w", F.col("w") / (1 - share))


def rank_slots(filters: Sequence[GraphFilter], graph: Graph, table: DataFrame, **more: Any) -> tuple[DataFrame, list[int]]:
    """Ranks (id, value: array) of many signals at once: slot i of table (id, p: array) by filter i.

    The filters are of one class and normalization and differ in their parameters. A step is one
    join and one shuffle of sums for all slots; a slot whose filter has converged is no longer moved.
    Also returns the iterations of each slot.
    """
    lead, n = filters[0], len(filters)
    if any(type(f) is not type(lead) or not f.ranks_many() or (f.normalization, f.preserve_norm, getattr(f, "quotient", None)) != (lead.normalization, lead.preserve_norm, getattr(lead, "quotient", None)) for f in filters):
        raise ValueError("filters of one state need one class, normalization and quotient")
    lead.checked(more)
    slots, steps = range(n), Steps()
    zero = f"array_repeat(0.0D, {n})"
    whole = graph.nodes.join(table.select("id", "p"), "id", "left").select("id", F.coalesce(F.col("p").cast("array<double>"), F.expr(zero)).alias("p"))
    edges = lead.adjacency(graph, more)
    state, norms = steps.written(lead.start(graph, edges, whole.withColumn("r", F.col("p")), more), "slots", **{f"n{i}": F.expr(f"sum(abs(p[{i}]))") for i in slots})
    norm = [norms[f"n{i}"] or 1.0 for i in slots]
    state = state.withColumn("p", F.expr(f"zip_with(p, {_numbers(norm)}, (x, y) -> x / y)")).withColumn("r", F.col("p"))
    shared = set(state.columns) - {"p", "r"}  # columns of nodes, the same for all slots
    state = state.withColumns(_each(filters, lambda f, c: f.first(c), ["p", "r"], shared))
    own = [c for c in state.columns if c != "id" and c not in shared]
    stops = [copy.copy(f.convergence) for f in filters]
    for s in stops:
        s.start()
    live, errors, totals = list(slots), None, getattr(lead, "quotient", False) is True
    while live := [i for i in live if not stops[i].stop(state, None if errors is None else "old", "r", {} if errors is None else {"error": errors[i]})]:
        k, names = stops[live[0]].iteration, lead.moved()
        moving = _each(filters, lambda f, c: {m: f.moving(m, c) for m in names}, own, shared)
        columns = [f"{m}_{i}" for m in names for i in live]
        moved = state.select("id", *[v.alias(m) for m, v in moving.items()])
        moved = moved.where(" OR ".join(f"exists({m}, x -> x <> 0)" for m in names)).selectExpr("id", *[f"{m}[{i}] AS {m}_{i}" for m in names for i in live])
        came = conv(edges, moved, *columns).selectExpr("id", *[f"array({', '.join(f'{m}_{i}' if i in live else '0.0D' for i in slots)}) AS {m}_in" for m in names])
        joined = state.drop("old").join(came, "id", "left").withColumns({f"{m}_in": F.coalesce(f"{m}_in", F.expr(zero)) for m in names})
        new = _each(filters, lambda f, c: f.step(k, c), [*own, *[f"{m}_in" for m in names]], shared)
        if len(live) < n:  # the others stay as they are
            new = {c: F.zip_with(F.zip_with(v, F.col(c), lambda x, y: F.struct(x.alias("new"), y.alias("old"))), F.expr(f"array({', '.join('true' if i in live else 'false' for i in slots)})"), lambda x, on: F.when(on, x["new"]).otherwise(x["old"])) for c, v in new.items()}
        watched = [i for i in live if stops[i].error != "iters"]
        seeing = {f"t{i}": F.expr(f"sum(r[{i}])") for i in live} if totals else {f"e{i}": ERRORS[stops[i].error](F.col("old")[i], F.col("r")[i]) for i in watched}
        kept = [c for c in state.columns if c not in ("id", "old", *new)]
        state, seen = steps.written(joined.select("id", F.col("r").alias("old"), *kept, *[v.alias(c) for c, v in new.items()]), "slots", **seeing)
        if totals:
            state = state.withColumn("r", F.expr(f"zip_with(r, {_numbers([(seen[f't{i}'] or 1.0) if i in live else 1.0 for i in slots])}, (x, y) -> x / y)"))
            if watched:
                seen = state.agg(*[ERRORS[stops[i].error](F.col("old")[i], F.col("r")[i]).alias(f"e{i}") for i in watched]).first().asDict()
        errors = {i: seen[f"e{i}"] if i in watched else None for i in live}
    value = _each(filters, lambda f, c: {"value": f.end(c)}, own, shared)["value"]
    scale = _numbers([norm[i] if f.preserve_norm else 1.0 for i, f in enumerate(filters)])
    return state.withColumn("value", value).select("id", F.expr(f"zip_with(value, {scale}, (x, y) -> x * y)").alias("value")), [s.iteration for s in stops]


def _numbers(values: Sequence[float]) -> str:
    """An array of numbers as SQL."""
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def _each(filters: Sequence[GraphFilter], make: Callable[[GraphFilter, At], dict[str, Column]], own: list[str], shared: set[str]) -> dict[str, Column]:
    """Arrays of what make() gives for each slot, from the slots of columns and from columns of nodes.

    If the filters are one, the formula is one function of a slot's values; else there is an expression for each slot.
    """
    if all(f is filters[0] for f in filters):
        zipped = F.arrays_zip(*own)

        def one(c: str) -> Callable[[Column], Column]:
            return lambda x: make(filters[0], lambda name: F.col(name) if name in shared else x[name])[c].cast("double")

        return {c: F.transform(zipped, one(c)) for c in make(filters[0], F.col)}
    found = [make(f, lambda name, i=i: F.col(name) if name in shared else F.col(name)[i]) for i, f in enumerate(filters)]
    return {c: F.array(*[v[c].cast("double") for v in found]) for c in found[0]}


class GraphFilter(Ranker):
    """The loop. Subclasses give step(), the columns r (scores), t (state) and others of a new state.

    dropout: share of edges left out of each step, with the rest weighted up; which ones goes by
    a hash of edge, step and seed.
    """

    def __init__(self, normalization: Normalization | str = "auto", convergence: Any = None, preserve_norm: bool = True, before: Ranker | None = None, dropout: float = 0.0, dropout_seed: int = 0, **convergence_options: Any):
        if convergence is not None and convergence_options:
            raise TypeError(f"unknown or repeated options {sorted(convergence_options)}")
        self.normalization = normalization if isinstance(normalization, Normalization) else Normalization(normalization)
        self.convergence = convergence if convergence is not None else Convergence(**convergence_options)
        self.preserve_norm, self.before, self.dropout, self.dropout_seed = preserve_norm, before, dropout, dropout_seed

    def __add__(self, x: Any) -> Ranker:
        return configured(self, x)

    def after(self, base: Ranker) -> Ranker:
        return self.with_(before=base)

    # What subclasses define. Formulas take columns by c(name), so that they hold for one signal and for each slot of many.
    def start(self, graph: Graph, edges: Any, state: DataFrame, more: dict) -> DataFrame:
        """The state (id, p, r) with further columns of nodes, which no step changes."""
        return state

    def first(self, c: At) -> dict[str, Column]:
        """Columns of the first state besides p and r."""
        return {}

    def moved(self) -> list[str]:
        """Columns that are moved along the edges; each arrives as <name>_in."""
        return ["r"]

    def moving(self, column: str, c: At) -> Column:
        """What of a column is moved."""
        return c(column)

    def step(self, k: int, c: At) -> dict[str, Column]:
        """New values of columns at iteration k (from 1)."""
        raise NotImplementedError

    def observed(self) -> dict[str, Column]:
        """Aggregates of a new state that settle() needs."""
        return {}

    def settle(self, state: DataFrame, graph: Graph, seen: dict[str, Any]) -> DataFrame:
        """The state after a step as the next one sees it; seen has what was observed."""
        return state

    def end(self, c: At) -> Column:
        return c("r")

    def adjacency(self, graph: Graph, more: dict) -> Adjacency:
        return self.normalization.adjacency(graph)

    inputs = ("warm_start",)

    def rank(self, graph, signal=None, warm_start: Any = None, **more):
        self.checked(more)
        p = Signal.of(graph, signal)
        if self.before is not None:
            p = self.before.rank(graph, p)
        p = p.stored()
        norm = p.norm()
        if norm == 0:
            return p
        edges = self.adjacency(graph, more)
        state = p.df.select("id", (F.col("value") / norm).alias("p"))
        if warm_start is None:
            state = state.withColumn("r", F.col("p"))
        else:
            state = state.join(Signal.of(graph, warm_start).df.withColumnRenamed("value", "r"), "id")
        steps = Steps()
        state = self.start(graph, edges, state, more)
        state, seen = steps.written(state.withColumns(self.first(F.col)), "state", **self.observed())
        state = self.begun(state, seen)
        convergence = copy.copy(self.convergence)
        convergence.start()
        old, seen = None, {}
        # errors can be observed as a state is written if nothing changes it afterwards
        late = type(self).settle is not GraphFilter.settle and bool(getattr(self, "quotient", True))
        while not convergence.stop(state, old, "r", seen):
            k, old = convergence.iteration, "old"
            e = edges._replace(rows=dropped(edges.rows, self.dropout, k, self.dropout_seed)) if self.dropout else edges
            names = self.moved()
            leaving = state.select("id", *[self.moving(c, F.col).alias(c) for c in names]).where(" OR ".join(f"{c} <> 0" for c in names))
            arrived = conv(e, leaving, *names)
            joined = state.drop("old").join(arrived.select("id", *[F.col(c).alias(f"{c}_in") for c in names]), "id", "left").fillna(0.0, [f"{c}_in" for c in names])
            changed = self.step(k, F.col)
            kept = [c for c in state.columns if c not in ("id", "old") and c not in changed]
            state = joined.select("id", F.col("r").alias("old"), *kept, *[v.cast("double").alias(c) for c, v in changed.items()])
            state, seen = steps.written(state, "state", **self.observed(), **({} if late else convergence.wanted("old", "r")))
            state = self.settle(state, graph, seen)
        out = state.select("id", self.end(F.col).alias("value"))
        found = Signal(graph, out.select("id", (F.col("value") * norm).alias("value")) if self.preserve_norm else out)
        found.iterations = convergence.iteration
        return found

    def begun(self, state: DataFrame, seen: dict[str, Any]) -> DataFrame:
        """The first state as the first step sees it."""
        return state

    def ranks_many(self) -> bool:
        """Whether many signals can be ranked in the slots of one state."""
        return isinstance(self.convergence, Convergence) and isinstance(getattr(self, "quotient", True), bool) and not (self.dropout or self.before)

    def rank_many(self, graph: Graph, table: DataFrame, **more: Any) -> DataFrame:
        """Ranks of each column of a table (id, ...) as a personalization of its own."""
        names = [c for c in table.columns if c != "id"]
        out = graph.nodes
        for at in range(0, len(names), SLOTS):
            some = names[at : at + SLOTS]
            ranks, _ = rank_slots([self] * len(some), graph, table.select("id", F.array(*some).alias("p")), **more)
            out = out.join(ranks.select("id", *[F.col("value")[i].alias(c) for i, c in enumerate(some)]), "id") if len(names) > SLOTS else ranks.select("id", *[F.col("value")[i].alias(c) for i, c in enumerate(some)])
        return out


class Recursive(GraphFilter):
    """r <- formula(r), then the quotient: True divides by the (signed) sum, a postprocessor is applied, False is nothing.

    eigenvectors: the personalization follows the scores.
    """

    def __init__(self, *args: Any, quotient: Any = True, eigenvectors: bool = False, **options: Any):
        super().__init__(*args, **options)
        self.quotient, self.eigenvectors = quotient, eigenvectors

    def formula(self, k: int, c: At) -> Column:
        """New scores from r_in (moved scores), r, p and further columns."""
        raise NotImplementedError

    def step(self, k, c):
        return {"r": self.formula(k, c)}

    def ranks_many(self):
        return super().ranks_many() and not self.eigenvectors

    def observed(self):
        return {"total": F.sum("r")} if self.quotient is True else {}

    def settle(self, state, graph, seen):
        if isinstance(self.quotient, Ranker):
            new = self.quotient.transform(Signal(graph, state.select("id", F.col("r").alias("value"))))
            state = written(state.drop("r").join(new.df.withColumnRenamed("value", "r"), "id"), "state")
        elif self.quotient and seen["total"]:
            state = state.withColumn("r", F.col("r") / seen["total"])
        return state.withColumn("p", F.col("r")) if self.eigenvectors else state


class PageRank(Recursive):
    """alpha * moved + (1 - alpha) * p."""

    def __init__(self, alpha: float = 0.85, **options: Any):
        super().__init__(**options)
        self.alpha = alpha

    def formula(self, k, c):
        return self.alpha * c("r_in") + (1 - self.alpha) * c("p")


class DijkstraRank(Recursive):
    """The larger of a score and the degraded moved one."""

    def __init__(self, degradation: float = 0.1, **options: Any):
        super().__init__(**options)
        self.degradation = degradation

    def formula(self, k, c):
        return F.greatest(c("r"), c("r_in") * self.degradation)


class BiasedKernel(Recursive):
    def __init__(self, alpha: float = 0.85, t: float = 1, **options: Any):
        super().__init__(**options)
        self.alpha, self.t = alpha, t

    def formula(self, k, c):
        return c("p") + (self.alpha * self.t / k) * c("r_in") * c("p") - c("r")


def _with_degrees(state: DataFrame, edges: Adjacency) -> DataFrame:
    d = edges.rows.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"))
    return state.join(d, "id", "left").fillna(0.0, ["d"])


class AbsorbingWalks(Recursive):
    """Walks absorbed at a node in proportion to absorption * (1 - alpha) / alpha. Degrees are of the normalized edges."""

    inputs = ("warm_start", "absorption")

    def __init__(self, alpha: float = 1 - 1e-6, **options: Any):
        super().__init__(**options)
        self.alpha = alpha

    def start(self, graph, edges, state, more):
        absorption = Signal.of(graph, more.get("absorption")).df
        state = _with_degrees(state, edges).join(absorption, "id")
        return state.withColumn("a", F.col("value") * ((1 - self.alpha) / self.alpha)).drop("value")

    def formula(self, k, c):
        return safe_div(c("r_in") * c("d") + c("p") * c("a"), c("a") + c("d"))


class SymmetricAbsorbing(Recursive):
    def __init__(self, alpha: float = 0.5, **options: Any):
        super().__init__(**options)
        self.alpha = alpha  # takes no part

    def start(self, graph, edges, state, more):
        return _with_degrees(state, edges).withColumn("a", (1 + F.sqrt(1 + 4 * F.col("d"))) / 2)

    def moving(self, column, c):
        return safe_div(c(column), c("a"))

    def formula(self, k, c):
        return (c("r_in") * c("d") + c("p") * c("a")) / (c("a") + c("d"))


class Impulse(Recursive):
    """a * moved + (1 - a) * r with the k-th parameter a; unchanged beyond them."""

    def __init__(self, params: Sequence[float] = (0.9,) * 10, **options: Any):
        super().__init__(**options)
        self.params = tuple(params)

    def at(self, k: int) -> float:
        return self.params[k - 1] if k <= len(self.params) else 0.0

    def formula(self, k, c):
        return self.at(k) * c("r_in") + (1 - self.at(k)) * c("r")


class LowPass(Impulse):
    """a * moved + (1 - a) * p with the k-th parameter a; unchanged beyond them."""

    def formula(self, k, c):
        if k > len(self.params):
            return c("r")
        return self.at(k) * c("r_in") + (1 - self.at(k)) * c("p")


class HopStore:
    """Signals moved 0, 1, ... times, kept for filters that weight them: a table of id, h0, h1, ... for each key.

    A key is the graph, the normalization and the content of the signal. A table is extended when
    more hops are asked for. keep: for how many keys tables are kept; the one used longest ago goes.
    """

    def __init__(self, keep: int = 1):
        self.keep = keep
        #: How many times signals have been moved so far.
        self.moves = 0
        self._held: dict[Any, tuple[Graph, DataFrame, list[dict[str, float]]]] = {}

    def __len__(self) -> int:
        return len(self._held)

    def columns(self, graph: Graph, normalization: Normalization, p: Signal, n: int) -> tuple[DataFrame, list[dict[str, float]]]:
        """id and h0 to h(n-1) at least, and for each the errors (of ERRORS, by name) that adding it makes."""
        content = p.df.agg(F.count("id"), F.sum(F.xxhash64("id", "value").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("value", "id"))).first()
        key = (id(graph), normalization, *content)
        names, a = ("mabs", "max", "l1", "l2", "msq"), F.lit(0.0)
        if key in self._held:
            _, state, sizes = self._held.pop(key)
        else:
            steps = Steps()
            state, seen = steps.written(p.df.withColumnRenamed("value", "h0"), "hops", **{m: ERRORS[m](a, F.col("h0")) for m in names})
            sizes = [seen]
        edges, steps = normalization.adjacency(graph), Steps()
        for i in range(len(sizes), n):
            moved = conv(edges, state.select("id", F.col(f"h{i - 1}").alias(f"h{i}")), f"h{i}")
            state, seen = steps.written(state.join(moved, "id", "left").fillna(0.0, [f"h{i}"]), "hops", **{m: ERRORS[m](a, F.col(f"h{i}")) for m in names})
            sizes = [*sizes, seen]
            self.moves += 1
        self._held[key] = (graph, state, sizes)  # the graph too, so that its id isn't given to another
        while len(self._held) > self.keep:
            self._held.pop(next(iter(self._held)))
        return state, sizes


def moved_hops(graph: Graph, normalization: Normalization, table: DataFrame, slots: int, n: int) -> DataFrame:
    """id and h<k>_<i>: slot i of a table (id, p: array) moved k times, k below n, for all nodes of the graph.

    A step carries nodes that something arrives at and one hop of them; hops come together once, at the end.
    """
    edges, steps, at = normalization.adjacency(graph), Steps(n + 1), [f"p{i}" for i in range(slots)]
    some = " OR ".join(f"{c} <> 0" for c in at)
    state, _ = steps.written(table.select("id", *[F.col("p")[i].cast("double").alias(c) for i, c in enumerate(at)]).where(some), "hop")
    whole = [state]
    for _ in range(1, n):
        state, _ = steps.written(conv(edges, state, *at).where(some), "hop")
        whole.append(state)
    cells = reduce(lambda a, b: a.union(b), [s.select("id", F.struct(F.lit(k).alias("k"), F.array(*at).alias("v")).alias("cell")) for k, s in enumerate(whole)])
    rows = graph.nodes.join(cells.groupBy("id").agg(F.map_from_entries(F.collect_list("cell")).alias("m")), "id", "left")
    out = written(rows.select("id", *[F.coalesce(F.expr(f"try_element_at(m, {k})[{i}]"), F.lit(0.0)).alias(f"h{k}_{i}") for k in range(n) for i in range(slots)]), "hops")
    steps.gone(graph.spark)
    return out


def in_hops(f: Any, sums: Sequence[float]) -> np.ndarray | None:
    """Coefficients of what f makes of a normalized signal, over the signal moved 0, 1, ... times, if its steps are linear and their number is fixed.

    sums: of all nodes' values, for each hop. None for other filters.
    """
    if not isinstance(f, GraphFilter) or not f.ranks_many() or f.convergence.error != "iters":
        return None
    steps, first = f.convergence.max_iters - 1, np.eye(len(sums))[0]
    if steps >= len(sums):
        return None
    if isinstance(f, ClosedForm):
        return np.array([*f.coefficients(steps), *[0.0] * (len(sums) - steps)])
    if type(f) not in (PageRank, Impulse, LowPass) or not isinstance(f.quotient, bool):
        return None
    r = first
    for k in range(1, steps + 1):
        now = {"r": r, "p": first, "r_in": np.concatenate([[0.0], r[:-1]])}
        r = f.formula(k, now.__getitem__)
        total = float(r @ np.asarray(sums)) if f.quotient else 0.0
        r = r / total if total else r
    return r


class ClosedForm(GraphFilter):
    """Sum of c_k times the signal moved k - 1 times, k from 1.

    chebyshev: from the third term on, twice the moved term less the term before takes its
    place. krylov: the number of dimensions in which powers are taken instead (Lanczos).
    hops: a store in which moved signals are kept for other filters.
    """

    def __init__(self, *args: Any, chebyshev: bool = False, krylov: int | None = None, hops: HopStore | None = None, **options: Any):
        super().__init__(*args, **options)
        self.chebyshev, self.krylov, self.hops = chebyshev, krylov, hops

    def coefficients(self, n: int) -> list[float]:
        """The first n."""
        raise NotImplementedError

    def first(self, c):
        return {"r": F.lit(0.0), "t": c("p")}

    def moved(self):
        return ["t"]

    def step(self, k, c):
        return {"r": c("r") + self.coefficients(k)[-1] * c("t"), "t": c("t_in")}

    def ranks_many(self):
        return super().ranks_many() and not (self.chebyshev or self.krylov)

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        if self.chebyshev:
            return self._chebyshev(graph, signal, **more)
        if self.krylov:
            return self._krylov(graph, signal)
        if self.hops is not None and not (self.dropout or self.before or more) and isinstance(self.convergence, Convergence) and self.convergence.error != "rmabs":
            return self._from_hops(graph, signal)
        return super().rank(graph, signal, **more)

    def _chebyshev(self, graph, signal, **more):
        parent = self

        class Adjusted(ClosedForm):
            def coefficients(self, n):
                return parent.coefficients(n)

            def first(self, c):
                return {"r": F.lit(0.0), "before": F.lit(0.0), "now": c("p")}

            def moved(self):
                return ["now"]

            def step(self, k, c):
                # now: this iteration's term, adjusted when it was made
                r = c("r") + self.coefficients(k)[-1] * c("now")
                before = c("now") if k >= 2 else c("before")
                term = c("now_in") if k + 1 <= 2 else 2 * c("now_in") - before
                return {"r": r, "before": before, "now": term}

        out = Adjusted(self.normalization, self.convergence, self.preserve_norm, self.before, self.dropout)
        return out.rank(graph, signal, **more)

    def _krylov(self, graph, signal):
        p = Signal.of(graph, signal).stored()
        norm = p.norm()
        if norm == 0:
            return p
        p = (p / norm).stored()
        edges = self.normalization.adjacency(graph)
        base, h = lanczos(edges, p.df.withColumnRenamed("value", "v0"), self.krylov)
        if (error := krylov_error(edges, base, h)) > KRYLOV_ERROR:
            raise NotConverged(f"{self.krylov} dimensions are too few: a moved signal is missed by {error}")
        convergence, power, result, n = copy.copy(self.convergence), np.eye(len(h)), np.zeros_like(h), 0
        last = None
        convergence.start()
        while n < max(1, convergence.max_iters - 1):
            n += 1
            result = result + self.coefficients(n)[-1] * power
            power = power @ h
            if last is not None and convergence.error != "iters" and np.abs(result - last).mean() <= (convergence.tol or 0):
                break
            last = result
        value = reduce(lambda a, b: a + b, [F.col(f"v{i}") * float(result[i, 0]) for i in range(len(h))])
        # columns are orthonormal: the first is p over its length
        length = p.aggregate(F.sqrt(F.sum(F.col("value") * F.col("value"))))[0]
        return Signal(graph, base.select("id", (value * float(length) * (norm if self.preserve_norm else 1.0)).alias("value")))

    def hop_columns(self, graph: Graph, signal: Any, n: int) -> DataFrame:
        """id, h0..h(n-1) at least: the normalized signal moved 0, 1, ... times, from the store if there is one."""
        store = self.hops if self.hops is not None else HopStore()
        return store.columns(graph, self.normalization, Signal.of(graph, signal).normalized(), n)[0]

    def _from_hops(self, graph: Graph, signal: Any) -> Signal:
        """As the loop does it, with what is moved taken from the store. Errors of sums follow from those of hops, without jobs."""
        p = Signal.of(graph, signal).stored()
        if (norm := p.norm()) == 0:
            return p
        c, n = copy.copy(self.convergence), 0
        c.start()
        state, sizes, error = None, [], None
        while not c.stop(None, None if error is None else "old", "r", {"error": error}):
            n += 1
            if len(sizes) < n:  # a few hops ahead
                state, sizes = self.hops.columns(graph, self.normalization, p / norm, n if c.error == "iters" else n + 4)
            w = abs(self.coefficients(n)[-1])
            error = w * sizes[n - 1][c.error] if c.error in ("mabs", "max", "l1") else w * w * sizes[n - 1][c.error] if c.error != "iters" else None
        value = reduce(lambda a, b: a + b, [F.col(f"h{i}") * w for i, w in enumerate(self.coefficients(n))], F.lit(0.0))
        rows = p.df.select("id", F.lit(0.0).alias("h0")) if state is None else state
        found = Signal(graph, rows.select("id", (value * (norm if self.preserve_norm else 1.0)).alias("value")))
        found.iterations = c.iteration
        return found


class PageRankClosed(ClosedForm):
    def __init__(self, alpha: float = 0.85, **options: Any):
        super().__init__(**options)
        self.alpha = alpha

    def coefficients(self, n):
        return [self.alpha**k for k in range(n)]


class HeatKernel(ClosedForm):
    """c_1 = 1, c_k = c_(k-1) * t / (k + 1)."""

    def __init__(self, t: float = 3, **options: Any):
        super().__init__(**options)
        self.t = t

    def coefficients(self, n):
        out = [1.0]
        for k in range(2, n + 1):
            out.append(out[-1] * self.t / (k + 1))
        return out[:n]


class GenericFilter(ClosedForm):
    """Given weights, 0 beyond them."""

    def __init__(self, weights: Sequence[float] = (0.9,) * 10, **options: Any):
        super().__init__(**options)
        self.weights = tuple(float(w) for w in weights)

    def coefficients(self, n):
        return [*self.weights[:n], *[0.0] * (n - len(self.weights))]


class FairPageRank(Recursive):
    """Locally fair PageRank. rank() needs ``sensitive``; quotient as for others.

    target: the ratio aimed at between the group's share and that of others.
    redistributor: None (even), "original" (PageRank of the personalization with column
    normalization and the same stopping rule) or a ranker, which gets the personalization too.
    balance (an extension): give the group its share of the personalization first.
    """

    inputs = ("warm_start", "sensitive")

    def __init__(self, alpha: float = 0.85, target: float = 1.0, redistributor: Any = None, balance: bool = False, **options: Any):
        super().__init__(**options)
        self.alpha, self.target, self.redistributor, self.balance = alpha, target, redistributor, balance

    def rank(self, graph, signal=None, sensitive=None, **more):
        s, p = Signal.of(graph, sensitive).stored(), Signal.of(graph, signal)
        if self.balance:
            phi = s.sum() / graph.number_of_nodes() * self.target
            p = p.normalized()
            red = (p * s).sum()
            blue = p.sum() - red
            if red and blue:
                p = p.zip(s, lambda v, x: v * x * (phi / red) + v * (1 - x) * ((1 - phi) / blue))
        return super().rank(graph, p, sensitive=_Inputs(s, p), **more)

    def adjacency(self, graph, more):
        raw = Normalization("none").adjacency(graph)
        s, p = more["sensitive"]
        n = graph.number_of_nodes()
        phi = s.sum() / n * self.target
        both = s.df.select("id", F.col("value").alias("red"), (1 - F.col("value")).alias("blue"))
        out = graph.nodes.join(conv(raw, both, "red", "blue"), "id", "left").fillna(0.0, ["red", "blue"])
        low = F.col("red") < phi * (F.col("red") + F.col("blue"))
        high = ~low & (F.col("red") != 0)
        rest = ~low & ~high
        a, b = safe_div(F.col("red"), F.col("blue")), safe_div(F.col("blue"), F.col("red"))
        scale = F.when(low, (1 - phi) * safe_inv(F.col("blue"))).when(high, phi * safe_inv(F.col("red"))).otherwise(1.0)
        d_red = F.when(low, phi - (1 - phi) * a).when(rest, phi).otherwise(0.0)
        d_blue = F.when(high, (1 - phi) - phi * b).when(rest, 1 - phi).otherwise(0.0)
        ranker = PageRank(self.alpha, normalization="col", convergence=copy.copy(self.convergence)) if self.redistributor == "original" else self.redistributor
        base = Signal.of(graph) if ranker is None else ranker.rank(graph, p)
        x = both.join(base.df, "id").select("id", (F.col("red") * F.col("value")).alias("xr"), (F.col("blue") * F.col("value")).alias("xb"))
        total = x.agg(F.sum("xr"), F.sum("xb")).first()
        x = x.select("id", (F.col("xr") / (total[0] or 1.0)).alias("xr"), (F.col("xb") / (total[1] or 1.0)).alias("xb"))
        more["tables"] = written(out.select("id", scale.alias("scale"), d_red.alias("dr"), d_blue.alias("db")).join(x, "id"), "fair")
        scaled = raw.plain.join(more["tables"].select(F.col("id").alias("src"), "scale"), "src")
        return Normalization.stored(scaled.select("src", "dst", (F.col("w") * F.col("scale")).alias("w")), graph)

    def start(self, graph, edges, state, more):
        return state.join(more["tables"].drop("scale"), "id")

    # the two sums over all nodes that a step needs are columns of the state before it
    def observed(self):
        return {**super().observed(), "red": F.sum(F.col("r") * F.col("dr")), "blue": F.sum(F.col("r") * F.col("db"))}

    def begun(self, state, seen):
        return state.withColumns({"red": F.lit(float(seen["red"] or 0)), "blue": F.lit(float(seen["blue"] or 0))})

    def settle(self, state, graph, seen):
        scale = seen["total"] if self.quotient is True and seen["total"] else 1.0
        out = super().settle(state, graph, seen)
        if isinstance(self.quotient, Ranker):
            seen = out.agg(*[v.alias(k) for k, v in self.observed().items()]).first().asDict()
        return self.begun(out, {k: (seen[k] or 0) / scale for k in ("red", "blue")})

    def formula(self, k, c):
        return self.alpha * (c("r_in") + c("red") * c("xr") + c("blue") * c("xb")) + (1 - self.alpha) * c("p")

    def end(self, c):
        return c("r") - (1 - self.alpha) * c("p")

    def ranks_many(self):
        return False  # two sums over all nodes take part in each step


class _Inputs(NamedTuple):
    """What FairPageRank's edges depend on: the sensitive group and the personalization."""

    sensitive: Signal
    personalization: Signal


def _orthonormal(state: DataFrame, edges: Adjacency | DataFrame, i: int) -> DataFrame:
    moved = conv(edges, state.select("id", F.col(f"v{i}").alias("m")), "m")
    return state.join(moved, "id", "left").fillna(0.0, ["m"])


def lanczos(edges: Adjacency | DataFrame, start: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """An orthonormal basis v0.. of the Krylov space of start (id, v0) and the tridiagonal matrix of the edges in it."""
    norm = start.agg(F.sqrt(F.sum(F.col("v0") * F.col("v0")))).first()[0]
    steps = Steps(4)  # two tables a dimension
    state, _ = steps.written(start.select("id", (F.col("v0") / norm).alias("v0")), "basis")
    alphas: list[float] = []
    betas: list[float] = []
    for j in range(dims):
        moved, seen = steps.written(_orthonormal(state, edges, j), "basis", alpha=F.sum(F.col(f"v{j}") * F.col("m")))
        alphas.append(float(seen["alpha"]))
        if j == dims - 1:
            break
        left = F.col("m") - alphas[j] * F.col(f"v{j}")
        if j:
            left = left - betas[j - 1] * F.col(f"v{j - 1}")
        moved = moved.withColumn("m", left)
        beta = float(moved.agg(F.sqrt(F.sum(F.col("m") * F.col("m")))).first()[0])
        if beta < 1e-12:
            break
        betas.append(beta)
        state, _ = steps.written(moved.withColumn(f"v{j + 1}", F.col("m") / beta).drop("m"), "basis")
    n = len(alphas)
    h = np.diag(alphas) + np.diag(betas[: n - 1], 1) + np.diag(betas[: n - 1], -1)
    return state, h


#: Fixed value: the most that the mean error of a moved signal may be.
KRYLOV_ERROR = 0.01


def krylov_error(edges: Adjacency | DataFrame, base: DataFrame, h: np.ndarray) -> float:
    """The mean error of the first basis vector after a move, as the basis and its matrix have it."""
    moved = _orthonormal(base, edges, 0)
    held = reduce(lambda a, b: a + b, [F.col(f"v{i}") * float(h[i, 0]) for i in range(len(h))])
    return float(moved.agg(F.avg(F.abs(F.col("m") - held))).first()[0] or 0.0)


def arnoldi(edges: Adjacency | DataFrame, start: DataFrame, dims: int) -> tuple[DataFrame, np.ndarray]:
    """A basis by modified Gram-Schmidt; the first vector has absolute sum 1. Returns it and its coefficients."""
    norm = start.agg(F.sum(F.abs("v0"))).first()[0]
    steps = Steps(4)  # two tables a dimension
    state, _ = steps.written(start.select("id", (F.col("v0") / norm).alias("v0")), "basis")
    h = np.zeros((dims, dims))
    for k in range(1, dims):
        moved, _ = steps.written(_orthonormal(state, edges, k - 1), "basis")
        for j in range(k):
            h[j, k - 1] = float(moved.agg(F.sum(F.col(f"v{j}") * F.col("m"))).first()[0])
            moved = moved.withColumn("m", F.col("m") - float(h[j, k - 1]) * F.col(f"v{j}"))
        h[k, k - 1] = float(moved.agg(F.sqrt(F.sum(F.col("m") * F.col("m")))).first()[0])
        if h[k, k - 1] < 1e-12:
            break
        state, _ = steps.written(moved.withColumn(f"v{k}", F.col("m") / float(h[k, k - 1])).drop("m"), "basis")
    return state, h


Step = Callable[[int], Column]


class CustomFilter(Recursive):
    """A filter from a function of the iteration that gives the formula's column."""

    def __init__(self, formula: Step, **options: Any):
        super().__init__(**options)
        self.own = formula

    def formula(self, k, c):
        return self.own(k)

    def ranks_many(self):
        return False  # the function names columns itself
