"""Quality measures of scores: supervised, unsupervised, combined, and over several groups.

A measure is called with a signal (or a table id, value) and gives a float; ``frame`` gives
the one-row table that it reads. ``direction`` is 1 if more is better, else -1.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.functions.math import EPSILON, conv, safe_div, safe_ln
from diffusio.functions.order import placed, running
from diffusio.graph import Graph, Signal
from diffusio.session import written



class Measure:
    direction = 1

    def frame(self, scores: Any) -> DataFrame:
        raise NotImplementedError

    def __call__(self, scores: Any) -> float:
        value = self.frame(scores).first()[0]
        return float(value) if value is not None else 0.0

    # adapters: this measure where something that makes measures is expected
    def as_supervised(self) -> Callable[..., Measure]:
        """Makes copies with given known values and exclusions."""
        return lambda known=None, exclude=None: self._with(known=known, exclude=exclude)

    def as_unsupervised(self) -> Callable[..., Measure]:
        """Makes copies for a given graph."""
        return lambda graph=None: self._with(graph=graph)

    def as_is(self) -> Callable[..., Measure]:
        """Gives this measure whatever it is asked for."""
        return lambda *args, **options: self

    def _with(self, **changed: Any) -> Measure:
        out = copy.copy(self)
        out.__dict__.update(changed)
        return out


class Utility:
    """Makes a supervised measure whose known values are the excluded ones (each may be transformed first)."""

    def __init__(self, measure: Callable[..., Measure], known: Callable[[Any], Any] = lambda x: x, excluded: Callable[[Any], Any] = lambda x: x):
        self.measure, self.known, self.excluded = measure, known, excluded

    def __call__(self, known: Any = None, exclude: Any = None) -> Measure:
        return self.measure(self.known(exclude), self.excluded(exclude))


def _df(x: Any) -> DataFrame:
    return x.df if isinstance(x, Signal) else x


class Supervised(Measure):
    """Against known values; nodes at which exclude isn't 0 are left out. Known may be a number for all nodes."""

    def __init__(self, known: Any = None, exclude: Any = None):
        self.known, self.exclude = known, exclude

    def rows(self, scores: Any) -> DataFrame:
        """id, y (known), x (scores)."""
        x = _df(scores).select("id", F.col("value").alias("x"))
        if self.known is None or isinstance(self.known, (int, float)):
            both = x.withColumn("y", F.lit(1.0 if self.known is None else float(self.known)))
        else:
            both = x.join(_df(self.known).select("id", F.col("value").alias("y")), "id", "left").fillna(0.0, ["y"])
        if self.exclude is not None:
            both = both.join(_df(self.exclude).where("value <> 0").select("id"), "id", "left_anti")
        return both

    def frame(self, scores):
        return self.of(self.rows(scores))

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.agg(self.value().alias("value"))

    def value(self) -> Column:
        """An aggregate of x and y."""
        raise NotImplementedError

    #: The measure from the sums of x * x, x * y and y * y, if these are enough.
    of_products: Callable[[float, float, float], float] | None = None


def of_columns(measure: Supervised, rows: DataFrame, scores: Sequence[Column]) -> list[float]:
    """A measure of each of several scores of rows (id, y, ...): one aggregation, if the measure is an aggregate of rows."""
    if type(measure).of is not Supervised.of:
        found = [measure.of(rows.select("id", "y", c.alias("x"))).first()[0] for c in scores]
        return [float(v or 0.0) for v in found]
    each = rows.select("y", F.posexplode(F.array(*scores)).alias("k", "x"))
    found = {r["k"]: r["value"] for r in each.groupBy("k").agg(measure.value().alias("value")).collect()}
    return [float(found.get(k) or 0.0) for k in range(len(scores))]


def products(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Sums over all rows of the products of any two columns: the measures of all their mixtures follow from them."""
    names, n = list(columns), len(columns)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names])
            total += x @ x.T
        yield pa.RecordBatch.from_arrays([pa.array(range(n * n), pa.int64()), pa.array(total.ravel(), pa.float64())], names=["at", "v"])

    found = rows.select(*[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(summed, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(n * n)
    for r in found.collect():  # one number for two columns
        out[r["at"]] = r["v"]
    return out.reshape(n, n)


def of_slots(measures: Sequence[Supervised], values: DataFrame, known: DataFrame, n: int) -> list[list[float]]:
    """Measures of each of n slots of values (id, value: array) against known (id, y: array), a known value for each measure.

    Measures that are aggregates of rows come from one aggregation, the others from one each.
    """
    rows = values.join(known, "id")
    if any(type(m).of is not Supervised.of for m in measures):
        return [of_columns(m, rows.select(F.col("y")[j].alias("y"), "id", "value"), [F.col("value")[i] for i in range(n)]) for j, m in enumerate(measures)]
    each = rows.select("y", F.posexplode("value").alias("k", "x")).select("k", "x", F.posexplode("y").alias("j", "y"))
    found = {(r["j"], r["k"]): r for r in each.groupBy("k", "j").agg(*[m.value().alias(f"v{j}") for j, m in enumerate(measures)]).collect()}
    return [[float((found[j, k][f"v{j}"] if (j, k) in found else None) or 0.0) for k in range(n)] for j in range(len(measures))]


def _simple(name: str, value: Callable[[], Column], direction: int = 1, doc: str = "") -> type[Supervised]:
    return type(name, (Supervised,), {"value": lambda self: value(), "direction": direction, "__doc__": doc})


MaxDifference = _simple("MaxDifference", lambda: F.max(F.abs(F.col("y") - F.col("x"))), -1, "Largest absolute difference.")
Mabs = _simple("Mabs", lambda: F.avg(F.abs(F.col("y") - F.col("x"))), -1, "Mean absolute difference.")
RMabs = _simple("RMabs", lambda: F.sum(F.abs(F.col("y") - F.col("x"))) / F.sum(F.abs(F.col("y"))), -1, "Absolute difference over absolute known values.")
MSQ = _simple("MSQ", lambda: F.avg((F.col("y") - F.col("x")) * (F.col("y") - F.col("x"))), -1, "Mean squared difference.")
MSQRT = _simple("MSQRT", lambda: F.sqrt(F.avg((F.col("y") - F.col("x")) * (F.col("y") - F.col("x")))), -1, "Its root.")
L1 = _simple("L1", lambda: F.sum(F.abs(F.col("y") - F.col("x"))), -1, "Sum of absolute differences.")
L2 = _simple("L2", lambda: F.sum((F.col("y") - F.col("x")) * (F.col("y") - F.col("x"))), -1, "Sum of squared differences, without a root.")
Euclidean = _simple("Euclidean", lambda: F.sqrt(F.sum((F.col("y") - F.col("x")) * (F.col("y") - F.col("x")))), -1, "Its root.")
BinaryCrossEntropy = _simple("BinaryCrossEntropy", lambda: -F.sum(F.col("y") * F.ln(F.col("x") + EPSILON) + (1 - F.col("y")) * F.ln(1 - F.col("x") + EPSILON)), -1, "Summed over nodes.")
CrossEntropy = _simple("CrossEntropy", lambda: -F.sum(F.col("x") * safe_ln(F.col("y"))), -1, "Of scores against known shares.")
Dot = _simple("Dot", lambda: F.sum(F.col("x") * F.col("y")), 1, "Sum of products.")
Cos = _simple("Cos", lambda: safe_div(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y")))), 1, "Cosine; 0 for a zero vector.")
Dot.of_products = staticmethod(lambda xx, xy, yy: xy)
Cos.of_products = staticmethod(lambda xx, xy, yy: xy / math.sqrt(xx * yy) if xx * yy > 0 else 0.0)
Accuracy = _simple("Accuracy", lambda: 1 - F.avg(F.abs(F.col("y") - F.col("x"))), 1, "1 - the mean absolute difference.")
Pearson = _simple("Pearson", lambda: F.corr(F.col("x"), F.col("y")), 1, "Correlation.")
PRule = _simple(
    "PRule",
    lambda: (lambda a, b, n, s: F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(safe_div(a * (n - s), b * s), safe_div(b * s, a * (n - s)))))(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * (1 - F.col("y"))), F.count("x"), F.sum(F.col("y"))),
    1,
    "Mean score of the known group against the mean of others, as a ratio of at most 1.",
)
L2Disparity = _simple("L2Disparity", lambda: F.pow(safe_div(F.sum(F.col("x") * F.col("y")), F.avg(F.col("y"))) / F.count("x") - safe_div(F.sum(F.col("x") * (1 - F.col("y"))), 1 - F.avg(F.col("y"))) / F.count("x"), 2.0), -1, "Squared difference of the group's and others' means.")


class _Shares(Supervised):
    """Values are divided by their maxima first."""

    def of(self, rows):
        tops = rows.agg(F.max("x").alias("mx"), F.max("y").alias("my"))
        scaled = rows.join(tops, F.lit(True)).select("id", safe_div(F.col("x"), F.col("mx")).alias("x"), safe_div(F.col("y"), F.col("my")).alias("y"))  # one row of maxima
        return super().of(scaled)


class TPR(_Shares):
    """True positives over known positives."""

    def value(self):
        return safe_div(F.sum(F.col("x") * F.col("y")), F.sum(F.col("y")))


class TNR(_Shares):
    """True negatives over known negatives."""

    def value(self):
        return safe_div(F.sum((1 - F.col("x")) * (1 - F.col("y"))), F.sum(1 - F.col("y")))


class PPV(_Shares):
    """True positives over predicted ones."""

    def value(self):
        return safe_div(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x")))


class KLDivergence(Supervised):
    """Of the scores from known values; scores are normalized, both get an epsilon and are normalized again."""

    direction, scale = -1, staticmethod(lambda total, n: total)

    def of(self, rows):
        t = rows.agg(F.sum(F.abs("x")).alias("sx"), F.sum("y").alias("sy"), F.sum("x").alias("tx"), F.count("x").alias("n"))
        n = F.col("n")
        x = (safe_div(F.col("x"), F.col("sx")) + EPSILON) / (safe_div(F.col("tx"), F.col("sx")) + n * EPSILON)
        y = (F.col("y") + EPSILON) / (F.col("sy") + n * EPSILON)
        both = rows.join(t, F.lit(True))  # one row of totals
        return both.agg(self.scale(F.sum(x * F.ln(x / y)), F.max("n")).alias("value"))


class MKLDivergence(KLDivergence):
    """The negative of it, by node."""

    direction, scale = 1, staticmethod(lambda total, n: -total / n)


def mean_ranks(counts: DataFrame, column: str, as_: str, by: Sequence[str] = ()) -> DataFrame:
    """counts (by, column, n, ...), a row for each value with its number of rows, with the rank that these rows share, from 1 in each group."""
    order = running(counts, [*by, column], "n", "_before")
    if by:
        first = order.groupBy(*by).agg(F.min("_before").alias("_first"))
        order = order.join(first, list(by)).withColumn("_before", F.col("_before") - F.col("_first")).drop("_first")
    return order.withColumn(as_, F.col("_before") + (F.col("n") + 1) / 2).drop("_before")


def auc_by(rows: DataFrame, *by: str) -> DataFrame:
    """The area under the ROC curve of rows (by, x, y) in each group, null if known values are alike.

    Rows are counted by value first; groups of any size are in ranges of one order of (group, value).
    """
    y = (F.col("y") > 0).cast("double")
    counts = rows.groupBy(*by, "x").agg(F.count("x").alias("n"), F.sum(y).alias("y"))
    p, n = F.sum("y"), F.sum("n")
    area = safe_div(F.sum(F.col("rank") * F.col("y")) - p * (p + 1) / 2, p * (n - p))
    return mean_ranks(counts, "x", "rank", by).groupBy(*by).agg(F.when((p > 0) & (p < n), area).alias("value"))


def ndcg_by(rows: DataFrame, k: int | None, *by: str) -> DataFrame:
    """Discounted gain of the top k of rows (by, id, x, y) by x over that of the top k by y, in each group."""
    found = None
    for c, as_ in (("x", "a"), ("y", "b")):
        order = placed(rows, [*by, F.col(c).desc(), "id"])
        if by:
            first = order.groupBy(*by).agg((F.min("place") - 1).alias("_first"))
            order = order.join(first, list(by)).withColumn("place", F.col("place") - F.col("_first"))
        top = order if k is None else order.where(F.col("place") <= k)
        gain = top.groupBy(*by).agg(F.sum(F.col("y") / F.log2(F.col("place") + 1)).alias(as_))
        found = gain if found is None else found.join(gain, list(by) if by else F.lit(True))
    return found.select(*by, safe_div(F.col("a"), F.col("b")).alias("value"))


class AUC(Supervised):
    """Area under the ROC curve; known values above 0 are positives. Raises if all are alike."""

    def of(self, rows):
        return auc_by(rows)

    def __call__(self, scores):
        value = self.frame(scores).first()[0]
        if value is None:
            raise ValueError("known values are all alike")
        return float(value)


class MannWhitneyParity(AUC):
    """1 - 2 |0.5 - U / (n0 n1)| of the known group and the others."""

    def of(self, rows):
        return super().of(rows).select((1 - 2 * F.abs(0.5 - F.col("value"))).alias("value"))


class Spearman(Supervised):
    """Correlation of mean ranks."""

    def of(self, rows):
        pairs, ranks = rows.groupBy("x", "y").agg(F.count("x").alias("n")), {}
        for c in ("x", "y"):
            ranks[c] = mean_ranks(pairs.groupBy(c).agg(F.sum("n").alias("n")), c, f"r{c}").drop("n")
        ranked = pairs.join(ranks["x"], "x").join(ranks["y"], "y")
        n, a, b = F.col("n"), F.col("rx"), F.col("ry")
        total, sa, sb = F.sum(n), F.sum(n * a), F.sum(n * b)
        spread = F.sqrt((total * F.sum(n * a * a) - sa * sa) * (total * F.sum(n * b * b) - sb * sb))
        return ranked.agg(F.when(spread > 0, (total * F.sum(n * a * b) - sa * sb) / spread).alias("value"))


class NDCG(Supervised):
    """Discounted gain of the top k by score over that of the top k by known value; ties by id."""

    def __init__(self, known: Any = None, exclude: Any = None, k: int | None = None):
        super().__init__(known, exclude)
        self.k = k

    def of(self, rows):
        return ndcg_by(rows, self.k)


class Mistreatment(Measure):
    """1 - the difference of a measure inside and outside the sensitive group."""

    def __init__(self, known: Any, sensitive: Signal, exclude: Any = None, measure: type[Supervised] = AUC):
        self.known, self.sensitive, self.exclude, self.measure = known, sensitive, exclude, measure

    def __call__(self, scores):
        values = []
        for side in ("value <> 0", "value = 0"):
            m = self.measure(self.known, self.exclude)
            rows = m.rows(scores).join(_df(self.sensitive).where(side).select("id"), "id", "left_semi")
            values.append(float(m.of(rows).first()[0] or 0.0))
        return 1 - abs(values[0] - values[1])


class _OnGraph(Measure):
    """Of scores on the edges as they are."""

    def __init__(self, graph: Graph | None = None):
        self.graph = graph

    def flows(self, scores: DataFrame) -> DataFrame:
        """w (incoming weight), a (of it, by the sources' values) and b (its own value) of each node with edges; edges aren't shuffled by their second end."""
        graph, own = self.graph, scores.select("id", F.col("value").alias("b"))
        came = conv(graph.edges, scores.select("id", F.lit(1.0).alias("w_in"), F.col("value").alias("a")), "w_in", "a")
        return came.join(own, "id").select(F.col("w_in").alias("w"), "a", "b")

    def on(self, scores: Signal) -> _OnGraph:
        """The same measure for the graph of these scores, if it has none."""
        return self if self.graph is not None else self._with(graph=scores.graph)


class Conductance(_OnGraph):
    """External over internal edges, with scores as membership probabilities (over top)."""

    direction = -1

    def __init__(self, graph: Graph | None = None, top: float = 1.0, autofix: bool = False, cut_only: bool = False):
        super().__init__(graph)
        self.top, self.autofix, self.cut_only = top, autofix, cut_only

    def frame(self, scores):
        most = scores.max()
        if most > self.top:
            if not self.autofix:
                raise ValueError(f"scores must be at most {self.top}")
            scores = scores * (self.top / most)
        measure = self.on(scores)
        e = measure.flows(scores.df)
        w, a, b, m = F.col("w"), F.col("a"), F.col("b"), F.lit(float(self.top))
        inside, outside, cut, back = F.sum(a * b), F.sum((m * w - a) * (m - b)), F.sum(a * (m - b)), F.sum((m * w - a) * b)
        internal = inside if self.cut_only else F.least(inside, outside)
        directed = measure.graph.directed
        ext, int_ = (cut, internal) if directed else (cut + back, 2 * internal)
        out = e.agg(F.coalesce(ext, F.lit(0.0)).alias("e"), F.coalesce(int_, F.lit(0.0)).alias("i"))
        return out.select(F.when((F.col("e") == 0) | (F.col("i") == 0), float("inf")).otherwise(F.col("e") / F.col("i")).alias("value"))


class Density(_OnGraph):
    """Score-weighted edges over score-weighted pairs."""

    def frame(self, scores):
        e = self.on(scores).flows(scores.df).agg(F.sum(F.col("a") * F.col("b")).alias("i"))
        n = scores.df.agg((F.sum("value") * F.sum("value") - F.sum(F.col("value") * F.col("value"))).alias("n"))
        return e.join(n, F.lit(True)).select(safe_div(F.coalesce("i", F.lit(0.0)), F.col("n")).alias("value"))


class Modularity(_OnGraph):
    """Over all pairs in closed form: (edges' products - (sum of d x)^2 / 2m) / 2m, with 2m the sum of weights."""

    def __init__(self, graph: Graph | None = None, top: float = 1.0):
        super().__init__(graph)
        self.top = top

    def frame(self, scores):
        v = scores.df.select("id", (F.col("value") / self.top).alias("v"))
        t = self.on(scores).flows(v.withColumnRenamed("v", "value")).agg(F.sum(F.col("a") * F.col("b")).alias("i"), F.sum("a").alias("d"), F.sum("w").alias("m"))
        return t.select(F.coalesce(safe_div(F.col("i") - safe_div(F.col("d") * F.col("d"), F.col("m")), F.col("m")), F.lit(0.0)).alias("value"))


#: Fixed value: how sharp the smooth hinge is.
SHARPNESS = 30.0


def _hinge(x: float) -> float:
    """About max(x, 0)."""
    return max(x, 0.0) + math.log1p(math.exp(-abs(x) * SHARPNESS)) / SHARPNESS


class Combined(Measure):
    """Several measures, each clipped to its limits (0 to 1 unless given), with weights.

    smooth: clip by a smooth hinge, whose slope never jumps, in place of the corners.
    """

    def __init__(self, measures: Sequence[Measure] = (), weights: Sequence[float] | None = None, limits: Sequence[tuple[float, float]] | None = None, smooth: bool = False):
        self.smooth = smooth
        self.measures = list(measures)
        self.weights = [1.0] * len(self.measures) if weights is None else list(weights)
        self.limits = [(0.0, 1.0)] * len(self.measures) if limits is None else list(limits)

    def add(self, measure: Measure, weight: float = 1.0, least: float = -math.inf, most: float = math.inf) -> Combined:
        return type(self)([*self.measures, measure], [*self.weights, weight], [*self.limits, (least, most)], self.smooth)

    def clipped(self, x: float, least: float, most: float) -> float:
        if not self.smooth:
            return min(max(x, least), most)
        x = x if math.isinf(least) else least + _hinge(x - least)
        return x if math.isinf(most) else most - _hinge(most - x)

    def __call__(self, scores):
        return self.combine([self.clipped(m(scores), a, b) if w else 0.0 for m, w, (a, b) in zip(self.measures, self.weights, self.limits, strict=True)])

    def combine(self, values: list[float]) -> float:
        raise NotImplementedError


class AM(Combined):
    """Weighted mean."""

    def combine(self, values):
        return sum(w * v for w, v in zip(self.weights, values, strict=True)) / sum(map(abs, self.weights))


class GM(Combined):
    """Weighted geometric mean."""

    def combine(self, values):
        return math.exp(sum(w * math.log(max(EPSILON, v)) for w, v in zip(self.weights, values, strict=True) if w) / sum(map(abs, self.weights)))


class Disparity(Combined):
    """Absolute value of M1 - M2 + M3 - ..."""

    direction = -1

    def combine(self, values):
        return abs(sum((-1) ** i * w * v for i, (w, v) in enumerate(zip(self.weights, values, strict=True))))


class Parity(Disparity):
    """1 - disparity."""

    direction = 1

    def combine(self, values):
        return 1 - super().combine(values)


class OverGroups:
    """The mean of a measure over groups of scores; known (if given) by group too. For groups in a table of any number see by_group()."""

    def __init__(self, measure: Callable[..., Measure], known: dict[Any, Any] | None = None, exclude: dict[Any, Any] | None = None):
        self.measure, self.known, self.exclude = measure, known, exclude

    def __call__(self, scores: dict[Any, Signal]) -> float:
        exclude = self.exclude or {}
        values = [(self.measure() if self.known is None else self.measure(self.known[g], exclude.get(g)))(s) for g, s in scores.items()]
        return sum(values) / len(values)


def by_group(measure: Supervised, scores: DataFrame, known: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """group_id and value: a measure of all groups of scores (group_id, id, value) in one plan.

    known (group_id, id, value): 0 where there is no row; exclude (group_id, id): rows that are left out. Ranks are
    places in one order of (group, value), so no group is one task. The measure's own known values take no part.
    """
    rows = scores.select("group_id", "id", F.col("value").alias("x")).join(known.select("group_id", "id", F.col("value").alias("y")), ["group_id", "id"], "left").fillna(0.0, ["y"])
    if exclude is not None:
        rows = rows.join(exclude.select("group_id", "id"), ["group_id", "id"], "left_anti")
    if type(measure).of is Supervised.of:
        return rows.groupBy("group_id").agg(measure.value().alias("value"))
    if type(measure) is MannWhitneyParity:
        return auc_by(rows, "group_id").select("group_id", (1 - 2 * F.abs(0.5 - F.col("value"))).alias("value"))
    if type(measure) is AUC:
        return auc_by(rows, "group_id")
    if isinstance(measure, NDCG):
        return ndcg_by(rows, measure.k, "group_id")
    raise TypeError(f"{type(measure).__name__} has no form by group")


def similarities(pairs: DataFrame, scores: DataFrame, kind: str = "cos") -> DataFrame:
    """pairs (u, v) with the similarity of their rows of scores (group_id, id, value)."""
    if kind not in ("cos", "dot"):
        raise ValueError(f"no similarity {kind}")
    a = scores.select("group_id", F.col("id").alias("u"), F.col("value").alias("a"))
    b = scores.select("group_id", F.col("id").alias("v"), F.col("value").alias("b"))
    dots = pairs.select("u", "v").distinct().join(a, "u").join(b, ["group_id", "v"]).groupBy("u", "v").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    out = pairs.join(dots, ["u", "v"], "left").withColumn("similarity", F.coalesce("dot", F.lit(0.0)))
    if kind == "cos":
        size = scores.groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("n"))
        out = out.join(size.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u", "left").join(size.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v", "left")
        out = out.withColumn("similarity", F.coalesce(safe_div(F.col("similarity"), F.sqrt(F.col("nu") * F.col("nv"))), F.lit(0.0)))
    return out.select(*pairs.columns, "similarity")


class LinkAssessment:
    """AUC of the similarity of nodes within some hops against ``negatives`` nodes drawn by hash for each node."""

    def __init__(self, graph: Graph, similarity: str = "cos", hops: int = 1, negatives: int = 20, seed: int = 1):
        self.graph, self.similarity, self.hops, self.negatives, self.seed = graph, similarity, hops, negatives, seed

    def pairs(self) -> DataFrame:
        """u, v, y: linked pairs, and for each node others drawn by hash of their places."""
        near = self.graph.hops(self.hops).select(F.col("src").alias("u"), F.col("dst").alias("v"))
        numbered = written(placed(self.graph.nodes, [F.xxhash64("id"), "id"]).select("id", (F.col("place") - 1).alias("place")), "places")
        n = numbered.count()
        draws = numbered.select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(min(self.negatives, n)))).alias("i"))
        draws = draws.select("u", F.pmod(F.xxhash64("u", "i", F.lit(self.seed)), F.lit(n)).alias("place"))
        far = draws.join(numbered.select(F.col("id").alias("v"), "place"), "place").where("u <> v").select("u", "v")
        far = far.join(near, ["u", "v"], "left_anti")
        return near.withColumn("y", F.lit(1.0)).union(far.withColumn("y", F.lit(0.0)))

    def __call__(self, scores: DataFrame) -> float:
        rows = similarities(self.pairs(), scores, self.similarity)
        rows = rows.select(F.concat_ws("|", "u", "v").alias("id"), "y", F.col("similarity").alias("x"))
        return float(AUC().of(written(rows, "pairs")).first()[0])


def closed_wedges(neighbors: DataFrame) -> DataFrame:
    """One row with n: the ordered triples (v, u, t) with u and t neighbours of v and t one of u, for neighbors (id, neighbor) in any directions.

    Triangles of different nodes are found at their node of least degree, so a node with very many
    neighbours makes no pairs of them; the six orders of a triangle are then told by its directions.
    """
    arcs = neighbors.select(F.col("id").alias("s"), F.col("neighbor").alias("t")).distinct()
    loops, arcs = arcs.where("s = t").select("s"), arcs.where("s <> t")
    ahead = (F.col("s") < F.col("t")).cast("int")
    sides = written(arcs.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.max(ahead).alias("ab"), F.max(1 - ahead).alias("ba")), "sides")
    degree = sides.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("x").alias("d"))
    both = sides.join(degree.select(F.col("x").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("x").alias("b"), F.col("d").alias("db")), "b")
    low = F.struct("da", "a") < F.struct("db", "b")
    from_low = both.select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("y"), F.when(low, F.col("ab")).otherwise(F.col("ba")).alias("out"), F.when(low, F.col("ba")).otherwise(F.col("ab")).alias("back"))
    from_low = written(from_low, "oriented")
    one = from_low.select("x", F.col("y").alias("a"), F.col("out").alias("xa"), F.col("back").alias("ax"))
    two = from_low.select("x", F.col("y").alias("b"), F.col("out").alias("xb"), F.col("back").alias("bx"))
    triangles = one.join(two, "x").where("a < b").join(sides, ["a", "b"])
    c = F.col
    # v is each corner in turn: both arcs from it, and the third between the others in either direction
    orders = c("xa") * c("xb") * (c("ab") + c("ba")) + c("ax") * c("ab") * (c("xb") + c("bx")) + c("bx") * c("ba") * (c("xa") + c("ax"))
    looped = loops.select(F.col("s").alias("x"))
    into = arcs.join(looped.withColumnRenamed("x", "t"), "t")  # v -> u -> u
    out = arcs.join(looped.withColumnRenamed("x", "s"), "s")  # v -> v -> t
    mutual = out.join(arcs.select(F.col("s").alias("t"), F.col("t").alias("s")), ["s", "t"])  # v -> u -> v, with v -> v
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    parts = triangles.agg(F.coalesce(F.sum(orders), F.lit(0)).cast("long").alias("n"))
    for df in (into, out, mutual, looped):
        parts = parts.unionByName(count(df))
    return parts.agg(F.sum("n").alias("n"))


class ClusteringCoefficient:
    """Sum of similarities of pairs of neighbours of a node over how many such pairs are linked.

    The sum over pairs is the squared length of the sum of the neighbours' rows (of length 1 for
    cos), so pairs are never made.
    """

    def __init__(self, graph: Graph, similarity: str = "cos"):
        if similarity not in ("cos", "dot"):
            raise ValueError(f"no similarity {similarity}")
        self.graph, self.similarity = graph, similarity

    def frame(self, scores: DataFrame) -> DataFrame:
        n = self.graph.neighbors()
        rows = scores.select("group_id", F.col("id").alias("neighbor"), "value")
        if self.similarity == "cos":
            size = rows.groupBy("neighbor").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("size"))
            rows = rows.join(size, "neighbor").select("group_id", "neighbor", safe_div(F.col("value"), F.col("size")).alias("value"))
        sums = n.join(rows, "neighbor").groupBy("id", "group_id").agg(F.sum("value").alias("v"))
        a = sums.agg(F.sum(F.col("v") * F.col("v")).alias("a"))
        return a.join(closed_wedges(n), F.lit(True)).select(F.coalesce(safe_div(F.col("a"), F.col("n").cast("double")), F.lit(0.0)).alias("value"))

    def __call__(self, scores: DataFrame) -> float:
        return float(self.frame(scores).first()[0])


def split(groups: DataFrame, training: float = 0.8, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(training, test) rows of groups (group_id, id), in each group by hash order.

    training: 1 keeps all for both; above 1 is a number of nodes, 0 to 1 a share (rounded
    down), negative counts from the end.
    """
    if training == 1:
        return groups, groups
    order = Window.partitionBy("group_id").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    rows = groups.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("id").over(Window.partitionBy("group_id")))
    size = F.lit(int(training)) if training > 1 else F.col("_n") + int(training) if training <= -1 else F.floor(F.col("_n") * (training if training >= 0 else 1 + training))
    return rows.where(F.col("_i") <= size).drop("_i", "_n"), rows.where(F.col("_i") > size).drop("_i", "_n")
