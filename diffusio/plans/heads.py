"""A softmax head on propagated features: what a linear graph network learns.

Propagation is linear, so moving the scores that weights give is the same as giving weights to moved
features. Features are moved once; what is trained are the weights. A step is one job: each task
sums the gradient and loss of its rows over Arrow batches, Spark sums those of the tasks, and one
matrix of weights comes to the driver and goes back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffusio.graph import Graph
from diffusio.operators.filters import SLOTS, GraphFilter, rank_slots
from diffusio.session import written


def propagated(filter_: GraphFilter, graph: Graph, features: DataFrame) -> DataFrame:
    """features (id, features: array of one width) of all nodes, moved by a filter; nodes without them have 0."""
    rows = written(features.select("id", F.col("features").cast("array<double>").alias("features")), "features")
    width = rows.agg(F.max(F.size("features"))).first()[0] or 0
    parts = None
    for at in range(0, width, SLOTS):
        n = min(SLOTS, width - at)
        out, _ = rank_slots([filter_] * n, graph, rows.select("id", F.slice("features", at + 1, n).alias("p")))
        out = out.select("id", F.lit(at).alias("at"), "value")
        parts = out if parts is None else parts.unionByName(out)
    if parts is None:
        return graph.nodes.select("id", F.array().cast("array<double>").alias("features"))
    joined = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]))
    return written(parts.groupBy("id").agg(joined.alias("features")), "moved")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradient(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Summed gradient and loss of cross entropy for rows x (with a last column of ones) of classes y."""
    p = softmax(x @ w)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    p[np.arange(len(y)), y] -= 1
    return x.T @ p, float(loss)


@dataclass(frozen=True)
class SoftmaxHead:
    """Weights (width + 1, classes) fitted by Adam on all rows a step.

    rate, decay (L2), epochs: as usual. patience: so many steps without a lower loss on the validation rows end
    training, and the best weights stay.
    """

    rate: float = 0.1
    decay: float = 1e-4
    epochs: int = 60
    patience: int = 10
    classes: tuple[Any, ...] = ()
    weights: np.ndarray | None = field(default=None, compare=False)

    def fit(self, rows: DataFrame, validation: DataFrame | None = None) -> SoftmaxHead:
        """rows (features, label) to learn from; labels are few and come to the driver, in order."""
        classes = tuple(r[0] for r in rows.select("label").where("label IS NOT NULL").distinct().orderBy("label").collect())
        if not classes:
            raise ValueError("no labels to learn from")
        number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
        sets = [written(df.where(F.col("label").isin(list(classes))).select("features", number.cast("int").alias("y")), "rows") for df in ([rows] if validation is None else [rows, validation])]
        width = sets[0].agg(F.max(F.size("features"))).first()[0]
        w = np.zeros((width + 1, len(classes)))
        m, v, best, least, left = np.zeros_like(w), np.zeros_like(w), w, float("inf"), self.patience
        for t in range(1, self.epochs + 1):
            g, loss, n = _summed(sets[0], w)
            if validation is not None:
                _, loss, seen = _summed(sets[1], w)
                loss /= max(1, seen)
            else:
                loss /= n
            if loss < least:
                best, least, left = w, loss, self.patience
            else:
                left -= 1
                if not left:
                    break
            g = g / n + self.decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return replace(self, classes=classes, weights=best)

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows (id, features, ...) with label, that of the highest score."""
        sent, classes = rows.sparkSession.sparkContext.broadcast(self.weights), self.classes

        @F.arrow_udf("int")
        def best(features: pa.Array) -> pa.Array:
            if not len(features):
                return pa.array([], pa.int32())
            x = _matrix(features, len(sent.value) - 1)
            return pa.array(np.argmax(x @ sent.value, axis=1).astype(np.int32))

        return rows.withColumn("label", F.array(*[F.lit(c) for c in classes])[best("features")])


def _matrix(features: pa.Array, width: int) -> np.ndarray:
    """Rows of features with a one behind each."""
    x = features.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(features), width)
    return np.hstack([x, np.ones((len(x), 1))])


def _summed(rows: DataFrame, w: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Gradient, loss and number of rows (features, y), summed by tasks and then by place."""
    sent = rows.sparkSession.sparkContext.broadcast(w)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = np.zeros_like(sent.value), 0.0, 0
        for b in batches:
            if b.num_rows:
                g, lost = gradient(_matrix(b.column("features"), len(sent.value) - 1), b.column("y").to_numpy(), sent.value)
                total, loss, n = total + g, loss + lost, n + b.num_rows
        if n:
            flat = np.concatenate([total.ravel(), [loss, n]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["place", "v"])

    found = np.zeros(w.size + 2)
    for r in rows.mapInArrow(of_task, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():  # as many as weights
        found[r["place"]] = r["v"]
    return found[:-2].reshape(w.shape), float(found[-2]), int(found[-1])
