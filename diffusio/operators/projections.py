"""Random projections of nodes: similarity by moved embeddings, and links from it.

Each node gets a very sparse vector of +-1, scaled by its degree. Moved along the edges and weighted by
the number of steps, the vectors' products with a node's own vector estimate weighted counts of
walks. No pair of nodes is made: scores of a signal come from one vector, and the best links of given
nodes from blocks of their vectors against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.graph import Graph, Signal
from diffusio.operators.filters import SLOTS, GenericFilter, rank_slots
from diffusio.operators.normalize import Normalization
from diffusio.plans.ranker import Ranker
from diffusio.operators.postprocess import Postprocessor
from diffusio.session import written

#: Bytes of query vectors that are sent out at once.
BLOCK_BYTES = 1 << 25


def drawn(node: Column, place: Column, sparsity: float, seed: int) -> Column:
    """1, -1 or (with probability 1 - 1/sparsity) 0, by a hash of node, place and seed."""
    h = F.pmod(F.xxhash64(node, place, F.lit(seed)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    return F.when(h < 0.5 / sparsity, 1.0).when(h < 1.0 / sparsity, -1.0).otherwise(0.0)


class CoSimRank(Postprocessor):
    """Scores by products with moved random projections: the sum over k of weights[k - 1] times E0(signal) . Ek(node).

    dims: numbers of a projection. sparsity: one place in so many isn't 0; half the root of the sum
    of degrees if None. beta: the power of a node's degree (over the highest) that scales its vector.
    """

    def __init__(self, base: Ranker | None = None, weights: Sequence[float] = (1.0, 0.5, 0.25), dims: int = 1024, sparsity: float | None = None, beta: float = 1.0, normalization: Normalization | str = "symmetric", seed: int = 0):
        self.base, self.weights, self.dims, self.sparsity, self.beta, self.seed = base, tuple(weights), dims, sparsity, beta, seed
        self.normalization = normalization if isinstance(normalization, Normalization) else Normalization(normalization)

    def _key(self) -> tuple:
        return ("projections", self.weights, self.dims, self.sparsity, self.beta, self.normalization, self.seed)

    def projections(self, graph: Graph) -> DataFrame:
        """id, own (the projection) and moved (the weighted sum of what 1, 2, ... steps make of it), kept for the graph."""
        return graph.remembered(self._key(), lambda: self._made(graph))

    def drawn(self, graph: Graph) -> DataFrame:
        """id, at and x: the places of projections that aren't 0, kept for the graph."""
        return graph.remembered(("drawn", self.dims, self.sparsity, self.beta, self.seed), lambda: self._drawn(graph))

    def _drawn(self, graph: Graph) -> DataFrame:
        degree = graph.known_degrees()
        if degree is None:
            degree = written(graph.nodes.join(graph.edges.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "id", "left").fillna(0.0, ["d"]), "degrees")
        top, total = degree.agg(F.max("d"), F.sum("d")).first()
        sparsity = max(1.0, (total or 0.0) ** 0.5 / 2 if self.sparsity is None else float(self.sparsity))
        scale = F.pow(F.col("d") / (top or 1.0), F.lit(float(self.beta)))
        places = degree.select("id", scale.alias("scale"), F.explode(F.sequence(F.lit(0), F.lit(self.dims - 1))).alias("at"))
        return written(places.withColumn("x", drawn(F.col("id"), F.col("at"), sparsity, self.seed)).where("x <> 0").select("id", "at", (F.col("x") * F.col("scale")).alias("x")), "drawn")

    def _walk(self) -> GenericFilter:
        return GenericFilter((0.0, *self.weights), normalization=self.normalization, error="iters", max_iters=len(self.weights) + 2)

    def _made(self, graph: Graph) -> DataFrame:
        cells = self.drawn(graph).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
        own = F.transform(F.sequence(F.lit(0), F.lit(self.dims - 1)), lambda j: F.coalesce(F.try_element_at("m", j), F.lit(0.0)))
        state = written(graph.nodes.join(cells, "id", "left").select("id", own.alias("own")), "projections")
        parts = None
        for at in range(0, self.dims, SLOTS):  # so many numbers a state
            n = min(SLOTS, self.dims - at)
            out, _ = rank_slots([self._walk()] * n, graph, state.select("id", F.slice("own", at + 1, n).alias("p")))
            out = out.select("id", F.lit(at).alias("at"), "value")
            parts = out if parts is None else parts.unionByName(out)
        rows = parts.groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])).alias("moved"))
        return written(state.join(rows, "id"), "projections")

    def transform(self, signal: Signal, **more: Any) -> Signal:
        """Products with one vector are moved in place of vectors: the product of what a walk makes of the nodes' vectors is what it makes of their products."""
        graph, cells = signal.graph, self.drawn(signal.graph)
        on = cells.join(signal.df.where("value <> 0"), "id").groupBy("at").agg(F.sum(F.col("x") * F.col("value")).alias("v"))
        on = written(on, "on")  # dims rows
        dots = cells.join(F.broadcast(on), "at").groupBy("id").agg(F.sum(F.col("x") * F.col("v")).alias("value"))
        return self._walk().rank(graph, dots)

    def links(self, graph: Graph, queries: DataFrame, k: int = 10) -> DataFrame:
        """For each node of queries (id) the k others with the highest scores that it isn't linked to: src, dst, score, place.

        Exact for the projections: blocks of query vectors go to all rows, and each task keeps the best of its
        rows, with as many more as the node has links, which are then taken out.
        """
        rows = self.projections(graph)
        linked = written(graph.edges.select("src", "dst").distinct().join(queries.select(F.col("id").alias("src")).distinct(), "src", "left_semi"), "linked")
        asked = queries.select("id").distinct().join(rows.select("id", "own"), "id").join(linked.groupBy(F.col("src").alias("id")).agg(F.count("dst").alias("n")), "id", "left")
        asked = written(asked.select("id", "own", (F.coalesce("n", F.lit(0)) + k + 1).alias("most")).orderBy("id"), "queries")
        per = max(1, BLOCK_BYTES // (8 * self.dims + 64))
        found, block = None, []
        for row in [*asked.toLocalIterator(), None]:
            if row is not None:
                block.append((row["id"], row["own"], row["most"]))
            if block and (row is None or len(block) == per):
                best = written(_best(rows, block, self.dims), "best")
                found, block = best if found is None else found.unionByName(best), []
        if found is None:
            return graph.spark.createDataFrame([], "src string, dst string, score double, place int")
        left = found.where("src <> dst").join(linked, ["src", "dst"], "left_anti")
        place = F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "dst"))
        return left.withColumn("place", place).where(F.col("place") <= k)


def _best(rows: DataFrame, block: list[tuple[str, list[float], int]], dims: int) -> DataFrame:
    """src, dst, score: of each batch of rows the best for each query of a block, ties included by id."""
    names, most = [b[0] for b in block], np.array([b[2] for b in block])
    sent = rows.sparkSession.sparkContext.broadcast(np.array([b[1] for b in block], dtype=np.float64).reshape(len(block), dims))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in batches:
            ids = np.array(b.column("id").to_pylist(), dtype=object)
            order = np.argsort(ids.astype(str), kind="stable")  # ties go by id
            vectors = b.column("moved").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), dims)[order]
            ids = ids[order]
            src, dst, score = [], [], []
            for at in range(0, len(q), 256):
                dots = q[at : at + 256] @ vectors.T
                for i, d in enumerate(dots):
                    n = min(int(most[at + i]), len(d))
                    keep = np.argsort(-d, kind="stable")[:n]
                    src.extend([names[at + i]] * n)
                    dst.extend(ids[keep])
                    score.extend(d[keep])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string()), pa.array(score, pa.float64())], names=["src", "dst", "score"])

    return rows.select("id", "moved").mapInArrow(best, "src string, dst string, score double")
