"""Normalized adjacency: edge weights from degrees."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from diffusio.functions.math import Adjacency, conv, safe_inv
from diffusio.graph import Graph, Signal
from diffusio.session import Steps, bucketed, written

#: How many edges of one source may be in one bucket.
HUB = 1_000_000
#: Up to so many nodes, degrees are sent to all edges; with more of them edges are shuffled by target.
SENT = 1_000_000
Edges = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Normalization:
    """How edges are weighted before diffusion.

    kind: auto (col if directed, else symmetric), col (by the source's degree), symmetric,
    both, laplacian, none, or a function of the edges. renormalize: weight of self-loops
    added first. transform: a function of the weighted edges. reduction: a function from
    edges to degrees (id, d); sums of weights if None.
    """

    kind: str | Edges = "auto"
    renormalize: float = 0.0
    transform: Edges | None = None
    reduction: Edges | None = None

    def edges(self, graph: Graph) -> DataFrame:
        """src, dst, w, written once for the graph."""
        return self.adjacency(graph).plain

    def adjacency(self, graph: Graph) -> Adjacency:
        """The same edges in buckets by source, so that a step doesn't shuffle them."""
        return graph.remembered(self, lambda: self.stored(*self._made(graph)))

    @staticmethod
    def stored(edges: DataFrame, graph: Graph, dealt: bool = False) -> Adjacency:
        """Edges of a graph written in buckets. Sources with more than HUB edges in the graph are dealt into parts before. dealt: edges lie by source already."""
        if graph.most_edges() <= HUB:
            return Adjacency(*bucketed(edges, "adjacency", "src", dealt=dealt))
        parts = F.ceil(F.count("dst") / HUB).cast("int")
        hubs = graph.remembered("hubs", lambda: written(graph.edges.groupBy("src").agg(parts.alias("parts")).where("parts > 1"), "hubs"))
        part = F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int")
        dealt = bucketed(edges.join(F.broadcast(hubs), "src", "left").withColumn("part", part).drop("parts"), "adjacency", "src", "part")
        return Adjacency(dealt.rows, dealt.plain.drop("part"), hubs)

    def _made(self, graph: Graph) -> tuple[DataFrame, Graph, bool]:
        """The weighted edges, the graph, and whether the edges are dealt by source."""
        e, dealt = graph.summed(), False
        loops = graph.nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"))
        if self.renormalize:
            e = e.union(loops.withColumn("w", F.lit(float(self.renormalize)))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        kind = ("col" if graph.directed else "symmetric") if self.kind == "auto" else self.kind
        if callable(kind):
            e = kind(e)
        elif kind != "none":
            if kind not in ("col", "symmetric", "both", "laplacian"):
                raise ValueError(f"no normalization {kind}")
            degrees = self.reduction or (lambda x: x.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")))
            known = None if self.renormalize or self.reduction else graph.known_degrees()
            if known is not None and (kind == "col" or graph.symmetric):
                e, dealt = self._joined(e, graph, known, kind), True
            else:
                out = degrees(e).select(F.col("id").alias("src"), F.col("d").alias("d_out"))
                e = e.join(out, "src", "left")
            if kind == "col":
                e = e.select("src", "dst", (F.col("w") * safe_inv(F.col("d_out"))).alias("w"))
            else:
                if not dealt:
                    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
                    e = e.join(degrees(back).select(F.col("id").alias("dst"), F.col("d").alias("d_in")), "dst", "left")
                a, b = (F.col(c) if kind == "both" else F.sqrt(c) for c in ("d_out", "d_in"))
                e = e.select("src", "dst", (F.col("w") * safe_inv(a) * safe_inv(b)).alias("w"))
                if kind == "laplacian":
                    dealt = False
                    e = e.select("src", "dst", (-F.col("w")).alias("w")).union(loops.withColumn("w", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("w").alias("w"))
        return (self.transform(e), graph, False) if self.transform else (e, graph, dealt)

    @staticmethod
    def _joined(e: DataFrame, graph: Graph, known: DataFrame, kind: str) -> DataFrame:
        """Edges with d_out (and d_in but for col) of a graph whose degrees are known, shuffled last by source, as their buckets are."""
        if kind != "col":
            back = known.select(F.col("id").alias("dst"), F.col("d").alias("d_in"))
            e = e.join(F.broadcast(back) if graph.known_size() <= SENT else back, "dst", "left")
        n = int(graph.spark.conf.get("spark.sql.shuffle.partitions"))
        return e.repartition(n, "src").join(known.select(F.col("id").alias("src"), F.col("d").alias("d_out")).hint("shuffle_hash"), "src", "left")


def eigdegree(graph: Graph, tol: float = 1e-16, max_iters: int = 1000) -> DataFrame:
    """Degrees (id, d) by power iteration: the eigenvalue over the squared eigenvector."""
    e = graph.remembered("raw", lambda: Normalization("none").adjacency(graph))
    v, last, states = graph.nodes.withColumn("v", F.lit(1.0)), float("inf"), Steps()
    norm = float(graph.number_of_nodes()) ** 0.5
    for _ in range(max_iters):
        moved = conv(e, v.select("id", (F.col("v") / norm).alias("v")), "v")
        v, seen = states.written(graph.nodes.join(moved, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("v")), "eigenvector", value=F.sqrt(F.sum(F.col("v") * F.col("v"))))
        value = seen["value"]
        if not value or abs(value - last) <= max(tol, 1e-12):
            break
        last = norm = value
    return v.select("id", F.when(F.col("v") == 0, 0.0).otherwise(F.lit(value) * value * value / (F.col("v") * F.col("v"))).alias("d"))


def as_signal(graph: Graph, degrees: DataFrame) -> Signal:
    return Signal(graph, degrees.select("id", F.col("d").alias("value")))
