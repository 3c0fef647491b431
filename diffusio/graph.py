"""Graphs and signals as DataFrames.

A graph is a table of edges (src, dst, w) with its nodes (id); an undirected graph holds
both directions of each edge. A signal is a table (id, value) with one row per node. Nothing
but scalars comes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from diffusio.functions.math import safe_div
from diffusio.session import outside, written

#: Targets of a block of edge_matrix.
BLOCK = 128


class Graph:
    """Nodes and edges, with the operations of a graph store. All of them return new graphs.

    Parallel edges add up when weights are read; degrees and neighbours count distinct ones.
    """

    def __init__(self, edges: DataFrame, directed: bool = False, nodes: DataFrame | None = None, known: dict[Any, Any] | None = None):
        """known: what stored() has found out; nodes are unique then."""
        self.edges, self.directed, self._made = edges.select("src", "dst", F.col("w").cast("double").alias("w")), directed, dict(known or {})
        #: Whether each edge is known to have its like in the other direction.
        self.symmetric = False
        if known is not None:
            self.nodes, self._given = nodes, True
            return
        ends = self.edges.select(F.col("src").alias("id")).union(self.edges.select(F.col("dst").alias("id"))).distinct()
        self.nodes = ends if nodes is None else nodes.select("id").distinct()
        self._given = nodes is not None

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def from_edges(cls, pairs: DataFrame, directed: bool = False, weight: str | None = None, nodes: DataFrame | None = None) -> Graph:
        """From a table whose first two columns are the ends; undirected pairs get both directions (self-loops too)."""
        a, b = pairs.columns[:2]
        w = F.col(weight).cast("double") if weight else F.lit(1.0)
        edges = pairs.select(F.col(a).cast("string").alias("src"), F.col(b).cast("string").alias("dst"), w.alias("w"))
        if not directed:  # both in one pass over pairs
            edges = edges.selectExpr("inline(array(struct(src, dst, w), struct(dst AS src, src AS dst, w)))")
        out = cls(edges, directed, nodes)
        out.symmetric = not directed
        return out

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: Iterable[tuple], directed: bool = False) -> Graph:
        rows = [(str(p[0]), str(p[1]), float(p[2]) if len(p) > 2 else 1.0) for p in pairs]
        return cls.from_edges(spark.createDataFrame(rows, "a string, b string, w double"), directed, "w")

    def stored(self, summed: bool = False) -> Graph:
        """The same graph as written tables, with parallel edges added up. summed: there are none, so edges aren't shuffled for it."""
        edges = written(self.edges if summed else self.edges.groupBy("src", "dst").agg(F.sum("w").alias("w")), "edges")
        zero, seen = F.lit(0.0).alias("w"), Observation()
        ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("n"), "w")
        if not self.symmetric:  # else all targets are sources
            ends = ends.union(edges.select("dst", F.lit(0), zero))
        if self._given:
            ends = ends.union(self.nodes.select("id", F.lit(0), zero))
        counted = ends.groupBy("id").agg(F.sum("n").alias("n"), F.sum("w").alias("d")).observe(seen, F.max("n").alias("most"), F.count("id").alias("size"))
        degrees = written(counted.select("id", "d"), "nodes")
        known = {"most": seen.get["most"] or 0, "size": seen.get["size"], "degrees": degrees, "summed": True}
        out = Graph(edges, self.directed, degrees.select("id"), known=known)
        out.symmetric = self.symmetric
        return out

    def add_edges(self, pairs: DataFrame) -> Graph:
        """Edges that are there already are not added again."""
        more = Graph.from_edges(pairs, self.directed, "w" if "w" in pairs.columns else None)
        new = more.edges.join(self.edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
        return Graph(self.edges.union(new.select("src", "dst", "w")), self.directed, self.nodes.union(more.nodes))

    def add_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(self.edges, self.directed, self.nodes.union(nodes.select(F.col(nodes.columns[0]).cast("string").alias("id"))))

    def remove_edges(self, pairs: DataFrame) -> Graph:
        """Without these edges (both directions if undirected); nodes stay."""
        gone = Graph.from_edges(pairs, self.directed).edges.select("src", "dst").distinct()
        return Graph(self.edges.join(gone, ["src", "dst"], "left_anti").select("src", "dst", "w"), self.directed, self.nodes)

    def subgraph(self, nodes: DataFrame) -> Graph:
        """The graph induced by nodes (id)."""
        kept = self.nodes.join(nodes.select("id").distinct(), "id", "left_semi")
        src, dst = kept.select(F.col("id").alias("src")), kept.select(F.col("id").alias("dst"))
        return Graph(self.edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi").select("src", "dst", "w"), self.directed, kept)

    def remove_intra_edges(self, groups: DataFrame) -> Graph:
        """Without edges whose ends share a group of groups (group_id, id)."""
        a = groups.select("group_id", F.col("id").alias("src"))
        b = groups.select("group_id", F.col("id").alias("dst"))
        inside = self.edges.select("src", "dst").distinct().join(a, "src").join(b, ["group_id", "dst"]).select("src", "dst").distinct()
        return Graph(self.edges.join(inside, ["src", "dst"], "left_anti").select("src", "dst", "w"), self.directed, self.nodes)

    def neighbors(self) -> DataFrame:
        """id and neighbor, each pair once."""
        pairs = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("neighbor"))
        return pairs if self._made.get("summed") else pairs.distinct()

    def degrees(self) -> DataFrame:
        """id and degree (distinct neighbours), 0 for isolated nodes."""
        n = self.neighbors().groupBy("id").agg(F.count("neighbor").alias("degree"))
        return self.nodes.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) with has_edge."""
        there = self.edges.select("src", "dst", F.lit(True).alias("there")).distinct()
        return pairs.join(there, ["src", "dst"], "left").select("src", "dst", F.coalesce("there", F.lit(False)).alias("has_edge"))

    def edge_matrix(self, sources: DataFrame, targets: DataFrame) -> DataFrame:
        """has_edge of every pair of sources (src) and targets (dst); repeated ones and nulls make pairs too.

        Targets are dealt into blocks, and what is shuffled are sources by block, with their neighbours there: one row
        for BLOCK pairs. Pairs are made last.
        """
        n = max(1, math.ceil(targets.count() / BLOCK))
        block = F.expr(f"pmod(xxhash64(dst), {n}L)").alias("block")
        blocks = targets.groupBy(block).agg(F.collect_list(F.struct("dst")).alias("members"))
        there = self.edges.groupBy("src", block).agg(F.collect_set("dst").alias("there"))
        rows = sources.select("src", F.explode(F.expr(f"sequence(0L, {n - 1}L)")).alias("block"))
        pairs = rows.join(there, ["src", "block"], "left").join(blocks, "block").select("src", "there", F.explode("members").alias("m"))
        return pairs.select("src", "m.dst", F.coalesce(F.array_contains("there", F.col("m.dst")), F.lit(False)).alias("has_edge"))

    def number_of_nodes(self) -> int:
        return self.nodes.count()

    def number_of_edges(self) -> int:
        """Edges of the store; an undirected edge counts once."""
        n = self.edges.count()
        return n if self.directed else n // 2

    def hops(self, n: int) -> DataFrame:
        """src and dst up to n steps apart, without the node itself."""
        one = self.edges.select("src", "dst").distinct()
        reach, last = one, one
        for _ in range(n - 1):
            last = last.join(one.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst")).distinct()
            reach = reach.union(last).distinct()
        return reach.where("src <> dst")

    def most_edges(self) -> int:
        """The most edges of a source."""
        return self.remembered("most", lambda: self.edges.groupBy("src").agg(F.count("dst").alias("n")).agg(F.max("n")).first()[0] or 0)

    def summed(self) -> DataFrame:
        """Edges with parallel ones added up."""
        return self.edges if self._made.get("summed") else self.edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))

    def known_degrees(self) -> DataFrame | None:
        """Sums of weights of sources (id, d), if stored() has made them."""
        return self._made.get("degrees")

    def known_size(self) -> float:
        """Nodes as stored() has counted them, else infinity."""
        return self._made.get("size", math.inf)

    def remembered(self, key: Any, make: Callable[[], Any]) -> Any:
        """What make() gives, kept under a key for the life of this object, whatever scope it is made in."""
        if key not in self._made:
            with outside():
                self._made[key] = make()
        return self._made[key]


class Signal:
    """Values of all nodes of a graph: df (id, value). Arithmetic is by node."""

    def __init__(self, graph: Graph, df: DataFrame):
        self.graph, self.df = graph, df.select("id", F.col("value").cast("double").alias("value"))
        #: Of what a filter returns: the iteration at which it stopped.
        self.iterations: int | None = None

    @classmethod
    def of(cls, graph: Graph, values: Any = None) -> Signal:
        """A signal from None (ones), a number, a signal of the same graph, a table (id[, value]), a dict or a list of nodes.

        Nodes that aren't named have 0; a dict's unknown node is an error, and so is another graph's signal.
        """
        if isinstance(values, Signal):
            if values.graph is not graph:
                raise ValueError("the signal is of another graph")
            return values
        if values is None or isinstance(values, (int, float)):
            return cls(graph, graph.nodes.withColumn("value", F.lit(1.0 if values is None else float(values))))
        if isinstance(values, dict) or not isinstance(values, DataFrame):
            rows = [(str(k), float(v)) for k, v in values.items()] if isinstance(values, dict) else [(str(k), 1.0) for k in values]
            values = graph.spark.createDataFrame(rows, "id string, value double")
            if (missing := values.join(graph.nodes, "id", "left_anti").first()) is not None:
                raise KeyError(missing["id"])
        if "value" not in values.columns:
            values = values.select("id").distinct().withColumn("value", F.lit(1.0))
        some = graph.nodes.join(values.select("id", "value"), "id", "left")
        return cls(graph, some.select("id", F.coalesce("value", F.lit(0.0)).alias("value")))

    def stored(self) -> Signal:
        return Signal(self.graph, written(self.df, "signal"))

    def map(self, f: Callable[[Column], Column]) -> Signal:
        return Signal(self.graph, self.df.select("id", f(F.col("value")).alias("value")))

    def zip(self, other: Any, f: Callable[[Column, Column], Column]) -> Signal:
        """Combined by node with another signal of the same graph, or with a number."""
        if isinstance(other, (int, float)):
            return self.map(lambda x: f(x, F.lit(float(other))))
        other = Signal.of(self.graph, other)
        both = self.df.join(other.df.select("id", F.col("value").alias("other")), "id")
        return Signal(self.graph, both.select("id", f(F.col("value"), F.col("other")).alias("value")))

    def aggregate(self, *columns: Column) -> Any:
        return self.df.agg(*columns).first()

    def sum(self) -> float:
        return float(self.aggregate(F.sum("value"))[0] or 0.0)

    def norm(self) -> float:
        return float(self.aggregate(F.sum(F.abs("value")))[0] or 0.0)

    def max(self) -> float:
        return float(self.aggregate(F.max("value"))[0] or 0.0)

    def normalized(self) -> Signal:
        """Divided by the sum of absolute values; unchanged if that is 0."""
        n = self.norm()
        return self / n if n else self

    def filter(self, exclude: Signal) -> DataFrame:
        """Rows of nodes that exclude has at 0."""
        return self.df.join(exclude.df.where("value = 0").select("id"), "id", "left_semi")

    def to_dict(self) -> dict[str, float]:
        """For small graphs."""
        return {r["id"]: r["value"] for r in self.df.collect()}

    def __getitem__(self, node: Any) -> float:
        row = self.df.where(F.col("id") == str(node)).first()
        if row is None:
            raise KeyError(node)
        return row["value"]

    def __add__(self, x):
        return self.zip(x, lambda a, b: a + b)

    def __sub__(self, x):
        return self.zip(x, lambda a, b: a - b)

    def __mul__(self, x):
        return self.zip(x, lambda a, b: a * b)

    def __truediv__(self, x):
        return self.zip(x, safe_div)

    def __pow__(self, x):
        return self.zip(x, lambda a, b: F.pow(a, b))

    def __rsub__(self, x):
        return self.zip(x, lambda a, b: b - a)

    def __rtruediv__(self, x):
        return self.zip(x, lambda a, b: safe_div(b, a))

    def __neg__(self):
        return self.map(lambda a: -a)

    def __pos__(self):
        return self

    __radd__, __rmul__ = __add__, __mul__

    def __rshift__(self, ranker):
        return ranker(self.graph, self)
