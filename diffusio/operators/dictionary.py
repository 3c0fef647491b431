"""Nodes as numbers: a dictionary of names, and rankers that run on numbers.

Names are numbered from 0 in their order; names that come later get the numbers after those, so numbers
stay as they are when edges are added. Edges and states then carry 8 bytes a node, and names are
joined back once, to the result.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F

from diffusio.functions.order import placed
from diffusio.graph import Graph, Signal
from diffusio.plans.ranker import Ranker
from diffusio.session import written


class Dictionary:
    """names: id and number, each number from 0 to size - 1 once."""

    def __init__(self, names: DataFrame, size: int):
        self.names, self.size = names, size

    @classmethod
    def of(cls, nodes: DataFrame) -> Dictionary:
        """Of nodes (id), in the order of their names."""
        empty = nodes.select("id").limit(0).withColumn("number", F.lit(0).cast("long"))
        return cls(empty, 0).extended(nodes)

    def extended(self, nodes: DataFrame) -> Dictionary:
        """With further nodes (id), those that are known left as they are."""
        new = nodes.select("id").distinct()
        new = new if not self.size else new.join(self.names, "id", "left_anti")
        new = placed(new, ["id"], "number").select("id", (F.col("number") - 1 + self.size).cast("long").alias("number"))
        names = written(self.names.unionByName(new) if self.size else new, "names")
        return Dictionary(names, names.count())

    def encoded(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows with the numbers in place of the names of some columns; rows with unknown names go."""
        for c in columns:
            rows = rows.join(self.names.select(F.col("id").alias(c), F.col("number").alias("_number")), c).drop(c).withColumnRenamed("_number", c)
        return rows

    def decoded(self, rows: DataFrame, column: str = "id") -> DataFrame:
        """rows with the names in place of the numbers of a column."""
        return rows.join(self.names.select(F.col("id").alias("_name"), F.col("number").alias(column)), column).drop(column).withColumnRenamed("_name", column)

    def graph(self, graph: Graph) -> Graph:
        """The graph on numbers, written."""
        edges = self.encoded(graph.edges, "src", "dst").select("src", "dst", "w")
        return Graph(written(edges, "edges"), graph.directed, written(self.encoded(graph.nodes, "id"), "nodes"))


class OnNumbers(Ranker):
    """A ranker that runs on numbers: the graph is encoded once (for the life of the graph) and the result decoded once.

    dictionary: one that is kept elsewhere; the graph's own if None. Further inputs are encoded too if they are signals or tables.
    """

    def __init__(self, base: Ranker, dictionary: Dictionary | None = None):
        self.base, self.dictionary = base, dictionary

    def encoded(self, graph: Graph) -> tuple[Dictionary, Graph]:
        def made() -> tuple[Dictionary, Graph]:
            names = self.dictionary or Dictionary.of(graph.nodes)
            return names, names.graph(graph)

        return graph.remembered(("numbers", id(self.dictionary)), made)

    def rank(self, graph, signal=None, **more):
        self.checked(more)
        names, numbers = self.encoded(graph)

        def inner(x: Any) -> Signal:
            return Signal(numbers, names.encoded(Signal.of(graph, x).df, "id").select("id", "value"))

        out = self.base.passed(numbers, inner(signal), {k: inner(v) for k, v in more.items()})
        found = Signal(graph, names.decoded(out.df))
        found.iterations = out.iterations
        return found
