"""Ranking over a stream of edges (an extension): each batch adds edges, and ranking starts from the last scores.

New edges and scores are tables by batch number in a folder beside the stream's checkpoint.
A batch reads what the batches before it have left there, so that a restarted stream goes on
with all edges, and a batch that runs twice replaces its own tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from diffusio.graph import Graph, Signal
from diffusio.plans.ranker import Ranker
from diffusio.session import deleted, exists


class StreamRanker:
    """Keeps the graph so far and its scores in a folder; ``sink`` gets (scores, batch number) after each batch."""

    def __init__(self, ranker: Ranker, seeds: Callable[[Graph], Signal], directed: bool = False, sink: Callable[[DataFrame, int], None] | None = None, folder: str | None = None):
        self.ranker, self.seeds, self.directed, self.sink, self.folder = ranker, seeds, directed, sink, folder

    def _before(self, spark: SparkSession, name: str, batch: int | None) -> DataFrame | None:
        """The tables of a name of all batches, or of those before one."""
        if not exists(spark, f"{self.folder}/{name}"):
            return None
        kind = "src string, dst string, w double" if name == "edges" else "id string, value double"
        rows = spark.read.schema(f"{kind}, batch long").parquet(f"{self.folder}/{name}")
        return rows if batch is None else rows.where(F.col("batch") < batch)

    def graph(self, spark: SparkSession, batch: int | None = None) -> Graph | None:
        """The graph of all batches, or of those before one."""
        edges = self._before(spark, "edges", batch)
        return None if edges is None else Graph(edges.drop("batch"), self.directed)

    def scores(self, spark: SparkSession, batch: int | None = None) -> DataFrame | None:
        """The last scores (id, value), or the last ones before a batch."""
        rows = self._before(spark, "scores", batch)
        last = None if rows is None else rows.agg(F.max("batch")).first()[0]
        return None if last is None else rows.where(F.col("batch") == last).drop("batch")

    def add(self, pairs: DataFrame, batch: int = 0) -> None:
        """A batch of pairs. Its edges that are there already are not added again; an empty batch does nothing."""
        spark = pairs.sparkSession
        if not pairs.take(1):
            return
        new, had = Graph.from_edges(pairs, self.directed).edges.distinct(), self._before(spark, "edges", batch)
        if had is not None:
            new = new.join(had.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "w")
        new.write.mode("overwrite").parquet(f"{self.folder}/edges/batch={batch}")
        graph, last = self.graph(spark, batch + 1), self.scores(spark, batch)
        more = {} if last is None else {"warm_start": Signal.of(graph, last)}
        ranked = self.ranker.rank(graph, self.seeds(graph), **more)
        ranked.df.write.mode("overwrite").parquet(f"{self.folder}/scores/batch={batch}")
        for old in self._before(spark, "scores", batch).select("batch").distinct().orderBy("batch").collect()[:-1]:
            deleted(spark, f"{self.folder}/scores/batch={old[0]}")  # the last ones before this batch stay, for recovery
        if self.sink is not None:
            self.sink(self.scores(spark), batch)

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run on a stream of pairs; what is available is read in batches, then it stops. The same checkpoint, a folder that all machines share, goes on."""
        self.folder = self.folder or f"{checkpoint}-graph"
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
