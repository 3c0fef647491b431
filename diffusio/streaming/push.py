"""PageRank over a stream of edges by pushing residuals (an extension): a batch works on what it changes.

The state has for each node its score x, the residual by which x misses the equation, and its number of
edges d. Scores are right when residuals are 0: x = alpha * (sum of x / d over incoming edges) + (1 - alpha) * p. New edges
of a node change what it gives its neighbours, old and new, which is added to their residuals. Then nodes whose
residual is above the tolerance take it into their score and pass it on, round by round. Only the rows that are reached
are read into the rounds and written in them; the state as a whole is rewritten once a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from diffusio.session import deleted, exists, written


class PushRanker:
    """Keeps edges and state by batch in a folder that all machines share; ``personalization`` maps nodes (id) to (id, value).

    A batch reads what those before it have left, so a restarted stream goes on, and a batch that runs twice replaces its own
    tables. tol: residuals up to this stay, so scores miss by tol / (1 - alpha) a node at most on average.
    """

    def __init__(self, folder: str, personalization: Callable[[DataFrame], DataFrame], alpha: float = 0.85, tol: float = 1e-9, directed: bool = False):
        self.folder, self.personalization, self.alpha, self.tol, self.directed = folder, personalization, alpha, tol, directed
        #: Rows that the rounds of the last batch have reached, and its rounds.
        self.touched, self.rounds = 0, 0

    def _read(self, spark: SparkSession, name: str, columns: str, batch: int | None) -> DataFrame:
        path = f"{self.folder}/{name}"
        schema = f"{columns}, batch long"
        rows = spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
        return rows if batch is None else rows.where(F.col("batch") < batch)

    def edges(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """src and dst of all batches, or of those before one."""
        return self._read(spark, "edges", "src string, dst string", batch).drop("batch")

    def state(self, spark: SparkSession, batch: int | None = None) -> DataFrame:
        """id, x, res, d after the last batch, or the last one before a batch."""
        rows = self._read(spark, "state", "id string, x double, res double, d long", batch)
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).drop("batch") if last is not None else rows.drop("batch")

    def scores(self, spark: SparkSession) -> DataFrame:
        """id and value."""
        return self.state(spark).select("id", F.col("x").alias("value"))

    def add(self, pairs: DataFrame, batch: int = 0) -> None:
        """A batch of pairs; edges that are there already are not added again, and an empty batch does nothing."""
        spark = pairs.sparkSession
        a, b = (F.col(c).cast("string") for c in pairs.columns[:2])
        new = pairs.select(a.alias("src"), b.alias("dst"))
        new = new if self.directed else new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        had = self.edges(spark, batch)
        new.distinct().join(had, ["src", "dst"], "left_anti").write.mode("overwrite").parquet(f"{self.folder}/edges/batch={batch}")
        new = spark.read.schema("src string, dst string").parquet(f"{self.folder}/edges/batch={batch}")
        if new.isEmpty():
            return
        every, before = self.edges(spark, batch + 1), self.state(spark, batch)
        ends = new.select(F.col("src").alias("id"), F.lit(1).alias("n")).union(new.select("dst", F.lit(0))).groupBy("id").agg(F.sum("n").alias("n"))
        # nodes at new edges, with their edges so far; unknown ones start with what the personalization gives them
        rows = ends.join(before, "id", "left")
        fresh = self.personalization(rows.where("d IS NULL").select("id")).select("id", F.col("value").alias("p"))
        rows = rows.join(fresh, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("res", (1 - self.alpha) * F.coalesce("p", F.lit(0.0))).alias("res"), F.coalesce("d", F.lit(0)).alias("was"), (F.coalesce("d", F.lit(0)) + F.col("n")).alias("d"))
        rows = written(rows, "reached")
        giving = rows.where("d > was AND x <> 0").select(F.col("id").alias("src"), "x", "was", "d")
        old = had.join(giving.where("was > 0"), "src").select("dst", (self.alpha * F.col("x") * (1 / F.col("d") - 1 / F.col("was"))).alias("v"))
        added = new.join(giving, "src").select("dst", (self.alpha * F.col("x") / F.col("d")).alias("v"))
        state = self._with(rows.drop("was"), before, old.unionByName(added))
        self.rounds = 0
        while True:
            active = written(state.where(F.abs("res") > self.tol).select("id", F.col("res").alias("v"), "d"), "active")
            if active.isEmpty():
                break
            flows = every.join(active.where("d > 0").select(F.col("id").alias("src"), (self.alpha * F.col("v") / F.col("d")).alias("v")), "src").select("dst", "v")
            taken = F.abs("res") > self.tol
            state = state.select("id", F.when(taken, F.col("x") + F.col("res")).otherwise(F.col("x")).alias("x"), F.when(taken, 0.0).otherwise(F.col("res")).alias("res"), "d")
            state = self._with(state, before, flows)
            self.rounds += 1
        self.touched = state.count()
        whole = before.join(state.select("id"), "id", "left_anti").unionByName(state)
        whole.write.mode("overwrite").parquet(f"{self.folder}/state/batch={batch}")
        for b in self._read(spark, "state", "id string, x double, res double, d long", batch).select("batch").distinct().orderBy("batch").collect()[:-1]:
            deleted(spark, f"{self.folder}/state/batch={b[0]}")  # the last one before this batch stays, for recovery

    @staticmethod
    def _with(reached: DataFrame, before: DataFrame, flows: DataFrame) -> DataFrame:
        """reached (id, x, res, d) with flows (dst, v) added to residuals; nodes reached for the first time come from the state before."""
        came = written(flows.groupBy(F.col("dst").alias("id")).agg(F.sum("v").alias("v")), "flows")
        more = before.join(came.join(reached.select("id"), "id", "left_anti").select("id"), "id", "left_semi").select("id", "x", "res", "d")
        rows = reached.unionByName(more).join(came, "id", "left")
        return written(rows.select("id", "x", (F.col("res") + F.coalesce("v", F.lit(0.0))).alias("res"), "d"), "reached")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Run on a stream of pairs; what is available is read in batches, then it stops. The same checkpoint goes on."""
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
