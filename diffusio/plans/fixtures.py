"""Graphs, groups and signals derived from the test tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from diffusio.functions.math import rounded
from diffusio.graph import Graph, Signal


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def customer_supplier(spark: SparkSession, folder: str) -> Graph:
    """Undirected, unweighted: customers and the suppliers they have bought from."""
    lines, orders = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    keys = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()  # names are longer
    return Graph.from_edges(keys.select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))).stored(summed=True)


def nations(spark: SparkSession, folder: str) -> Graph:
    """Directed, weighted: nations of customers to nations of suppliers, by lines."""
    lines, orders = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    c, s = table(spark, folder, "customer").select("c_custkey", "c_nationkey"), table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = rows.groupBy("c_nationkey", "s_nationkey").agg(F.count("l_orderkey").alias("w"))
    return Graph.from_edges(pairs.select(F.concat(F.lit("n"), "c_nationkey").alias("a"), F.concat(F.lit("n"), "s_nationkey").alias("b"), "w"), True, "w").stored()


def regions(spark: SparkSession, folder: str) -> Graph:
    """Undirected, unweighted: nations and their regions."""
    return Graph.from_edges(table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b")).distinct()).stored()


GRAPHS = {"cs": customer_supplier, "nat": nations, "reg": regions}
GRAPH_SQL = {
    "cs": """pairs AS MATERIALIZED (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM pairs UNION ALL SELECT b, a, 1.0::DOUBLE FROM pairs),
nodes AS MATERIALIZED (SELECT DISTINCT src AS id FROM edges)""",
    "reg": """pairs AS MATERIALIZED (SELECT DISTINCT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation),
edges AS MATERIALIZED (SELECT a AS src, b AS dst, 1.0::DOUBLE AS w FROM pairs UNION ALL SELECT b, a, 1.0::DOUBLE FROM pairs),
nodes AS MATERIALIZED (SELECT DISTINCT src AS id FROM edges)""",
    "nat": """edges AS MATERIALIZED (SELECT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst, count(*)::DOUBLE AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
nodes AS MATERIALIZED (SELECT src AS id FROM edges UNION SELECT dst FROM edges)""",
}


def key(column: str = "id") -> Column:
    """The number in a node's id."""
    return F.substring(F.col(column), 2, 20).cast("long")


KEY_SQL = "CAST(substr(id, 2) AS BIGINT)"
#: Seeds: suppliers (or nations) whose number is divisible by 5. Sensitive: even numbers.
SEED_SQL = f"CASE WHEN substr(id, 1, 1) <> 'c' AND {KEY_SQL} % 5 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
SENSITIVE_SQL = f"CASE WHEN {KEY_SQL} % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def seeds(graph: Graph) -> Signal:
    chosen = (F.substring("id", 1, 1) != "c") & (key() % 5 == 0)
    return Signal(graph, graph.nodes.select("id", F.when(chosen, 1.0).otherwise(0.0).alias("value")))


def sensitive(graph: Graph) -> Signal:
    return Signal(graph, graph.nodes.select("id", F.when(key() % 2 == 0, 1.0).otherwise(0.0).alias("value")))


def shown(signal: Signal) -> DataFrame:
    """id and score, rounded by a rule that both engines share."""
    return signal.df.select("id", rounded("value").alias("score"))


def settled(signal: Signal) -> Signal:
    """The rounded signal, so that what follows starts from equal numbers in both engines."""
    return Signal(signal.graph, signal.df.select("id", rounded("value").alias("value"))).stored()


def communities(spark: SparkSession, folder: str) -> DataFrame:
    """group_id and id: customers by market segment."""
    return table(spark, folder, "customer").select(F.col("c_mktsegment").alias("group_id"), F.concat(F.lit("c"), "c_custkey").alias("id"))


COMMUNITIES_SQL = "groups AS MATERIALIZED (SELECT c_mktsegment AS group_id, 'c' || c_custkey AS id FROM customer)"
