"""Scalar and vector functions whose edge cases Spark's ANSI mode would raise on."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: the smallest step of a double at 1.
EPSILON = 2.220446049250313e-16


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def safe_inv(a: Column) -> Column:
    return safe_div(F.lit(1.0), a)


def safe_ln(a: Column) -> Column:
    """ln, negative infinity at 0."""
    return F.when(a == 0, F.lit(float("-inf"))).otherwise(F.ln(F.when(a > 0, a)))


class Adjacency(NamedTuple):
    """Edges as a step wants them: rows (src, dst, w) in buckets by source; plain: the same for other uses.

    hubs (src, parts): sources whose edges are in several parts, numbered in the column part; None if there are none.
    """

    rows: DataFrame
    plain: DataFrame
    hubs: DataFrame | None = None


def conv(edges: DataFrame | Adjacency, values: DataFrame, *columns: str) -> DataFrame:
    """For each target: the sums of columns of its sources times the weights. One shuffle by target after the join by source.

    The values of sources whose edges are in several parts are repeated for each.
    """
    sums, values, keys = [F.expr(f"sum({c} * w) AS {c}") for c in columns], values.select(F.col("id").alias("src"), *columns), ["src"]
    if isinstance(edges, Adjacency):
        if edges.hubs is not None:  # a row for each part's size of edges at most
            values = values.join(F.broadcast(edges.hubs), "src", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            keys = ["src", "part"]
        edges = edges.rows
        return edges.join(values.hint("shuffle_hash"), keys).groupBy(F.col("dst").alias("id")).agg(*sums)  # a bucket's values are few beside its edges, which needn't be sorted then
    return edges.join(values, keys).groupBy(F.col("dst").alias("id")).agg(*sums)


def rounded(column: str) -> Column:
    """To 8 decimals by a rule that SQL engines share."""
    return F.floor(F.col(column) * 1e8 + 0.5) / 1e8
