"""Orders over whole tables without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.session import written


def running(df: DataFrame, order: Sequence[Column | str], amount: Column | str, into: str) -> DataFrame:
    """df with the sum of an amount over all rows before each in an order.

    The table is sorted by ranges and written; sums run within ranges, and the sums of the
    ranges before (one row a range) are added.
    """
    value = F.col(amount) if isinstance(amount, str) else amount
    rows = written(df.withColumn("_amount", value).orderBy(*order).withColumn("_part", F.spark_partition_id()), "sorted")
    totals = rows.groupBy("_part").agg(F.sum("_amount").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(bases), "_part").withColumn(into, F.col("_own") + F.col("_base")).drop("_part", "_amount", "_own", "_base")


def placed(df: DataFrame, order: Sequence[Column | str], into: str = "place") -> DataFrame:
    """df with its places in an order, from 1. Equal rows of the order are numbered in any way."""
    return running(df, order, F.lit(1), into).withColumn(into, F.col(into) + 1)
