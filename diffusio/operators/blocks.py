"""Edges in blocks of arrays, for signals that are moved many times.

Nodes are numbered and dealt into parts by number; a block has the edges between two parts, as arrays
of places and weights. A part's values are one row, which is joined with the part's blocks; what
arrives is summed by part. A step shuffles a row of sums for each block at most, and no names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from diffusio.graph import Graph
from diffusio.operators.dictionary import Dictionary
from diffusio.operators.normalize import SENT, Normalization
from diffusio.session import Steps, bucketed, ship, written

#: Nodes of a part at most.
PART = 1 << 16
#: Parts at least, as far as there are so many shuffle partitions.
PARTS = 16


def _packed(t: pa.Table) -> pa.Table:
    src, dst, w = (t.column(c).to_numpy() for c in ("src", "dst", "w"))
    order = np.argsort(dst, kind="stable")
    cells = [src[order].astype("<i4").tobytes(), dst[order].astype("<i4").tobytes(), w[order].astype("<f8").tobytes()]
    return pa.table({"sp": t.column("sp").slice(0, 1), "dp": t.column("dp").slice(0, 1)} | {c: pa.array([v], pa.binary()) for c, v in zip(("src", "dst", "w"), cells, strict=True)})


def _summed(t: pa.Table) -> pa.Table:
    total = reduce(np.add, (np.frombuffer(x.as_buffer(), "<f8") for x in t.column("x")))
    return pa.table({"sp": t.column("sp").slice(0, 1), "x": pa.array([total.tobytes()], pa.binary())})


class Blocks:
    """The edges of a graph in blocks, kept for the graph."""

    def __init__(self, graph: Graph, normalization: Normalization):
        self.names = graph.remembered(("names",), lambda: Dictionary.of(graph.nodes))
        n = self.names.size
        self.n, self.parts = n, max(1, math.ceil(n / PART), min(PARTS, int(graph.spark.conf.get("spark.sql.shuffle.partitions"))))
        names = self.names.names
        sent = F.broadcast if n <= SENT else (lambda df: df)
        e = normalization.edges(graph)
        for end, p in (("src", "sp"), ("dst", "dp")):
            e = e.join(sent(names.select(F.col("id").alias(end), F.col("number").alias(f"_{end}"))), end).drop(end).withColumns({p: self._part(f"_{end}"), end: self._place(f"_{end}")})
        packed = e.select("sp", "dp", "src", "dst", "w").groupBy("sp", "dp").applyInArrow(_packed, "sp int, dp int, src binary, dst binary, w binary")
        self.rows = bucketed(packed, "blocks", "sp").rows

    def _part(self, number: str) -> Column:
        return F.expr(f"CAST({number} % {self.parts} AS INT)")

    def _place(self, number: str) -> Column:
        return F.expr(f"CAST({number} DIV {self.parts} AS INT)")

    def hops(self, table: DataFrame, slots: int, n: int) -> DataFrame:
        """id and h<k>_<i>: slot i of a table (id, p: array) moved k times, k below n."""
        ship(table.sparkSession)
        steps, size, parts = Steps(n + 1), -(-self.n // self.parts), self.parts

        def first(t: pa.Table) -> pa.Table:
            x = np.zeros((slots, size))
            x[:, t.column("place").to_numpy()] = np.stack(t.column("p").combine_chunks().flatten().to_numpy().reshape(-1, slots)).T
            return pa.table({"sp": t.column("sp").slice(0, 1), "x": pa.array([x.tobytes()], pa.binary())})

        def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dp, out = b.column("dp"), []
                for src, dst, w, x in zip(*(b.column(c) for c in ("src", "dst", "w", "x")), strict=True):
                    src, dst = (np.frombuffer(c.as_buffer(), "<i4") for c in (src, dst))
                    w, x = np.frombuffer(w.as_buffer(), "<f8"), np.frombuffer(x.as_buffer(), "<f8").reshape(slots, size)
                    out.append(np.concatenate([np.bincount(dst, w * v[src], size) for v in x]).tobytes())
                yield pa.RecordBatch.from_arrays([dp, pa.array(out, pa.binary())], names=["sp", "x"])

        def spread(t: pa.Table) -> pa.Table:
            part, x = t.column("sp")[0].as_py(), np.zeros((n * slots, size))
            for k, v in zip(t.column("k").to_pylist(), t.column("x"), strict=True):
                x[k * slots : (k + 1) * slots] = np.frombuffer(v.as_buffer(), "<f8").reshape(slots, size)
            return pa.table({"number": np.arange(size, dtype=np.int64) * parts + part} | {c: x[i] for i, c in enumerate(columns)})

        columns = [f"h{k}_{i}" for k in range(n) for i in range(slots)]
        cells = self.names.encoded(table.select("id", F.col("p").cast("array<double>").alias("p")), "id")
        start = cells.select(self._part("id").alias("sp"), self._place("id").alias("place"), "p").groupBy("sp").applyInArrow(first, "sp int, x binary")
        state, _ = steps.written(start, "hop")
        whole = [state]
        for _ in range(1, n):
            arrived = self.rows.join(state.hint("shuffle_hash"), "sp").select("dp", "src", "dst", "w", "x").mapInArrow(moved, "sp int, x binary")
            state, _ = steps.written(arrived.groupBy("sp").applyInArrow(_summed, "sp int, x binary"), "hop")
            whole.append(state)
        rows = reduce(lambda a, b: a.union(b), [s.select("sp", F.lit(k).alias("k"), "x") for k, s in enumerate(whole)])
        wide = rows.groupBy("sp").applyInArrow(spread, f"number long, {', '.join(f'{c} double' for c in columns)}")
        named = self.names.names.join(wide, "number", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])
        out = written(named, "hops")
        steps.gone(table.sparkSession)
        return out
