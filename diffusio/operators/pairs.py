"""Pairs two steps apart, without a table of paths.

Nodes are numbered in the order of their names and dealt into parts. A part is one row with its nodes' names and
edges as arrays; each pair of parts is a task that finds, source by source, the targets of the source's
neighbours. Nothing that grows with paths or pairs is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffusio.graph import Graph
from diffusio.operators.dictionary import Dictionary
from diffusio.session import ship, written

#: Nodes of a part at most.
PART = 1 << 14
#: Pairs of a batch at most, but for those of one source.
BATCH = 1 << 18


def _row(t: pa.Table) -> pa.Table:
    """A part as one row: nodes in their order, edges to them by their other ends."""
    t = t.sort_by("place")
    ends = t.column("ends").combine_chunks()
    counts = np.diff(ends.offsets.to_numpy())
    place, end = np.repeat(np.arange(t.num_rows, dtype="<i4"), counts), ends.flatten().to_numpy().astype("<i8")
    return pa.table({"part": t.column("part").slice(0, 1), "names": pa.array([t.column("id").to_pylist()], pa.list_(pa.string())), "place": pa.array([place.tobytes()], pa.binary()), "end": pa.array([end.tobytes()], pa.binary()), "x": pa.array([np.stack([np.asarray(v, "<f8") for v in t.column("x").to_pylist()]).tobytes()], pa.binary())})


def parts(graph: Graph, ends: str, features: DataFrame | None = None) -> DataFrame:
    """part, names, place and end: the edges of each part's nodes, with the number of the other end; ends: "src" if the nodes are sources, else "dst". x: rows of features (id, x)."""
    names = graph.remembered(("names",), lambda: Dictionary.of(graph.nodes))
    n = max(int(min(8, int(graph.spark.conf.get("spark.sql.shuffle.partitions")))), -(-names.size // PART))
    pairs = names.encoded(graph.edges.select(F.col(ends).alias("a"), F.col("dst" if ends == "src" else "src").alias("b")), "b")
    lists = pairs.groupBy(F.col("a").alias("id")).agg(F.collect_set("b").alias("ends"))
    nodes = names.names.join(lists, "id", "left")
    nodes = nodes.withColumn("x", F.array(F.lit(0.0))) if features is None else nodes.join(features, "id", "left")
    number = F.col("number")
    rows = nodes.select((number % n).cast("int").alias("part"), F.floor(number / n).cast("int").alias("place"), "id", F.coalesce("ends", F.array().cast("array<bigint>")).alias("ends"), "x")
    return written(rows.groupBy("part").applyInArrow(_row, "part int, names array<string>, place binary, end binary, x binary"), "parts").repartitionByRange(n, "part").withColumn("parts", F.lit(n))


#: From a source's targets (a flag each), its own linked ones, and both rows of features: the places to return and their scores.
Chosen = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def two_steps(graph: Graph, choose: Chosen, features: DataFrame | None = None) -> DataFrame:
    """src, found (dst, score): for each source and part of targets what choose() takes of the targets up to two steps away."""
    ship(graph.spark)
    left, right = parts(graph, "src", features), parts(graph, "dst", features)
    both = left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]).crossJoin(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]))
    cell = pa.struct([("dst", pa.string()), ("score", pa.float64())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                of = lambda c, kind, r=r, b=b: np.frombuffer(b.column(c)[r].as_buffer(), kind)
                sources, targets, part, other, n = b.column("l_names")[r].values, b.column("r_names")[r].values, b.column("l_part")[r].as_py(), b.column("r_part")[r].as_py(), b.column("l_parts")[r].as_py()
                mid, place = of("r_end", "<i8"), of("r_place", "<i4")
                order = np.argsort(mid, kind="stable")
                mids, place = mid[order], place[order]
                at, end = of("l_place", "<i4"), of("l_end", "<i8")
                begins = np.searchsorted(at, np.arange(len(sources) + 1))
                low, high = np.searchsorted(mids, end, "left"), np.searchsorted(mids, end, "right")
                x, y = of("l_x", "<f8").reshape(len(sources), -1), of("r_x", "<f8").reshape(len(targets), -1)
                out: list[tuple[int, np.ndarray, np.ndarray]] = []
                held = 0
                for s in range(len(sources)):
                    a, z = begins[s], begins[s + 1]
                    if a == z:
                        continue
                    own = end[a:z]
                    linked = own[own % n == other] // n
                    flags = np.zeros(len(targets), bool)
                    for i, j in zip(low[a:z].tolist(), high[a:z].tolist(), strict=True):
                        flags[place[i:j]] = True
                    flags[linked] = True
                    if part == other:
                        flags[s] = False
                    chosen, scores = choose(flags, linked, x[s], y)
                    if len(chosen):
                        out.append((s, chosen, scores))
                        held += len(chosen)
                    if held >= BATCH:
                        yield batch(sources, targets, out)
                        out, held = [], 0
                if out:
                    yield batch(sources, targets, out)

    def batch(sources: pa.Array, targets: pa.Array, out: list) -> pa.RecordBatch:
        sizes = np.cumsum([0, *[len(c) for _, c, _ in out]])
        dst, score = targets.take(pa.array(np.concatenate([c for _, c, _ in out]))), pa.array(np.concatenate([v for _, _, v in out]))
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([dst, score], fields=list(cell)))
        return pa.RecordBatch.from_arrays([sources.take(pa.array([s for s, _, _ in out])), lists], names=["src", "found"])

    return both.mapInArrow(found, "src string, found array<struct<dst: string, score: double>>")


def within_two(graph: Graph) -> DataFrame:
    """src and dst up to two steps apart, without the node itself."""

    def choose(flags: np.ndarray, linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        chosen = np.flatnonzero(flags)
        return chosen, np.zeros(len(chosen))

    return two_steps(graph, choose).select("src", F.explode("found").alias("f")).select("src", "f.dst")


def best_of_two(graph: Graph, features: DataFrame, k: int) -> DataFrame:
    """src, dst and score: of each part of targets the k highest products of features (id, x: array) among those two steps away that aren't linked."""

    def choose(flags: np.ndarray, linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flags[linked] = False
        chosen = np.flatnonzero(flags)
        scores = y[chosen] @ x
        if len(chosen) > k:  # ties go by name, which is the order of places
            least = np.partition(scores, -k)[-k]
            keep = np.concatenate([np.flatnonzero(scores > least), np.flatnonzero(scores == least)[:k]])
            chosen, scores = chosen[keep], scores[keep]
        return chosen, scores

    return two_steps(graph, choose, features).select("src", F.explode("found").alias("f")).select("src", "f.dst", "f.score")
