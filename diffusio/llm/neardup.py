"""N-gram Jaccard join in the metric space of shingle sets.

Sets are points under the Jaccard distance d(x, y) = 1 - |x & y| / |x | y|, a metric. Two
texts link when d <= EPSILON. Regions are split by pivots until they fit into a task:

* Level 0: pivots are pooled sets. A pivot P is the union of the sets of some texts, and the
  distance of x from P is that from the nearest set which P contains, x & P, so
  d(x, P) = |x - P| / |x|. Distances from a pool obey the triangle inequality,
  |d(x, P) - d(y, P)| <= d(x, y). Each text is in the pool of the most frequent of its
  window shingles, at distance 0, which makes the pools' Voronoi regions; so a text at
  d(y, P) <= EPSILON is replicated into the region of P if that is before y's own in an order
  of pools, and linked texts share a region, the lesser of their two.
  (Single texts can't be pivots here: unrelated texts are all at distance about 1 of each
  other, so that windows would copy all texts into all regions.) The window test is decided
  by a text's EPSILON |x| + 1 first shingles in one global order, rare ones first: if P
  misses all of these, d(x, P) > EPSILON. The order, the sizes and the places of shared
  shingles prune further: enough shingles must be left for a link.
* Texts that no other one of their region can link with, by a lower bound of d from histograms
  of hash classes, are left out. Nothing but small numbers has been shuffled so far.
* A region of more than CELL_ROWS texts or CELL_SHINGLES shingles is divided in Spark: some of
  its texts are pivots, and each text's distances from them are computed, which finds all
  links of the pivots. Texts that these links join with the region's main component are
  settled: links between two of them add nothing. Settled texts go to the cell of their
  nearest pivot; the others to every cell whose pivot is at most 2 EPSILON farther than
  their nearest, so that each still meets whatever it may link with. Pivots are unsettled
  texts, those with the most usual shingles, which link with most. Cells without unsettled
  texts are done; others are regions of the next level. A region of which windows put more
  than nine tenths into one cell is cut into salted parts instead: its settled texts are dealt
  out, and its unsettled ones, mostly few by then, go to each part. (If they are many, they
  are dealt out too, and each two parts are a region.)
* A region that fits is divided in the same way, by two pivots at a time, in one task.

Equal sets are one point from the start. All distances are exact, from the hashes of whole
sets. Steps are Spark joins on written tables; what reaches the driver are counts of rows, a
bit for each row (which of equal sets is the point) and the sketch of shingle frequencies
(WIDTH counters), which only orders shingles: any order gives exact results.

What is moved: a text's window shingles once, packed by ranges of hashes, and the whole texts
of the regions that fit into a task, where their sets are made.

Defined cases: a text of fewer than five words, but not none, has one shingle; null texts
and texts without words link with nothing; texts of any length count whole; repeated rows are
copies, and rows of equal id are judged by their texts; rows without id link as others do,
and the component of rows none of which has an id is null; an empty table gives no rows;
other columns are not read (near_duplicates) or kept, whatever their names (keep_one).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.llm.text import Words, grams, mix, not_space, slices
from diffusio.session import ship, written

WORDS, EPSILON = 5, 0.2
WIDTH_BITS = 21
#: What fits into a task: texts and shingles of one region.
CELL_ROWS, CELL_SHINGLES = 256, 1 << 22
#: Pivots of a division in Spark.
PIVOTS = 8
#: How many rows of a few numbers are broadcast (some 100 bytes each in memory); more are shuffled.
SENT_ROWS = 1_000_000
#: The same for blocks of rows with a bit for each (4 KB), as bitmap_construct_agg makes them.
SENT_BLOCKS, _BLOCK = 8_192, 32_768
#: Window tokens that a task packs at a time, and those of one bucket that it holds before it lets shared ones go unpruned.
PACKED_TOKENS, HELD_TOKENS = 1 << 18, 1 << 22
_SLACK = 2 * EPSILON + 1e-9


def _shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, shingle hashes and their bounds by row; repeated shingles repeat."""
    for lo, hi, buf, offsets in slices(column):
        yield lo, hi, *grams(Words(buf, offsets, not_space()), WORDS)


def _planes(v: np.ndarray) -> bytes:
    """Numbers as planes of their bytes: those of small ones are runs of zeros, which compress."""
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _numbers(planes: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


def _frequencies(docs: DataFrame) -> np.ndarray:
    """Counts of shingles by hash bucket over all texts, added up in a tree."""
    shift = np.uint64(64 - WIDTH_BITS)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << WIDTH_BITS, dtype=np.uint32)
        for b in batches:
            for _, _, h, _ in _shingles(b.column(0)):
                total += np.bincount((h >> shift).astype(np.int64), minlength=len(total)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(_planes(total), 1)], pa.binary())], names=["counts"])

    def summed(parts: Iterator) -> Iterator[bytes]:
        total = np.zeros(1 << WIDTH_BITS, dtype=np.uint32)
        for p in parts:
            total += _numbers(zlib.decompress(p), np.uint32)
        yield zlib.compress(_planes(total), 1)

    parts = docs.select("text").mapInArrow(partial, "counts binary").rdd.map(lambda r: bytes(r[0]))
    if parts.getNumPartitions() == 0:
        return np.zeros(1 << WIDTH_BITS, dtype=np.uint32)
    while parts.getNumPartitions() > 8:
        parts = parts.mapPartitions(summed).repartition(max(1, parts.getNumPartitions() // 8))
    got = parts.mapPartitions(summed).reduce(lambda a, b: next(summed(iter((a, b)))))
    return _numbers(zlib.decompress(got), np.uint32)


def _distinct(h: np.ndarray, bounds: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, rare buckets first if counts are given, and their bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    keys = (h, row) if counts is None else (h, counts[(h >> np.uint64(64 - WIDTH_BITS)).astype(np.int64)], row)
    order = np.lexsort(keys)
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(bounds)))


def _digests(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit values of each row's set, whatever its order."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (0x51ED270B, 0x2545F491):
            total = np.concatenate(([np.uint64(0)], np.cumsum(mix(h + np.uint64(seed)), dtype=np.uint64)))
            out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return out


def _histogram(h: np.ndarray) -> bytes:
    """Counts of hash classes, a power of two of them that grows with the set."""
    classes = 1 << (len(h) // 8).bit_length()
    return np.minimum(np.bincount((h & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n (distinct shingles), d1, d2 (digests of the set), prefix (its window) and hist."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequencies(docs))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, h, bounds in _shingles(b.column("text")):
                h, bounds = _distinct(h, bounds, sent.value)
                n = np.diff(bounds)
                d1, d2 = _digests(h, bounds)
                take = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
                ends = np.concatenate(([0], np.cumsum(take)))
                at = np.repeat(bounds[:-1] - ends[:-1], take) + np.arange(ends[-1])
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[at].view(np.int64)))
                hist = pa.array([_histogram(h[bounds[i] : bounds[i + 1]]) for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("h").slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(d1), pa.array(d2), prefix, hist], names=["doc_id", "h", "n", "d1", "d2", "prefix", "hist"])

    return docs.select("doc_id", "text", _text_hash().alias("h")).mapInArrow(made, "doc_id long, h long, n long, d1 long, d2 long, prefix array<long>, hist binary")


def connected(edges: DataFrame) -> DataFrame:
    """v, c: the least member of the component of each vertex of edges (a, b).

    Each round every vertex takes the least label around it, twice over, and edges are
    contracted to labels; rounds grow with the logarithm of the longest path.
    """
    labels: DataFrame | None = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")), "up")
        above = up.select(F.col("v").alias("c"), F.col("c").alias("d"))
        up = up.join(above, "c").select("v", F.col("d").alias("c"))
        labels = up if labels is None else labels.join(up.select(F.col("v").alias("c"), F.col("c").alias("d")), "c", "left").select("v", F.coalesce("d", "c").alias("c"))
        labels = written(labels, "labels")
        now = up.select(F.col("v"), F.col("c"))
        edges = edges.join(now.select(F.col("v").alias("a"), F.col("c").alias("p")), "a").join(now.select(F.col("v").alias("b"), F.col("c").alias("q")), "b")
        edges = written(edges.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "edges")
        if edges.isEmpty():
            return labels


def _with_texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """Rows of need (rep, h, ...), a written table, with the texts they name; rows of docs that are repeated repeat them."""
    keys = docs.select(F.coalesce("doc_id", F.lit(0)).alias("rep"), _text_hash().alias("h"), "text")
    return keys.join(_sent(need.withColumn("rep", F.coalesce("rep", F.lit(0)))), ["rep", "h"]).drop("rep", "h")


def _sets_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Columns and members, the whole sets, sorted, of rows (..., d1, d2, text) whose texts have these digests."""
    for b in batches:
        want1, want2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("d1", "d2"))
        for lo, hi, h, bounds in _shingles(b.column("text")):
            h, bounds = _distinct(h, bounds, None)
            d1, d2 = _digests(h, bounds)
            own = np.flatnonzero((d1 == want1[lo:hi]) & (d2 == want2[lo:hi]))
            sets, at = [h[bounds[i] : bounds[i + 1]].tobytes() for i in own], pa.array(own + lo)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in columns), pa.array(sets, pa.binary())], names=[*columns, "members"])


def _full_sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """x, at and members, the whole set, sorted, for points (x, at, rep, h, d1, d2), one row each."""
    rows = _with_texts(docs, need).select("x", "at", "d1", "d2", "text")
    full = written(rows.mapInArrow(lambda batches: _sets_of(batches, "x", "at"), "x long, at double, members binary"), "sets")
    return full if full.count() == need.count() else written(full.groupBy("x").agg(F.first("at").alias("at"), F.first("members").alias("members")), "sets")


def _sent(rows: DataFrame) -> DataFrame:
    """A written table of small rows, to be broadcast if it has at most SENT_ROWS of them, else joined by shuffling."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def _with_sets(rows: DataFrame, full: DataFrame) -> DataFrame:
    return full.join(_sent(written(rows, "rows")), "x")


def _by_region(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[list]]]:
    """Regions, which are sorted, with their columns' values."""
    now, rows = None, [[] for _ in columns]
    for b in batches:
        values = [b.column(c).to_pylist() for c in columns]
        for i, r in enumerate(b.column("r").to_pylist()):
            if r != now and rows[0]:
                yield now, rows
                rows = [[] for _ in columns]
            now = r
            for own, v in zip(rows, values, strict=True):
                own.append(v[i])
    if rows[0]:
        yield now, rows


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("r").sortWithinPartitions("r")


def _partnered(cells: DataFrame) -> DataFrame:
    """Members (r, x, settled) of regions (r, x, settled, n, hist) that may link with another one, by sizes and histograms."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, (x, settled, n, hist) in _by_region(batches, "x", "settled", "n", "hist"):
            classes = min(map(len, hist))  # classes are hashes modulo powers of two, so that they fold
            h = np.array([np.frombuffer(v, dtype=np.uint8).reshape(-1, classes).sum(axis=0, dtype=np.int32) for v in hist])
            n, known = np.array(n), np.array(settled)
            some = []
            for i in range(len(x)):
                may = (9 * np.abs(h - h[i]).sum(axis=1) <= n + n[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
                may[i] = False
                if (may & ~known).any() if settled[i] else may.any():
                    some.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(some), pa.int64()), pa.array([x[i] for i in some], pa.int64()), pa.array([settled[i] for i in some], pa.bool_())], names=["r", "x", "settled"])

    made_of = _dealt(cells.select("r", "x", "settled", "n", "hist")).mapInArrow(made, "r long, x long, settled boolean")
    return written(made_of, "partners")


class _Region:
    """The sets of a region in one task, and the links that are found between them."""

    def __init__(self, sets: list[bytes], settled: list[bool]):
        self.sizes = np.array([len(v) // 8 for v in sets])
        self.bounds = np.concatenate(([0], np.cumsum(self.sizes)))
        _, self.flat, often = np.unique(np.frombuffer(b"".join(sets), dtype=np.uint64), return_inverse=True, return_counts=True)
        self.central = np.add.reduceat(often[self.flat], self.bounds[:-1]) / self.sizes  # how usual a text's shingles are here
        self.mark = np.zeros(len(self.flat) + 1, dtype=bool)
        self.label = np.arange(len(sets))  # settled texts are one component already
        self.label[np.array(settled)] = min((i for i, s in enumerate(settled) if s), default=0)
        self.links: list[tuple[int, int]] = []

    def distances(self, p: int, at: np.ndarray) -> np.ndarray:
        """Distances of some members from member p; links are recorded."""
        own = self.flat[self.bounds[p] : self.bounds[p + 1]]
        self.mark[own] = True
        flat = np.concatenate([self.flat[self.bounds[i] : self.bounds[i + 1]] for i in at])
        sizes = self.sizes[at]
        shared = np.add.reduceat(self.mark[flat].astype(np.int64), np.cumsum(sizes) - sizes)
        self.mark[own] = False
        union = sizes + self.sizes[p] - shared
        for i in at[100 * shared >= 80 * union]:
            if self.label[i] != self.label[p]:
                self.links.append((p, int(i)))
                self.label[self.label == self.label[i]] = self.label[p]
        return 1 - shared / union

    def join(self, at: np.ndarray) -> None:
        """Find links until the components of these members are known: divide them by two pivots, and join the cells."""
        todo = [at]
        while todo:
            at = todo.pop()
            while len(at) > 1:
                names, counts = np.unique(self.label[at], return_counts=True)
                if len(names) == 1:
                    break
                apart = at[self.label[at] != names[counts.argmax()]] if counts.max() > 1 else at
                p = apart[self.central[apart].argmax()]
                at = at[at != p]
                d = self.distances(int(p), at)
                q = at[d.argmax()]
                d, at = d[at != q], at[at != q]
                if not len(at):
                    break
                e = self.distances(int(q), at)
                names, counts = np.unique(self.label[at], return_counts=True)
                settled = self.label[at] == names[counts.argmax()]
                left = np.where(settled, d <= e, d <= e + _SLACK)
                right = np.where(settled, d > e, e <= d + _SLACK)
                if left.all() or right.all():
                    continue  # one cell holds all: go on with other pivots
                todo.append(at[left])
                at = at[right]


def _joined(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect what is linked in regions (r, x, settled, d1, d2, text) that fit into a task.

    Texts are dealt out, as they are shorter than their sets, which have 8 bytes a word that don't compress.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (x, settled, sets) in _by_region(_sets_of(batches, "r", "x", "settled"), "x", "settled", "members"):
            region = _Region(sets, settled)
            region.join(np.arange(len(x)))
            if region.links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in side], pa.int64()) for side in zip(*region.links, strict=True)], names=["a", "b"])

    return _dealt(rows).mapInArrow(made, "a long, b long")


def _shares(count: Column, shingles: Column, part: float = 1.0) -> Column:
    """How many parts of a share of what fits into a task so many texts and shingles make."""
    return F.greatest(F.ceil(count / (part * CELL_ROWS)), F.ceil(shingles / (part * CELL_SHINGLES))).cast("int")


def _measured(rows: DataFrame, level: int) -> DataFrame:
    """For rows (r, x, settled, at, members) of regions that don't fit: r, x, n, mask, pivots (their x) and d, the distances from them.

    mask has a bit for each pivot that x links with, and one more if it is settled. A region's texts are
    measured in shares that fit into a task, each of which gets the sets of the pivots once.
    """
    order = F.xxhash64("x", F.lit(level))
    best = [F.min(F.struct("settled", F.pmod(order, F.lit(PIVOTS)) != k, "at", order.alias("o"), "x"))["x"] for k in range(PIVOTS)]
    chosen = rows.groupBy("r").agg(F.array_distinct(F.array(*best)).alias("p"), _shares(F.count("x"), F.sum(F.length("members")) / 8).alias("shares"))
    chosen = _sent(written(chosen, "pivots"))
    pivots = rows.select("r", "x", "members").join(chosen.select("r", "shares", F.explode("p").alias("x")), ["r", "x"])
    pivots = pivots.select(F.col("r").alias("at_r"), F.col("x").alias("pivot"), F.col("members").alias("set"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("at_share"))
    mine = rows.join(chosen.select("r", "shares"), "r").select("r", F.pmod(F.xxhash64("x"), F.col("shares")).cast("int").alias("share"), "x", "settled", "members")

    def made(key, own: pa.Table, pivots: pa.Table) -> pa.Table:
        pivots = pivots.sort_by("pivot")
        names, far = pivots["pivot"].to_pylist(), [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in pivots["set"]]
        distances, masks, sizes = [], [], []
        for v, settled in zip(own["members"], own["settled"].to_pylist(), strict=True):
            v, out, mask = np.frombuffer(v.as_buffer(), dtype=np.uint64), [], settled << PIVOTS
            for k, p in enumerate(far):
                shared = int((p[np.minimum(np.searchsorted(p, v), len(p) - 1)] == v).sum())
                union = len(v) + len(p) - shared
                mask |= (100 * shared >= 80 * union) << k
                out.append(1 - shared / union)
            distances.append(out)
            masks.append(mask)
            sizes.append(len(v))
        columns = [own["r"], own["x"], pa.array(sizes, pa.int64()), pa.array(masks, pa.int32()), pa.array([names] * len(own), pa.list_(pa.int64())), pa.array(distances, pa.list_(pa.float64()))]
        return pa.table(columns, names=["r", "x", "n", "mask", "pivots", "d"])

    found = mine.groupBy("r", "share").cogroup(pivots.groupBy("at_r", "at_share")).applyInArrow(made, "r long, x long, n long, mask int, pivots array<long>, d array<double>")
    return written(found, "distances")


def _main(groups: pa.Table) -> pa.Table:
    """Of a region's sets of linked pivots (mask, k: how many texts), the pivots of the main component, as a mask."""
    masks, counts = groups["mask"].to_pylist(), groups["k"].to_pylist()
    known = 1 << PIVOTS  # stands for the texts that were settled before
    parts: list[list[int]] = []
    for m, k in zip(masks, counts, strict=True):
        near = [p for p in parts if p[0] & m]
        parts = [p for p in parts if not p[0] & m] + [[reduce(int.__or__, (p[0] for p in near), m), k + sum(p[1] for p in near)]]
    main = max(parts, key=lambda p: (bool(p[0] & known), p[1], p[0]), default=[0, 0])
    return pa.table({"r": groups["r"][:1], "main": pa.array([main[0]], pa.int32()), "size": pa.array([sum(counts)], pa.int64())})


def _divided(rows: DataFrame, level: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of the pivots of regions that don't fit; the regions' cells and, of those that windows don't cut, parts (r, x, settled)."""
    measured = _measured(rows, level)
    links = measured.select("x", "mask", F.posexplode("pivots").alias("k", "p")).where("shiftright(mask, k) & 1 = 1 AND p <> x").select(F.col("x").alias("a"), F.col("p").alias("b"))
    main = measured.groupBy("r", "mask").agg(F.count("x").alias("k")).where("mask > 0").groupBy("r").applyInArrow(_main, "r long, main int, size long")
    sizes = measured.groupBy("r").agg(F.count("x").alias("whole"))
    regions = _sent(written(main.drop("size").join(sizes, "r"), "regions"))
    now = measured.where(~F.array_contains("pivots", F.col("x"))).join(regions, "r")
    now = now.withColumn("settled", F.col("mask").bitwiseAND(F.col("main")) != 0)
    least = F.array_min("d")
    home = F.array(F.array_position("d", least).cast("int") - 1)
    window = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda k: F.get("d", k) <= least + _SLACK)
    now = written(now.select("r", "whole", "x", "n", "settled", F.when(F.col("settled"), home).otherwise(window).alias("k")), "windows")
    cells = now.select("r", "whole", "x", "settled", F.explode("k").alias("k"))
    sizes = written(cells.groupBy("r", "k").agg(F.count("x").alias("rows"), F.max("whole").alias("whole"), F.min("settled").alias("done")), "sizes")
    whole = sizes.groupBy("r").agg((F.max("rows") > 0.9 * F.max("whole")).alias("whole"), F.min("done").alias("done")).where("whole AND NOT done").select("r")
    whole = _sent(written(whole, "whole"))
    one = _sent(written(sizes.where("NOT done AND rows > 1").select("r", "k").join(whole, "r", "left_anti"), "kept"))
    cells = cells.join(one, ["r", "k"]).select(F.xxhash64("r", "k", F.lit(level)).alias("r"), "x", "settled")
    return written(links, "links"), written(cells, "cells"), _salted(now.join(whole, "r", "left_semi").select(F.xxhash64("r", F.lit(level)).alias("r"), "x", "n", "settled"))


def _salted(rows: DataFrame) -> DataFrame:
    """Regions (r, x, n, settled) as parts in which every unsettled text meets all others, of half a task's texts and shingles of each kind."""
    known, n = F.col("settled"), F.col("n")
    own = rows.groupBy("r").agg(_shares(F.count_if(known), F.sum(F.when(known, n).otherwise(0)), 0.5).alias("b"), _shares(F.count_if(~known), F.sum(F.when(known, 0).otherwise(n)), 0.5).alias("c"))
    rows = rows.join(_sent(written(own, "parts")), "r")
    salt = F.xxhash64("x", F.lit("part"))
    mine = F.pmod(salt, F.when(F.col("settled"), F.col("b")).otherwise(F.col("c"))).cast("int")
    # kinds of parts: b settled ones with c unsettled ones, and unsettled ones with each other
    mixed = F.when(F.col("settled"), F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct(mine.alias("u"), k.alias("v"))))
    mixed = mixed.otherwise(F.when(F.col("b") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("b"), F.lit(1)) - 1), lambda k: F.struct(k.alias("u"), mine.alias("v")))).otherwise(F.array()))
    pairs = F.when(F.col("settled") | ((F.col("c") == 1) & (F.col("b") > 0)), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda k: F.struct((-1 - F.least(k, mine)).alias("u"), F.greatest(k, mine).alias("v"))))
    out = rows.withColumn("part", F.explode(F.concat(mixed, pairs)))
    return out.select(F.xxhash64("r", "part.u", "part.v").alias("r"), "x", "settled")


class _First:
    """Which rows (x, d1, d2, ...) are the first with their set, a bit for each: what else they have needn't be shuffled for that."""

    def __init__(self, rows: DataFrame):
        first = rows.groupBy("d1", "d2").agg(F.min("x").alias("x"))
        bits = written(first.groupBy(F.bitmap_bucket_number("x").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")), "bits")
        self.rows, self.sent = rows, None
        if bits.count() <= SENT_BLOCKS:
            self.sent = rows.sparkSession.sparkContext.broadcast({r["block"]: bytes(r["bits"]) for r in bits.collect()})
        else:
            self.rows = written(rows.join(written(first.select("x"), "first"), "x", "left_semi"), "firsts")

    @staticmethod
    def among(x: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
        at, out = x - (x > 0), np.zeros(len(x), dtype=bool)
        blocks = (x > 0) + at // _BLOCK
        for b in np.unique(blocks):
            own = blocks == b
            out[own] = np.unpackbits(np.frombuffer(bits.get(int(b), bytes(_BLOCK // 8)), dtype=np.uint8), bitorder="little")[at[own] % _BLOCK]
        return out


def _packed(batches: Iterator[pa.RecordBatch], buckets: int, most: int, bits: dict[int, bytes] | None) -> Iterator[pa.RecordBatch]:
    """Window tokens of rows (x, n, prefix), packed by bucket r, a range of hashes: steps of s, x less x0, n and i, the places.

    bits: those of _First, of rows that aren't chosen yet.
    """

    def packed(held: list[tuple]) -> pa.RecordBatch:
        s, x, n, i = (np.concatenate(v) for v in zip(*held, strict=True))
        order, x0 = np.argsort(s), x.min()
        s, x, n, i = s[order], x[order] - x0, n[order], i[order]
        r = (s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.concatenate(([0], np.flatnonzero(r[1:] != r[:-1]) + 1, [len(r)]))
        parts = [slice(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [pa.array(r[cuts[:-1]].view(np.int64)), pa.array([x0] * len(parts), pa.int64()), pa.array([_planes(np.diff(s[p], prepend=np.uint64(0))) for p in parts], pa.binary())]
        return pa.RecordBatch.from_arrays(columns + [pa.array([_planes(v[p]) for p in parts], pa.binary()) for v in (x, n, i)], names=["r", "x0", "s", "x", "n", "i"])

    held, count = [], 0
    for b in batches:
        if bits is not None:
            b = b.filter(pa.array(_First.among(b.column("x").to_numpy(zero_copy_only=False), bits)))
        prefix = b.column("prefix")
        ends = np.concatenate(([0], np.cumsum(prefix.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        sizes = np.diff(ends)
        x, n = (np.repeat(b.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("x", "n"))
        held.append((prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint64), x, n, np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)))
        count += int(ends[-1])
        if count >= most:
            yield packed(held)
            held, count = [], 0
    if count:
        yield packed(held)


def _unpacked(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Tokens (s, x, n, i) that more than one text has, and that may bring a link, with how many have them, from packed ones by r.

    Of a bucket of more tokens than fit, those of several texts go on as they come, without the test: it only prunes.
    """

    def rows(s, x, n, i, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (s, x, n, i, size)], names=["s", "x", "n", "i", "size"])

    def counted(tokens: list[np.ndarray]) -> tuple:
        """Tokens in the order of s, the first one of each s, the number of the s of each, and sizes."""
        order = np.argsort(tokens[0], kind="stable")
        tokens = [v[order] for v in tokens]
        s = tokens[0]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        size = np.diff(np.append(first, len(s)))
        return tokens, first, np.repeat(np.arange(len(first)), size), size

    def bucket(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held, count, known = [], 0, np.zeros(0, dtype=np.uint64)
        for _, x0, s, x, n, i in parts:
            now = [np.cumsum(_numbers(s, np.uint64), dtype=np.uint64), _numbers(x, np.int64) + x0, _numbers(n, np.int64), _numbers(i, np.int64)]
            if len(known):
                had = np.isin(now[0], known)
                yield rows(*(v[had] for v in now), np.full(had.sum(), 2))
                now = [v[~had] for v in now]
            held.append(now)
            count += len(now[0])
            if count >= most:
                tokens, first, k, size = counted([np.concatenate(v) for v in zip(*held, strict=True)])
                more = size[k] > 1
                yield rows(*(v[more] for v in tokens), size[k][more])
                known = np.union1d(known, tokens[0][more])
                held, count = [[v[~more] for v in tokens]], 0
        tokens, first, k, size = counted([np.concatenate(v) for v in zip(*held, strict=True)])
        s, x, n, i = tokens
        if not len(s):
            return
        # two sets whose first shared shingle is at places i and j link only if 9 min(n - i, m - j) >= 4 (n + m);
        # of a shingle's members, the least m and the greatest 5 m - 9 j decide whether any can
        lo, far = np.minimum.reduceat(n, first), np.maximum.reduceat(5 * n - 9 * i, first)
        left = (size[k] > 1) & (9 * (n - i) >= 4 * (n + lo[k])) & (far[k] >= 4 * n)
        left &= np.bincount(k[left], minlength=len(first))[k] > 1
        yield rows(*(v[left] for v in tokens), size[k][left])

    packed = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("r", "x0", "s", "x", "n", "i")), strict=True))
    for _, parts in groupby(packed, itemgetter(0)):
        yield from bucket(parts)


def pooled_cells(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level 0, for points (x, n, d1, d2, prefix): r, x of all members of regions of more than one text; x, at.

    Of points of equal digests, the one of the least x stands for all.

    at: the less, the more usual a text's window shingles are among the others, which makes it central.
    """
    reach = {"lo": F.min("n"), "far": F.max(5 * F.col("n") - 9 * F.col("i"))}
    enough = "9 * (n - i) >= 4 * (n + lo) AND far >= 4 * n"  # as in _unpacked, for a pool's members
    by_shingle = Window.partitionBy("s")
    # tokens are shuffled once, by ranges of their hashes and packed; most, of one text, go
    buckets, packs, most = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), PACKED_TOKENS, HELD_TOKENS
    first = _First(points)
    sent = first.sent
    tokens = first.rows.select("x", "n", "prefix").mapInArrow(lambda batches: _packed(batches, buckets, packs, sent and sent.value), "r long, x0 long, s binary, x binary, n binary, i binary")
    left = written(_dealt(tokens).mapInArrow(lambda batches: _unpacked(batches, most), "s long, x long, n long, i long, size long"), "shared")
    home = written(left.groupBy("x").agg(F.max(F.struct("size", "s"))["s"].alias("r"), (-F.sum("size") / F.first("n")).alias("at")), "homes")
    placed = left.join(home.select("x", F.col("r").alias("home")), "x")
    # shingles whose texts all have one pool bring nobody elsewhere
    placed = placed.select("*", F.min("home").over(by_shingle).alias("first"), F.max("home").over(by_shingle).alias("last"))
    placed = written(placed.where("first < last").drop("first", "last"), "placed")
    pools = placed.groupBy("s", F.col("home").alias("r")).agg(*[v.alias(k) for k, v in reach.items()])
    # each of two linked texts is in reach of the other's pool; they need to meet once, which is in the lesser pool of the two
    cells = placed.join(pools, "s").where(enough).where("r < home").select("r", "x").unionByName(home.select("r", "x")).distinct()
    cells = written(cells, "cells")
    several = written(cells.groupBy("r").agg(F.count("x").alias("k")).where("k > 1").select("r"), "regions")
    return written(cells.join(_sent(several), "r"), "cells"), home.select("x", "at")


def _fitting(cells: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (r, x, ...) with n and hist, those that fit into a task and those that don't."""
    rows = written(sets.select("x", "n", "hist").join(_sent(cells), "x"), "members")
    fits = rows.groupBy("r").agg(((F.count("x") <= CELL_ROWS) & (F.sum("n") <= CELL_SHINGLES)).alias("fits"))
    rows = rows.join(_sent(written(fits, "regions")), "r")
    return rows.where("fits").drop("fits"), rows.where("NOT fits").drop("fits")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, h, n, d1, d2), points (x, rep, d1, d2), labels (x, c) of linked points.

    A point is a set, its x the number of the first row that has it, and rep and h name the row of the least id.
    """
    sets = written(shingle_sets(docs).withColumn("x", F.monotonically_increasing_id()), "shingles")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("one")
    points = sets.where("n > 0").groupBy("d1", "d2").agg(first, F.min("x").alias("x"))
    points = written(points.select("d1", "d2", F.col("one.doc_id").alias("rep"), F.col("one.h").alias("h"), "x"), "points")

    cells, places = pooled_cells(sets.where("n > 0").select("x", F.col("doc_id").alias("rep"), "n", "d1", "d2", "prefix"))
    small, large = _fitting(cells.withColumn("settled", F.lit(False)), sets)
    ready, large = [_partnered(small)], large.select("r", "x", "settled")
    links, level = [], 0
    keys = points.select("x", "rep", "h", "d1", "d2")
    if not large.isEmpty():
        need = written(large.select("x").distinct().join(places, "x"), "need")
        full = _full_sets(docs, written(keys.join(_sent(need), "x"), "need"))
    while not large.isEmpty():
        found, cells, parts = _divided(written(_with_sets(large, full), "large"), level)
        links.append(found)
        small, large = _fitting(cells, sets)
        ready.append(_partnered(small.unionByName(sets.select("x", "n", "hist").join(_sent(written(parts, "parts")), "x"))))
        large, level = large.select("r", "x", "settled"), level + 1
    rows = written(reduce(DataFrame.unionByName, ready), "ready")
    need = written(keys.join(_sent(rows), "x"), "need")
    texts = _with_texts(docs, need).select("r", "x", "settled", "d1", "d2", "text")
    named = sets.select(F.coalesce("doc_id", F.lit(0)).alias("rep"), "h").join(_sent(need.select(F.coalesce("rep", F.lit(0)).alias("rep"), "h")), ["rep", "h"])
    if named.count() != need.count():  # repeated rows, or texts of one hash
        texts = texts.groupBy("r", "x", "settled", "d1", "d2", F.md5("text").alias("other")).agg(F.first("text").alias("text")).drop("other")
    links.append(written(_joined(texts), "links"))
    edges = reduce(DataFrame.unionByName, links).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    labels = connected(edges).select(F.col("v").alias("x"), "c")
    return sets.select("doc_id", "h", "n", "d1", "d2"), points.select("x", "rep", "d1", "d2"), labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text): doc_id, n_shingles and component_id, the least id that links reach."""
    ship(docs.sparkSession)
    rows, points, labels = _classes(docs.select("doc_id", "text"))
    least = labels.join(points.select("x", "rep"), "x").groupBy("c").agg(F.min("rep").alias("least"))
    reached = labels.join(least, "c").select("x", "least")
    known = points.join(reached, "x", "left").select("d1", "d2", F.coalesce("least", "rep").alias("component"))
    found = rows.join(known, ["d1", "d2"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the least id (rows without id come last), then of the least text hash.

    Of rows that are equal in id and text, the one with the least hash of all columns stays.
    Rows without words link with nothing, and all stay.
    """
    ship(docs.sparkSession)
    rows, points, labels = _classes(docs.select("doc_id", "text"))
    named = rows.where("n > 0").join(points.select("d1", "d2", "x"), ["d1", "d2"]).join(labels, "x", "left").withColumn("c", F.coalesce("c", "x"))
    kept = named.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")).alias("k")).select("k.*")
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), _text_hash().alias("h"), has_words.alias("words"))
    one = keyed.where("words").drop("words").join(kept, ["none", "id", "h"]).groupBy("none", "id", "h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return one.select("row.*").unionByName(keyed.where("NOT words").select("row.*"))
