"""Packing of token pieces into sequences of a fixed capacity.

A packing is made on the histogram of lengths, which has at most ``capacity`` entries for
any corpus: it says which sets of lengths share a sequence and how often. The pieces of each
length are numbered, and a piece's number and length give its sequence and place. A number is
a piece's rank among those of its length that the same task has cut, which is written with
it, and the count of those of all tasks before. So places are found without a shuffle of
pieces: what is shuffled are the tasks' counts, at most ``capacity`` of them a task.

What reaches the driver is the histogram; what is sent out is its plan (a few rows a length)
and, if it takes at most BASES_BYTES, the table of counts before each task, which is gathered
as one array for that. A larger table of counts (of more than some 4,000 tasks) is joined by
shuffling instead.

Two ways to pack a histogram:

* ``dominance``: the Martello-Toth reduction first. A set that holds the largest length and
  dominates every other feasible one is fixed for as many sequences as its counts allow: a
  length that nothing fits beside; a pair that fills the sequence; the best partner where no
  two others fit or no two others add up to more. What remains is packed best-fit.
* ``decreasing``: best-fit-decreasing alone.

Best-fit search is by a segment tree over remaining capacities. Sequences of equal contents
are handled together, in the order in which they would come one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from diffusio.llm.tokens import encoder, pieces, tokenized
from diffusio.session import ship, written

BASES_BYTES = 1 << 26
Pattern = tuple  # () or (pattern, length, how many)


class CapacityTree:
    """A segment tree over 0..capacity that finds the least marked number not below a given one."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.marked = bytearray(2 * self.leaves)

    def mark(self, at: int, flag: bool) -> None:
        at += self.leaves
        self.marked[at] = flag
        while at > 1:
            at //= 2
            self.marked[at] = self.marked[2 * at] | self.marked[2 * at + 1]

    def first(self, at: int) -> int | None:
        at += self.leaves
        while not self.marked[at]:
            while at % 2:  # a right child: go up until there is something to the right
                at //= 2
            if at <= 1:
                return None
            at += 1
            if at & (at - 1) == 0:  # wrapped around to the next level
                return None
        while at < self.leaves:
            at = 2 * at if self.marked[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit-decreasing of a histogram: patterns and their numbers of sequences."""
    tree, room = CapacityTree(capacity), [{} for _ in range(capacity + 1)]

    def put(pattern: Pattern, left: int, n: int) -> None:
        if n:
            room[left][pattern] = room[left].get(pattern, 0) + n
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        c = counts[length]
        while c:
            left = tree.first(length)
            if left is None:
                left, pattern, n = capacity, (), -(-c // (capacity // length))
            else:
                pattern, n = room[left].popitem()
                if not room[left]:
                    tree.mark(left, False)
            each = left // length
            full = min(n, c // each)
            put((pattern, length, each), left - each * length, full)
            c, n = c - full * each, n - full
            if c and n:
                put((pattern, length, c), left - c * length, 1)
                c, n = 0, n - 1
            if pattern:
                put(pattern, left, n)
    return [(p, n) for group in room for p, n in group.items()]


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix dominating sets: their patterns and numbers, and the histogram that remains."""
    left = {k: v for k, v in counts.items() if v}
    fixed: list[tuple[Pattern, int]] = []

    def fix(*lengths: int) -> None:
        if len(lengths) == 2 and lengths[0] == lengths[1]:
            n, pattern = left[lengths[0]] // 2, ((), lengths[0], 2)
            left[lengths[0]] -= 2 * n
        else:
            n, pattern = min(left[x] for x in lengths), ()
            for x in lengths:
                left[x] -= n
                pattern = (pattern, x, 1)
        for x in set(lengths):
            if not left[x]:
                del left[x]
        fixed.append((pattern, n))

    changed = True
    while changed:
        changed = False
        for big in sorted(left, reverse=True):
            while big in left:
                small = sorted(left)  # at most capacity many lengths

                def have(x: int, n: int = 1, big: int = big) -> bool:
                    return left.get(x, 0) - (x == big) >= n

                rest = capacity - big
                fits = [x for x in small if x <= rest and have(x)]
                if not fits:
                    n = left.pop(big)
                    fixed.append((((), big, 1), n))
                    changed = True
                    break
                best = fits[-1]
                if best < rest:
                    two = fits[0] + (fits[0] if have(fits[0], 2) else fits[1] if len(fits) > 1 else capacity)
                    if two <= rest:
                        # two more fit; the best partner must outweigh any two, and no three may fit
                        three = two + fits[0]
                        if three <= rest or _best_pair(fits, have, rest) > best:
                            break
                if best == big and left[big] < 2:
                    break
                fix(big, best)
                changed = True
    return fixed, left


def _best_pair(fits: list[int], have, rest: int) -> int:
    """The greatest sum of two lengths that is at most rest."""
    lo, hi, most = 0, len(fits) - 1, 0
    while lo <= hi:
        total = fits[lo] + fits[hi]
        if total > rest:
            hi -= 1
        else:
            if lo < hi or have(fits[lo], 2):
                most = max(most, total)
            lo += 1
    return most


def plan(counts: dict[int, int], capacity: int, method: str) -> list[tuple[Pattern, int]]:
    """Patterns and numbers of sequences for a histogram."""
    if method == "dominance":
        fixed, rest = reduce_dominated(counts, capacity)
        return fixed + best_fit(rest, capacity)
    if method == "decreasing":
        return best_fit(counts, capacity)
    raise ValueError(method)


def entries(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """The plan as rows (length, first number, first sequence, how many in each, place of the first), sorted."""
    rows, base, used = [], 0, {}
    for pattern, n in patterns:
        place = 0
        while pattern:
            pattern, length, each = pattern
            rows.append((length, used.get(length, 0), base, each, place))
            used[length] = used.get(length, 0) + n * each
            place += length * each
        base += n
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def piece_table(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of docs (doc_id, text), written once.

    _task and _rank: the task that cut the piece, and how many of its length it had cut before.
    with_ids: the ids too, as 16-bit numbers where the vocabulary allows, else 32-bit.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if max(encoder(path).size - 1, end) < 1 << 16 else "<u4"
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "_task", "_rank", *["ids"] * with_ids]
        task, had = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for b in batches:
            rows: list[tuple] = []
            for doc, tokens in zip(b.column("doc_id").to_pylist(), tokenized(b.column("text"), path, end), strict=True):
                for k, (start, p) in enumerate(pieces(tokens, capacity)):
                    n = len(p) // 4
                    rows.append((doc, k, start, n, crc32(p), task, had[n], *[np.frombuffer(p, "<u4").astype(kind).tobytes()] * with_ids))
                    had[n] += 1
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _rank long" + ", ids binary" * with_ids
    return written(docs.select("doc_id", "text").mapInArrow(cut, schema), "pieces", compression="zstd")


def pack(table: DataFrame, capacity: int, method: str) -> DataFrame:
    """A piece table with sequence_id and offset in place of _task and _rank."""
    sizes = written(table.groupBy("_task", "length").agg(F.count("length").alias("n")), "sizes")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}
    sent = table.sparkSession.sparkContext.broadcast(entries(plan(counts, capacity, method)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    bases = written(sizes.select("_task", "length", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    tasks = (bases.agg(F.max("_task")).first()[0] or 0) + 1

    def places(n: np.ndarray, r: np.ndarray) -> pa.Array:
        p, shift = sent.value, np.int64(1) << np.int64(46)
        e = p[np.searchsorted(p[:, 0] * shift + p[:, 1], n * shift + r, "right") - 1]
        at = r - e[:, 1]
        return pa.StructArray.from_arrays([pa.array(e[:, 2] + at // e[:, 3]), pa.array(e[:, 4] + at % e[:, 3] * n)], names=["sequence_id", "offset"])

    if tasks * (capacity + 1) * 8 <= BASES_BYTES:
        known = bases.toArrow()
        dense = np.zeros((tasks, capacity + 1), dtype=np.int64)
        dense[known["_task"].to_numpy(), known["length"].to_numpy()] = known["base"].to_numpy()
        base = table.sparkSession.sparkContext.broadcast(dense)

        @F.arrow_udf("sequence_id long, offset long")
        def placed(task: pa.Array, length: pa.Array, rank: pa.Array) -> pa.Array:
            t, n, r = (c.to_numpy(zero_copy_only=False) for c in (task, length, rank))
            return places(n, r + base.value[t, n])

        found = table.withColumn("_at", placed("_task", "length", "_rank"))
    else:

        @F.arrow_udf("sequence_id long, offset long")
        def placed_at(length: pa.Array, number: pa.Array) -> pa.Array:
            return places(*(c.to_numpy(zero_copy_only=False) for c in (length, number)))

        found = table.join(bases, ["_task", "length"]).withColumn("_at", placed_at("length", F.col("_rank") + F.col("base")))
    kept = [c for c in table.columns if c not in ("_task", "_rank")]
    return found.select(*kept, F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Best-fit packing of docs (doc_id, text) after the dominance reduction.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Each text's ids are followed by ``end``. Defined cases: a null or empty text is the id
    ``end`` alone; texts of any length are cut whole; repeated rows, and rows without id, are
    packed each; pieces of equal length take places in the order of tasks and rows; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    return pack(piece_table(docs, path, capacity, end), capacity, "dominance")


def pack_matrices(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, pad: int = 0) -> DataFrame:
    """Best-fit-decreasing packing, written out as matrices: a row per sequence.

    Returns sequence_id, n_segments, n_tokens, ids (capacity unsigned 16- or 32-bit numbers,
    padded), width (bytes of a number), cu_seqlens (cumulative segment lengths from 0) and
    positions_reset (the same without the end: where positions start at 0 again), doc_ids.
    Overlong texts are cut losslessly. Cases as in pack_documents. Ids are stored with their
    pieces and travel in one shuffle, by sequence.
    """
    ship(docs.sparkSession)
    table = piece_table(docs, path, capacity, end, with_ids=True)
    rows = pack(table, capacity, "decreasing").select("sequence_id", "offset", "length", "doc_id", "ids")
    rows = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now: list[tuple] = []

        def close() -> None:
            n, width = sum(x[2] for x in now), len(now[0][4]) // now[0][2]
            filler = np.full(capacity - n, pad, dtype=f"<u{width}").tobytes()
            ends = np.cumsum([x[2] for x in now]).tolist()
            made.append((now[0][0], len(now), n, b"".join(x[4] for x in now) + filler, width, [0, *ends], [0, *ends[:-1]], [x[3] for x in now]))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ["sequence_id", "n_segments", "n_tokens", "ids", "width", "cu_seqlens", "positions_reset", "doc_ids"]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)
            made.clear()
            return out

        for b in batches:
            for x in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if now and now[0][0] != x[0]:
                    close()
                    now = []
                now.append(x)
                if len(made) >= 1000:
                    yield batch()
        if now:
            close()
        if made:
            yield batch()

    return rows.mapInArrow(built, MATRICES)


def write_matrices(packed: DataFrame, path: str) -> None:
    """The matrices as files: Parquet rows of pack_matrices(), ids as raw little-endian numbers, sequences in order in each file."""
    packed.write.option("compression", "zstd").parquet(path)


MATRICES = "sequence_id long, n_segments int, n_tokens int, ids binary, width int, cu_seqlens array<int>, positions_reset array<int>, doc_ids array<long>"


def read_matrices(spark: SparkSession, path: str) -> DataFrame:
    """What write_matrices() has written; numbers() gives a row's ids."""
    return spark.read.schema(MATRICES).parquet(path)


def numbers(row) -> np.ndarray:
    """The ids of one row, padding included."""
    return np.frombuffer(bytes(row["ids"]), dtype=f"<u{row['width']}")


def digest_matrices(packed: DataFrame) -> DataFrame:
    """Checksums and listings of packed rows."""

    def listed(column: str):
        return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")

    return packed.select("sequence_id", F.col("n_segments").cast("long").alias("n_segments"), F.col("n_tokens").cast("long").alias("n_tokens"), F.crc32("ids").alias("row_crc32"), listed("cu_seqlens").alias("cu_seqlens"), listed("positions_reset").alias("positions_reset"), listed("doc_ids").alias("doc_ids"))
