"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words and word stems (first bytes, for inflected languages), pairs
of neighbours and pairs one or two words apart (skip-grams) of a whole text, hashed to
BUCKETS; each counts once a text, however often it occurs. Learning uses at most ``sample``
labelled rows, those with the least hashes of id, text and label, in a fixed order; their
features are made on the executors and are all that reaches the driver. L1 leaves few
weights, which are sent out as sorted arrays; BUCKETS bounds them.

Defined cases: a null or empty text has the score of the bias alone; without labels every
score is 0; repeated rows score alike and count once in learning; rows of one id with
different texts all take its labels; several labels of a row each count, null ones don't;
rows without id are scored, not learnt from; an empty table gives no rows; other columns are
kept in scoring (a column of the result's name is replaced) and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from diffusio.llm.ftrl import Ftrl
from diffusio.llm.text import Words, alphanumeric, mix, slices
from diffusio.session import ship

BITS, SAMPLE, THRESHOLD = 22, 8000, 0.3
BUCKETS = 1 << BITS
_SKIPS, _STEMS = (1, 2, 3), (3, 4, 5, 6)


def features(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For runs of rows: the first row, features and their rows (from 0, each feature once a row), the number of rows.

    wanted: flags of the features to return, those with a weight; it makes scoring fast.
    """
    table = alphanumeric()
    for lo, _, buf, offsets in slices(column):
        words = Words(buf, offsets, table)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(words.bounds))
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def add(h: np.ndarray, rows: np.ndarray) -> None:
            """Features of one kind; those without a weight go at once, so that long texts take little memory."""
            at = (h >> np.uint64(64 - BITS)).astype(np.int64)
            some = slice(None) if wanted is None else wanted[at]  # noqa: B023
            found.append((at[some], rows[some]))  # noqa: B023

        add(words.hashes, row)
        for size in _STEMS:
            long = words.ends - words.starts > size
            add(mix(words.stems(size)[long] + np.uint64(size)), row[long])
        with np.errstate(over="ignore"):
            for skip in _SKIPS:
                same = row[skip:] == row[:-skip]
                add(mix(words.hashes[:-skip] * np.uint64(2 * skip + 1) + words.hashes[skip:])[same], row[skip:][same])
        at, rows = (np.concatenate(c) for c in zip(*found, strict=True))
        yield lo, *_distinct(at, rows), len(offsets) - 1


def _distinct(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(rows * BUCKETS + at)
    return both % BUCKETS, both // BUCKETS


class Model:
    """Sorted features with their weights; bias; known: whether there was anything to learn."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, bias: float, known: bool = True):
        self.at, self.weights, self.bias, self.known = at, weights, bias, known

    def table(self) -> np.ndarray:
        """All weights, dense, for lookups."""
        out = np.zeros(BUCKETS, dtype=np.float32)
        out[self.at] = self.weights
        return out


def fit(rows: list[tuple[np.ndarray, float]], epochs: int = 8, alpha: float = 1.0, l1: float = 5.0, l2: float = 0.0) -> Model:
    """Learn from (distinct features, label) pairs."""
    model = Ftrl(BUCKETS, 1, alpha=alpha, l1=l1, l2=l2)
    bias = Ftrl(1, 1, alpha=alpha, l1=0.0, l2=0.0)
    rng, zero = np.random.RandomState(7), np.zeros(1, dtype=np.int64)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, label = rows[i]
            w, b = model.weights(at), bias.weights(zero)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b.sum(), -35, 35)))
            g = np.array([[p - label]])
            model.step(at, w, np.broadcast_to(g, (len(at), 1)))
            bias.step(zero, b, g)
    some = np.flatnonzero(np.abs(model.z[:, 0]) > l1)
    return Model(some, model.weights(some)[:, 0].astype(np.float32), float(bias.weights()[0, 0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic).

    Rows (id, hash of the text, label) are chosen first, so that no text is shuffled; at most
    ``sample`` of them are broadcast, and as many rows of features come back.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    known = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = rows.select("doc_id", "t").distinct().join(known, "doc_id")
    chosen = chosen.orderBy(F.xxhash64("doc_id", "t"), "doc_id", "t", "toxic").limit(sample)
    rows = rows.join(F.broadcast(chosen), ["doc_id", "t"]).select("doc_id", "t", "toxic", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, at, row, n in features(b.column("text")):
                bounds = np.searchsorted(row, np.arange(n + 1))
                parts = [at[bounds[i] : bounds[i + 1]].astype("<i4").tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, n) for c in ("doc_id", "t", "toxic")), pa.array(parts, pa.binary())], names=["doc_id", "t", "toxic", "at"])

    found = rows.mapInArrow(made, "doc_id long, t long, toxic int, at binary").groupBy("doc_id", "t", "toxic").agg(F.min("at").alias("at"))
    got = found.toArrow().sort_by([("doc_id", "ascending"), ("t", "ascending"), ("toxic", "ascending")])
    if not len(got):
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0, False)
    at = [np.frombuffer(x.as_buffer(), dtype="<i4") for x in got["at"]]
    return fit(list(zip(at, got["toxic"].to_numpy().astype(float), strict=True)))


def score(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """docs with the score (0 to 1) of each whole text in one more column. No shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        table = m.table()
        wanted = table != 0
        for texts in batches:
            out = np.zeros(len(texts))
            if m.known:
                for lo, at, row, n in features(texts, wanted):
                    total = m.bias + np.bincount(row, weights=table[at], minlength=n)
                    out[lo : lo + n] = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.array(out)

    return docs.withColumn(into, scored("text"))
