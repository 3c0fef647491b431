"""Benchmark decontamination by winnowing.

Of every window of WINNOW consecutive K-word hashes the least is kept, in documents and in
benchmark items alike; so any shared run of K + WINNOW - 1 = 13 words keeps at least one
common fingerprint. Document fingerprints are joined with those of the items; around each
match, every 13-word window that covers it is looked up among the items' windows, which
extends hits to all of the shared span. Items of fewer than 13 words have one window, all
their words, and are looked up at every position.

The items' index is broadcast. It holds at most BLOCK_WORDS words: a larger benchmark is read
in blocks that are closed before they pass that size, each joined in turn, and their hits are
united. Items of more than half a block are cut into pieces that overlap by 12 words, so that
no window is lost. Documents are not shuffled for one block.

Defined cases: null texts and null items have no words and hit nothing; items without words
are ignored; texts and items of any length are read whole; repeated rows, and rows without
id, are judged each; equal item_ids count once, a null one is named "null"; empty tables give
no hits; all columns of documents are kept, whatever their names, but one of the given name of
the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from diffusio.llm.text import Words, alphanumeric, grams, slices
from diffusio.session import ship, written

SPAN, K = 13, 5
WINNOW = SPAN - K + 1
BLOCK_WORDS = 2_000_000
RESULT = "n_words long, hits binary, items array<string>"
_TYPE = pa.struct([("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])


def winnow(h: np.ndarray, bounds: np.ndarray, window: int = WINNOW) -> np.ndarray:
    """Positions whose value is the least of some window of consecutive values of its row.

    A row with fewer values than a window is one window.
    """
    n = len(h)
    if not n:
        return np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = bounds[row + 1] - 1
    least = h.copy()  # least of the values from here on, window many, within the row
    for j in range(1, window):
        at = np.minimum(np.arange(n) + j, last)
        np.minimum(least, h[at], out=least)
    kept = np.zeros(n, dtype=bool)
    starts = (np.arange(n) + window - 1 <= last) | (np.arange(n) == bounds[row])
    for j in range(window):
        at = np.arange(n) + j
        ok = starts & (at <= last)
        some = np.flatnonzero(ok)
        kept[some[h[some + j] == least[some]] + j] = True
    return np.flatnonzero(kept)


class Index:
    """Fingerprints and windows of some items."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(names)}
        self.names = np.array(names, dtype=object)
        prints: list[np.ndarray] = [np.zeros(0, np.uint64)]
        by_width: dict[int, list[tuple[np.ndarray, int]]] = {}
        for name, hashes in items:
            words = Words.__new__(Words)
            words.hashes, words.bounds = hashes, np.array([0, len(hashes)])
            width = min(SPAN, len(hashes))
            if not width:
                continue
            if width == SPAN:
                h, bounds = grams(words, K)
                prints.append(h[winnow(h, bounds)])
            by_width.setdefault(width, []).append((grams(words, width)[0], number[name]))
        self.prints = np.unique(np.concatenate(prints))
        #: width: sorted window hashes, where the items of each begin, and the items
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width, parts in by_width.items():
            h = np.concatenate([p for p, _ in parts])
            who = np.concatenate([np.full(len(p), i) for p, i in parts])
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
            h, who = h[new], who[new]
            values, first = np.unique(h, return_index=True)
            self.windows[width] = values, np.append(first, len(h)), who

    def __len__(self) -> int:
        return len(self.windows)


def _found(sorted_values: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the values, and where."""
    if not len(sorted_values) or not len(h):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    at = np.minimum(np.searchsorted(sorted_values, h), len(sorted_values) - 1)
    some = np.flatnonzero(sorted_values[at] == h)
    return some, at[some]


def _hash_at(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width words from each start, as grams() has them."""
    words = Words.__new__(Words)
    words.hashes = hashes[(starts[:, None] + np.arange(width)[None, :]).ravel()]
    words.bounds = np.arange(0, len(words.hashes) + 1, width)
    return grams(words, width)[0]


def hits(index: Index, words: Words) -> Iterator[tuple[int, np.ndarray, set[str]]]:
    """For rows with hits: the row, the numbers of its hit words, and the items."""
    n, bounds = len(words.hashes), words.bounds
    counts = np.diff(bounds)
    row_of = np.repeat(np.arange(len(counts)), counts)
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for width in index.windows:
        if width == SPAN:
            h, gram_bounds = grams(words, K)
            picked = winnow(h, gram_bounds)
            some, _ = _found(index.prints, h[picked])
            at = picked[some]
            row = np.searchsorted(gram_bounds, at, "right") - 1
            at = at - gram_bounds[row] + bounds[row]  # word numbers
            starts = np.unique((at[:, None] - np.arange(WINNOW)[None, :]).ravel()) if len(at) else at
        else:
            starts = np.arange(n)
        starts = starts[(starts >= 0) & (starts + width <= n)]
        starts = starts[row_of[starts] == row_of[starts + width - 1]] if len(starts) else starts
        for part in np.array_split(starts, max(1, len(starts) // 200_000)):
            some, which = _found(index.windows[width][0], _hash_at(words.hashes, part, width)) if len(part) else (part, part)
            if len(some):
                found.append((part[some], which, width))
    by_row: dict[int, tuple[list, set]] = {}
    for starts, which, width in found:
        _, first, who = index.windows[width]
        rows = row_of[starts]
        for lo, hi in zip(*_bounds(rows), strict=True):
            r = int(rows[lo])
            said, items = by_row.setdefault(r, ([], set()))
            said.append((starts[lo:hi, None] + np.arange(width)[None, :]).ravel() - bounds[r])
            for w in np.unique(which[lo:hi]):
                items.update(index.names[who[first[w] : first[w + 1]]])
    for r, (said, items) in by_row.items():
        yield r, np.unique(np.concatenate(said)), items


def _bounds(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    return new, np.append(new[1:], len(rows))


def _items(benchmark: DataFrame, item: str, text: str, most: int) -> DataFrame:
    """name, n and hashes (of the words) of the items that have words, in pieces of at most so many words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in slices(b.column("text")):
                w = Words(buf, offsets, alphanumeric())
                whole = [(b.column("name")[i].as_py(), w.hashes[w.bounds[i - lo] : w.bounds[i - lo + 1]]) for i in range(lo, hi)]
                parts = [(name, h[a : a + most]) for name, h in whole for a in range(0, max(1, len(h) - SPAN + 1), most - SPAN + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([name for name, _ in parts], pa.string()), pa.array([len(h) for _, h in parts], pa.int64()), pa.array([h.tobytes() for _, h in parts], pa.binary())], names=["name", "n", "hashes"])

    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("name"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(hashed, "name string, n long, hashes binary").where("n > 0")


def _judge(index: Index, sc) -> Column:
    sent = sc.broadcast(index)

    @F.arrow_udf(RESULT)
    def judged(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            counts, hit, items = np.zeros(len(t), dtype=np.int64), [b""] * len(t), [[] for _ in range(len(t))]
            for lo, hi, buf, offsets in slices(t):
                w = Words(buf, offsets, alphanumeric())
                counts[lo:hi] = np.diff(w.bounds)
                if len(sent.value):
                    for r, said, names in hits(sent.value, w):
                        hit[lo + r], items[lo + r] = said.astype("<u4").tobytes(), sorted(names)
            yield pa.StructArray.from_arrays([pa.array(counts), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))], fields=list(_TYPE))

    return judged


@F.arrow_udf(T.BinaryType())
def _united(lists: pa.Array) -> pa.Array:
    """Of lists of hit-word numbers, the union."""
    return pa.array([np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in v] or [np.zeros(0, "<u4")])).tobytes() for v in lists.to_pylist()], pa.binary())


def find_contamination(docs: DataFrame, benchmark: DataFrame, into: str = "contamination", text: str = "text", item: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column: n_words, hits (numbers of hit words, unsigned 32-bit), n_hit, items (sorted), contaminated.

    contaminated: some word is hit, and at least one in twenty.
    """
    spark = docs.sparkSession
    ship(spark)
    items = written(_items(benchmark, item, "text", max(block_words // 2, 2 * SPAN)), "items")
    total = items.agg(F.sum("n")).first()[0] or 0

    def indexes() -> Iterator[Index]:
        block: list[tuple[str, np.ndarray]] = []
        size = 0
        for r in items.toLocalIterator():
            if size + r["n"] > block_words and block:
                yield Index(block)
                block, size = [], 0
            block.append((r["name"], np.frombuffer(bytes(r["hashes"]), dtype=np.uint64)))
            size += r["n"]
        yield Index(block)

    if total <= block_words:
        found = docs.withColumn(into, _judge(next(indexes()), spark.sparkContext)(F.col(text)))
    else:
        rows = written(docs.select(F.struct("*").alias("_doc"), F.monotonically_increasing_id().alias("_row")), "documents")
        counts, parts = None, None
        for index in indexes():
            judged = rows.select("_row", _judge(index, spark.sparkContext)(F.col(f"_doc.{text}")).alias("r"))
            if counts is None:  # the first block's rows have the counts of words; others are kept if they have hits
                judged = counts = written(judged, "hits")
            part = judged.where("length(r.hits) > 0").select("_row", "r.hits", "r.items")
            part = part if judged is counts else written(part, "hits")
            parts = part if parts is None else parts.unionByName(part)
        hit = parts.groupBy("_row").agg(F.collect_list("hits").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hit = hit.select("_row", _united(F.col("hits")).alias("hits"), "items")
        one = counts.select("_row", "r.n_words").join(hit, "_row", "left")
        none = F.array().cast("array<string>")
        one = one.select("_row", F.struct("n_words", F.coalesce("hits", F.lit(b"")).alias("hits"), F.coalesce("items", none).alias("items")).alias("_found"))
        found = rows.join(one, "_row").select("_doc.*", F.col("_found").alias(into))
    c = F.col(into)
    n_hit = (F.length(c["hits"]) / 4).cast("long")
    return found.withColumn(into, F.struct(c["n_words"].alias("n_words"), c["hits"].alias("hits"), n_hit.alias("n_hit"), c["items"].alias("items"), ((n_hit > 0) & (20 * n_hit >= c["n_words"])).alias("contaminated")))


def digest_contamination(found: DataFrame, into: str = "contamination") -> DataFrame:
    c = F.col(into)
    names = F.array_join(c["items"], ",")
    return found.select("doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), c["contaminated"].alias("contaminated"))
