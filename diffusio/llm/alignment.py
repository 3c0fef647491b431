"""Alignment of two tokenizers over the same texts.

Each tokenizer's tokens end at byte offsets of the text. The ends are marked in packed bitsets;
their AND has the offsets at which both end, which cut the text into groups. The number of
marks up to a cut (a popcount) is the number of tokens before it, so cuts map to token ranges on both
sides; within a group every token of one side is linked with every one of the other.

Texts are worked through in blocks of a few megabytes. A block holds the distinct id pairs of
all its texts, with how many texts have each; so pairs are counted over the corpus from one row for a
block and pair, and the counts come back to the block the same way: what is shuffled
are distinct pairs of blocks, not links, and a pair of every text has one row a block.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from diffusio.llm.tokens import byte_values, encoder
from diffusio.session import ship, written

#: Texts of a block, in bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
#: Links that are expanded at once; larger groups are expanded by distinct ids.
MOST_LINKS = 1 << 12
_DOC = "doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, n_pairs: long"
BLOCK = f"block long, docs array<struct<{_DOC}>>, pairs array<long>, holders array<int>, places binary, times binary"
COUNTED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_sides: dict[str, ByteTokens | PieceTokens] = {}


class ByteTokens:
    """Side A: a byte-level vocabulary file. Strings of special tokens in texts are plain text."""

    def __init__(self, path: str):
        self.encoder = encoder(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        byte = byte_values()
        self.bytes = [b""] * self.encoder.size
        for token, i in vocabulary.items():
            # an added token's string isn't byte-level text, and no plain text gives it
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [array("I", self.encoder.encode_plain(t)).tolist() for t in texts]


class PieceTokens:
    """Side B: a piece model, which puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.model.id_to_piece(i)) for i in ids)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def _side(kind: type, path: str):
    """A tokenizer with its tables, kept for the life of the process."""
    if path not in _sides:
        side = _sides[path] = kind(path)
        side.lengths = np.array([len(b) for b in side.bytes], dtype=np.int64)
    return _sides[path]


class Marks:
    """A packed bitset of byte offsets (from 1) with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def of(cls, ends: np.ndarray, size: int) -> Marks:
        flags = np.zeros((size // 64 + 1) * 64, dtype=bool)
        flags[ends] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Marks) -> Marks:
        return Marks(self.words & other.words)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks there are up to each offset."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        low = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self) -> np.ndarray:
        """The offsets of all marks, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


def cuts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For byte lengths of two tokenizations of one text: how many tokens of each come before the end of each group."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    size = int(ends_a[-1])
    marks_a, marks_b = Marks.of(ends_a, size), Marks.of(ends_b, size)
    shared = (marks_a & marks_b).select()
    return marks_a.rank(shared), marks_b.rank(shared)


def links(a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs, as a * 2**32 + b, that groups link, and how many links each has."""
    n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    wide = n_a * n_b > MOST_LINKS
    rows_b = np.where(wide, 0, n_b)  # links of each token of A in its group
    each = np.repeat(rows_b, n_a)
    left = np.repeat(a, each)
    start = np.repeat(to_b - n_b, n_a)
    right = b[np.repeat(start - (np.cumsum(each) - each), each) + np.arange(len(left))]
    keys, times = [left << 32 | right], [np.ones(len(left), dtype=np.int64)]
    for g in np.flatnonzero(wide):
        (ids_a, c_a), (ids_b, c_b) = (np.unique(x[end - n : end], return_counts=True) for x, end, n in ((a, to_a[g], n_a[g]), (b, to_b[g], n_b[g])))
        keys.append((ids_a[:, None] << 32 | ids_b[None, :]).ravel())
        times.append((c_a[:, None] * c_b[None, :]).ravel())
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(times))
    return found, total


class Listing:
    """Groups as text: ids of A by commas, a bar, ids of B by commas; groups by semicolons."""

    def __init__(self, size_a: int, size_b: int):
        def names(n: int, mark: str) -> np.ndarray:
            return np.array([f"{i}{mark}" for i in range(n)], dtype=object)

        self.a, self.a_last, self.b, self.b_last = names(size_a, ","), names(size_a, "|"), names(size_b, ","), names(size_b, ";")

    def text(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        out = np.empty(len(a) + len(b), dtype=object)
        # a token's place is its number and those of the other side before it
        place_a, place_b = np.arange(len(a)) + np.repeat(to_b - n_b, n_a), np.arange(len(b)) + np.repeat(to_a, n_b)
        out[place_a], out[place_b] = self.a[a], self.b[b]
        out[place_a[to_a - 1]], out[place_b[to_b - 1]] = self.a_last[a[to_a - 1]], self.b_last[b[to_b - 1]]
        return "".join(out.tolist())[:-1]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of texts with their groups and distinct pairs (BLOCK), written once.

    places and times (32-bit numbers): for each text in turn the places of its pairs in pairs,
    and how many links they have.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = _side(ByteTokens, path_a), _side(PieceTokens, path_b)
        listing = Listing(len(a_side.bytes), len(b_side.bytes))
        number, held = TaskContext.get().partitionId() << 40, 0
        docs: list[tuple] = []
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            pairs, places, holders = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            columns = ([number], [docs], [pairs], [holders.astype(np.int32)], [places.astype("<u4").tobytes()], [np.concatenate(times).astype("<u4").tobytes()])
            row = pa.struct([pa.field(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (x.split(":")[0] for x in _DOC.split(", "))])
            kinds = (pa.int64(), pa.list_(row), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "docs", "pairs", "holders", "places", "times"])

        for batch in batches:
            for lo, hi in _runs(batch.column("text")):
                texts = [t or "" for t in batch.column("text")[lo:hi].to_pylist()]
                ids_a, ids_b = a_side.encode([" " + t for t in texts]), b_side.encode(texts)
                for doc, text, a, b in zip(batch.column("doc_id")[lo:hi].to_pylist(), texts, ids_a, ids_b, strict=True):
                    said = b" " + text.encode()
                    held += len(said)
                    if not text or any(b"".join(map(side.bytes.__getitem__, ids)) != said for side, ids in ((a_side, a), (b_side, b))):
                        docs.append((doc, 0, 0, 0, 0, "", 0))
                        continue
                    a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
                    to_a, to_b = cuts(a_side.lengths[a], b_side.lengths[b])
                    found, n = links(a, b, to_a, to_b)
                    keys.append(found)
                    times.append(n)
                    docs.append((doc, len(a), len(b), len(to_a), int(n.sum()), sha256(listing.text(a, b, to_a, to_b).encode()).hexdigest(), len(found)))
                if held > BLOCK_BYTES:
                    keys, times = keys or [np.zeros(0, np.int64)], times or [np.zeros(0, np.int64)]
                    yield block()
                    number, held, docs, keys, times = number + 1, 0, [], [], []
        if docs:
            keys, times = keys or [np.zeros(0, np.int64)], times or [np.zeros(0, np.int64)]
            yield block()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(blocks, BLOCK), "aligned", compression="zstd")


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about an eighth of a block of text each."""
    at = held = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        held += n
        if held > BLOCK_BYTES // 8:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, a, b, count (texts of the corpus that hold the pair linked) and best, whether count is the highest of a."""
    rows = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = written(rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("count")), "pairs", compression="zstd")
    counts = counts.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "count")
    # as many rows as side A has ids at most
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers, for every row of docs (doc_id, text).

    Returns doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the highest
    of their A id), count_sum (of the counts of all links) and groups_sha256. The text that is compared
    is a space and the row's text.

    Defined cases: null and empty texts, and those which a side doesn't give back byte by byte
    (piece models change some characters), have no tokens: zeros, and '' for the digest; texts
    of any length and groups of any size are taken whole; repeated rows, and rows without id, count as texts
    each; an empty table gives no rows; other columns are not read, whatever their names.
    """
    ship(docs.sparkSession)
    blocks = aligned(docs, path_a, path_b)
    asked = blocks.select(F.col("block").alias("asking"), F.explode("pairs").alias("pair"))
    told = asked.join(pair_counts(blocks).select("pair", "count", "best"), "pair")

    def counted(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        order = np.argsort(right.column("pair").to_numpy(), kind="stable")  # as the block's pairs are
        count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        for row in left.to_pylist():
            places, times = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("places", "times"))
            at = 0
            for d in row["docs"]:
                p, t = places[at : at + d["n_pairs"]], times[at : at + d["n_pairs"]]
                at += d["n_pairs"]
                out.append((d["doc_id"], d["n_a"], d["n_b"], d["n_groups"], d["n_links"], int(t[best[p]].sum()), int((t * count[p]).sum()), d["groups_sha256"]))
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in COUNTED.split(", ")])

    rows = blocks.select("block", "docs", "places", "times")
    return rows.groupBy("block").cogroup(told.groupBy("asking")).applyInArrow(counted, COUNTED)


def token_groups(text: str, path_a: str, path_b: str) -> list[tuple[list[int], list[int]]]:
    """The groups of one text: ids of A and of B. Empty if the text has no tokens."""
    a_side, b_side = _side(ByteTokens, path_a), _side(PieceTokens, path_b)
    a, b = a_side.encode([" " + text])[0], b_side.encode([text])[0]
    if not text or any(b"".join(s.bytes[i] for i in ids) != b" " + text.encode() for s, ids in ((a_side, a), (b_side, b))):
        return []
    to_a, to_b = cuts(a_side.lengths[a], b_side.lengths[b])
    return [(a[i:j], b[k:m]) for i, j, k, m in zip([0, *to_a[:-1]], to_a, [0, *to_b[:-1]], to_b, strict=True)]
