"""Exact duplicates by Grace hashing, compared by complete contents.

1. Each task strips its texts and combines equal ones in an open-addressing table, chunk by
   chunk. What it writes are records: one content with the rows that have it in that chunk. The
   records are the spill files; their contents move on, the rows behind them stay.
2. Records are dealt into buckets by hash, one bucket a task. A task puts contents into an
   open-addressing table until they reach ``table_bytes``. From then on records whose content is in
   the table are still counted, and the others are spilled for the next round, which deals
   them by another hash; so a content is wholly in a table or wholly spilled.
3. A content in very many records (one a chunk at most) is first combined in salted buckets.
4. What a table found goes back to the rows by the record's number, which is unique, so a
   large group isn't one key of any join.

Hashes deal records out and start the search; whether two contents are equal is decided by
comparing all their bytes.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from diffusio.session import ship, written

#: Bytes of distinct contents that a bucket's table may hold.
TABLE_BYTES = 1 << 26
#: Bytes of contents, and rows, that a task combines before it writes them.
CHUNK_BYTES, CHUNK_ROWS = 1 << 25, 100_000
#: Contents in more records than this are combined in salted buckets first.
HOT_RECORDS = 1_000
#: Hot contents at most; more than that can't have a millionth of all records each.
MOST_HOT = 1_000_000
#: Fixed value: the characters left out when texts are compared, [\x20\x09-\x0D].
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"

BATCH_BYTES = 1 << 22
_BEST = "best_chars long, best_doc long, best_record long, best_place int"
RECORD = f"record long, h long, content binary, bytes long, size long, {_BEST}, sha binary, rows array<struct<doc_id: long, n_chars: long>>"
FOUND = f"spilled boolean, record long, entry long, h long, content binary, bytes long, size long, {_BEST}"


class ContentTable:
    """Contents by open addressing with linear probing. The hash finds a slot, all bytes decide."""

    def __init__(self) -> None:
        self.slots, self.hashes, self.contents = array("q", [-1]) * 1024, array("q"), []

    def find(self, h: int, content: bytes) -> int:
        """The number of an equal content, or -1."""
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e
            at = (at + 1) & mask
        return -1

    def add(self, h: int, content: bytes) -> int:
        """The number of a content that isn't there yet."""
        self.hashes.append(h)
        self.contents.append(content)
        if 2 * len(self.contents) > len(self.slots):
            self.slots = array("q", [-1]) * (4 * len(self.slots))
            for e in range(len(self.contents)):
                self._place(e)
        else:
            self._place(len(self.contents) - 1)
        return len(self.contents) - 1

    def _place(self, e: int) -> None:
        mask = len(self.slots) - 1
        at = self.hashes[e] & mask
        while self.slots[at] >= 0:
            at = (at + 1) & mask
        self.slots[at] = e


def fingerprint(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _better(a: tuple, b: tuple) -> tuple:
    """Of (n_chars, doc_id, record, place): the most characters, then the least id (null last), then the first row."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[3]))


def _split(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about BATCH_BYTES each."""
    at = held = 0
    for k, n in enumerate(lengths):
        held += n
        if held > BATCH_BYTES:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of a task's rows (doc_id, text), combined by chunks."""
    base, made = TaskContext.get().partitionId() << 40, 0
    table, digests, rows, held, n_rows = ContentTable(), [], [], 0, 0

    def records() -> Iterator[pa.RecordBatch]:
        for lo, hi in _split([len(c) + 16 * len(r) for c, r in zip(table.contents, rows, strict=True)]):
            numbers = range(base + made + lo, base + made + hi)
            best = []
            for record, group in zip(numbers, rows[lo:hi], strict=True):
                first = (group[0][1], group[0][0], record, 0)
                for k, (doc, chars) in enumerate(group):
                    first = _better(first, (chars, doc, record, k))
                best.append(first)
            flat = [x for group in rows[lo:hi] for x in group]
            ends = np.cumsum([0, *map(len, rows[lo:hi])]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64())], names=["doc_id", "n_chars"])
            contents = table.contents[lo:hi]
            columns = {
                "record": pa.array(numbers, pa.int64()),
                "h": pa.array(table.hashes[lo:hi], pa.int64()),
                "content": pa.array(contents, pa.binary()),
                "bytes": pa.array(map(len, contents), pa.int64()),
                "size": pa.array(map(len, rows[lo:hi]), pa.int64()),
                **{name: pa.array([x[k] for x in best], kind) for k, (name, kind) in enumerate((("best_chars", pa.int64()), ("best_doc", pa.int64()), ("best_record", pa.int64()), ("best_place", pa.int32())))},
                "sha": pa.array(digests[lo:hi], pa.binary()),
                "rows": pa.ListArray.from_arrays(pa.array(ends), items),
            }
            yield pa.RecordBatch.from_pydict(columns)

    for b in batches:
        texts = b.column("text").cast(pa.binary())
        chars = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
        for doc, text, n in zip(b.column("doc_id").to_pylist(), texts, chars, strict=True):
            content = (text.as_py() or b"").translate(None, BLANKS)
            digest = sha256(content).digest()
            h = fingerprint(digest)
            e = table.find(h, content)
            if e < 0:
                e = table.add(h, content)
                digests.append(digest)
                rows.append([])
                held += len(content)
            rows[e].append((doc, n))
            n_rows += 1
            if held > CHUNK_BYTES or n_rows >= CHUNK_ROWS:
                yield from records()
                made += len(rows)
                table, digests, rows, held, n_rows = ContentTable(), [], [], 0, 0
    if rows:
        yield from records()


def _bucket(table_bytes: int, go_on: bool):
    """What a bucket's task does: found records with their group's totals, and spilled ones.

    go_on: the groups themselves go on to the next round, as records of their first one.
    """
    kinds = dict(zip([x.split()[0] for x in FOUND.split(", ")], (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = ContentTable(), 0
        first, sizes, best = array("q"), array("q"), []
        records, entries = array("q"), array("q")
        spilled, waiting = [], 0
        for b in batches:
            for record, h, content, size, *of in zip(*(b.column(c).to_pylist() for c in ("record", "h", "content", "size", "best_chars", "best_doc", "best_record", "best_place")), strict=True):
                e = table.find(h, content)
                if e < 0 and held and held + len(content) > table_bytes:
                    spilled.append((True, record, None, h, content, len(content), size, *of))
                    waiting += len(content)
                    if waiting > BATCH_BYTES:
                        yield batch(spilled)
                        spilled, waiting = [], 0
                    continue
                if e < 0:
                    e = table.add(h, content)
                    held += len(content) + 1
                    first.append(record)
                    sizes.append(0)
                    best.append(tuple(of))
                sizes[e] += size
                best[e] = _better(best[e], tuple(of))
                records.append(record)
                entries.append(e)
        if spilled:
            yield batch(spilled)
        if go_on:
            for lo, hi in _split(list(map(len, table.contents))):
                yield batch([(True, first[e], None, table.hashes[e], table.contents[e], len(table.contents[e]), sizes[e], *best[e]) for e in range(lo, hi)])
        for lo in range(0, len(records), 50_000):
            yield batch([(False, r, first[e], table.hashes[e], None, None, sizes[e], *best[e]) for r, e in zip(records[lo : lo + 50_000], entries[lo : lo + 50_000], strict=True)])

    return done


def _round(rows: DataFrame, table_bytes: int, go_on: bool, *keys) -> DataFrame:
    """One round over records: they are dealt by keys, and each bucket's result is written."""
    spark = rows.sparkSession
    total, count = rows.agg(F.sum("bytes"), F.count("bytes")).first()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(count, 2 * (total or 0) // table_bytes + 1))
    dealt = rows.repartition(n, *keys).select("record", "h", "content", "size", "best_chars", "best_doc", "best_record", "best_place")
    return written(dealt.mapInArrow(_bucket(table_bytes, go_on), FOUND), "buckets", compression="zstd")


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, hot_records: int = HOT_RECORDS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text).

    Texts are equal if they are so without the characters [\\x20\\x09-\\x0D]. Of equal ones the row
    with the most code points stays, then the least doc_id.

    Defined cases: a null text counts as empty, and all texts without other characters form
    one group; null ids come last, so that a row without id stays (with a null keep_id) only among such rows;
    of repeated rows exactly one stays; a text longer than ``table_bytes`` has a table of its
    own; an empty table gives no rows; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    records = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_combined, RECORD), "contents", compression="zstd")
    rows = records.drop("sha", "rows")
    counts = rows.groupBy("h").agg(F.count("record").alias("n"))
    most = max(hot_records, (rows.count()) // MOST_HOT)
    hot = written(counts.where(F.col("n") > most), "hot")
    sent = None
    if not hot.isEmpty():
        # fewer than MOST_HOT contents have more than a millionth of the records
        salted = rows.join(F.broadcast(hot), "h").withColumn("salt", F.pmod(F.xxhash64("record"), F.ceil(F.col("n") / most)))
        sent = _round(salted, table_bytes, True, "h", "salt")
        rows = rows.join(F.broadcast(hot), "h", "left_anti").unionByName(sent.where("spilled").select(*rows.columns))
    found, turn = None, 0
    while True:
        out = _round(rows, table_bytes, False, F.xxhash64("h", F.lit(turn)))
        part = out.where("NOT spilled").select("record", "size", "best_doc", "best_record", "best_place")
        found = part if found is None else found.unionByName(part)
        rows, turn = out.where("spilled").select(*rows.columns), turn + 1
        if rows.isEmpty():
            break
    if sent is not None:
        # a spilled one of a salted bucket keeps its number; the others follow their group's first
        links = sent.where("NOT spilled").select("record", "entry")
        followed = links.where("record <> entry").join(found.withColumnRenamed("record", "entry"), "entry").select(*found.columns)
        found = found.unionByName(followed)
    every = records.select("record", "sha", "rows").join(found, "record").select("record", "sha", "size", "best_doc", "best_record", "best_place", F.posexplode("rows").alias("place", "row"))
    kept = (F.col("record") == F.col("best_record")) & (F.col("place") == F.col("best_place"))
    return every.select(F.col("row.doc_id").alias("doc_id"), F.col("best_doc").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), F.col("row.n_chars").alias("n_chars"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows without id stay with their text if no row with an id has it.

    Rows that share id, length and stripped text are taken as one row.
    """
    stays = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("n_chars").alias("_n"), F.col("text_sha256").alias("_sha"))
    text = F.coalesce("text", F.lit(""))
    keys = {"_id": F.col("doc_id"), "_n": F.char_length(text).cast("long"), "_sha": F.sha2(F.regexp_replace(text, "[\\x20\\x09-\\x0D]", "").cast("binary"), 256)}
    rows = docs.select(F.struct("*").alias("_row"), *[v.alias(k) for k, v in keys.items()])
    at = rows["_id"].eqNullSafe(stays["_id"]) & (rows["_n"] == stays["_n"]) & (rows["_sha"] == stays["_sha"])
    return rows.join(stays, at, "left_semi").dropDuplicates(["_id", "_n", "_sha"]).select("_row.*")
