"""A Merkle manifest of a dataset: a tree of digests for each source, and one over the sources.

Every ``FANOUT`` consecutive nodes of a level become one node of the next, the digest of their
hex digests; the last run of a level may be shorter and isn't padded. A single leaf is its own
tree.

* Rows are dealt by ranges of (source, id) and numbered within their source: a row's rank in
  its partition plus the count of the partitions before it. No source is one task.
* Each task climbs its indexed rows with a mountain range: a stack with one open run for each
  level. A leaf is put on the lowest; a run that is full, or ends its level, is carried as
  one node to the level above. Runs whose beginning or end lies in another task can't be
  closed; their nodes come out as edges.
* Edges are merged level by level in Spark, grouped by source and run, so no group has more than
  ``FANOUT`` rows.
* Paths go down from the roots by joins on (source, run), and each leaf folds its path again.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from diffusio.session import ship, written

FANOUT = 16
NODE = "tree string, level int, at long, n long, digest string, kids array<string>"
_STEP = "array<struct<before: string, after: string>>"


def lengths(n: int) -> list[int]:
    """How many nodes each level of a tree of n leaves has, from the leaves to the root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


class Mountains:
    """The open runs of one tree, level by level, for leaves that come in order from any first one."""

    def __init__(self, n: int, at: int):
        self.sizes, self.next = lengths(n), at
        self.open: list[tuple[int, list[str]]] = [(0, [])] * len(self.sizes)

    def push(self, digest: str) -> Iterator[tuple[int, int, str | None, list[str] | None]]:
        """Add the next leaf; gives the nodes (level, at, digest, kids) that it completes."""
        level, at = 0, self.next
        self.next += 1
        while level < len(self.sizes) - 1:
            first, run = self.open[level]
            if not run:
                first = at
            run = [*run, digest]
            last = at % FANOUT == FANOUT - 1 or at == self.sizes[level] - 1
            if not last or first % FANOUT:
                self.open[level] = (first, run)
                if last:  # its beginning is elsewhere: an edge
                    yield from self._edges(level)
                return
            self.open[level] = (0, [])
            digest, level, at = sha256("".join(run).encode()).hexdigest(), level + 1, at // FANOUT
            yield level, at, digest, run
        if len(self.sizes) == 1:
            yield level, at, digest, None  # the only leaf

    def _edges(self, level: int) -> Iterator[tuple[int, int, str, None]]:
        first, run = self.open[level]
        self.open[level] = (0, [])
        for k, digest in enumerate(run):
            yield level, first + k, digest, None

    def close(self) -> Iterator[tuple[int, int, str, None]]:
        """What is open becomes edges."""
        for level in range(len(self.open)):
            yield from self._edges(level)


def _climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with kids, roots and edges of sorted rows (tree, at, n, digest), which may begin and break off anywhere."""
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
    names, rows = [x.split()[0] for x in NODE.split(", ")], []
    now, mountains = None, None

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        rows.clear()
        return out

    for b in batches:
        for tree, at, n, digest in zip(*(b.column(c).to_pylist() for c in ("tree", "at", "n", "digest")), strict=True):
            if now != (tree, at):
                if mountains is not None:
                    rows += [(now[0], level, k, mountains.sizes[0], d, kids) for level, k, d, kids in mountains.close()]
                mountains = Mountains(n, at)
            rows += [(tree, level, k, n, d, kids) for level, k, d, kids in mountains.push(digest)]
            now = (tree, at + 1)
            if len(rows) > 5_000:
                yield batch()
    if mountains is not None:
        rows += [(now[0], level, k, mountains.sizes[0], d, kids) for level, k, d, kids in mountains.close()]
    if rows:
        yield batch()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with at, their number within the tree by order, and n, the tree's size; sorted in each partition.

    Rows that tie in all of order are told apart by where they were read, which is written first.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = ["tree", *order, "_row"]

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tree, rank = TaskContext.get().partitionId(), None, 0
        for b in batches:
            ranks = []
            for x in b.column("tree").to_pylist():
                rank = rank + 1 if x == tree else 0
                tree = x
                ranks.append(rank)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(ranks, pa.int64())], names=[*b.schema.names, "part", "rank"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", part int, rank long"
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(ranked, schema), "ranked")
    sizes = dealt.groupBy("part", "tree").agg(F.count("rank").alias("size"))
    whole = Window.partitionBy("tree")
    before = F.sum("size").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each partition that holds rows of a tree
    bases = written(sizes.select("part", "tree", F.coalesce(before, F.lit(0)).alias("base"), F.sum("size").over(whole).alias("n")), "bases")
    out = dealt.join(bases, ["part", "tree"]).withColumn("at", F.col("base") + F.col("rank"))
    return out.drop("part", "rank", "base", "_row").sortWithinPartitions("tree", "at")


def build(leaves: DataFrame) -> DataFrame:
    """The nodes of all trees of numbered leaves (tree, at, n, digest).

    Returns tree, level, at, n (leaves of the tree), digest, kids; inner nodes once, with kids, and
    the leaf of a tree of one leaf. Other leaves aren't repeated.
    """
    rows = written(leaves.select("tree", "at", "n", "digest").mapInArrow(_climbed, NODE), "climbed")
    inner = rows.where("kids IS NOT NULL OR n = 1")
    edges = rows.where("kids IS NULL AND n > 1")
    top = len(lengths(rows.agg(F.max("n")).first()[0] or 1)) - 1
    size: Column = F.col("n")  # nodes of the level
    carried = None
    for level in range(top):
        loose = edges.where(F.col("level") == level)
        if carried is not None:
            loose = loose.unionByName(carried)
        group = loose.where(size > 1).groupBy("tree", (F.floor(F.col("at") / FANOUT)).alias("at"), "n").agg(F.sort_array(F.collect_list(F.struct("at", "digest"))).alias("run"))
        kids = F.transform("run", lambda x: x["digest"])
        carried = written(group.select("tree", F.lit(level + 1).alias("level"), "at", "n", F.sha2(F.array_join(kids, "").cast("binary"), 256).alias("digest"), kids.alias("kids")), "merged")
        inner = inner.unionByName(carried)
        size = F.ceil(size / FANOUT)
    return inner


def paths(nodes: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """For each lowest run of every tree: tree, at (of the run), kids, subroot, path from the run's node up.

    A path is a list of steps (before, after): the joined digests of a node's siblings on both
    sides. above: tree and path of the trees' roots, which come after their own. A tree of one leaf
    has one row, without kids.
    """
    deep = nodes.select("tree", "level", "at", "n", "digest", "kids")
    top = len(lengths(deep.agg(F.max("n")).first()[0] or 1)) - 1
    roots = deep.where(is_root())
    roots = roots.select("tree", "level", "at", "kids", F.col("digest").alias("subroot"))
    roots = roots.withColumn("path", F.expr(f"CAST(array() AS {_STEP})")) if above is None else roots.join(above.select("tree", "path"), "tree")
    roots = written(roots, "roots")
    lone = roots.where("level = 0").drop("level")
    at = None
    for level in range(top, 0, -1):
        here = roots.where(F.col("level") == level).drop("level")
        if at is not None:
            over = at.select("tree", F.col("at").alias("run"), F.col("kids").alias("run_kids"), "subroot", "path")
            below = deep.where((F.col("level") == level) & ~is_root()).select("tree", "at", "kids", F.floor(F.col("at") / FANOUT).alias("run"))
            here = here.unionByName(below.join(over, ["tree", "run"]).select("tree", "at", "kids", "subroot", stepped("run_kids", "path").alias("path")))
        at = here
    return lone if at is None else at.unionByName(lone)


def stepped(kids: str, path: str) -> Column:
    """The path of a node (at) within the run kids, whose own path is given."""
    place = F.pmod(F.col("at"), F.lit(FANOUT)).cast("int")
    before = F.array_join(F.slice(kids, F.lit(1), place), "")
    after = F.array_join(F.slice(kids, place + 2, F.lit(FANOUT)), "")
    return F.concat(F.array(F.struct(before.alias("before"), after.alias("after"))), F.col(path))


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path lead to."""
    return F.aggregate(path, digest, lambda a, s: F.sha2(F.concat(s["before"], a, s["after"]).cast("binary"), 256))


def encoded(*columns: Column) -> Column:
    """The digest of fields: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""

    def one(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*map(one, columns)).cast("binary"), 256)


#: The letters that tampering lowers.
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


class Manifest(NamedTuple):
    """leaves: tree (null source: '', others 's' and the source), doc_id, at, n, digest, and seen, the digest of the row
    with a changed text. nodes: of the sources' trees, as build() gives them. sources: the leaves of the tree over
    them, with their name. over: its nodes; it is called ''. root: None without rows.
    """

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    over: DataFrame
    root: str | None


def build_manifest(docs: DataFrame, tampered: Column | None = None) -> Manifest:
    """The manifest of docs (doc_id, source, lang, n_chars, text); with ``tampered`` in place of the text, leaves have its digest too."""
    ship(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    digest = encoded(*fields)
    # a changed text is hashed, others have their digest already
    seen = digest if tampered is None else F.when(tampered.eqNullSafe(F.col("text")), digest).otherwise(encoded(*fields[:-1], tampered))
    rows = docs.select(tree.alias("tree"), "doc_id", digest.alias("digest"), seen.alias("seen"))
    leaves = written(numbered(rows, "doc_id", "digest"), "indexed")
    nodes = build(leaves)
    names = nodes.where(is_root()).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    sources = written(numbered(names, "name"), "sources")
    over = build(sources)
    root = over.where(is_root()).select("digest").first()
    return Manifest(leaves, nodes, sources, over, root and root[0])


def is_root() -> Column:
    """Whether a node (level, n) is its tree's root: the level is the least that holds all leaves."""
    level, n = F.col("level").cast("double"), F.col("n")
    return (n <= F.pow(F.lit(float(FANOUT)), level)) & (n > F.pow(F.lit(float(FANOUT)), level - 1))


def prove(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """A proof for each row of docs, and whether its (tampered) row still leads to the root.

    Returns doc_id, leaf, subroot, root, path (the steps from the leaf to the root), folded_root, verified.

    Defined cases: nulls in any column are hashed as ``-``, so null and empty texts differ; a null
    source is a source, the first; null ids come first in their source; repeated rows are leaves
    each, and rows of one id are in the order of their digests; the only row of the only source has an
    empty path and is the root; an empty table gives no rows; other columns are not read.
    """
    manifest = build_manifest(docs, tampered)
    above = with_paths(manifest.sources, paths(manifest.over)).select(F.col("name").alias("tree"), "path")
    out = with_paths(manifest.leaves, paths(manifest.nodes, above)).withColumn("root", F.lit(manifest.root))
    found = out.withColumn("folded_root", folded(F.col("seen"), F.col("path")))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def with_paths(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """Numbered leaves with subroot and path, from the lowest runs of paths()."""
    runs = runs.select("tree", F.col("at").alias("run"), "kids", "subroot", F.col("path").alias("up"))
    rows = leaves.withColumn("run", F.floor(F.col("at") / FANOUT)).join(runs, ["tree", "run"])
    path = F.when(F.col("kids").isNull(), F.col("up")).otherwise(stepped("kids", "up"))
    return rows.withColumn("path", path).drop("run", "kids", "up")


def digest_proofs(proofs: DataFrame) -> DataFrame:
    """proofs with proof_sha256, the digest of all siblings from the leaf to the root, in place of the path."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    return proofs.withColumn("proof_sha256", F.sha2(siblings.cast("binary"), 256)).drop("path")


def lowered(column: str = "text", key: str = "doc_id", share: int = 5) -> Column:
    """text with A-Z lowered where share divides the crc32 of the id's digits."""
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % share == 0
    return F.when(hit, F.translate(column, UPPER, LOWERED)).otherwise(F.col(column))
