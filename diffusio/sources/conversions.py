"""Published files as tables: archives, and rules that turn their lines into pairs, groups and features.

A rule is a function from the column of a line's words to the columns that the table needs, null for lines to leave out;
so rules are part of the plan and run wherever the lines are read.
"""

from __future__ import annotations

import fnmatch
import gzip
import io
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from diffusio.session import ship

Rule = Callable[[Column], Column]
#: Lines of a batch.
LINES = 50_000


@dataclass(frozen=True)
class Conversion:
    """What a dataset's files hold. Rules take words (array of strings) and have to bear lines with few of them (``F.get``).

    pair: [a, b]; node_group: the group of a node, from its name alone (not of words); feature_row: [id, value, ...,
    label]; member_row: [id, group, ...]. least: groups of fewer members are left out.
    """

    pair: Rule = lambda words: words
    node_group: Rule | None = None
    feature_row: Rule = lambda words: words
    member_row: Rule | None = None
    least: int = 2


def archive_lines(spark: SparkSession, path: str, members: str = "*") -> DataFrame:
    """archive, member, number and value: the lines of those members of archives (zip, tar, tgz, gz) that fit a pattern.

    Archives are read by Spark, so they may be in any store; a task reads one archive member by member, as lines. Bytes
    that aren't UTF-8 are replaced. A path of other files gives no rows; for single gz files Spark's text source does as well.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for member, stream in _members(name, io.BytesIO(content.as_buffer())):
                    if not fnmatch.fnmatch(member, members):
                        continue
                    rows, at = [], 0
                    for line in io.TextIOWrapper(stream, "utf-8", "replace"):
                        rows.append(line.rstrip("\r\n"))
                        if len(rows) == LINES:
                            yield _lines(name, member, at, rows)
                            at, rows = at + len(rows), []
                    if rows:
                        yield _lines(name, member, at, rows)

    return files.mapInArrow(lines, "archive string, member string, number long, value string")


def _lines(archive: str, member: str, at: int, rows: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([archive] * n), pa.array([member] * n), pa.array(range(at, at + n), pa.int64()), pa.array(rows, pa.string())], names=["archive", "member", "number", "value"])


def _members(name: str, content: io.BytesIO) -> Iterator[tuple[str, io.IOBase]]:
    """Names and contents of an archive's files."""
    if zipfile.is_zipfile(content):
        with zipfile.ZipFile(content) as z:
            for info in z.infolist():
                if not info.is_dir():
                    with z.open(info) as f:
                        yield info.filename, f
    elif name.endswith((".tgz", ".tar.gz", ".tar")):
        content.seek(0)
        with tarfile.open(fileobj=content) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info)
    elif name.endswith(".gz"):
        content.seek(0)
        yield name.rsplit("/", 1)[-1].removesuffix(".gz"), gzip.GzipFile(fileobj=content)


def words_of(lines: DataFrame, value: str = "value") -> DataFrame:
    """words of each line; comments (#) and empty lines are left out."""
    words = F.filter(F.split(F.trim(value), r"\s+"), lambda x: x != "")
    return lines.where(~F.startswith(F.col(value), F.lit("#"))).select(words.alias("words")).where("size(words) > 0")


def _ruled(lines: DataFrame, rule: Rule) -> DataFrame:
    return words_of(lines).select(rule(F.col("words")).alias("r")).where("r IS NOT NULL")


def converted_pairs(lines: DataFrame, how: Conversion = Conversion()) -> DataFrame:  # noqa: B008
    """a and b of lines (value)."""
    return _ruled(lines, how.pair).where("size(r) > 1").select(F.get("r", F.lit(0)).alias("a"), F.get("r", F.lit(1)).alias("b"))


def large_groups(groups: DataFrame, least: int) -> DataFrame:
    """Groups (group_id, id) with so many different members at least."""
    groups = groups.select("group_id", "id").distinct()
    kept = groups.groupBy("group_id").agg(F.count("id").alias("n")).where(F.col("n") >= least)
    return groups.join(kept.select("group_id"), "group_id", "left_semi")


def groups_of_nodes(pairs: DataFrame, how: Conversion) -> DataFrame:
    """group_id and id of the first nodes of pairs (a, b), by a rule on their names."""
    rows = pairs.select(how.node_group(F.col("a")).alias("group_id"), F.col("a").alias("id")).where("group_id IS NOT NULL")
    return large_groups(rows, how.least)


def converted_groups(lines: DataFrame, how: Conversion) -> DataFrame:
    """group_id and id of lines that name a node and its groups, or end in its group if there is no rule."""
    if how.member_row is not None:
        rows = _ruled(lines, how.member_row).select(F.explode(F.slice("r", 2, 1 << 30)).alias("group_id"), F.get("r", F.lit(0)).alias("id"))
    else:
        rows = _ruled(lines, how.feature_row).where("size(r) > 1").select(F.try_element_at("r", F.lit(-1)).alias("group_id"), F.get("r", F.lit(0)).alias("id"))
    return large_groups(rows, how.least)


def converted_features(lines: DataFrame, how: Conversion = Conversion()) -> DataFrame:  # noqa: B008
    """id and features (array of numbers) of lines: what stands between the id and the label."""
    rows = _ruled(lines, how.feature_row).where("size(r) > 1")
    return rows.select(F.get("r", F.lit(0)).alias("id"), F.transform(F.slice("r", F.lit(2), F.greatest(F.size("r") - 2, F.lit(0))), lambda x: x.cast("double")).alias("features"))
