"""Readers of graph files as DataFrames, and writers of the same formats.

Lines are read by Spark's text source, so files may be of any size and in any store.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from diffusio.functions.math import safe_div
from diffusio.graph import Graph
from diffusio.session import exists, written

#: Datasets by name: which files they have. Files are expected under the data folder; nothing is downloaded.
REGISTRY: dict[str, dict[str, str]] = {}


def register(name: str, **files: str) -> None:
    """Declare a dataset: files by role (pairs, groups, features, labels), paths below its folder."""
    REGISTRY[name] = {"pairs": "pairs.txt", "groups": "groups.txt", **files}


#: Names of the usual datasets that have pairs and groups, and of those that are small.
USUAL = ("dblp", "youtube", "livejournal", "friendster", "orkut", "eucore", "citeseer", "highschool", "pokec", "polblogs", "polbooks", "maven", "amazon", "graph5", "graph9", "bigraph", "blockmodel", "synthfeats", "pubmed", "cora")
SMALL = ("bigraph", "blockmodel", "citeseer", "eucore", "graph5", "graph9")


def resolve(spark: SparkSession, name: str, folders: Sequence[str]) -> str:
    """The dataset's folder: that in the first of these folders which has it."""
    for folder in folders:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"no {name} in {', '.join(folders)}")


def available(spark: SparkSession, folders: Sequence[str], names: Sequence[str] = USUAL) -> list[str]:
    """Those of the datasets that are there."""
    return [n for n in names if any(exists(spark, f"{folder}/{n}") for folder in folders)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """line (its place: file, start of the split, number in it) and words; comment lines (#) and empty ones are left out."""
    rows = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("number"))
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = rows.where("NOT startswith(value, '#')")
    return rows.select(F.struct("file_path", "file_block_start", "number").alias("line"), words.alias("words")).where("size(words) > 0")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The first two words of each line: a, b."""
    return _lines(spark, path).where("size(words) > 1").select(F.col("words")[0].alias("a"), F.col("words")[1].alias("b"))


def read_groups(spark: SparkSession, path: str, nodes: DataFrame, least: float = 0.01, skip: int = 0, most: int = 20) -> DataFrame:
    """One community a line: group_id, id.

    Words that aren't nodes are dropped. Groups with fewer than ``least`` members (a share of
    nodes below 1) go, then the first ``skip``, and at most ``most`` stay.
    """
    found = written(_lines(spark, path).select("line", F.explode("words").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi"), "groups")
    size = least * nodes.count() if least < 1 else least
    kept = found.groupBy("line").agg(F.count("id").alias("n")).where(F.col("n") >= size).orderBy("line").limit(skip + most)
    kept = kept.withColumn("group_id", F.row_number().over(Window.orderBy("line")) - 1 - skip).where("group_id >= 0")
    return found.join(F.broadcast(kept.select("line", "group_id")), "line").select("group_id", "id")


def read_graph(spark: SparkSession, folder: str, directed: bool = False, pairs: str = "pairs.txt", groups: str | None = "groups.txt", **limits) -> tuple[Graph, DataFrame | None]:
    """A graph and its groups from a folder."""
    graph = Graph.from_edges(read_pairs(spark, f"{folder}/{pairs}"), directed).stored()
    return graph, read_groups(spark, f"{folder}/{groups}", graph.nodes, **limits) if groups else None


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _filled(words: Column, width: int) -> Column:
    """The numbers of a dense row, with zeros up to the width."""
    return F.concat(F.transform(words, lambda x: x.cast("double")), F.array_repeat(F.lit(0.0), F.lit(width) - F.size(words)))


def _spread(words: Column, width: int) -> Column:
    """The numbers of a sparse row (``k=v`` words) at their places, zeros between; the last one of a place counts.

    Entries are sorted, and each is followed by as many zeros as there are places to the next.
    """
    entry = lambda x, i: F.struct(F.split_part(x, F.lit("="), F.lit(1)).cast("int").alias("k"), i.alias("i"), F.split_part(x, F.lit("="), F.lit(2)).cast("double").alias("v"))
    after = lambda es, i: F.when(i + 1 < F.size(es), F.get(es, i + 1)["k"]).otherwise(F.lit(width))
    run = lambda es: lambda e, i: F.when(after(es, i) == e["k"], F.array().cast("array<double>")).otherwise(F.concat(F.array(e["v"]), F.array_repeat(F.lit(0.0), after(es, i) - e["k"] - 1)))
    first = lambda es: F.array_repeat(F.lit(0.0), F.coalesce(F.get(es, F.lit(0))["k"], F.lit(width)))
    return _let(F.array_sort(F.transform(words, entry)), lambda es: F.concat(first(es), F.flatten(F.transform(es, run(es)))))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """id and features: ``id v1 v2 ...`` or ``id k=v ...``; short rows are filled with zeros. Work is linear in the width."""
    rows = _lines(spark, path).select(F.col("words")[0].alias("id"), F.slice("words", 2, 1 << 30).alias("words"))
    sparse = F.exists("words", lambda x: F.contains(x, F.lit("=")))
    last = F.when(F.col("sparse"), F.array_max(F.transform("words", lambda x: F.try_to_number(F.split_part(x, F.lit("="), F.lit(1)), F.lit("9999999999")).cast("int")))).otherwise(F.size("words") - 1)
    rows = rows.select("id", "words", sparse.alias("sparse"))
    width = rows.agg(F.max(last)).first()[0]
    width = 0 if width is None else width + 1
    words = F.col("words")
    return rows.select("id", F.when(F.col("sparse"), _spread(words, width)).otherwise(_filled(words, width)).alias("features"))


def normalized_features(features: DataFrame) -> DataFrame:
    """Rows divided by their sums; rows with sum 0 become 0."""
    cells = _let(F.col("features"), lambda f: _let(F.aggregate(f, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(f, lambda x: safe_div(x, total))))
    return features.select("id", cells.alias("features"))


def groups_of(rows: DataFrame, label: str = "label") -> DataFrame:
    """group_id, id of rows (id, label)."""
    return rows.select(F.col(label).alias("group_id"), "id").distinct()


def features_to_groups(features: DataFrame) -> DataFrame:
    """A group for each feature: the rows where it isn't 0."""
    return features.select("id", F.posexplode("features").alias("group_id", "v")).where("v <> 0").select("group_id", "id")


def one_hot(labels: DataFrame, label: str = "label") -> DataFrame:
    """id and an array with 1 at the label's place among the sorted labels, which must be few."""
    known = labels.select(label).distinct().orderBy(label)
    numbered = known.withColumn("_k", F.row_number().over(Window.orderBy(label)) - 1)
    n = numbered.count()
    return labels.join(numbered, label).select("id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k == F.col("_k")).cast("double")).alias("labels"))


def read_feature_dataset(spark: SparkSession, folder: str, groups: str | None = "groups.txt", **limits) -> tuple[Graph, DataFrame, DataFrame | None]:
    """A graph of pairs.txt, its nodes' features of features.txt with rows that sum to 1, and its groups."""
    graph, found = read_graph(spark, folder, groups=groups, **limits)
    features = normalized_features(read_features(spark, f"{folder}/features.txt"))
    return graph, features.join(graph.nodes, "id", "left_semi"), found


def load_multiple(spark: SparkSession, folder: str, names: list[str] | None = None, **limits) -> Iterator[tuple[str, Graph, DataFrame]]:
    """(name, graph, groups) of registered datasets with groups."""
    for name in names or REGISTRY:
        files = REGISTRY[name]
        graph, groups = read_graph(spark, f"{folder}/{name}", files.get("directed") == "yes", files["pairs"], files["groups"], **limits)
        if groups is not None and groups.take(1):
            yield name, graph, groups


def load_all_communities(spark: SparkSession, folder: str, names: list[str] | None = None, **limits) -> Iterator[tuple[str, Graph, DataFrame]]:
    """(name and group, graph, id) for each group."""
    for name, graph, groups in load_multiple(spark, folder, names, **limits):
        for row in groups.select("group_id").distinct().orderBy("group_id").collect():
            yield f"{name}{row[0]}", graph, groups.where(F.col("group_id") == row[0]).select("id")


def load_one_community(spark: SparkSession, folder: str, names: list[str] | None = None, group: int | None = None, **limits) -> Iterator[tuple[str, Graph, DataFrame]]:
    """(name, graph, id) of one group of each dataset, the last one unless another is given."""
    for name, graph, groups in load_multiple(spark, folder, names, **limits):
        chosen = groups.agg(F.max("group_id")).first()[0] if group is None else group
        yield name, graph, groups.where(F.col("group_id") == chosen).select("id")


def load_graphs(spark: SparkSession, folder: str, names: list[str] | None = None) -> Iterator[Graph]:
    for name in names or REGISTRY:
        yield read_graph(spark, f"{folder}/{name}", REGISTRY[name].get("directed") == "yes", REGISTRY[name]["pairs"], None)[0]


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (id, value), edges (a, b)) of a GML file, read as records that end with a bracket."""
    rows = spark.read.text(path, lineSep="]").select(F.col("value").alias("r"))
    field = lambda name: F.nullif(F.regexp_extract("r", rf'\b{name}\s+"?([^"\s\]]+)"?', 1), F.lit(""))
    nodes = rows.where(r"r rlike '\\bnode\\s*\\[?' AND NOT r rlike '\\bsource\\s'").select(field("id").alias("id"), field("value").alias("value")).where("id IS NOT NULL")
    edges = rows.where(r"r rlike '\\bsource\\s'").select(field("source").alias("a"), field("target").alias("b"))
    return nodes, edges


def read_product_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of similar products, groups (group_id, id)) of blank-line separated product records."""
    rows = spark.read.text(path, lineSep="\n\n").select(F.regexp_extract("value", r"ASIN:\s*(\S+)", 1).alias("id"), F.regexp_extract("value", r"(?m)^\s*group:\s*(.+?)\s*$", 1).alias("group_id"), F.regexp_extract("value", r"similar:\s*\d+([^\n]*)", 1).alias("s")).where("id <> ''")
    pairs = rows.select(F.col("id").alias("a"), F.explode(F.filter(F.split(F.trim("s"), r"\s+"), lambda x: x != "")).alias("b"))
    return pairs, rows.where("group_id <> ''").select("group_id", "id")


def read_profile_groups(spark: SparkSession, path: str, flags: dict[str, int], keywords: dict[str, int] | None = None) -> DataFrame:
    """group_id, id of tab-separated profiles: a column that is 1, or that holds a keyword (keyword: column)."""
    columns = F.split("value", "\t")
    rows = spark.read.text(path).select(columns[0].alias("id"), columns.alias("c"))
    tests: list[tuple[str, Column]] = [(g, F.get("c", k) == "1") for g, k in flags.items()]
    tests += [(w, F.contains(F.get("c", k), F.lit(w))) for w, k in (keywords or {}).items()]
    groups = F.filter(F.array(*[F.when(t, F.lit(g)) for g, t in tests]), lambda x: x.isNotNull())
    return rows.select(F.explode(groups).alias("group_id"), "id")


def write_pairs(pairs: DataFrame, path: str) -> None:
    a, b = pairs.columns[:2]
    pairs.select(F.concat_ws("\t", a, b).alias("value")).write.text(path)


def write_groups(groups: DataFrame, path: str) -> None:
    """One line a group, in the order of group_id; a group is a line of the format, so it must fit in a row."""
    groups.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list("id")), "\t").alias("value")).orderBy("group_id").select("value").write.text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Lines of an id and its features (id, features)."""
    features.select(F.concat_ws("\t", "id", F.array_join(F.transform("features", lambda x: x.cast("string")), "\t")).alias("value")).write.text(path)
