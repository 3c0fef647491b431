import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from diffusio.graph import Graph, Signal
from diffusio.operators import filters as O
from diffusio.operators.dictionary import Dictionary, OnNumbers
from diffusio.sources import conversions as C

PAIRS = "# comment\na b 1\nb c 0\n\nc a 1\r\na c 1"
NODES = "a 1 0 x\nb 0 1 y\nc 2 2 x\nd 1 1 z"


def archive(path, kind):
    files = {"net/pairs.txt": PAIRS, "net/nodes.txt": NODES, "net/other.bin": "no lines wanted"}
    if kind == "zip":
        with zipfile.ZipFile(path / "net.zip", "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
    elif kind == "tgz":
        with tarfile.open(path / "net.tgz", "w:gz") as t:
            for name, text in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
    else:
        for name, text in files.items():
            with gzip.open(path / f"{name.split('/')[1]}.gz", "wb") as f:
                f.write(text.encode())
    return str(path)


@pytest.mark.parametrize("kind", ["zip", "tgz", "gz"])
def test_archives(spark, tmp_path, kind):
    place = archive(tmp_path, kind)
    lines = C.archive_lines(spark, place, "*pairs.txt")
    assert [(r["number"], r["value"]) for r in lines.orderBy("number").collect()] == list(enumerate(PAIRS.replace("\r", "").split("\n")))
    how = C.Conversion(pair=lambda w: F.when(F.get(w, F.lit(2)) != "0", F.slice(w, 1, 2)), node_group=lambda n: F.when(n != "c", F.lit("vowels or b")), member_row=lambda w: F.array(F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1)), F.lit("all")))
    pairs = C.converted_pairs(lines, how)
    assert sorted(map(tuple, pairs.collect())) == [("a", "b"), ("a", "c"), ("c", "a")]
    assert C.groups_of_nodes(pairs, how).count() == 0  # one node in all of its rows
    nodes = C.archive_lines(spark, place, "*nodes.txt")
    assert sorted(map(tuple, C.converted_groups(nodes, C.Conversion()).collect())) == [("x", "a"), ("x", "c")]
    assert sorted(map(tuple, C.converted_groups(nodes, how).collect())) == [("all", i) for i in "abcd"] + [("x", "a"), ("x", "c")]
    assert sorted((r["id"], r["features"]) for r in C.converted_features(nodes).collect()) == [("a", [1, 0]), ("b", [0, 1]), ("c", [2, 2]), ("d", [1, 1])]
    assert C.archive_lines(spark, place, "nothing").count() == 0


def shuffled(spark, run):
    """Bytes that stages wrote for shuffles while run() ran."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._jvm.java.util.ArrayList()
    quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(none, False, False, quantiles, none)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_numbers(spark):
    """Numbers are dense and stay; scores are those of names, with fewer bytes a step."""
    names = [f"a-rather-long-name-of-a-node-{(i * 7919) % 100_003:06d}" for i in range(600)]
    pairs = [(names[i], names[(i * 5 + j) % 600]) for i in range(600) for j in (1, 2, 7)]
    graph = Graph.from_pairs(spark, pairs[:-3]).stored()
    known = Dictionary.of(graph.nodes)
    first = {r["id"]: r["number"] for r in known.names.collect()}
    assert sorted(first.values()) == list(range(len(first))) and sorted(first, key=first.get) == sorted(first)
    more = known.extended(spark.createDataFrame([("0 new",), ("zz new",), (names[0],)], "id string"))
    second = {r["id"]: r["number"] for r in more.names.collect()}
    assert {k: second[k] for k in first} == first and sorted(second.values()) == list(range(len(first) + 2)) and more.size == len(first) + 2
    f = O.PageRank(0.85, error="iters", max_iters=3)
    p = Signal.of(graph, names[:5])
    plain, numbered = f.rank(graph, p), OnNumbers(f).rank(graph, p)
    a, b = plain.to_dict(), numbered.to_dict()
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-12) for k, v in a.items()) and plain.iterations == numbered.iterations
    again = OnNumbers(f, more)
    c = again.rank(graph, p).to_dict()
    assert all(c[k] == pytest.approx(v, abs=1e-12) for k, v in a.items())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbers = OnNumbers(f).encoded(graph)[1]
        wide = shuffled(spark, lambda: O.conv(f.normalization.adjacency(graph), graph.nodes.withColumn("v", F.lit(1.0)), "v").write.format("noop").mode("overwrite").save())
        narrow = shuffled(spark, lambda: O.conv(f.normalization.adjacency(numbers), numbers.nodes.withColumn("v", F.lit(1.0)), "v").write.format("noop").mode("overwrite").save())
        assert 0 < narrow < 0.9 * wide
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
