"""What keeps large runs within their disk, memory and time, on small graphs."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffusio import session
from diffusio.graph import Graph
from diffusio.operators import filters as O


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    pairs = {(f"a{a}", f"b{b}") for a, b in rng.integers(0, 30, (150, 2))} | {("x", "y"), ("y", "z")}
    return Graph.from_pairs(spark, sorted(pairs)).stored()


def test_rows_of_zeros_are_not_moved(spark, graph, monkeypatch):
    seen, conv = [], O.conv
    monkeypatch.setattr(O, "conv", lambda e, v, *c: (seen.append(v.count()), conv(e, v, *c))[1])
    table = graph.nodes.select("id", F.when(F.col("id") == "x", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("p"))
    walk = O.GenericFilter((1.0, 1.0, 1.0), error="iters", max_iters=4)
    many = {r["id"]: r["value"] for r in O.rank_slots([walk] * 2, graph, table)[0].collect()}
    assert seen == [1, 1, 2]  # x, then y, then x and z
    one = walk.rank(graph, ["x"]).to_dict()
    assert seen == [1, 1, 2] * 2
    assert all(many[k] == pytest.approx([one[k], 0.0]) for k in one) and one["x"] > 0 and one["z"] > 0


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.length()) if files.apply(i).getName().startswith("shuffle_")}


def test_shuffles_of_a_written_table_are_freed(spark, monkeypatch):
    monkeypatch.setattr(session, "FREED_BYTES", 0)
    before = _shuffle_files(spark)
    kept = session.written(spark.range(1000).repartition(4, "id"), "freed")
    first = _shuffle_files(spark) - before
    time.sleep(1)
    session.written(kept, "next")
    end = time.time() + 20
    while (left := first & _shuffle_files(spark)) and time.time() < end:
        time.sleep(0.2)
    assert first and not left and kept.count() == 1000


def test_edges_that_are_summed_are_not_shuffled_again(spark, monkeypatch):
    plans, written = [], session.written
    from diffusio import graph as G

    monkeypatch.setattr(G, "written", lambda df, name, **o: (plans.append(df._jdf.queryExecution().toString()), written(df, name, **o))[1])
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("d", "b")], "a string, b string")
    one, two = Graph.from_edges(edges).stored(summed=True), Graph.from_edges(edges).stored()
    assert plans[0].count("Exchange") == 0 and plans[2].count("Exchange") > 0
    weights = lambda g: {(r["src"], r["dst"]): r["w"] for r in O.Normalization("symmetric").edges(g).collect()}
    assert weights(one) == pytest.approx(weights(two)) and weights(one)["a", "b"] == pytest.approx(0.5) and len(weights(one)) == 6
