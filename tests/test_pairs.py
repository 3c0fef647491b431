"""Pairs two steps apart, found by parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffusio.functions.measures import similarities
from diffusio.graph import Graph
from diffusio.operators import pairs
from diffusio.plans import recipes as R


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(7)
    return Graph.from_pairs(spark, sorted({(f"a{a}", f"a{b}") for a, b in rng.integers(0, 40, (90, 2))}), True).stored()


def test_pairs_two_steps_apart_without_a_shuffle_of_paths(spark, graph, monkeypatch):
    monkeypatch.setattr(pairs, "PART", 7)
    monkeypatch.setattr(pairs, "BATCH", 3)
    found = pairs.within_two(graph)
    got, want = [tuple(r) for r in found.collect()], {tuple(r) for r in graph.hops(2).collect()}
    assert len(got) == len(want) and set(got) == want
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("kind", ["dot", "cos"])
def test_links_are_those_of_all_pairs(spark, graph, monkeypatch, kind):
    monkeypatch.setattr(pairs, "PART", 7)
    scores = graph.nodes.where("id <> 'a3'").select(F.explode(F.array(F.lit("g"), F.lit("h"))).alias("group_id"), "id").withColumn("value", F.pmod(F.xxhash64("id", "group_id"), F.lit(5)) / 4)
    far = graph.hops(2).join(graph.edges.select("src", "dst"), ["src", "dst"], "left_anti").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    rows = {}
    for r in similarities(far, scores, kind).collect():
        rows.setdefault(r["u"], []).append((-r["similarity"], r["v"]))
    got = {}
    for r in R.predict_links(graph, scores, 2, kind).collect():
        got.setdefault(r["src"], {})[r["place"]] = (r["similarity"], r["dst"])
    assert got.keys() == rows.keys()
    for u, all_ in rows.items():
        assert [got[u][i + 1][0] for i in range(len(got[u]))] == pytest.approx([-s for s, _ in sorted(all_)[:2]])
        if kind == "dot":
            assert [got[u][i + 1][1] for i in range(len(got[u]))] == [v for _, v in sorted(all_)[:2]]
