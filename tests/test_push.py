import pytest
from pyspark.sql import functions as F

from diffusio.graph import Graph, Signal
from diffusio.operators import filters as O
from diffusio.streaming.push import PushRanker


def seed(nodes):
    return nodes.select("id", (F.col("id") == "0").cast("double").alias("value"))


def test_pushes_reach_the_full_run_and_little_else(spark, tmp_path, directed=False):
    """After each batch, scores are those of a whole run; a batch far from the seed reaches few rows; a repeated batch changes nothing."""
    ring = [(str(i), str((i + 1) % 60)) for i in range(60)] + [("0", "5")]
    batches = [ring[:45], ring[45:] + [("30", "31")], [("31", "33"), ("33", "31")], [("31", "33")]]
    ranker, seen = PushRanker(str(tmp_path / "state"), seed, 0.5, 1e-4, directed), []
    for k, pairs in enumerate(batches):
        ranker.add(spark.createDataFrame(pairs, "a string, b string"), k)
        seen += pairs
        if k == 2:
            graph = Graph.from_pairs(spark, sorted(set(seen) if directed else {tuple(sorted(p)) for p in seen}), directed).stored()
            want = O.PageRank(0.5, quotient=False, normalization="col", error="iters", max_iters=13).rank(graph, Signal.of(graph, ["0"])).to_dict()
            got = {r["id"]: r["value"] for r in ranker.scores(spark).collect()}
            assert got.keys() == want.keys() and all(got[n] == pytest.approx(v, abs=1e-3) for n, v in want.items())
    assert 0 < ranker.touched < 12  # of 60
    last = {r["id"]: r["value"] for r in ranker.scores(spark).collect()}
    ranker.add(spark.createDataFrame(batches[2], "a string, b string"), 2)  # once more, as after a failure
    assert {r["id"]: r["value"] for r in ranker.scores(spark).collect()} == pytest.approx(last)
