"""Similarity by projections without tables of projections."""

import numpy as np
import pytest

from diffusio.graph import Graph, Signal
from diffusio.operators import projections


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(3)
    pairs = {(f"a{a}", f"b{b}") for a, b in rng.integers(0, 30, (150, 2))} | {("x", "y"), ("y", "z")}
    return Graph.from_pairs(spark, sorted(pairs)).stored()


def test_similarity_moves_one_number_a_node(spark, graph, monkeypatch):
    sim = projections.CoSimRank(dims=40, sparsity=3.0)
    rows = {r["id"]: (np.array(r["own"]), np.array(r["moved"])) for r in sim.projections(graph).collect()}
    p = {"x": 1.0, "a1": 2.0}
    on = sum(rows[k][0] * v for k, v in p.items())
    monkeypatch.setattr(projections, "rank_slots", None)
    got = projections.CoSimRank(dims=40, sparsity=3.0).rank(graph, Signal.of(graph, p)).to_dict()
    assert got == pytest.approx({k: float(on @ m) for k, (_, m) in rows.items()})
