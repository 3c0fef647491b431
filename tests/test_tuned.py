"""Tuners that move signals once."""

import numpy as np
import pytest

from diffusio.functions import measures as M
from diffusio.graph import Graph, Signal
from diffusio.operators import filters as O
from diffusio.operators.blocks import Blocks
from diffusio.plans import tuning as T


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(5)
    pairs = {(f"a{a}", f"b{b}") for a, b in rng.integers(0, 20, (90, 2))}
    return Graph.from_pairs(spark, sorted(pairs)).stored()


SEEDS = [f"{c}{i}" for c in "ab" for i in range(0, 20, 2)]


def _counted(monkeypatch):
    """How often signals are moved."""
    n, conv = [], O.conv
    monkeypatch.setattr(O, "conv", lambda *a: (n.append(1), conv(*a))[1])
    return n


@pytest.mark.parametrize("kind", [O.Impulse, O.LowPass])
def test_filters_with_fixed_steps_are_tuned_from_hops(spark, graph, monkeypatch, kind):
    n, seeds = _counted(monkeypatch), [s for s in SEEDS if graph.nodes.where(f"id = '{s}'").count()]
    make = lambda w: kind(w, error="iters", max_iters=3)
    training, validation = T.halves(Signal.of(graph, seeds).stored(), 0.5)
    measure = M.Cos(validation, exclude=training)
    points = [[1.0, 0.3], [0.5, 0.5], [0.2, 0.9]]
    got = T._filters_in_hops(make, [1.0, 1.0], graph, training, measure)(points)
    assert len(n) == 2
    assert got == pytest.approx([-measure(make(w).rank(graph, training)) for w in points])


def test_all_turns_of_hop_weights_are_one_job(spark, graph, monkeypatch):
    n, seeds = _counted(monkeypatch), [s for s in SEEDS if graph.nodes.where(f"id = '{s}'").count()]
    tuner = T.ParameterTuner(highest=[1.0] * 3, training=0.5, measure=M.Cos, deviation_tol=1e-3, divide_range=2)
    ranks = tuner.rank(graph, seeds).to_dict()
    assert len(n) == 3
    ranker, p = tuner.tune(graph, seeds)
    assert ranks == pytest.approx(ranker.rank(graph, p).to_dict())


def test_blocks_move_as_edges_do(spark, graph):
    table = graph.nodes.where("id LIKE 'a%'").selectExpr("id", "array(1.0D, length(id) * 1.0D) AS p")
    n = O.Normalization("symmetric")
    rows = lambda df: {r["id"]: list(r.asDict().values())[1:] for r in df.collect()}
    got, want = rows(Blocks(graph, n).hops(table, 2, 4)), rows(O.moved_hops(graph, n, table, 2, 4))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_hop_tuner_moves_parts_together(spark, graph, monkeypatch):
    n, seeds = _counted(monkeypatch), [s for s in SEEDS if graph.nodes.where(f"id = '{s}'").count()]
    ranks = T.HopTuner(hops=4).rank(graph, seeds).to_dict()
    assert len(n) == 3
    ranker, p = T.HopTuner(hops=4).tune(graph, seeds)
    assert ranks == pytest.approx(ranker.rank(graph, p).to_dict())
