import random

import pytest

from diffusio import queries as Q
from diffusio.functions import measures as M
from diffusio.graph import Graph, Signal
from diffusio.operators import fairness, filters as O, postprocess as P
from diffusio.operators.convergence import NotConverged
from diffusio.plans import tuning as T
from diffusio.plans.optimize import optimize


def two_steps():
    return O.PageRank(0.85, error="iters", max_iters=3)


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(5)
    return Graph.from_pairs(spark, [(f"a{i}", f"a{rng.randrange(20)}") for i in range(20) for _ in range(3)]).stored()


def test_rank_many(graph):
    ids = sorted(r["id"] for r in graph.nodes.collect())
    one, two = Signal.of(graph, ids[:3]), Signal.of(graph, ids[2:9])
    table = one.df.withColumnRenamed("value", "x0").join(two.df.withColumnRenamed("value", "x1"), "id")
    got = {r["id"]: r for r in two_steps().rank_many(graph, table).collect()}
    for name, p in (("x0", one), ("x1", two)):
        alone = two_steps().rank(graph, p).to_dict()
        assert all(got[i][name] == pytest.approx(v, abs=1e-12) for i, v in alone.items())


def test_boosting_says_that_it_has_not_settled(graph):
    with pytest.raises(NotConverged):
        P.BoostedSeedOversampling(two_steps(), tol=-1.0, max_iters=3).rank(graph, [graph.nodes.first()["id"]])


def test_rounds_at_once():
    loss = lambda w: (w[0] - 0.3) ** 2 + (w[1] - 0.6) ** 4
    rounds = []
    many = lambda ws: rounds.append(len(ws)) or [loss(w) for w in ws]
    assert optimize(None, [1, 1], many=many) == optimize(loss, [1, 1]) and max(rounds) == 5


def test_queries_take_defaults_on_customers_and_suppliers(spark, monkeypatch):
    """Which ranker and graph the four queries run; defaults in all but the measure and the share of the tuner."""
    seen = []
    for kind in (P.BoostedSeedOversampling, fairness.FairPersonalizer, T.ParameterTuner, T.HopTuner):
        monkeypatch.setattr(kind, "rank", lambda self, graph, signal=None, *a, **b: seen.append((self, graph)) or Signal.of(graph, signal))
    for name in ("boosted_oversample", "fair_personalizer", "parameter_tuner", "hop_tuner"):
        Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    boosted, fair, tuner, hop = (r for r, _ in seen)
    assert (boosted.max_iters, boosted.tol, fair.buckets, fair.tol, len(tuner.highest), tuner.options["deviation_tol"], hop.hops) == (100, 0.001, 1, 1e-6, 40, 1e-6, 20)
    assert all(g.edges.where("src LIKE 'c%'").limit(1).count() for _, g in seen) and isinstance(M.Cos(), M.Supervised)
