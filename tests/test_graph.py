import re

import pytest
from pyspark.sql import functions as F

from diffusio.functions.math import conv
from diffusio.graph import Graph, Signal
from diffusio.operators import fairness, filters as O, normalize, postprocess as P
from diffusio.operators.convergence import Convergence, NotConverged, RankOrder
from diffusio.operators.normalize import Normalization

SHOWCASE = ["AB", "BC", "CD", "DE", "AC", "CE", "BE"]


@pytest.fixture(scope="module")
def five(spark):
    return Graph.from_pairs(spark, SHOWCASE).stored()


def near(a, b, tol=1e-12):
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= tol for k in a), (a, b)


def steps(n):
    return {"error": "iters", "max_iters": n + 1}


def test_store(spark, five):
    assert five.number_of_nodes() == 5 and five.number_of_edges() == 7
    fewer = five.remove_edges(spark.createDataFrame([("A", "B")], "a string, b string"))
    assert fewer.number_of_edges() == 6 and fewer.number_of_nodes() == 5
    again = fewer.add_edges(spark.createDataFrame([("A", "B"), ("B", "C")], "a string, b string"))
    assert again.number_of_edges() == 7
    assert {r["id"]: r["degree"] for r in five.degrees().collect()} == {"A": 2, "B": 3, "C": 4, "D": 2, "E": 3}
    sub = five.subgraph(spark.createDataFrame([("A",), ("B",), ("Z",)], "id string"))
    assert sub.number_of_edges() == 1 and sub.number_of_nodes() == 2


def test_signals(spark):
    g = Graph.from_pairs(spark, [(1, 2), (2, 3)], directed=True)
    s = Signal.of(g, {1: 1, 2: 2, 3: 3})
    assert s.sum() == 6 and (s + 1).sum() == 9 and (s * s).sum() == 14 and (s**2 - s).sum() == 8 and (2 / s).sum() == pytest.approx(2 + 1 + 2 / 3)
    assert (-s).sum() == -6 and s.normalized().sum() == pytest.approx(1) and s[2] == 2
    with pytest.raises(KeyError):
        Signal.of(g, {9: 1})
    with pytest.raises(ValueError):
        Signal.of(Graph.from_pairs(spark, [(1, 2)]), s)
    assert Signal.of(g).sum() == 3 and Signal.of(g, [1, 2]).sum() == 2


def test_known_scores(five):
    f = O.PageRank(0.85)
    got = f(five, ["A", "B"])
    scores = got.to_dict()
    assert got.iterations == 19
    for node, value in {"B": 0.5173091321819129, "D": 0.24969444089457765, "E": 0.3415804634807899}.items():
        assert scores[node] == pytest.approx(value, abs=1e-14)


def test_max_iters_raise(five):
    with pytest.raises(NotConverged):
        O.PageRank(0.85, max_iters=3)(five, ["A"])
    with pytest.raises(TypeError):
        O.PageRank(0.85, unknown=3)
    with pytest.raises(ValueError):
        O.PageRank(0.85, normalization="salsa")(five, ["A"])


def test_forms_agree(five):
    a = O.PageRank(0.85, quotient=False, normalization="col", tol=1e-9)(five, ["A"]) / 0.15
    b = O.PageRankClosed(0.85, normalization="col", tol=1e-11, max_iters=200)(five, ["A"])
    near(P.Normalize("sum").transform(a).to_dict(), P.Normalize("sum").transform(b).to_dict(), 1e-6)
    c = O.LowPass([0.85] * 40, quotient=False, normalization="col", **steps(40))(five, ["A"])
    d = O.PageRank(0.85, quotient=False, normalization="col", **steps(40))(five, ["A"])
    near(c.to_dict(), d.to_dict())


def test_krylov(five):
    near(O.PageRankClosed(0.5, krylov=5, **steps(12))(five, ["A"]).to_dict(), O.PageRankClosed(0.5, **steps(12))(five, ["A"]).to_dict(), 1e-9)


def test_combinations(five):
    f, h = O.PageRank(0.85, **steps(4)), O.HeatKernel(3, **steps(4))
    p = Signal.of(five, ["A"])
    near((f >> P.Normalize("max") >> P.Ordinals())(five, p).to_dict(), P.Ordinals(P.Normalize(f)).rank(five, p).to_dict())
    near((f & ~h)(five, p).to_dict(), (f(five, p) - h(five, p)).to_dict())
    near((f | p).to_dict(), f(five, p).to_dict())
    near((f >> h)(five, p).to_dict(), h.with_(before=f)(five, p).to_dict())
    near((O.PageRank(0.85) + Convergence(error="iters", max_iters=5) + Normalization("col"))(five, p).to_dict(), O.PageRank(0.85, normalization="col", **steps(4))(five, p).to_dict())
    assert "Ordinals" in (f >> P.Ordinals()).describe() and f.quotient is True
    zero = f(five, {"A": 0})
    assert zero.sum() == 0


def test_rank_order_stops_early(five):
    f = O.PageRank(0.85, convergence=RankOrder(0.85, 0.98, "fraction_of_walks"))
    assert f(five, ["A", "B"]).iterations < 19


def test_unknown_options_are_refused(five):
    f = O.PageRank(0.85, **steps(2))
    for ranker in (f, f >> P.Normalize(), f & f, ~f, O.HeatKernel(3, chebyshev=True, **steps(2)), f >> fairness.AdHocFairness()):
        with pytest.raises(TypeError):
            ranker.rank(five, ["A"], nonsense=1)
    near((f >> fairness.AdHocFairness()).rank(five, ["A"], sensitive=["B"]).to_dict(), fairness.AdHocFairness(f).rank(five, ["A"], sensitive=["B"]).to_dict())


def test_steps_read_edges_in_buckets(spark):
    """Edges aren't shuffled by a step, and each step leaves two states."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = Graph.from_pairs(spark, [(i, (i * 7 + 1) % 50) for i in range(50)]).stored()
        edges = Normalization("symmetric").adjacency(graph)
        plan = conv(edges, graph.nodes.withColumn("value", F.lit(1.0)), "value")._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan and not re.search(r"Exchange hashpartitioning\(src#\d+, 4\)[^\n]*\n[^\n]*\n?[^\n]*FileScan parquet[^\n]*dst", plan)
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2  # the values by source, the sums by target
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hubs_are_split(spark, monkeypatch):
    pairs = [("hub", i) for i in range(40)] + [(i, i + 1) for i in range(40)]
    whole = O.PageRank(0.85, **steps(3))(Graph.from_pairs(spark, pairs).stored(), ["hub"]).to_dict()
    monkeypatch.setattr(normalize, "HUB", 7)
    graph = Graph.from_pairs(spark, pairs).stored()
    found = Normalization().adjacency(graph)
    assert found.rows.agg(F.max("part")).first()[0] > 0 and found.hubs.collect()[0]["src"] == "hub" and found.plain.columns == ["src", "dst", "w"]
    near(O.PageRank(0.85, **steps(3))(graph, ["hub"]).to_dict(), whole)


def test_laplacian_and_symmetric_are_identity(five):
    a, b = (Normalization(k).edges(five) for k in ("laplacian", "symmetric"))
    both = a.unionByName(b).groupBy("src", "dst").sum("w").collect()
    assert all(abs(r[2] - (r[0] == r[1])) < 1e-12 for r in both)


def test_unions_of_stored_edges(spark, monkeypatch):
    """Sums by source over unions of stored, added and normalized edges, directed or not, with hubs or without."""
    pairs = [("hub", i) for i in range(30)] + [(i, (i + 1) % 30) for i in range(30)]
    for most, directed in ((normalize.HUB, False), (7, True)):
        monkeypatch.setattr(normalize, "HUB", most)
        graph = Graph.from_pairs(spark, pairs, directed).stored()
        added = graph.add_edges(spark.createDataFrame([("x", "hub"), ("0", "5")], "a string, b string"))
        again = added.stored()
        for one in (graph, added, again):
            normal = Normalization("col").edges(one)
            for a, b in ((one.edges, one.edges), (one.edges, normal), (normal, normal)):
                both = a.unionByName(b).groupBy("src").agg(F.sum("w").alias("w")).collect()
                assert len(both) == len({r["src"] for r in both}) and sum(r["w"] for r in both) == pytest.approx(a.agg(F.sum("w")).first()[0] + b.agg(F.sum("w")).first()[0])
        assert again.edges.count() == graph.edges.count() + (2 if directed else 4)


def test_nothing_stays_in_the_catalog(spark):
    from diffusio.session import scope, shared_folder
    import os

    graph = Graph.from_pairs(spark, [(i, (i * 7 + 1) % 50) for i in range(50)]).stored()
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scope(spark):
        O.PageRank(0.85, **steps(3)).rank(graph, ["1"]).to_dict()
        assert len(set(os.listdir(folder)) - before) > 2
    left = {x.split("-")[0] for x in set(os.listdir(folder)) - before if not x.startswith(".")}
    assert left == {"adjacency"}  # the graph's own, which other runs read
    assert O.PageRank(0.85, **steps(2)).rank(graph, ["1"]).to_dict()
    assert not [t for t in spark.catalog.listTables() if not t.isTemporary]


def test_dropout_is_the_same_in_any_layout(spark):
    """Which edges go depends on edge, step and seed; a share near the given one goes and the rest weighs more."""
    graph = Graph.from_pairs(spark, [(i, j) for i in range(40) for j in range(40)], True)
    left = [{(r["src"], r["dst"]) for r in O.dropped(graph.edges.repartition(n), 0.25, 2, 7).collect()} for n in (1, 7)]
    assert left[0] == left[1] and 1100 < len(left[0]) < 1300
    assert {(r["src"], r["dst"]) for r in O.dropped(graph.edges, 0.25, 3, 7).collect()} != left[0]
    assert O.dropped(graph.edges, 0.25, 2).first()["w"] == pytest.approx(4 / 3)
    f = O.PageRank(0.85, dropout=0.3, dropout_seed=3, **steps(3))
    stored = graph.stored()
    near(f.rank(stored, ["1"]).to_dict(), f.rank(Graph(graph.edges.repartition(5), True).stored(), ["1"]).to_dict())


def test_postprocessors(five):
    s = Signal.of(five, {"A": 0.5, "B": 0.4, "C": 0.1, "D": 0.1, "E": 0.0})
    assert P.Ordinals().transform(s).to_dict() == {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5}
    assert P.Top(3).transform(s).sum() == 4 and P.Top(0.4).transform(s).sum() == 2
    assert P.Threshold(0.1).transform(s).sum() == 2 and P.Threshold(0.1, inclusive=True).transform(s).sum() == 4
    assert P.Threshold("gap").transform(s).sum() == 4  # the relative drop to 0 is the largest
    assert P.Normalize("range").transform(s + 1).max() == 1
    assert P.Transformer(lambda x: x * 2, vectorized=False).transform(s).sum() == pytest.approx(2.2)
    sub = P.Subgraph().transform(s)
    assert sub.graph.number_of_nodes() == 4 and P.Supergraph().transform(sub).to_dict() == s.to_dict()
    with pytest.raises(ValueError):
        P.SeedOversampling(O.PageRank(0.85))(five, {"A": 0.5})
    with pytest.raises(ValueError):
        P.Normalize("other").transform(s)


def test_fairness(five):
    s = Signal.of(five, ["D", "E"])
    f = O.PageRank(0.85, **steps(6))
    from diffusio.functions.measures import PRule

    for method in ("O", "B"):
        out = fairness.AdHocFairness(f, method).rank(five, ["A", "B"], sensitive=s)
        assert PRule(s)(out) > 0.98 and out.sum() == pytest.approx(1)
    lfpr = O.FairPageRank(0.85, max_iters=300)(five, ["A", "B"], sensitive=s)
    assert PRule(s)(lfpr) > 0.9
    with pytest.raises(TypeError):
        fairness.FairWalk(f).transform(lfpr)
