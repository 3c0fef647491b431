import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffusio.functions import measures as M
from diffusio.graph import Graph, Signal
from diffusio.operators import filters as O
from diffusio.plans import benchmark as B, recipes as R, tuning as T
from diffusio.plans.optimize import optimize


@pytest.fixture(scope="module")
def four(spark):
    return Graph.from_pairs(spark, ["AB", "BC", "CD"]).stored()


def sig(g, *values):
    return Signal.of(g, dict(zip("ABCD", values, strict=False)))


def test_vectors(four):
    assert M.TPR(sig(four, 1, 0, 0, 0))(sig(four, 1, 1, 0, 0)) == 1
    assert M.PPV(sig(four, 1, 0, 0, 0))(sig(four, 1, 1, 0, 0)) == 0.5
    assert M.TNR(sig(four, 1, 0, 0, 1))(sig(four, 1, 1, 0, 0)) == 0.5
    assert M.Mabs(sig(four, 3, 1, 1, 0))(sig(four, 2, 0, 2, 0)) == 0.75
    assert M.Cos(sig(four, 1, 1, 1, 1))(sig(four, -1, -1, -1, -1)) == pytest.approx(-1)
    assert M.Cos(sig(four, 1, 0, 0, 0))(sig(four, 0, 1, 0, 0)) == 0
    assert M.Dot(1)(sig(four, 1, 1, 1, 0)) == 3
    assert M.AUC(sig(four, 1, 0, 1, 0))(sig(four, 3, 1, 2, 2)) == pytest.approx(0.875)
    with pytest.raises(ValueError):
        M.AUC(sig(four, 1, 1, 1, 1))(sig(four, 1, 2, 3, 4))
    assert M.Spearman(sig(four, 1, 2, 3, 4))(sig(four, 10, 20, 30, 41)) == pytest.approx(1)
    assert M.NDCG(sig(four, 1, 1, 0, 0))(sig(four, 4, 3, 2, 1)) == pytest.approx(1)
    assert M.Mabs(1, exclude=sig(four, 1, 0, 0, 0))(sig(four, 9, 1, 1, 1)) == 0


def test_combined(four):
    auc = lambda v: type("Fixed", (M.Measure,), {"__call__": lambda self, s, v=v: v})()
    parts = ([auc(0.5), auc(1.0)], None, [(0.0, 0.5), (0.9, 1.0)])
    assert M.GM(*parts)(None) == pytest.approx(math.sqrt(0.5)) and M.AM(*parts)(None) == 0.75
    assert M.Disparity(*parts)(None) == 0.5 and M.Parity(*parts)(None) == 0.5


def test_unsupervised(spark):
    g = Graph.from_pairs(spark, ["AB", "BC", "CA", "DE", "EF", "FD", "CD"]).stored()
    good, bad = Signal.of(g, list("ABC")), Signal.of(g, list("ADE"))
    assert M.Conductance()(good) < M.Conductance()(bad)
    assert M.Density()(good) > M.Density()(bad) and M.Modularity()(good) > M.Modularity()(bad)
    assert M.Conductance()(Signal.of(g, list("ABC"))) == pytest.approx(2 / 12)
    with pytest.raises(ValueError):
        M.Conductance()(good * 2)
    assert M.Conductance(autofix=True)(good * 2) == pytest.approx(2 / 12)


def test_split(spark):
    groups = spark.createDataFrame([(1, x) for x in "ABCD"] + [(2, x) for x in "BEFGHI"], "group_id int, id string")
    size = lambda df, g: df.where(f"group_id = {g}").count()
    a, b = M.split(groups, 0.5)
    assert (size(a, 1), size(b, 1), size(a, 2), size(b, 2)) == (2, 2, 3, 3)
    a, b = M.split(groups, 3)
    assert (size(a, 1), size(b, 2)) == (3, 3)
    a, b = M.split(groups, 1)
    assert a.count() == b.count() == 10


def beale(p):
    return (1.5 - p[0] + p[0] * p[1]) ** 2 + (2.25 - p[0] + p[0] * p[1] ** 2) ** 2 + (2.625 - p[0] + p[0] * p[1] ** 3) ** 2


def booth(p):
    return (p[0] + 2 * p[1] - 7) ** 2 + (2 * p[0] + p[1] - 5) ** 2


def test_optimizer():
    assert optimize(booth, [10, 10], [-10, -10], parameter_tol=1e-8) == pytest.approx([1, 3], abs=1e-3)
    assert beale(optimize(beale, [4.5, 4.5], [-4.5, -4.5], parameter_tol=1e-8)) < 1e-3
    with pytest.raises(ValueError):
        optimize(booth, [1], [2])


def test_tuners(spark):
    pairs = [(f"a{i}", f"a{(i + j) % 12}") for i in range(12) for j in (1, 2, 3)] + [(f"b{i}", f"b{(i + j) % 12}") for i in range(12) for j in (1, 2, 3)] + [("a0", "b0")]
    g = Graph.from_pairs(spark, pairs).stored()
    p = Signal.of(g, [f"a{i}" for i in range(8)])
    known = Signal.of(g, [f"a{i}" for i in range(12)])
    for tuner in (T.Selection([O.PageRank(0.85, error="iters", max_iters=5), O.HeatKernel(3, error="iters", max_iters=5)], shares=(0.5,)), T.ParameterTuner(highest=[1.0] * 3, training=0.5, deviation_tol=0.1, divide_range=2), T.HopTuner(hops=4)):
        assert M.AUC(known)(tuner.rank(g, p)) > 0.9
    results = B.benchmark(spark, {"PPR": O.PageRank(0.85, error="iters", max_iters=5)}, [("rings", g, known.df)], {"auc": M.AUC, "time": B.Time})
    assert results.count() == 2 and "rings" in B.printed(results) and B.as_dict(B.average(results)).keys() == {"rings", "Average"}
    found = R.detect_community(g, O.PageRank(0.9, error="iters", max_iters=8), p, 0.1)
    assert M.AUC(known)(found) > 0.9


def test_adapters_and_smooth_limits(spark):
    graph = Graph.from_pairs(spark, ["AB", "BC"])
    x, y = Signal.of(graph, {"A": 1, "B": 0, "C": 1}), Signal.of(graph, ["A"])
    m = M.Mabs(y)
    assert m.as_supervised()(x)(x) == 0 and m.as_is()(x)(x) == m(x) and M.Utility(M.Mabs)(y, None)(x) == M.Mabs(None)(x)
    sharp, smooth = (M.AM([m], limits=[(0.2, 0.9)], smooth=s) for s in (False, True))
    for v in (-1.0, 0.0, 0.2, 0.5, 0.9, 3.0):
        assert abs(sharp.clipped(v, 0.2, 0.9) - smooth.clipped(v, 0.2, 0.9)) < 0.03
    assert smooth.clipped(5.0, float("-inf"), float("inf")) == 5.0


def test_nemenyi(spark):
    rows = [(f"d{i}", 0.5, 0, a, "auc", v) for i in range(12) for a, v in (("x", 0.9), ("y", 0.5), ("z", 0.1))]
    results = spark.createDataFrame(rows, "dataset string, share double, seed int, algorithm string, measure string, value double")
    got = {(r["algorithm"], r["other"]): (r["difference"], round(r["least"], 3), r["differ"]) for r in B.nemenyi(results).collect()}
    assert got == {("x", "y"): (1.0, 0.957, True), ("x", "z"): (2.0, 0.957, True), ("y", "z"): (1.0, 0.957, True)}
    p = {(r["algorithm"], r["other"]): r["p"] for r in B.nemenyi(results).collect()}
    assert 0.03 < p["x", "y"] < 0.05 and p["y", "z"] == pytest.approx(p["x", "y"]) and p["x", "z"] < 1e-4
    assert B.scores(results).count() == 36
    many = spark.createDataFrame([(f"d{i}", 0.5, 0, f"a{j:02}", "auc", float((i * 7 + j) % 24)) for i in range(9) for j in range(24)], results.schema)
    assert B.nemenyi(many).count() == 24 * 23 // 2


def test_studentized_range():
    """Upper points of the usual tables (infinite degrees of freedom) to three digits."""
    for k, five, one in ((2, 2.772, 3.643), (3, 3.314, 4.120), (5, 3.858, 4.603), (10, 4.474, 5.157), (20, 5.012, 5.645)):
        assert B.range_quantile(0.95, k) == pytest.approx(five, abs=2e-3) and B.range_quantile(0.99, k) == pytest.approx(one, abs=2e-3)
    assert B.studentized_range(0.0, 4) == 0 and B.studentized_range(39.0, 4) == pytest.approx(1.0)


def test_measures_by_group(spark):
    """Every group's AUC, NDCG and means in one plan, as each alone has them."""
    rng = np.random.default_rng(3)
    rows = [(f"g{g}", f"n{i:03}", float(rng.integers(0, 6) if g % 2 else rng.normal()), float(rng.random() < 0.4)) for g in range(5) for i in range(60)]
    rows += [("one", "n000", 0.5, 1.0)]
    table = spark.createDataFrame(rows, "group_id string, id string, value double, y double")
    known = table.select("group_id", "id", F.col("y").alias("value")).where("value <> 0")
    out = table.where("id LIKE 'n00%'").select("group_id", "id")
    for m, exclude in ((M.AUC(), out), (M.NDCG(k=7), None), (M.Cos(), out), (M.MannWhitneyParity(), None)):
        got = {r["group_id"]: r["value"] for r in M.by_group(m, table, known, exclude).collect()}
        for g in ("g0", "g1", "one"):
            one = table.where(F.col("group_id") == g).select("id", F.col("value").alias("x"), "y")
            one = one if exclude is None else one.where("NOT id LIKE 'n00%'")
            if one.isEmpty():
                assert g not in got
                continue
            want = m.of(one).first()[0]
            assert got[g] == (None if want is None else pytest.approx(want, abs=1e-9)), (type(m), g)
    with pytest.raises(TypeError):
        M.by_group(M.Spearman(), table, known)


def test_spearman_and_auc_of_ties(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 5, 300).astype(float), rng.integers(0, 3, 300).astype(float)

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    rows = spark.createDataFrame([(str(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "id string, x double, y double")
    assert M.Spearman().of(rows).first()[0] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])
    pos = y > 0
    want = np.mean([(a > b) + 0.5 * (a == b) for a in x[pos] for b in x[~pos]])
    assert M.AUC().of(rows).first()[0] == pytest.approx(want)


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("kind", ["cos", "dot"])
def test_clustering_without_wedges(spark, directed, kind):
    """Against all wedges, with self-loops, one-way and two-way edges, and a hub."""
    rng = np.random.default_rng(8)
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 14, (60, 2))} | {(0, i) for i in range(1, 14)} | {(3, 3)}
    graph = Graph.from_pairs(spark, sorted(pairs), directed)
    near = {(str(a), str(b)) for a, b in pairs} | (set() if directed else {(str(b), str(a)) for a, b in pairs})
    vectors = {str(i): rng.integers(0, 3, 4).astype(float) for i in range(14)}
    scores = spark.createDataFrame([(g, i, float(v[g])) for i, v in vectors.items() for g in range(4)], "group_id int, id string, value double")
    size = lambda v: np.sqrt(v @ v) if kind == "cos" else 1.0
    sim = lambda a, b: 0.0 if size(a) * size(b) == 0 else a @ b / (size(a) * size(b))
    wedges = [(u, t) for v in vectors for a, u in near if a == v for b, t in near if b == v]
    want = sum(sim(vectors[u], vectors[t]) for u, t in wedges) / sum((u, t) in near for u, t in wedges)
    assert M.ClusteringCoefficient(graph, kind)(scores) == pytest.approx(want)
    plan = M.closed_wedges(graph.neighbors())._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan
    assert M.closed_wedges(graph.neighbors()).first()["n"] == sum((u, t) in near for u, t in wedges)


def test_autoregression_predicts_a_geometric_series():
    values = np.stack([0.5 ** np.arange(12), 2 * 0.5 ** np.arange(12)], axis=1)
    plain, smooth = T._smoothed(values, 0), T._smoothed(values, 2)
    assert plain == pytest.approx(values.mean(axis=1)) and smooth == pytest.approx(plain, abs=0.02)
