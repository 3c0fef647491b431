"""Many signals in one state, hop stores, candidates of tuners, projections."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from diffusio.functions import measures as M
from diffusio.graph import Graph, Signal
from diffusio.operators import fairness, filters as O, normalize
from diffusio.operators.convergence import NotConverged, RankOrder
from diffusio.operators.normalize import Normalization
from diffusio.operators.projections import CoSimRank
from diffusio.plans import tuning as T


def steps(n):
    return {"error": "iters", "max_iters": n + 1}


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(5)
    return Graph.from_pairs(spark, sorted({(f"a{a}", f"a{b}") for a, b in rng.integers(0, 25, (70, 2))})).stored()


@pytest.fixture(scope="module")
def table(graph):
    """Five signals: seeds, numbers, a negative one, one that is 0 and one node."""
    n = F.substring("id", 2, 5).cast("int")
    return graph.nodes.select("id", (n < 5).cast("double").alias("x0"), (n / 7.0).alias("x1"), F.when(n == 3, -1.0).otherwise(F.lit(2.0)).alias("x2"), F.lit(0.0).alias("x3"), (n == 7).cast("double").alias("x4"))


FILTERS = {
    "pagerank": lambda **o: O.PageRank(0.85, **o),
    "no quotient": lambda **o: O.PageRank(0.85, quotient=False, **o),
    "absorbing": lambda **o: O.AbsorbingWalks(0.9, **o),
    "symmetric absorbing": lambda **o: O.SymmetricAbsorbing(**o),
    "dijkstra": lambda **o: O.DijkstraRank(0.2, **o),
    "biased": lambda **o: O.BiasedKernel(0.5, quotient=False, **o),
    "heat": lambda **o: O.HeatKernel(3, **o),
    "closed": lambda **o: O.PageRankClosed(0.8, **o),
    "generic": lambda **o: O.GenericFilter([0.5, 0.3, 0.2], **o),
    "impulse": lambda **o: O.Impulse([0.9, 0.5, 0.2], **o),
    "lowpass": lambda **o: O.LowPass([0.9, 0.5, 0.2], **o),
}


@pytest.mark.parametrize("name", [*FILTERS, "pagerank to a tolerance", "heat to a tolerance"])
def test_slots_are_single_runs(graph, table, name):
    """Each filter with fixed steps, and two with a tolerance; columns besides those compared share the state."""
    options = {"tol": 1e-3, "max_iters": 60} if "tolerance" in name else steps(2)
    f = FILTERS[name.split(" to ")[0]](**options)
    got = f.propagate(graph, table).toPandas().set_index("id")
    for c in ("x1", "x3"):
        alone = f.rank(graph, Signal.of(graph, table.select("id", F.col(c).alias("value")))).to_dict()
        assert all(got.loc[i, c] == pytest.approx(v, abs=1e-10) for i, v in alone.items()), (name, c)


def test_slots_of_their_own_parameters_and_stops(graph, table):
    """Slots of one signal with other coefficients each stop when they alone would."""
    p, stopped = Signal.of(graph, table.select("id", F.col("x0").alias("value"))), set()
    for filters in ([O.PageRank(a, tol=1e-3, quotient=False) for a in (0.2, 0.85)], [O.PageRank(a, tol=1e-3) for a in (0.3, 0.7)], [O.LowPass(w, **steps(2)) for w in ([0.9, 0.1], [0.5])]):
        ranks, iterations = O.rank_slots(filters, graph, p.df.select("id", F.array_repeat("value", len(filters)).alias("p")))
        rows = {r["id"]: r["value"] for r in ranks.collect()}
        for i, f in enumerate(filters):
            one = f.rank(graph, p)
            assert iterations[i] == one.iterations
            stopped.add(one.iterations)
            assert all(rows[n][i] == pytest.approx(v, abs=1e-10) for n, v in one.to_dict().items())
    assert len(stopped) > 2
    with pytest.raises(NotConverged):
        O.rank_slots([O.PageRank(0.9, max_iters=3)], graph, p.df.select("id", F.array("value").alias("p")))
    for odd in ([O.PageRank(0.5, **steps(2)), O.HeatKernel(3, **steps(2))], [O.PageRank(convergence=RankOrder())], [O.PageRank(0.5, normalization=n, **steps(2)) for n in ("col", "none")]):
        with pytest.raises(ValueError):
            O.rank_slots(odd, graph, p.df.select("id", F.array_repeat("value", len(odd)).alias("p")))


def test_more_signals_than_slots_and_hubs(spark, graph, table, monkeypatch):
    want = O.PageRank(0.85, **steps(2)).propagate(graph, table).orderBy("id").toPandas()
    monkeypatch.setattr(O, "SLOTS", 2)
    monkeypatch.setattr(normalize, "HUB", 2)
    again = Graph(graph.edges, False, graph.nodes)
    got = O.PageRank(0.85, **steps(2)).propagate(again, table).orderBy("id").toPandas()
    assert list(got.columns) == list(want.columns)
    assert np.allclose(got[["x0", "x1", "x2", "x3", "x4"]], want[["x0", "x1", "x2", "x3", "x4"]])


def test_a_step_of_many_signals_is_one_shuffle_of_sums(spark, graph, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = O.conv(Normalization("symmetric").adjacency(graph), table, "x0", "x1", "x2", "x3", "x4")
        plan = moved._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hops_are_shared(graph):
    """Closed forms on one seed move it once; other seeds, graphs and normalizations don't meet."""
    p, store = Signal.of(graph, ["a1", "a2"]), O.HopStore()
    kinds = [lambda **o: O.HeatKernel(3, **o), lambda **o: O.PageRankClosed(0.8, **o), lambda **o: O.GenericFilter([0.4, 0.3, 0.2], **o)]
    for make in kinds:
        for options in (steps(3), {"tol": 1e-2, "error": "max", "max_iters": 80}):
            one, two = make(**options).rank(graph, p), make(hops=store, **options).rank(graph, p)
            assert one.iterations == two.iterations
            want = one.to_dict()
            assert all(want[i] == pytest.approx(v, abs=1e-10) for i, v in two.to_dict().items())
    moves = store.moves
    assert moves < 80 and len(store) == 1
    kinds[0](hops=store, **steps(3)).rank(graph, Signal.of(graph, {"a1": 5.0, "a2": 5.0}))  # the same seed once it is normalized
    assert store.moves == moves
    O.HeatKernel(3, hops=store, normalization="col", **steps(3)).rank(graph, p).to_dict()
    assert store.moves == moves + 2 and len(store) == 1  # one personalization is kept
    zero = O.HeatKernel(3, hops=store, **steps(3)).rank(graph, 0.0).to_dict()
    assert set(zero.values()) == {0.0}
    two = O.HopStore(keep=2)
    for seed in (["a1"], ["a2"], ["a1"], ["a2"]):
        O.HeatKernel(3, hops=two, **steps(2)).rank(graph, seed)
    assert two.moves == 2 and len(two) == 2


def test_tuners_share_hops(graph):
    store = O.HopStore()
    for weights in (1, 2):
        T.ParameterTuner(highest=[1.0] * weights, training=0.5, measure=M.Cos, deviation_tol=1.0, divide_range=2, partitions=2, hops=store).rank(graph, ["a1", "a2", "a3", "a4"])
    assert store.moves == 2


@pytest.mark.parametrize("kind", [O.Impulse, O.LowPass])
def test_candidates_are_slots(graph, monkeypatch, kind):
    """A turn of the tuner is one state; it finds what one run a candidate finds."""
    p = Signal.of(graph, [f"a{i}" for i in range(8)])
    tuner = lambda **o: T.ParameterTuner(lambda w: kind(w, **steps(1)), [1.0], measure=M.Cos, training=0.5, deviation_tol=0.2, divide_range=2, partitions=3, **o)
    runs = []
    slots = T.rank_slots
    monkeypatch.setattr(T, "rank_slots", lambda filters, *a: runs.append(len(filters)) or slots(filters, *a))
    together = tuner().rank(graph, p).to_dict()
    assert runs and max(runs) == 3
    monkeypatch.setattr(T, "_in_slots", lambda r: False)
    alone = tuner().rank(graph, p).to_dict()
    assert all(together[i] == pytest.approx(v, abs=1e-9) for i, v in alone.items())


def test_fair_personalizer_against_numpy(graph):
    """The loss that is searched, and that its end is no worse than the first point, by a plain model."""
    nodes = sorted(r["id"] for r in graph.nodes.collect())
    at = {n: i for i, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in graph.edges.collect():
        a[at[r["src"]], at[r["dst"]]] += r["w"]
    d = np.sqrt(a.sum(1))
    a = a / np.where(d == 0, 1, d)[:, None] / np.where(d == 0, 1, d)[None, :]
    p = np.array([1.0 if n in ("a1", "a2", "a3") else 0.0 for n in nodes])
    s = np.array([1.0 if int(n[1:]) % 2 == 0 else 0.0 for n in nodes])

    def rank(p):
        total = np.abs(p).sum()
        r = q = p / total
        for _ in range(2):
            r = 0.85 * (r @ a) + 0.15 * q
            r = r / r.sum()
        return r * total

    def prule(r):
        x, y = (r * s).sum() / s.sum(), (r * (1 - s)).sum() / (1 - s).sum()
        return min(x, y) / max(x, y)

    base = rank(p)
    ranker = fairness.FairPersonalizer(O.PageRank(0.85, **steps(2)), tol=0.3)
    ps, ss = Signal.of(graph, ["a1", "a2", "a3"]), Signal(graph, graph.nodes.select("id", (F.substring("id", 2, 5).cast("int") % 2 == 0).cast("double").alias("value")))
    got = ranker.rank(graph, ps, ss).to_dict()
    got = np.array([got[n] for n in nodes])
    loss = lambda r: np.abs(r - base).mean() - min(1.0, prule(r))

    def edit(q):
        r = base / base.max()
        gap = np.abs(r - p)
        w, b = s * (q[0] - q[1]) + q[1], s * (q[2] - q[3]) + q[3]
        return (1 - q[4]) * ((1 - w) * np.exp(b * gap) + w * np.exp(-b * gap)) + q[4] * p

    first = loss(rank(edit([0.5, 0.5, 0.0, 0.0, 0.5])))
    assert loss(got) <= first + 1e-9 and prule(got) > 0.7
    original = Signal.of(graph, dict(zip(nodes, base, strict=True)))
    edited = ranker.edited(ps, ss, original, [0.2, 0.9, 1.5, -2.0, 0.3]).to_dict()
    assert np.allclose([edited[n] for n in nodes], edit([0.2, 0.9, 1.5, -2.0, 0.3]))


def test_projections_against_numpy(graph):
    nodes = sorted(r["id"] for r in graph.nodes.collect())
    sim = CoSimRank(dims=70, sparsity=3.0, seed=2)  # more than a state's slots
    rows = {r["id"]: r for r in sim.projections(graph).collect()}
    at = {n: i for i, n in enumerate(nodes)}
    a, raw = np.zeros((len(nodes), len(nodes))), np.zeros((len(nodes), len(nodes)))
    for r in Normalization("symmetric").edges(graph).collect():
        a[at[r["src"]], at[r["dst"]]] = r["w"]
    for r in graph.edges.collect():
        raw[at[r["src"]], at[r["dst"]]] = r["w"]
    own = np.array([rows[n]["own"] for n in nodes])
    d = raw.sum(1) / raw.sum(1).max()
    assert set(np.round(np.unique(own / np.where(d == 0, 1, d)[:, None]), 9)) == {-1.0, 0.0, 1.0}
    assert 0.2 < (own != 0).mean() < 0.47
    moved, e = 0, own
    for w in (1.0, 0.5, 0.25):
        e = a.T @ e
        moved = moved + w * e
    assert np.allclose([rows[n]["moved"] for n in nodes], moved)
    scores = moved @ own.T  # row: node, column: seed
    got = sim.rank(graph, {"a1": 2.0, "a2": 1.0}).to_dict()
    assert np.allclose([got[n] for n in nodes], 2 * scores[:, at["a1"]] + scores[:, at["a2"]])
    links = sim.links(graph, graph.nodes, 4).collect()
    for n in nodes:
        free = [m for m in nodes if m != n and not raw[at[n], at[m]]]
        want = sorted(free, key=lambda m: (-round(scores[at[m], at[n]], 9), m))[:4]
        mine = [r for r in sorted((r for r in links if r["src"] == n), key=lambda r: r["place"])]
        assert np.allclose([r["score"] for r in mine], [scores[at[m], at[n]] for m in want]) and len(mine) == len(want)
        assert all(r["dst"] in free for r in mine)
    assert sim.links(graph, graph.nodes.limit(0)).count() == 0
