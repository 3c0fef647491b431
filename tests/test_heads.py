import numpy as np
import pytest
from pyspark.sql import functions as F

from diffusio.graph import Graph
from diffusio.operators import filters as O
from diffusio.plans import heads as H, recipes as R


def test_one_step_against_numpy(spark):
    """Gradient and loss of all rows, in any layout, by differences of the loss."""
    rng = np.random.default_rng(4)
    x, y, w = rng.normal(size=(37, 3)), rng.integers(0, 4, 37), rng.normal(size=(4, 4))
    rows = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "features array<double>, y int")
    ones = np.hstack([x, np.ones((37, 1))])

    def loss(w):
        z = ones @ w
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(37), y]).sum())

    for n in (1, 5, 60):
        g, lost, seen = H._summed(rows.repartition(n), w)
        assert seen == 37 and lost == pytest.approx(loss(w))
        for i in range(4):
            for j in range(4):
                step = np.zeros((4, 4))
                step[i, j] = 1e-6
                assert g[i, j] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=1e-4)


def test_head_on_moved_features(spark):
    """Two rings of which a few nodes have features: after moving them, all others are told apart."""
    pairs = [(f"{r}{i}", f"{r}{(i + j) % 15}") for r in "ab" for i in range(15) for j in (1, 2)]
    graph = Graph.from_pairs(spark, pairs).stored()
    features = spark.createDataFrame([(f"{r}{i}", [1.0, 0.0] if r == "a" else [0.0, 1.0]) for r in "ab" for i in (0, 7)], "id string, features array<double>")
    moved = H.propagated(O.PageRank(0.9, quotient=False, error="iters", max_iters=12), graph, features)
    rows = moved.withColumn("label", F.substring("id", 1, 1))
    few = rows.where("id IN ('a0', 'b0', 'a3', 'b3')")
    head = H.SoftmaxHead(epochs=30).fit(few, rows.where("id IN ('a5', 'b5')"))
    assert head.classes == ("a", "b")
    got = head.predict(moved)
    assert R.accuracy(got, rows.select("id", "label")).first()[0] == 1.0 and got.count() == 30
    assert head.predict(moved.limit(0)).count() == 0
    with pytest.raises(ValueError):
        H.SoftmaxHead().fit(rows.limit(0))
