"""Queries that must read whole tables, against brute force on a small folder."""

import math
import random
import shutil
from collections import Counter
from itertools import product

import pytest

from diffusio import queries as Q
from diffusio.functions import measures as M

CUSTOMERS, SUPPLIERS = 45, 12


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Customers 0 to 44, suppliers 0 to 11, nations 0 to 3, orders of up to 3 lines."""
    at, rng = tmp_path_factory.mktemp("tables"), random.Random(3)
    orders = [(i, rng.randrange(CUSTOMERS)) for i in range(80)]
    lines = [(i, rng.randrange(SUPPLIERS)) for i, _ in orders for _ in range(rng.randrange(1, 4))]
    made = {
        "orders": (orders, "o_orderkey long, o_custkey long"), "lineitem": (lines, "l_orderkey long, l_suppkey long"),
        "customer": ([(i, i % 4, "A") for i in range(CUSTOMERS)], "c_custkey long, c_nationkey int, c_mktsegment string"), "supplier": ([(i, i % 4) for i in range(SUPPLIERS)], "s_suppkey long, s_nationkey int"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    by = dict(orders)
    return str(at), {(f"c{by[o]}", f"s{s}") for o, s in lines}


def vector(node, scale):
    return [int(node[1:]) * (i + 3) % 7 / scale for i in range(4)]


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def cos(a, b):
    n = math.sqrt(dot(a, a) * dot(b, b))
    return dot(a, b) / n if n else 0.0


def test_all_pairs(spark, folder):
    at, pairs = folder
    got = {(r["src"], r["dst"]): r["has_edge"] for r in Q.QUERIES["has_edge_whole"](spark, at).collect()}
    assert got == {p: p in pairs for p in product([f"c{i}" for i in range(CUSTOMERS)], [f"s{i}" for i in range(SUPPLIERS)])}


def test_all_pairs_in_blocks(spark, folder, tmp_path, monkeypatch):
    """Suppliers far from any sold one, repeated and missing numbers: a row for each pair, from blocks of a few suppliers."""
    monkeypatch.setattr("diffusio.graph.BLOCK", 3)
    at, pairs = folder
    for name in ("orders", "lineitem"):
        shutil.copytree(f"{at}/{name}.parquet", tmp_path / f"{name}.parquet")
    customers, suppliers = [0, 1, 1, 44, 77, None], [*range(SUPPLIERS), 3, 500, 501, None]
    spark.createDataFrame([(c,) for c in customers], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(s,) for s in suppliers], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    c, s = ([None if v is None else f"{k}{v}" for v in values] for k, values in (("c", customers), ("s", suppliers)))
    got = Q.QUERIES["has_edge_whole"](spark, str(tmp_path))
    assert got.columns == ["src", "dst", "has_edge"]
    assert Counter(map(tuple, got.collect())) == Counter((a, b, (a, b) in pairs) for a, b in product(c, s))
    for name, side in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.createDataFrame([], f"{side} long").write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        assert Q.QUERIES["has_edge_whole"](spark, str(tmp_path)).isEmpty()


def test_whole_hops_and_links(spark, folder):
    at, pairs = folder
    one = pairs | {(b, a) for a, b in pairs}
    two = {(a, d) for (a, b), (c, d) in product(one, one) if b == c and a != d}
    assert {tuple(r) for r in Q.QUERIES["two_hop_whole"](spark, at).collect()} == one | two
    best = {a: sorted((-dot(vector(a, 8.0), vector(d, 8.0)), d) for b, d in two - one if a == b)[:3] for a, _ in two}
    got = {(r["src"], r["dst"], r["similarity"]) for r in Q.QUERIES["link_predict_whole"](spark, at).collect()}
    assert {x[:2] for x in got} == {(a, d) for a, rows in best.items() for _, d in rows}
    assert all(abs(s + dict((d, v) for v, d in best[a])[d]) < 1e-6 for a, d, s in got)


def test_link_auc_of_all_links(spark, folder):
    at, pairs = folder
    rows = [tuple(r) for r in M.LinkAssessment(Q.GRAPHS["cs"](spark, at), hops=1, negatives=8).pairs().collect()]
    links, others = ([cos(vector(u, 7.0), vector(v, 7.0)) for u, v, y in rows if y == k] for k in (1.0, 0.0))
    assert {(u, v) for u, v, y in rows if y} == pairs | {(b, a) for a, b in pairs} and others
    wins = sum(1.0 if a > b + 1e-12 else 0.5 if a > b - 1e-12 else 0.0 for a in links for b in others)
    assert Q.QUERIES["measure_link_auc"](spark, at).first()[0] == pytest.approx(wins / len(links) / len(others), abs=0.02)


def test_clustering_of_all_edges(spark, folder):
    at, pairs = folder
    edges = {(int(a[1:]) % 4, int(b[1:]) % 4) for a, b in pairs}
    wedges = [(b, d) for (a, b), (c, d) in product(edges, edges) if a == c]
    expected = sum(cos(vector(f"n{u}", 7.0), vector(f"n{v}", 7.0)) for u, v in wedges) / sum(w in edges for w in wedges)
    assert Q.QUERIES["measure_clustering_whole"](spark, at).first()[0] == pytest.approx(expected, abs=1e-6)
