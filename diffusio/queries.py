"""The queries of the node-ranking operators and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from diffusio.functions import measures as M
from diffusio.functions.math import conv, rounded, safe_inv
from diffusio.graph import Graph, Signal
from diffusio.operators import fairness, filters as O, postprocess as P
from diffusio.operators.convergence import RankOrder
from diffusio.operators.normalize import Normalization, eigdegree
from diffusio.operators.dictionary import OnNumbers
from diffusio.operators.pairs import within_two
from diffusio.operators.projections import CoSimRank
from diffusio.plans import benchmark as B, recipes as R, sql as S, tuning as T
from diffusio.plans.fixtures import COMMUNITIES_SQL, GRAPH_SQL, GRAPHS, KEY_SQL, SEED_SQL, SENSITIVE_SQL, communities, key, seeds, sensitive, settled, shown, table
from diffusio.plans.heads import SoftmaxHead
from diffusio.plans.ranker import Chain
from diffusio.session import shared_folder
from diffusio.sources import conversions as C, loaders as L
from diffusio.streaming.edges import StreamRanker
from diffusio.streaming.push import PushRanker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


# ---- graph store ----------------------------------------------------------------------


def on(graph: str, f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, folder: f(GRAPHS[graph](spark, folder))


CS, NAT = f"WITH {GRAPH_SQL['cs']}", f"WITH {GRAPH_SQL['nat']}"
_LOW = "CAST(substr(src, 2) AS BIGINT) % 3 = 0 AND CAST(substr(dst, 2) AS BIGINT) % 2 = 0"


def _some_pairs(g: Graph) -> DataFrame:
    return g.edges.where((key("src") % 3 == 0) & (key("dst") % 2 == 0)).select("src", "dst")


add("degrees", on("cs", lambda g: g.degrees().select("id", F.col("degree").cast("long").alias("degree"))), f"{CS} SELECT src AS id, count(DISTINCT dst) AS degree FROM edges GROUP BY src")
add("symmetrize", on("cs", lambda g: g.edges), f"{CS} SELECT src, dst, w FROM edges")
add("neighbors", on("nat", lambda g: g.neighbors()), f"{NAT} SELECT DISTINCT src AS id, dst AS neighbor FROM edges")
add(
    "has_edge",
    on("reg", lambda g: g.has_edges(g.nodes.select(F.col("id").alias("src")).crossJoin(g.nodes.select(F.col("id").alias("dst"))))),  # 30 nodes, whatever the scale
    f"WITH {GRAPH_SQL['reg']} SELECT a.id AS src, b.id AS dst, e.src IS NOT NULL AS has_edge FROM nodes a JOIN nodes b ON true LEFT JOIN edges e ON e.src = a.id AND e.dst = b.id",
)
add("edge_weights_sum", on("nat", lambda g: g.edges.groupBy("src").agg(F.sum("w").alias("w"))), f"{NAT} SELECT src, sum(w) AS w FROM edges GROUP BY src")
add("graph_counts", on("cs", lambda g: g.nodes.agg(F.count("id").alias("n_nodes")).join(g.edges.agg((F.count("src") / 2).cast("long").alias("n_edges")), F.lit(True))), f"{CS} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT CAST(count(*) / 2 AS BIGINT) FROM edges) AS n_edges")
add("subgraph", on("cs", lambda g: g.subgraph(g.nodes.where(key() % 3 == 0)).edges), f"{CS} SELECT src, dst, w FROM edges WHERE CAST(substr(src, 2) AS BIGINT) % 3 = 0 AND CAST(substr(dst, 2) AS BIGINT) % 3 = 0")
add("add_edges", on("nat", lambda g: g.add_edges(g.nodes.select("id", F.concat(F.lit("x"), (key() % 4).cast("string")).alias("far"))).edges), f"{NAT} SELECT src, dst, w FROM edges UNION ALL SELECT id, 'x' || ({KEY_SQL} % 4), 1.0::DOUBLE FROM nodes")
add("remove_edges", on("nat", lambda g: g.remove_edges(_some_pairs(g)).edges), f"{NAT} SELECT src, dst, w FROM edges WHERE NOT ({_LOW})")
add(
    "remove_intra_edges",
    lambda spark, folder: GRAPHS["nat"](spark, folder).remove_intra_edges(table(spark, folder, "nation").select(F.col("n_regionkey").alias("group_id"), F.concat(F.lit("n"), "n_nationkey").alias("id"))).edges,
    f"{NAT} SELECT src, dst, w FROM edges JOIN nation a ON src = 'n' || a.n_nationkey JOIN nation b ON dst = 'n' || b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey",
)
add("two_hop", on("reg", lambda g: g.hops(2)), f"WITH {GRAPH_SQL['reg']} SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst")


def _all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer with every supplier, and whether one has bought from the other."""
    customers = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"))
    return GRAPHS["cs"](spark, folder).edge_matrix(customers, table(spark, folder, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("dst")))


# The same on the customers and suppliers.
add(
    "has_edge_whole",
    _all_pairs,
    f"{CS} SELECT a.src, a.dst, e.src IS NOT NULL AS has_edge FROM (SELECT 'c' || c_custkey AS src, 's' || s_suppkey AS dst FROM customer, supplier) a LEFT JOIN edges e ON e.src = a.src AND e.dst = a.dst",
)
add("two_hop_whole", on("cs", within_two), f"{CS} SELECT src, dst FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst")

# ---- normalization --------------------------------------------------------------------


def _edges(g: Graph, **options) -> DataFrame:
    return Normalization(**options).edges(g).select("src", "dst", rounded("w").alias("w"))


def _edges_sql(graph: str, kind: str, loops: float = 0.0) -> str:
    return f"{S.adjacency(graph, kind, loops)} SELECT src, dst, {S.ROUND.format('w')} AS w FROM m"


for kind in ("col", "symmetric", "both", "laplacian", "none"):
    add(f"norm_{kind}", on("nat", lambda g, k=kind: _edges(g, kind=k)), _edges_sql("nat", kind))
add("norm_auto", on("cs", lambda g: _edges(g)), _edges_sql("cs", "symmetric"))
add("norm_renormalize", on("nat", lambda g: _edges(g, kind="symmetric", renormalize=2.0)), _edges_sql("nat", "symmetric", 2.0))
add("norm_transform", on("nat", lambda g: _edges(g, kind=lambda e: e.where("w > 2"), transform=lambda e: e.withColumn("w", F.sqrt("w")))), f"{NAT} SELECT src, dst, {S.ROUND.format('sqrt(w)')} AS w FROM edges WHERE w > 2")

# ---- filters with fixed steps ----------------------------------------------------------


def steps(n: int, **more) -> dict:
    return {"error": "iters", "max_iters": n + 1, **more}


def ranked(graph: str, make: Callable[[], O.Ranker], **inputs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = GRAPHS[graph](spark, folder)
        return shown(make().rank(g, seeds(g), **{k: f(g) for k, f in inputs.items()}))

    return run


def out_degree(m: str = "m") -> str:
    return f"deg AS MATERIALIZED (SELECT nodes.id, coalesce(sum({m}.w), 0) AS d FROM nodes LEFT JOIN {m} ON {m}.src = nodes.id GROUP BY nodes.id)"


add("pagerank_k", ranked("cs", lambda: O.PageRank(0.85, quotient=False, **steps(5))), S.shown(S.pagerank(steps=5, quotient=False)))
add("pagerank_quotient_k", ranked("cs", lambda: O.PageRank(0.85, **steps(5))), S.shown(S.pagerank(steps=5)))
add("pagerank_directed_k", ranked("nat", lambda: O.PageRank(0.9, **steps(6))), S.shown(S.pagerank("nat", "col", 6, 0.9)))
add("pagerank_closed_k", ranked("cs", lambda: O.PageRankClosed(0.85, **steps(5))), S.shown(S.closed("cs", "symmetric", [0.85**k for k in range(5)])))
_HEAT = O.HeatKernel(3).coefficients(5)
add("heat_kernel_k", ranked("cs", lambda: O.HeatKernel(3, **steps(5))), S.shown(S.closed("cs", "symmetric", _HEAT)))
_A = (1 - 0.9) / 0.9
add(
    "absorbing_k",
    ranked("cs", lambda: O.AbsorbingWalks(0.9, **steps(4)), absorption=lambda g: Signal(g, g.nodes.select("id", (1.0 + key() % 3).alias("value")))),
    S.shown(S.diffusion("cs", "symmetric", 4, lambda k: "(x * d + p * a) / (d + a)", tables=f"{out_degree()}, ab AS (SELECT id, (1.0::DOUBLE + {KEY_SQL} % 3) * {_A!r}::DOUBLE AS a0 FROM nodes)", join=("deg", "ab"), columns={"d": "d", "a": "a0"})),
)
add("symmetric_absorbing_k", ranked("cs", lambda: O.SymmetricAbsorbing(**steps(4))), S.shown(S.diffusion("cs", "symmetric", 4, lambda k: "(x * d + p * a) / (d + a)", tables=out_degree(), join=("deg",), columns={"d": "d", "a": "(1 + sqrt(1 + 4 * d)) / 2"}, moved="r / a")))
add("dijkstra_k", ranked("cs", lambda: O.DijkstraRank(0.2, **steps(4))), S.shown(S.diffusion("cs", "symmetric", 4, lambda k: "greatest(r, 0.2::DOUBLE * x)")))
add("biased_kernel_k", ranked("cs", lambda: O.BiasedKernel(0.85, 1, quotient=False, **steps(3))), S.shown(S.diffusion("cs", "symmetric", 3, lambda k: f"p + {0.85 / k!r}::DOUBLE * x * p - r", quotient=False)))
_W = [0.9, 0.5, 0.25, 0.1]
add("generic_k", ranked("cs", lambda: O.GenericFilter(_W, **steps(4))), S.shown(S.closed("cs", "symmetric", _W)))
add("impulse_k", ranked("cs", lambda: O.Impulse(_W, quotient=False, **steps(4))), S.shown(S.diffusion("cs", "symmetric", 4, lambda k: f"{_W[k - 1]!r}::DOUBLE * x + {1 - _W[k - 1]!r}::DOUBLE * r", quotient=False)))
add("lowpass_k", ranked("cs", lambda: O.LowPass(_W, quotient=False, **steps(4))), S.shown(S.diffusion("cs", "symmetric", 4, lambda k: f"{_W[k - 1]!r}::DOUBLE * x + {1 - _W[k - 1]!r}::DOUBLE * p", quotient=False)))
add(
    "chebyshev_k",
    ranked("cs", lambda: O.GenericFilter(_W, chebyshev=True, **steps(4))),
    S.shown(S.diffusion("cs", "symmetric", 4, lambda k: f"r + {_W[k - 1]!r}::DOUBLE * t", quotient=False, columns={"t": "p", "b": "0.0::DOUBLE"}, moved="t", start="0.0::DOUBLE", follow=lambda k: {"t": "x" if k < 2 else "2 * x - t", "b": "t"})),
)
add("warm_start_k", ranked("cs", lambda: O.PageRank(0.85, **steps(3)), warm_start=lambda g: Signal(g, g.nodes.withColumn("value", F.lit(0.001)))), S.shown(S.pagerank(start="0.001::DOUBLE")))
add("eigenvector_k", ranked("cs", lambda: O.PageRank(0.85, eigenvectors=True, **steps(3))), S.shown(S.diffusion("cs", "symmetric", 3, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * r")))
_FIRST = S.pagerank(steps=2, name="one", prefix="a")
add("personalized_filter_k", ranked("cs", lambda: O.PageRank(0.85, **steps(2)) >> O.HeatKernel(3, **steps(2))), S.shown(S.closed("cs", "symmetric", O.HeatKernel(3).coefficients(2), seed="(SELECT value FROM one WHERE one.id = nodes.id)", head=_FIRST)))
add("custom_filter_k", ranked("cs", lambda: O.CustomFilter(lambda k: 0.5 * F.col("r_in") + 0.25 * F.col("r") + 0.25 * F.col("p"), quotient=False, **steps(3))), S.shown(S.diffusion("cs", "symmetric", 3, lambda k: "0.5::DOUBLE * x + 0.25::DOUBLE * r + 0.25::DOUBLE * p", quotient=False)))
add("pagerank_laplacian_k", ranked("nat", lambda: O.PageRank(0.5, quotient=False, normalization="laplacian", **steps(3))), S.shown(S.pagerank("nat", "laplacian", 3, 0.5, quotient=False)))


def _propagate(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["nat"](spark, folder)
    features = g.nodes.select("id", (key() % 3).cast("double").alias("f0"), (key() % 4).cast("double").alias("f1"))
    out = O.PageRank(0.85, quotient=False, **steps(2)).propagate(g, features)
    return out.select("id", rounded("f0").alias("f0"), rounded("f1").alias("f1"))


_F1 = S.diffusion("nat", "col", 2, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", quotient=False, seed=f"({KEY_SQL} % 3)::DOUBLE", name="one", prefix="a")
_F2 = S.diffusion("nat", "col", 2, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", quotient=False, seed=f"({KEY_SQL} % 4)::DOUBLE", name="two", prefix="b", head=_F1)
add("propagate_features_k", _propagate, f"{_F2} SELECT id, {S.ROUND.format('one.value')} AS f0, {S.ROUND.format('two.value')} AS f1 FROM one JOIN two USING (id)")




def _embeddings_of(g: Graph, spark: SparkSession, folder: str) -> DataFrame:
    """The 64 numbers of the embedding that has a node's number; nodes without one have 0."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return g.nodes.join(rows, key() == F.col("vec_id"), "left").select("id", *[F.coalesce(F.col("e")[i], F.lit(0.0)).alias(f"e{i}") for i in range(64)])


def propagated(make: Callable[[], O.GraphFilter]) -> Query:
    """All 64 columns of embeddings moved over customers and suppliers: id, place, v."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = GRAPHS["cs"](spark, folder)
        out = make().propagate(g, _embeddings_of(g, spark, folder))
        cells = out.select("id", F.posexplode(F.array(*[F.col(f"e{i}") for i in range(64)])).alias("place", "v"))
        return cells.select("id", F.col("place").cast("long").alias("place"), (F.floor(F.col("v") * 1e6 + 0.5) / 1e6).alias("v"))

    return run


def _propagated_sql(steps: int, formula: Callable[[int], str], first: str, last: str = "r", quotient: bool = False, tables: str = "") -> str:
    """The same in long form. Cells have p, r, t and x (t moved); first: r and t at the start; formula: r and t after a step."""
    features = f"f AS MATERIALIZED (SELECT id, unnest(CAST(range(0, 64) AS BIGINT[])) AS place, unnest(CAST(coalesce(embedding, list_transform(range(0, 64), lambda i: 0.0::FLOAT)) AS DOUBLE[])) AS v FROM nodes LEFT JOIN embeddings ON vec_id = {KEY_SQL})"
    out = [f"{S.adjacency('cs', 'symmetric')}{tables}", features]
    out.append("nrm AS MATERIALIZED (SELECT place, sum(abs(v)) AS norm FROM f GROUP BY place)")
    out.append(f"z0 AS MATERIALIZED (SELECT id, place, p, {first} FROM (SELECT id, f.place, v / norm AS p FROM f JOIN nrm ON f.place = nrm.place))")
    for k in range(1, steps + 1):
        out.append(f"zx{k} AS MATERIALIZED (SELECT dst AS id, place, sum(t * w) AS x FROM z{k - 1} JOIN m ON id = src GROUP BY dst, place)")
        body = f"SELECT id, place, p, {formula(k)} FROM (SELECT z.id, z.place, p, r, t, coalesce(x, 0) AS x{', d, a0 AS a' if tables else ''} FROM z{k - 1} z LEFT JOIN zx{k} ON z.id = zx{k}.id AND z.place = zx{k}.place{' JOIN deg ON deg.id = z.id JOIN ab ON ab.id = z.id' if tables else ''})"
        if quotient:
            out.append(f"zu{k} AS MATERIALIZED ({body})")
            out.append(f"zt{k} AS MATERIALIZED (SELECT place, sum(r) AS total FROM zu{k} GROUP BY place)")
            body = f"SELECT id, zu{k}.place, p, r / total AS r, r / total AS t FROM zu{k} JOIN zt{k} ON zu{k}.place = zt{k}.place"
        out.append(f"z{k} AS MATERIALIZED ({body})")
    return ",\n".join(out) + f"\nSELECT id, z.place, floor({last} * norm * 1e6 + 0.5) / 1e6 AS v FROM z{steps} z JOIN nrm ON nrm.place = z.place"


_HEAT3 = O.HeatKernel(3).coefficients(3)
add("propagate_pagerank_k", propagated(lambda: O.PageRank(0.85, quotient=False, **steps(3))), _propagated_sql(3, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p AS r, 0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p AS t", "p AS r, p AS t"))
add("propagate_heat_k", propagated(lambda: O.HeatKernel(3, **steps(3))), _propagated_sql(3, lambda k: f"r + {_HEAT3[k - 1]!r}::DOUBLE * t AS r, x AS t", "0.0::DOUBLE AS r, p AS t"))
add(
    "propagate_absorbing_k",
    propagated(lambda: O.AbsorbingWalks(0.9, quotient=False, **steps(2))),
    _propagated_sql(2, lambda k: "(x * d + p * a) / (d + a) AS r, (x * d + p * a) / (d + a) AS t", "p AS r, p AS t", tables=f", {out_degree()}, ab AS (SELECT id, {_A!r}::DOUBLE AS a0 FROM nodes)"),
)
add("propagate_tol", propagated(lambda: O.PageRank(0.5, quotient=False, tol=1e-7)))


def _hops_shared(spark: SparkSession, folder: str) -> DataFrame:
    """Two closed forms of one seed, which is moved once."""
    g, store = GRAPHS["cs"](spark, folder), O.HopStore()
    p = seeds(g).stored()
    heat, closed = O.HeatKernel(3, hops=store, **steps(4)).rank(g, p), O.PageRankClosed(0.85, hops=store, **steps(4)).rank(g, p)
    return heat.df.withColumnRenamed("value", "heat").join(closed.df.withColumnRenamed("value", "closed"), "id").select("id", rounded("heat").alias("heat"), rounded("closed").alias("closed"))


add(
    "hop_store_k",
    _hops_shared,
    f"{S.closed('cs', 'symmetric', [0.85**k for k in range(4)], name='two', prefix='b', head=S.closed('cs', 'symmetric', O.HeatKernel(3).coefficients(4), name='one', prefix='a'))} SELECT id, {S.ROUND.format('one.value')} AS heat, {S.ROUND.format('two.value')} AS closed FROM one JOIN two USING (id)",
)


def _draw_sql(k: int) -> str:
    return f"('0x' || substr(md5(src || chr(9) || dst || chr(9) || '{k}' || chr(9) || '7'), 1, 8))::BIGINT >= {int(0.25 * (1 << 32))}"


add("dropout_edges", on("cs", lambda g: O.dropped(Normalization("symmetric").edges(g), 0.25, 1, 7).select("src", "dst", rounded("w").alias("w"))), f"{S.adjacency('cs', 'symmetric')} SELECT src, dst, {S.ROUND.format('w / 0.75::DOUBLE')} AS w FROM m WHERE {_draw_sql(1)}")
_THIN = S.adjacency("cs", "symmetric") + "".join(f", m{k} AS MATERIALIZED (SELECT src, dst, w / 0.75::DOUBLE AS w FROM m WHERE {_draw_sql(k)})" for k in (1, 2))
add(
    "dropout_k",
    ranked("cs", lambda: O.PageRank(0.85, quotient=False, dropout=0.25, dropout_seed=7, **steps(2))),
    S.shown(S.diffusion("cs", "symmetric", 1, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", quotient=False, m="m2", prefix="b", start="(SELECT value FROM one WHERE one.id = bp.id) / norm", name="two", head=S.diffusion("cs", "symmetric", 1, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", quotient=False, m="m1", prefix="a", name="one", head=_THIN)).replace("FROM bp)", "FROM bp, bn)"), "two"),
)
add("tautology", ranked("cs", lambda: O.PageRank(0.85, **steps(3)) >> P.Tautology()), S.shown(S.pagerank()))
add("sequential", ranked("cs", lambda: Chain(O.PageRank(0.85, **steps(2)), O.HeatKernel(3, **steps(2)))), ORACLE_SQL["personalized_filter_k"])


def _fair_sql(base: str, head: str) -> str:
    """Locally fair PageRank of three steps after a head with raw edges; base is what is redistributed by, of n (id, v)."""
    tables = f"""sens AS MATERIALIZED (SELECT id, {SENSITIVE_SQL} AS s FROM nodes), phi AS MATERIALIZED (SELECT sum(s) / count(*) AS phi FROM sens),
flow AS MATERIALIZED (SELECT dst AS id, sum(w * s) AS red, sum(w * (1 - s)) AS blue FROM raw JOIN sens ON src = id GROUP BY dst),
kinds AS MATERIALIZED (SELECT id, s, coalesce(red, 0) AS red, coalesce(blue, 0) AS blue, phi, coalesce(red, 0) < phi * (coalesce(red, 0) + coalesce(blue, 0)) AS low, {base} AS v FROM sens LEFT JOIN flow USING (id), phi),
fair AS MATERIALIZED (SELECT id,
  CASE WHEN low THEN (CASE WHEN blue = 0 THEN 0 ELSE (1 - phi) / blue END) WHEN red <> 0 THEN phi / red ELSE 1.0::DOUBLE END AS scale,
  CASE WHEN low THEN phi - (CASE WHEN blue = 0 THEN 0 ELSE (1 - phi) * (red / blue) END) WHEN red = 0 THEN phi ELSE 0.0::DOUBLE END AS dr0,
  CASE WHEN low THEN 0.0::DOUBLE WHEN red <> 0 THEN (1 - phi) - phi * (blue / red) ELSE 1 - phi END AS db0,
  s * v / (SELECT sum(s * v) FROM kinds) AS xr0, (1 - s) * v / (SELECT sum((1 - s) * v) FROM kinds) AS xb0 FROM kinds),
fm AS MATERIALIZED (SELECT src, dst, w * scale AS w FROM raw JOIN fair ON src = id)"""
    sums = lambda k: f"(SELECT sum(r * dr) FROM f{k - 1}) * xr + (SELECT sum(r * db) FROM f{k - 1}) * xb"
    return S.diffusion("cs", "none", 3, lambda k: f"0.85::DOUBLE * (x + {sums(k)}) + 0.15000000000000002::DOUBLE * p", quotient=False, tables=tables, join=("fair",), columns={"dr": "dr0", "db": "db0", "xr": "xr0", "xb": "xb0"}, m="fm", prefix="f", end="r - 0.15000000000000002::DOUBLE * p", head=head)


add("lfpr_k", ranked("cs", lambda: O.FairPageRank(0.85, quotient=False, **steps(3)), sensitive=sensitive), S.shown(_fair_sql("1.0::DOUBLE", S.adjacency("cs", "none"))))
add(
    "lfpr_original_k",
    ranked("cs", lambda: O.FairPageRank(0.85, redistributor="original", quotient=False, **steps(3)), sensitive=sensitive),
    S.shown(_fair_sql("(SELECT value FROM one WHERE one.id = sens.id)", S.pagerank("cs", "col", 3, name="one", prefix="a"))),
)

# ---- filters that stop by themselves ----------------------------------------------------

add("pagerank_tol", ranked("cs", lambda: O.PageRank(0.85, tol=1e-7)))
add("rank_order_stop", ranked("nat", lambda: O.PageRank(0.85, convergence=RankOrder(0.85, 0.98))))
add("lanczos", ranked("cs", lambda: O.PageRankClosed(0.5, krylov=5, **steps(8))))


def _arnoldi(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["nat"](spark, folder)
    base, _ = O.arnoldi(Normalization("symmetric").edges(g), seeds(g).df.withColumnRenamed("value", "v0"), 3)
    return base.select("id", *[rounded(f"v{i}").alias(f"v{i}") for i in range(3)])


def _eigdegree(spark: SparkSession, folder: str) -> DataFrame:
    return eigdegree(GRAPHS["nat"](spark, folder)).select("id", rounded("d").alias("d"))


add("arnoldi", _arnoldi)
add("eigdegree", _eigdegree)

# ---- postprocessors on three steps of PageRank -------------------------------------------


def base(g: Graph) -> Signal:
    """The scores that postprocessors and measures start from."""
    return settled(O.PageRank(0.85, **steps(3)).rank(g, seeds(g)))


BASE = S.settled(S.pagerank())


def post(make: Callable[[], P.Postprocessor], **inputs) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = GRAPHS["cs"](spark, folder)
        return shown(make().transform(base(g), **{k: f(g) for k, f in inputs.items()}))

    return run


def post_sql(value: str, more: str = "") -> str:
    return f"{BASE}{more}\nSELECT id, {S.ROUND.format(value)} AS score FROM base"


add("normalize_max", post(lambda: P.Normalize("max")), post_sql("value / (SELECT max(value) FROM base)"))
add("normalize_sum", post(lambda: P.Normalize("sum")), post_sql("value / (SELECT sum(value) FROM base)"))
add("normalize_range", post(lambda: P.Normalize("range")), post_sql("(value - (SELECT min(value) FROM base)) / ((SELECT max(value) FROM base) - (SELECT min(value) FROM base))"))
add("normalize_l2", post(lambda: P.Normalize("L2")), post_sql("value / (SELECT sqrt(sum(value * value)) FROM base)"))
add("ordinals", post(lambda: P.Ordinals()), post_sql("row_number() OVER (ORDER BY value DESC, id)"))
add("transformer_exp", post(lambda: P.Transformer(F.exp)), post_sql("exp(value)"))
add("top_k", post(lambda: P.Top(20)), post_sql("CASE WHEN value >= (SELECT value FROM base ORDER BY value DESC, id LIMIT 1 OFFSET 19) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add("top_fraction", post(lambda: P.Top(0.1)), post_sql("CASE WHEN value >= (SELECT min(value) FROM (SELECT value, row_number() OVER (ORDER BY value DESC, id) AS r, count(*) OVER () AS n FROM base) WHERE r = CAST(floor(0.1 * n) AS BIGINT)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add("threshold", post(lambda: P.Threshold(0.01)), post_sql("CASE WHEN value > 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add("threshold_inclusive", post(lambda: P.Threshold(0.01, inclusive=True)), post_sql("CASE WHEN value >= 0.01 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add(
    "threshold_gap",
    post(lambda: P.Threshold("gap")),
    post_sql("CASE WHEN value > (SELECT value FROM gaps ORDER BY g DESC, r LIMIT 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", ",\no AS (SELECT value, row_number() OVER (ORDER BY value DESC, id) AS r, lag(value) OVER (ORDER BY value DESC, id) AS prev FROM base),\ngaps AS (SELECT value, r, (prev - value) / prev AS g FROM o WHERE prev > 0)"),
)
_EVEN = S.diffusion("cs", "symmetric", 3, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", seed="1.0::DOUBLE", name="even", prefix="e", head=BASE)
add("sweep", post(lambda: P.Sweep(uniform=O.PageRank(0.85, **steps(3)))), f"{_EVEN} SELECT id, {S.ROUND.format('base.value / (1e-12::DOUBLE + even.value)')} AS score FROM base JOIN even USING (id)")
add("linear_sweep", post(lambda: P.LinearSweep(uniform=O.PageRank(0.85, **steps(3)))), f"{_EVEN} SELECT id, {S.ROUND.format('base.value - even.value')} AS score FROM base JOIN even USING (id)")
add("mabs_maintain", post(lambda: P.MabsMaintain(), personalization=seeds), post_sql(f"value * (SELECT sum({SEED_SQL}) FROM nodes) / (SELECT sum(abs(value)) FROM base)"))
_SENS = f",\nsen AS MATERIALIZED (SELECT id, value, {SENSITIVE_SQL} AS s FROM base), tot AS MATERIALIZED (SELECT sum(value * s) AS a, sum(value * (1 - s)) AS b, sum(s) / count(*) AS phi, sum(value) AS t, count(*) AS n, sum(s) AS ns FROM sen)"


def _separate(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["cs"](spark, folder)
    return shown(P.SeparateNormalization(sensitive(g)).transform(base(g)))


add("separate_norm", _separate, f"{BASE}{_SENS} SELECT id, {S.ROUND.format('value * s / a + value * (1 - s) / b')} AS score FROM sen, tot")
add("add_neg", on("cs", lambda g: shown((O.PageRank(0.85, **steps(3)) & ~O.HeatKernel(3, **steps(3))).rank(g, seeds(g)))), f"{S.closed('cs', 'symmetric', O.HeatKernel(3).coefficients(3), name='heat', prefix='h', head=S.pagerank())} SELECT id, {S.ROUND.format('scores.value - heat.value')} AS score FROM scores JOIN heat USING (id)")
add("signal_arithmetic", on("cs", lambda g: shown((base(g) * 2 + seeds(g)) / (1 + sensitive(g)) - base(g) ** 2)), f"{BASE} SELECT id, {S.ROUND.format(f'(value * 2 + {SEED_SQL}) / (1 + {SENSITIVE_SQL}) - value * value')} AS score FROM base")


def _on_top(g: Graph) -> Signal:
    top = base(g).map(lambda x: F.when(x > 0.01, x).otherwise(0.0))
    return P.Subgraph().transform(top)


def _subgraph_rank(g: Graph) -> Signal:
    inner = _on_top(g)
    return O.PageRank(0.85, **steps(2)).rank(inner.graph, inner)


_INNER = f"{BASE},\nkeep AS MATERIALIZED (SELECT id, value FROM base WHERE value > 0.01)"
_SUB_HEAD = f"{_INNER},\nraw2 AS MATERIALIZED (SELECT src, dst, w FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)), out2 AS (SELECT src, sum(w) AS d FROM raw2 GROUP BY src), in2 AS (SELECT dst, sum(w) AS d FROM raw2 GROUP BY dst), m2 AS MATERIALIZED (SELECT src, dst, w / sqrt(out2.d) / sqrt(in2.d) AS w FROM raw2 JOIN out2 USING (src) JOIN in2 USING (dst)), keep0 AS (SELECT id AS kid FROM keep)"
_SUB = S.diffusion("cs", "symmetric", 2, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", seed="coalesce((SELECT value FROM keep WHERE keep.id = nodes.id), 0.0)", name="inner_scores", prefix="i_", head=_SUB_HEAD, m="m2")
add("subgraph_rank", on("cs", lambda g: shown(_subgraph_rank(g))), f"{_SUB} SELECT id, {S.ROUND.format('value')} AS score FROM inner_scores WHERE id IN (SELECT id FROM keep)")
add("supergraph", on("cs", lambda g: shown(P.Supergraph().transform(_on_top(g)))), f"{BASE} SELECT id, CASE WHEN value > 0.01 THEN value ELSE 0.0::DOUBLE END AS score FROM base")


def oversampled(method: str) -> Query:
    return ranked("nat", lambda: P.SeedOversampling(O.PageRank(0.85, **steps(3)), method))


_NAT = S.pagerank("nat", "col", 3)


def _oversampled_sql(rule: str, head: str = _NAT) -> str:
    chain = S.diffusion("nat", "col", 3, lambda k: "0.85::DOUBLE * x + 0.15000000000000002::DOUBLE * p", seed=rule, name="again", prefix="o_", head=head)
    return f"{chain} SELECT id, {S.ROUND.format('value')} AS score FROM again"


_BY = "(SELECT value FROM scores WHERE scores.id = nodes.id)"
add("oversample_safe", oversampled("safe"), _oversampled_sql(f"CASE WHEN {_BY} >= (SELECT min(value) FROM scores WHERE {SEED_SQL} = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add("oversample_neighbors", oversampled("neighbors"), _oversampled_sql(f"CASE WHEN {SEED_SQL} = 1 OR EXISTS (SELECT 1 FROM seedy WHERE seedy.dst = nodes.id) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", f"{_NAT}, seedy AS (SELECT DISTINCT dst FROM edges JOIN (SELECT id FROM nodes WHERE {SEED_SQL} = 1) t ON src = t.id)"))
add("oversample_top", oversampled("top"), _oversampled_sql(f"CASE WHEN {SEED_SQL} = 1 OR {_BY} >= (SELECT value FROM (SELECT value, row_number() OVER (ORDER BY value DESC, id) AS r FROM scores) WHERE r = least((SELECT count(*) FROM nodes), CAST(floor((SELECT count(*) FROM nodes)::DOUBLE * (SELECT count(*) FROM nodes) / (SELECT count(*) FROM edges)) AS BIGINT))) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"))
add("boosted_oversample", ranked("cs", lambda: P.BoostedSeedOversampling(O.PageRank(0.85, **steps(3)))))

# ---- fairness ---------------------------------------------------------------------------


def fair(make: Callable[[], P.Postprocessor]) -> Query:
    return post(make, sensitive=sensitive)


add("fair_mult", fair(lambda: fairness.AdHocFairness(method="B")), f"{BASE}{_SENS} SELECT id, {S.ROUND.format('(value / t) * s * phi / (a / t) + (value / t) * (1 - s) * (1 - phi) / (b / t)')} AS score FROM sen, tot")
_GAIN = "(CASE WHEN a / t < phi THEN 1.0 ELSE 0.0 END)"
_LFPRO = f"""{BASE}{_SENS},
v AS MATERIALIZED (SELECT id, value / t AS v, s = {_GAIN} AS gains, CASE WHEN a / t < phi THEN phi - a / t ELSE (1 - phi) - b / t END AS mass, CASE WHEN a / t < phi THEN ns ELSE n - ns END AS size FROM sen, tot),
ups AS (SELECT v, mass, sum(v) OVER (ORDER BY v, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below, count(*) OVER (ORDER BY v DESC, id DESC) AS k FROM v WHERE NOT gains AND v > 0),
lev AS (SELECT v, (mass - coalesce(below, 0)) / k AS level FROM ups), cut AS (SELECT level FROM lev WHERE level <= v ORDER BY v, level DESC LIMIT 1)"""
add("fair_lfpro", fair(lambda: fairness.AdHocFairness(method="O")), f"{_LFPRO} SELECT id, {S.ROUND.format('CASE WHEN gains THEN v + mass / size ELSE greatest(v - (SELECT level FROM cut), 0.0) END')} AS score FROM v")
add(
    "fairwalk_k",
    on("cs", lambda g: shown(fairness.FairWalk(O.PageRank(0.85, normalization="col", **steps(3))).rank(g, seeds(g), sensitive(g)))),
    S.shown(S.pagerank(head=f"WITH {GRAPH_SQL['cs']}, f AS MATERIALIZED (SELECT id, {SENSITIVE_SQL} AS s FROM nodes), ph AS (SELECT sum(s) / count(*) AS phi FROM f), raw AS MATERIALIZED (SELECT src, dst, w / (s * phi + (1 - s) * (1 - phi)) AS w FROM edges JOIN f ON src = id, ph), {S.DEGREES}, m AS MATERIALIZED ({S.NORMALIZED['col']})")),
)


def _fair_personalizer(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["cs"](spark, folder)
    ranker = fairness.FairPersonalizer(O.PageRank(0.85, **steps(2)))
    return shown(ranker.rank(g, seeds(g), sensitive(g)))


add("fair_personalizer", _fair_personalizer)

# ---- measures -----------------------------------------------------------------------------


def measured(make: Callable[[Graph], M.Measure], scores: Callable[[Graph], Signal] = base) -> Query:
    return lambda spark, folder: (lambda g: make(g).frame(scores(g)).select(rounded("value").alias("value")))(GRAPHS["cs"](spark, folder))


def half(g: Graph) -> Signal:
    """Scores over their maximum."""
    return settled(P.Normalize("max").transform(base(g)))


_HALF = f"{BASE},\nhalf AS MATERIALIZED (SELECT id, {S.ROUND.format('value / (SELECT max(value) FROM base)')} AS value FROM base)"
_ROWS = f"{_HALF},\nrows AS MATERIALIZED (SELECT id, value AS x, {SEED_SQL} AS y FROM half),\nshares AS MATERIALIZED (SELECT id, x / (SELECT max(x) FROM rows) AS x, y / (SELECT max(y) FROM rows) AS y FROM rows)"


def value_sql(expression: str, source: str = "rows", head: str = _ROWS) -> str:
    return f"{head}\nSELECT {S.ROUND.format(expression)} AS value FROM {source}"


_EPS = "2.220446049250313e-16::DOUBLE"
_RANK = lambda c, as_: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {as_}"
_PLAIN = {
    "max_difference": (M.MaxDifference, "max(abs(y - x))"),
    "mabs": (M.Mabs, "avg(abs(y - x))"),
    "rmabs": (M.RMabs, "sum(abs(y - x)) / sum(abs(y))"),
    "msq": (M.MSQ, "avg((y - x) * (y - x))"),
    "msqrt": (M.MSQRT, "sqrt(avg((y - x) * (y - x)))"),
    "l1": (M.L1, "sum(abs(y - x))"),
    "l2": (M.L2, "sum((y - x) * (y - x))"),
    "euclidean": (M.Euclidean, "sqrt(sum((y - x) * (y - x)))"),
    "cos": (M.Cos, "sum(x * y) / sqrt(sum(x * x) * sum(y * y))"),
    "dot": (M.Dot, "sum(x * y)"),
    "accuracy": (M.Accuracy, "1 - avg(abs(y - x))"),
    "pearson": (M.Pearson, "corr(x, y)"),
    "prule": (M.PRule, "least((sum(x * y) / sum(y)) / (sum(x * (1 - y)) / sum(1 - y)), (sum(x * (1 - y)) / sum(1 - y)) / (sum(x * y) / sum(y)))"),
    "l2_disparity": (M.L2Disparity, "pow(sum(x * y) / avg(y) / count(*) - sum(x * (1 - y)) / (1 - avg(y)) / count(*), 2)"),
}
for name, (kind, expression) in _PLAIN.items():
    add(f"measure_{name}", measured(lambda g, k=kind: k(seeds(g)), half), value_sql(expression))
for name, (kind, expression) in {
    "tpr": (M.TPR, "sum(x * y) / sum(y)"),
    "tnr": (M.TNR, "sum((1 - x) * (1 - y)) / sum(1 - y)"),
    "ppv": (M.PPV, "sum(x * y) / sum(x)"),
}.items():
    add(f"measure_{name}", measured(lambda g, k=kind: k(seeds(g)), half), value_sql(expression, "shares"))


def damped(g: Graph) -> Signal:
    """Within (0.05, 0.95), for logarithms."""
    return half(g).map(lambda x: 0.05 + 0.9 * x)


_DAMP = f"{_HALF},\nrows AS MATERIALIZED (SELECT id, 0.05::DOUBLE + 0.9::DOUBLE * value AS x, {SEED_SQL} AS y FROM half)"
add("measure_binary_cross_entropy", measured(lambda g: M.BinaryCrossEntropy(seeds(g)), damped), value_sql(f"-sum(y * ln(x + {_EPS}) + (1 - y) * ln(1 - x + {_EPS}))", head=_DAMP))
add("measure_cross_entropy", measured(lambda g: M.CrossEntropy(damped(g)), seeds), value_sql("-sum(y * ln(x))", head=_DAMP))
_KL = f"{_HALF},\nrows AS MATERIALIZED (SELECT id, value AS x, 0.05::DOUBLE + 0.9::DOUBLE * value AS y FROM half),\nt AS MATERIALIZED (SELECT sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM rows),\nkl AS MATERIALIZED (SELECT (x / sx + {_EPS}) / (1 + n * {_EPS}) AS x, (y + {_EPS}) / (sy + n * {_EPS}) AS y FROM rows, t)"
add("measure_kl_divergence", measured(lambda g: M.KLDivergence(damped(g)), half), value_sql("sum(x * ln(x / y))", "kl", _KL))
add("measure_mkl_divergence", measured(lambda g: M.MKLDivergence(damped(g)), half), value_sql("-sum(x * ln(x / y)) / count(*)", "kl", _KL))


def _ranked_sql(known: str = SEED_SQL, where: str = "true") -> str:
    return f"{_HALF},\nrows AS MATERIALIZED (SELECT id, value AS x, {known} AS y FROM half),\nranked AS MATERIALIZED (SELECT x, y, {_RANK('x', 'rx')}, {_RANK('y', 'ry')} FROM rows WHERE {where})"


_RANKED = _ranked_sql()
_AUC = "(sum(rx * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))"
add("measure_auc", measured(lambda g: M.AUC(seeds(g)), half), value_sql(_AUC, "ranked", _RANKED))
add("measure_auc_excluding", measured(lambda g: M.AUC(seeds(g), exclude=Signal(g, g.nodes.select("id", (key() % 10 == 0).cast("double").alias("value")))), half), value_sql(_AUC, "ranked", _ranked_sql(where=f"{KEY_SQL} % 10 <> 0")))
add("measure_mann_whitney_parity", measured(lambda g: M.MannWhitneyParity(sensitive(g)), half), value_sql(f"1 - 2 * abs(0.5 - {_AUC})", "ranked", _ranked_sql(SENSITIVE_SQL)))
add("measure_spearman", measured(lambda g: M.Spearman(seeds(g)), half), value_sql("corr(rx, ry)", "ranked", _RANKED))
add(
    "measure_ndcg",
    measured(lambda g: M.NDCG(seeds(g), k=50), half),
    f"{_ROWS},\na AS (SELECT y, row_number() OVER (ORDER BY x DESC, id) AS r FROM rows), b AS (SELECT y, row_number() OVER (ORDER BY y DESC, id) AS r FROM rows) SELECT {S.ROUND.format('(SELECT sum(y / log2(r + 1)) FROM a WHERE r <= 50) / (SELECT sum(y / log2(r + 1)) FROM b WHERE r <= 50)')} AS value",
)
_PAIRS = f"{_HALF},\nef AS MATERIALIZED (SELECT w, a.value AS a, b.value AS b FROM edges JOIN half a ON src = a.id JOIN half b ON dst = b.id)"
add("measure_conductance", measured(lambda g: M.Conductance(), half), value_sql("(sum(w * a * (1 - b)) + sum(w * (1 - a) * b)) / (2 * least(sum(w * a * b), sum(w * (1 - a) * (1 - b))))", "ef", _PAIRS))
add("measure_density", measured(lambda g: M.Density(), half), value_sql("sum(w * a * b) / (SELECT sum(value) * sum(value) - sum(value * value) FROM half)", "ef", _PAIRS))
add("measure_modularity", measured(lambda g: M.Modularity(), half), value_sql("(sum(w * a * b) - sum(w * a) * sum(w * a) / sum(w)) / sum(w)", "ef", _PAIRS))


def _one(spark: SparkSession, value: float) -> DataFrame:
    return spark.createDataFrame([(float(value),)], "value double").select(rounded("value").alias("value"))


def combined(kind: type[M.Combined]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        g = GRAPHS["cs"](spark, folder)
        return _one(spark, kind([M.AUC(seeds(g)), M.Cos(seeds(g))], [1.0, 2.0], [(0.0, 0.9), (0.1, 1.0)])(half(g)))

    return run


_TWO = f"{_RANKED},\ntwo AS MATERIALIZED (SELECT least(greatest({_AUC}, 0.0), 0.9) AS a, least(greatest((SELECT sum(x * y) / sqrt(sum(x * x) * sum(y * y)) FROM rows), 0.1), 1.0) AS b FROM ranked)"
add("measure_am", combined(M.AM), value_sql("(a + 2 * b) / 3", "two", _TWO))
add("measure_gm", combined(M.GM), value_sql("exp((ln(a) + 2 * ln(b)) / 3)", "two", _TWO))
add("measure_disparity", combined(M.Disparity), value_sql("abs(a - 2 * b)", "two", _TWO))
add("measure_parity", combined(M.Parity), value_sql("1 - abs(a - 2 * b)", "two", _TWO))


def _group_scores(g: Graph, scale: float = 7.0) -> DataFrame:
    """group_id, id, value of four made groups of nodes. A scale of 8 makes sums of products exact, so that ties are ties in any order."""
    return g.nodes.select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("group_id")).select("group_id", "id", ((key() * (F.col("group_id") + 3) % 7) / scale).alias("value"))


_SIM = f"""WITH {GRAPH_SQL['nat']}, gs AS MATERIALIZED (SELECT i AS group_id, id, (({KEY_SQL} * (i + 3)) % 7) / 7.0::DOUBLE AS value FROM nodes, range(0, 4) t(i)),
nb AS MATERIALIZED (SELECT DISTINCT src AS id, dst AS n FROM edges),
dots AS MATERIALIZED (SELECT a.id AS u, b.id AS v, sum(a.value * b.value) AS d, sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS n FROM gs a JOIN gs b USING (group_id) GROUP BY 1, 2)"""


def _sim_whole(graph: str, scale: float) -> str:
    """_SIM over all edges of a graph."""
    return f"""WITH {GRAPH_SQL[graph]}, gs AS MATERIALIZED (SELECT i AS group_id, id, (({KEY_SQL} * (i + 3)) % 7) / {scale}::DOUBLE AS value FROM nodes, range(0, 4) t(i)),
nb AS MATERIALIZED (SELECT DISTINCT src AS id, dst AS n FROM edges),
dots AS MATERIALIZED (SELECT a.id AS u, b.id AS v, sum(a.value * b.value) AS d, sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS n FROM gs a JOIN gs b USING (group_id) GROUP BY 1, 2)"""


def _closed(g: Graph) -> Graph:
    """A graph with its two-step pairs as edges, which closes triangles."""
    return Graph(g.hops(2).withColumn("w", F.lit(1.0)), True, g.nodes)


_CLOSED = _sim_whole("reg", 7.0).replace("(SELECT DISTINCT src AS id, dst AS n FROM edges)", "(SELECT src AS id, dst AS n FROM edges UNION SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst)")


add(
    "measure_clustering_coefficient",
    on("reg", lambda g: M.ClusteringCoefficient(_closed(g)).frame(_group_scores(g)).select(rounded("value").alias("value"))),
    f"{_CLOSED}, wedge AS (SELECT a.n AS u, b.n AS v FROM nb a JOIN nb b ON a.id = b.id) SELECT {S.ROUND.format('sum(CASE WHEN dots.n = 0 THEN 0 ELSE d / dots.n END) / count(l.id)')} AS value FROM wedge JOIN dots USING (u, v) LEFT JOIN nb l ON l.id = wedge.u AND l.n = wedge.v",
)
add(
    "measure_clustering_whole",
    on("nat", lambda g: M.ClusteringCoefficient(g).frame(_group_scores(g)).select(rounded("value").alias("value"))),
    f"{_sim_whole('nat', 7.0)}, wedge AS (SELECT a.n AS u, b.n AS v FROM nb a JOIN nb b ON a.id = b.id) SELECT {S.ROUND.format('sum(CASE WHEN dots.n = 0 THEN 0 ELSE d / dots.n END) / count(l.id)')} AS value FROM wedge JOIN dots USING (u, v) LEFT JOIN nb l ON l.id = wedge.u AND l.n = wedge.v",
)
add("measure_link_auc", lambda spark, folder: _one(spark, (lambda g: M.LinkAssessment(g, hops=1, negatives=8)(_group_scores(g)))(GRAPHS["cs"](spark, folder))))
add("similarity_dot", on("nat", lambda g: M.similarities(g.neighbors().select(F.col("id").alias("u"), F.col("neighbor").alias("v")), _group_scores(g), "dot").select("u", "v", rounded("similarity").alias("similarity"))), f"{_SIM} SELECT u, v, {S.ROUND.format('d')} AS similarity FROM dots JOIN (SELECT DISTINCT src AS u, dst AS v FROM edges) USING (u, v)")


def _mistreatment(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["cs"](spark, folder)
    return _one(spark, M.Mistreatment(seeds(g), sensitive(g), measure=M.Cos)(half(g)))


add("measure_mistreatment", _mistreatment, f"{_ROWS}, t AS (SELECT {SENSITIVE_SQL} AS s, sum(x * y) / sqrt(sum(x * x) * sum(y * y)) AS c FROM rows GROUP BY 1) SELECT {S.ROUND.format('1 - (max(c) - min(c))')} AS value FROM t")


def _multi(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["nat"](spark, folder)
    scores = {i: Signal.of(g, _group_scores(g).where(F.col("group_id") == i)) for i in range(3)}
    return _one(spark, M.OverGroups(M.Cos, {i: seeds(g) for i in range(3)})(scores))


add("measure_multi_supervised", _multi, f"{_SIM}, c AS (SELECT group_id, sum(value * {SEED_SQL}) / sqrt(sum(value * value) * sum({SEED_SQL})) AS c FROM gs WHERE group_id < 3 GROUP BY 1) SELECT {S.ROUND.format('avg(c)')} AS value FROM c")


def _multi_un(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["nat"](spark, folder)
    scores = {i: Signal.of(g, _group_scores(g).where(F.col("group_id") == i)) for i in range(3)}
    return _one(spark, M.OverGroups(M.Density)(scores))


add("measure_multi_unsupervised", _multi_un, f"{_SIM}, e AS (SELECT a.group_id, sum(w * a.value * b.value) AS i FROM edges JOIN gs a ON src = a.id JOIN gs b ON dst = b.id AND a.group_id = b.group_id GROUP BY 1), n AS (SELECT group_id, sum(value) * sum(value) - sum(value * value) AS n FROM gs GROUP BY 1) SELECT {S.ROUND.format('avg(i / n)')} AS value FROM e JOIN n USING (group_id) WHERE group_id < 3")


def _segments(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Scores and known values (group_id, id, value) of all customers for each market segment."""
    who = table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_mktsegment", "c_acctbal")
    all_groups = F.array(*[F.lit(x) for x in SEGMENTS])
    scores = who.select(F.explode(all_groups).alias("group_id"), "id", "c_acctbal", "c_mktsegment")
    value = F.pmod(key() * 7 + F.length("group_id"), F.lit(101)).cast("double")
    known = F.when(F.col("c_mktsegment") == F.col("group_id"), 1.0).otherwise(0.0)
    return scores.select("group_id", "id", value.alias("value")), scores.select("group_id", "id", known.alias("value"))


#: The market segments of customers.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SEGMENTS_SQL = f"""WITH s AS (SELECT unnest({list(SEGMENTS)!r}) AS group_id), r AS MATERIALIZED (SELECT group_id, 'c' || c_custkey AS id, ((c_custkey * 7 + length(group_id)) % 101)::DOUBLE AS x, CASE WHEN c_mktsegment = group_id THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM customer, s)"""


def by_group(measure: Callable[[], M.Supervised]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        scores, known = _segments(spark, folder)
        return M.by_group(measure(), scores, known).select("group_id", rounded("value").alias("value"))

    return run


add("measure_auc_by_group", by_group(M.AUC), f"{_SEGMENTS_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY group_id ORDER BY x) + (count(*) OVER (PARTITION BY group_id, x) - 1) / 2.0::DOUBLE AS k FROM r) SELECT group_id, {S.ROUND.format('(sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y)))')} AS value FROM k GROUP BY 1")
add("measure_ndcg_by_group", by_group(lambda: M.NDCG(k=50)), f"{_SEGMENTS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY x DESC, id) AS a, row_number() OVER (PARTITION BY group_id ORDER BY y DESC, id) AS b FROM r) SELECT group_id, {S.ROUND.format('sum(CASE WHEN a <= 50 THEN y / log2(a + 1) ELSE 0 END) / sum(CASE WHEN b <= 50 THEN y / log2(b + 1) ELSE 0 END)')} AS value FROM k GROUP BY 1")
add("measure_cos_by_group", by_group(M.Cos), f"{_SEGMENTS_SQL} SELECT group_id, {S.ROUND.format('sum(x * y) / sqrt(sum(x * x) * sum(y * y))')} AS value FROM r GROUP BY 1")
add(
    "split_groups",
    lambda spark, folder: M.split(communities(spark, folder), 0.5)[0].groupBy("group_id").agg(F.count("id").alias("n")),  # which members is by hash, which SQL engines don't share
    f"WITH {COMMUNITIES_SQL} SELECT group_id, CAST(floor(count(*) * 0.5) AS BIGINT) AS n FROM groups GROUP BY 1",
)
add("backend_conv", on("nat", lambda g: conv(g.edges, g.nodes.withColumn("value", (key() % 3).cast("double")), "value").select("id", rounded("value").alias("value"))), f"{NAT} SELECT dst AS id, {S.ROUND.format('sum(w * (CAST(substr(src, 2) AS BIGINT) % 3))')} AS value FROM edges GROUP BY dst")
add("backend_safe_inv", on("nat", lambda g: g.nodes.withColumn("v", safe_inv((key() % 3).cast("double"))).select("id", rounded("v").alias("value"))), f"{NAT} SELECT id, CASE WHEN {KEY_SQL} % 3 = 0 THEN 0.0::DOUBLE ELSE {S.ROUND.format(f'1.0::DOUBLE / ({KEY_SQL} % 3)')} END AS value FROM nodes")

# ---- tuners, benchmarks, recipes, sources ---------------------------------------------------


def tuned(make: Callable[[], T.Tuner]) -> Query:
    return ranked("nat", make)


add("algorithm_selection", tuned(lambda: T.Selection([O.PageRank(0.85, **steps(3)), O.PageRank(0.5, **steps(3)), O.HeatKernel(3, **steps(3))], M.Cos, (0.5,))))
add("parameter_tuner", ranked("cs", lambda: T.ParameterTuner(measure=M.Cos, training=0.5)))
add("hop_tuner", ranked("cs", lambda: T.HopTuner()))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    """Three filters on two graphs, with all seeds known: share 1, so that SQL can follow."""
    graphs = {n: GRAPHS[n](spark, folder) for n in ("nat", "reg")}
    kinds = {"HK": O.HeatKernel(3, **steps(2)), "PPR": O.PageRank(0.85, **steps(2)), "low": O.LowPass(_W, **steps(2))}
    return B.benchmark(spark, kinds, [(n, g, settled(seeds(g)).df) for n, g in graphs.items()], {"cos": M.Cos}, shares=(1,)).withColumn("value", rounded("value"))


def _results_sql() -> str:
    """results (dataset, algorithm, value) of the same runs."""
    chains, rows = [], []
    for n, kind in (("nat", "col"), ("reg", "symmetric")):
        runs = {
            "HK": lambda **o: S.closed(n, kind, O.HeatKernel(3).coefficients(2), **o),  # noqa: B023
            "PPR": lambda **o: S.pagerank(n, kind, 2, **o),  # noqa: B023
            "low": lambda **o: S.diffusion(n, kind, 2, lambda k: f"{_W[k - 1]!r}::DOUBLE * x + {1 - _W[k - 1]!r}::DOUBLE * p", **o),  # noqa: B023
        }
        head = S.adjacency(n, kind).removeprefix("WITH ")
        for i, (a, run) in enumerate(runs.items()):
            head = run(head=head, name=f"r{i}", prefix=f"q{i}_")
            rows.append(f"SELECT '{n}' AS dataset, '{a}' AS algorithm, {S.ROUND.format('sum(value * y) / sqrt(sum(value * value) * sum(y * y))')} AS value FROM r{i} JOIN seen USING (id)")
        chains.append(f"SELECT * FROM (WITH {head}, seen AS (SELECT id, {SEED_SQL} AS y FROM nodes) {' UNION ALL '.join(rows[-3:])})")
    return f"WITH results AS ({' UNION ALL '.join(chains)})"


_RESULTS = _results_sql()


def _benchmark(spark: SparkSession, folder: str) -> DataFrame:
    g = GRAPHS["nat"](spark, folder)
    return B.benchmark(spark, {"PPR": O.PageRank(0.85, **steps(3)), "HK": O.HeatKernel(3, **steps(3))}, [("nat", g, seeds(g).df)], {"cos": M.Cos, "mabs": M.Mabs}).withColumn("value", rounded("value"))


add("benchmark_table", _benchmark)
add("benchmark_ranks", lambda spark, folder: B.ranks(_results(spark, folder)).select("dataset", "algorithm", "value"), f"{_RESULTS} SELECT dataset, algorithm, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0::DOUBLE AS value FROM results")
add("benchmark_average", lambda spark, folder: B.average(_results(spark, folder)).select("dataset", "algorithm", rounded("value").alias("value")), f"{_RESULTS} SELECT dataset, algorithm, value FROM results UNION ALL SELECT 'Average', algorithm, {S.ROUND.format('avg(value)')} FROM results GROUP BY algorithm")
add("community_partition", on("nat", lambda g: R.partition(_group_scores(g)).select("id", F.col("group_id").cast("long").alias("group_id"))), f"{_SIM} SELECT id, min(group_id) AS group_id FROM (SELECT *, max(value) OVER (PARTITION BY id) AS top FROM gs) WHERE value = top GROUP BY id")
add("community_detect", on("nat", lambda g: shown(R.detect_community(g, O.PageRank(0.85, **steps(3)), seeds(g), 0.1))))
add(
    "link_predict_topk",
    on("reg", lambda g: R.predict_links(g, _group_scores(g, 8.0), 3, "dot").select("src", "dst", rounded("similarity").alias("similarity"))),
    f"{_sim_whole('reg', 8.0)}, far AS (SELECT DISTINCT a.id AS u, b.n AS v FROM nb a JOIN nb b ON a.n = b.id WHERE a.id <> b.n AND NOT EXISTS (SELECT 1 FROM nb c WHERE c.id = a.id AND c.n = b.n)), r AS (SELECT u, v, d, row_number() OVER (PARTITION BY u ORDER BY d DESC, v) AS k FROM far JOIN dots USING (u, v)) SELECT u AS src, v AS dst, {S.ROUND.format('d')} AS similarity FROM r WHERE k <= 3",
)
add(
    "link_predict_whole",
    on("cs", lambda g: R.predict_links(g, _group_scores(g, 8.0), 3, "dot").select("src", "dst", rounded("similarity").alias("similarity"))),
    f"{_sim_whole('cs', 8.0)}, two AS (SELECT DISTINCT a.id AS u, b.n AS v FROM nb a JOIN nb b ON a.n = b.id WHERE a.id <> b.n), far AS (SELECT u, v FROM two LEFT JOIN nb ON nb.id = u AND nb.n = v WHERE nb.id IS NULL), r AS (SELECT u, v, d, row_number() OVER (PARTITION BY u ORDER BY d DESC, v) AS k FROM far JOIN dots USING (u, v)) SELECT u AS src, v AS dst, {S.ROUND.format('d')} AS similarity FROM r WHERE k <= 3",
)




def _projected_links(spark: SparkSession, folder: str) -> DataFrame:
    """For each node whose number is divisible by 50, the ten best links among all nodes."""
    g = GRAPHS["cs"](spark, folder)
    return CoSimRank(dims=256).links(g, g.nodes.where(key() % 50 == 0), 10).select("src", "dst", rounded("score").alias("score"), F.col("place").cast("long").alias("place"))


add("cosimrank_links", _projected_links)
add("cosimrank_k", ranked("cs", lambda: CoSimRank(dims=256)))
add("tune_impulse", ranked("cs", lambda: T.ParameterTuner(lambda w: O.Impulse(w, **steps(3)), [1.0] * 3, measure=M.Cos, training=0.5, deviation_tol=1e-2, divide_range=2)))
add("tune_lowpass", ranked("cs", lambda: T.ParameterTuner(lambda w: O.LowPass(w, **steps(3)), [1.0] * 3, measure=M.Cos, training=0.5, deviation_tol=1e-2, divide_range=2)))


def _embedded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("features"), F.col("label").cast("long").alias("label"))


_CELLS = "SELECT CAST(vec_id AS VARCHAR) AS id, CAST(unnest(range(0, len(embedding))) AS BIGINT) AS place, unnest(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS x, list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS total FROM embeddings"


def _cells(features: DataFrame) -> DataFrame:
    return features.select("id", F.posexplode("features").alias("place", "v")).select("id", F.col("place").cast("long").alias("place"), (F.floor(F.col("v") * 1e6 + 0.5) / 1e6).alias("v"))


add("feature_normalize", lambda spark, folder: _cells(L.normalized_features(_embedded(spark, folder))), f"SELECT id, place, CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE floor(x / total * 1e6 + 0.5) / 1e6 END AS v FROM ({_CELLS})")
add("labels_to_groups", lambda spark, folder: L.groups_of(_embedded(spark, folder)), "SELECT DISTINCT CAST(label AS BIGINT) AS group_id, CAST(vec_id AS VARCHAR) AS id FROM embeddings")
add("features_to_groups", lambda spark, folder: L.features_to_groups(_embedded(spark, folder)).select(F.col("group_id").cast("long").alias("group_id"), "id"), f"SELECT place AS group_id, id FROM ({_CELLS}) WHERE x <> 0")
add("feature_argmax_accuracy", lambda spark, folder: R.accuracy(R.predictions(_embedded(spark, folder)), _embedded(spark, folder).select("id", "label")).select(rounded("value").alias("value")), f"SELECT {S.ROUND.format('avg(CASE WHEN label = list_position(a, list_max(a)) - 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS value FROM (SELECT label, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS a FROM embeddings)")
add("one_hot_labels", lambda spark, folder: L.one_hot(_embedded(spark, folder).select("id", "label")).select("id", (F.array_position("labels", F.lit(1.0)) - 1).cast("long").alias("place"), F.size("labels").cast("long").alias("width")), "SELECT CAST(vec_id AS VARCHAR) AS id, dense_rank() OVER (ORDER BY label) - 1 AS place, (SELECT count(DISTINCT label) FROM embeddings) AS width FROM embeddings")


# ---- files: derived tables are written in each format and read again ---------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _nation_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("region"))


def _read_pairs(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "pairs")
    L.write_pairs(GRAPHS["cs"](spark, folder).edges, place)
    return L.read_pairs(spark, place)


def _read_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of customers, of which those in the graph of orders are kept; a group's number is its line."""
    place = _place(spark, "groups")
    L.write_groups(communities(spark, folder), place)
    return L.read_groups(spark, place, GRAPHS["cs"](spark, folder).nodes).select(F.col("group_id").cast("long").alias("group_id"), "id")


def _read_features(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "features")
    L.write_features(_embedded(spark, folder), place)
    return _cells(L.normalized_features(L.read_features(spark, place)))


def _read_feature_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, groups and features in one folder: the features of nodes with their groups."""
    place, names = _place(spark, "dataset"), _nation_names(spark, folder)
    L.write_pairs(GRAPHS["reg"](spark, folder).edges, f"{place}/pairs.txt")
    L.write_groups(names.select(F.col("region").alias("group_id"), "id"), f"{place}/groups.txt")
    L.write_features(names.select("id", F.array(key().cast("double") + 1, key("region").cast("double") + 1).alias("features")), f"{place}/features.txt")
    _, features, groups = L.read_feature_dataset(spark, place)
    return _cells(features).join(groups, "id").select("id", "place", "v", F.col("group_id").cast("long").alias("group_id"))


def _read_gml(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes with their values, then edges, of one GML file a part."""
    place, g = _place(spark, "gml"), GRAPHS["reg"](spark, folder)
    nodes = g.nodes.select(F.format_string('node [\n id %s\n value "%s"\n ]', "id", F.substring("id", 1, 1)).alias("value"))
    nodes.union(g.edges.select(F.format_string("edge [\n source %s\n target %s\n ]", "src", "dst"))).write.text(place)
    nodes, edges = L.read_gml(spark, place)
    return nodes.select(F.col("id").alias("a"), F.col("value").alias("b")).unionByName(edges)


def _product_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations as products of a region, similar to the next one."""
    place = _place(spark, "products")
    rows = _nation_names(spark, folder).select(F.format_string("Id: 1\nASIN: %s\n  group: %s\n  similar: 1  n%d\n\n", "id", "region", (key() + 1) % 25).alias("value"))
    rows.write.text(place)
    return L.read_product_records(spark, place)


def _read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with a flag for a positive balance and their segment as a text."""
    place = _place(spark, "profiles")
    rows = table(spark, folder, "customer").select(F.concat_ws("\t", F.concat(F.lit("c"), "c_custkey"), F.when(F.col("c_acctbal") > 0, "1").otherwise("0"), F.concat(F.lit("likes "), F.lower("c_mktsegment"), F.lit(" best"))).alias("value"))
    rows.write.text(place)
    return L.read_profile_groups(spark, place, {"solvent": 1}, {"building": 2, "machinery": 2})


add("read_pairs", _read_pairs, f"{CS} SELECT src AS a, dst AS b FROM edges")
add("read_groups", _read_groups, f"{CS}, {COMMUNITIES_SQL} SELECT dense_rank() OVER (ORDER BY group_id) - 1 AS group_id, id FROM groups WHERE id IN (SELECT id FROM nodes)")
add("read_features", _read_features, ORACLE_SQL["feature_normalize"])
_NATIONS = "SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS region, n_nationkey + 1.0::DOUBLE AS f0, n_regionkey + 1.0::DOUBLE AS f1 FROM nation"
_LINE = "dense_rank() OVER (ORDER BY region) - 1"
add("read_feature_dataset", _read_feature_dataset, f"SELECT id, CAST(place AS BIGINT) AS place, floor((CASE WHEN place = 0 THEN f0 ELSE f1 END) / (f0 + f1) * 1e6 + 0.5) / 1e6 AS v, group_id FROM (SELECT *, {_LINE} AS group_id FROM ({_NATIONS})), range(0, 2) t(place)")
add("read_gml", _read_gml, f"WITH {GRAPH_SQL['reg']} SELECT id AS a, substr(id, 1, 1) AS b FROM nodes UNION ALL SELECT src, dst FROM edges")
add("read_product_pairs", lambda spark, folder: _product_records(spark, folder)[0], "SELECT 'n' || n_nationkey AS a, 'n' || ((n_nationkey + 1) % 25) AS b FROM nation")
add("read_product_groups", lambda spark, folder: _product_records(spark, folder)[1], "SELECT 'r' || n_regionkey AS group_id, 'n' || n_nationkey AS id FROM nation")
add("read_profile_groups", _read_profiles, "SELECT 'solvent' AS group_id, 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION ALL SELECT lower(c_mktsegment), 'c' || c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of nations as a stream of two files (even sources first), ranked after each; then a restart finds no more."""
    edges, place = GRAPHS["nat"](spark, folder).edges.select("src", "dst"), _place(spark, "pairs")
    for part in (0, 1):
        edges.where(key("src") % 2 == part).coalesce(1).write.mode("append").parquet(place)
    for _ in range(2):
        ranker = StreamRanker(O.PageRank(0.85, **steps(3)), seeds, directed=True)
        stream = spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).parquet(place)
        ranker.start(stream, f"{place}-state").awaitTermination()
    return shown(Signal(ranker.graph(spark), ranker.scores(spark)))


def _batch_sql(n: int, where: str) -> str:
    """Normalized edges m<n> and nodes<n> of the unweighted edges of nations that a condition keeps."""
    return f"""e{n} AS MATERIALIZED (SELECT DISTINCT src, dst FROM edges WHERE {where}), nodes{n} AS MATERIALIZED (SELECT src AS id FROM e{n} UNION SELECT dst FROM e{n}),
m{n} AS MATERIALIZED (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS w FROM e{n})"""


_ONE = S.pagerank(m="m1", nodes="nodes1", name="one", prefix="a", head=f"{NAT},\n{_batch_sql(1, 'CAST(substr(src, 2) AS BIGINT) % 2 = 0')},\n{_batch_sql(2, 'true')}")
add("edge_stream", _stream, S.shown(S.pagerank(m="m2", nodes="nodes2", name="two", head=_ONE, start="coalesce((SELECT value FROM one WHERE one.id = sp.id), 0)"), "two"))

# ---- node numbers, archives and several datasets -------------------------------------------

add("numbered_pagerank_k", ranked("cs", lambda: OnNumbers(O.PageRank(0.85, **steps(5)))), ORACLE_SQL["pagerank_quotient_k"])


def _compressed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Lines (value) written as gz files and read as archives."""
    place = _place(spark, name)
    rows.write.option("compression", "gzip").text(place)
    return C.archive_lines(spark, f"{place}/*.gz")


def _convert_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with a mark in the third word, of which marked ones are pairs."""
    rows = GRAPHS["cs"](spark, folder).edges.select(F.concat_ws(" ", "src", "dst", (key("dst") % 3).cast("string")).alias("value"))
    return C.converted_pairs(_compressed(spark, rows, "marked"), C.Conversion(pair=lambda words: F.when(F.get(words, F.lit(2)) != "0", F.slice(words, 1, 2))))


def _vector_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an id, the numbers of its embedding and its label."""
    return _embedded(spark, folder).select(F.concat_ws(" ", "id", F.array_join(F.transform("features", lambda x: x.cast("string")), " "), F.concat(F.lit("L"), F.col("label").cast("string"))).alias("value"))


add("convert_pairs", _convert_pairs, f"{CS} SELECT src AS a, dst AS b FROM edges WHERE CAST(substr(dst, 2) AS BIGINT) % 3 <> 0")
add("convert_node_groups", lambda spark, folder: C.groups_of_nodes(_convert_pairs(spark, folder), C.Conversion(node_group=lambda n: F.when(key("a") % 4 != 1, F.concat(F.substring(n, 1, 1), (key("a") % 4).cast("string"))))), f"{CS} SELECT DISTINCT substr(src, 1, 1) || (CAST(substr(src, 2) AS BIGINT) % 4) AS group_id, src AS id FROM edges WHERE CAST(substr(dst, 2) AS BIGINT) % 3 <> 0 AND CAST(substr(src, 2) AS BIGINT) % 4 <> 1")
add("convert_features", lambda spark, folder: _cells(C.converted_features(_compressed(spark, _vector_lines(spark, folder), "vectors"))), f"SELECT id, place, floor(x * 1e6 + 0.5) / 1e6 AS v FROM ({_CELLS})")
add("convert_groups", lambda spark, folder: C.converted_groups(_compressed(spark, _vector_lines(spark, folder), "vectors"), C.Conversion(least=3)), "SELECT 'L' || label AS group_id, CAST(vec_id AS VARCHAR) AS id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) >= 3)")


def _datasets(spark: SparkSession, folder: str) -> str:
    """A folder with two registered datasets: customers by segment, and nations by region."""
    place, names = _place(spark, "datasets"), _nation_names(spark, folder)
    for name, edges, groups in (("regions", GRAPHS["reg"](spark, folder).edges, names.select(F.col("region").alias("group_id"), "id")), ("segments", GRAPHS["cs"](spark, folder).edges, communities(spark, folder))):
        L.register(name)
        L.write_pairs(edges, f"{place}/{name}/pairs.txt")
        L.write_groups(groups, f"{place}/{name}/groups.txt")
    return place


def loaded(load: Callable[..., Any]) -> Query:
    """name and id of what a loader of several datasets gives."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = None
        for name, _, ids in load(spark, _datasets(spark, folder), ["regions", "segments"]):
            rows = ids.select(F.lit(name).alias("name"), *[F.col(c).cast("string").alias(c) for c in ids.columns])
            found = rows if found is None else found.unionByName(rows)
        return found

    return run


_BOTH = f"{CS}, {COMMUNITIES_SQL}, sets AS (SELECT 'regions' AS name, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS group_id, 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'segments', dense_rank() OVER (ORDER BY group_id) - 1, id FROM groups WHERE id IN (SELECT id FROM nodes))"
add("load_multiple", loaded(L.load_multiple), f"{_BOTH} SELECT name, CAST(group_id AS VARCHAR) AS group_id, id FROM sets")
add("load_all_communities", loaded(L.load_all_communities), f"{_BOTH} SELECT name || group_id AS name, id FROM sets")
add("load_one_community", loaded(L.load_one_community), f"{_BOTH} SELECT name, id FROM sets WHERE group_id = 4")
add("load_graphs", lambda spark, folder: list(L.load_graphs(spark, _datasets(spark, folder), ["regions", "segments"]))[1].edges, f"{CS} SELECT src, dst, 2 * w AS w FROM edges")


def _head(spark: SparkSession, folder: str) -> DataFrame:
    """The labels of embeddings, learnt from those whose number isn't divisible by 3: id, held_out, label, predicted."""
    rows = _embedded(spark, folder)
    held = (F.col("id").cast("long") % 3 == 0).alias("held_out")
    head = SoftmaxHead(epochs=40).fit(rows.where(~held), None)
    return head.predict(rows.withColumnRenamed("label", "known").withColumn("held_out", held)).select("id", "held_out", F.col("known").alias("label"), F.col("label").cast("long").alias("predicted"))


add("softmax_head", _head)


def _stream_pushed(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of nations as two files, each a batch that pushes what it changes."""
    edges, place = GRAPHS["nat"](spark, folder).edges.select("src", "dst"), _place(spark, "pairs")
    for part in (0, 1):
        edges.where(key("src") % 2 == part).coalesce(1).write.mode("append").parquet(place)
    seed = (F.substring("id", 1, 1) != "c") & (key() % 5 == 0)
    ranker = PushRanker(f"{place}-state", lambda nodes: nodes.select("id", seed.cast("double").alias("value")), 0.5, 1e-5, True)
    ranker.start(spark.readStream.schema("src string, dst string").option("maxFilesPerTrigger", 1).parquet(place), f"{place}-checkpoint").awaitTermination()
    return ranker.scores(spark).select("id", F.round("value", 3).alias("score"))


add("edge_stream_push", _stream_pushed)
