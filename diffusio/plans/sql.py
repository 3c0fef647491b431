"""SQL texts of the queries: filters as one chain of named tables, a step each."""

from __future__ import annotations

from collections.abc import Callable

from diffusio.plans.fixtures import GRAPH_SQL, SEED_SQL

ROUND = "floor(({}) * 1e8 + 0.5) / 1e8"
DEGREES = "dout AS (SELECT src, sum(w) AS d FROM raw GROUP BY src), din AS (SELECT dst, sum(w) AS d FROM raw GROUP BY dst)"
_JOINED = "FROM raw JOIN dout USING (src) JOIN din USING (dst)"
NORMALIZED = {
    "none": "SELECT src, dst, w FROM raw",
    "col": f"SELECT src, dst, w / dout.d AS w {_JOINED}",
    "symmetric": f"SELECT src, dst, w / sqrt(dout.d) / sqrt(din.d) AS w {_JOINED}",
    "both": f"SELECT src, dst, w / dout.d / din.d AS w {_JOINED}",
    "laplacian": f"SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, -(w / sqrt(dout.d) / sqrt(din.d)) AS w {_JOINED} UNION ALL SELECT id, id, 1.0::DOUBLE FROM nodes) GROUP BY 1, 2",
}


def adjacency(graph: str, kind: str, loops: float = 0.0) -> str:
    """Tables edges, nodes, raw, m."""
    raw = "SELECT src, dst, w FROM edges"
    if loops:
        raw = f"SELECT src, dst, sum(w) AS w FROM ({raw} UNION ALL SELECT id, id, {loops}::DOUBLE FROM nodes) GROUP BY 1, 2"
    return f"WITH {GRAPH_SQL[graph]}, raw AS MATERIALIZED ({raw}), {DEGREES}, m AS MATERIALIZED ({NORMALIZED[kind]})"


def diffusion(
    graph: str, kind: str, steps: int, formula: Callable[[int], str], *, quotient: bool = True, columns: dict[str, str] | None = None, tables: str = "", join: tuple[str, ...] = (), moved: str = "r",
    seed: str = SEED_SQL, start: str | None = None, follow: Callable[[int], dict[str, str]] | None = None, end: str = "r", loops: float = 0.0, name: str = "scores", m: str = "m", prefix: str = "s", head: str | None = None, nodes: str = "nodes",
) -> str:
    """A chain whose last table (id, value) has a filter's scores.

    formula: the new r from x (moved), r, p and columns (name: first value, over p and tables
    joined by id). follow: new values of columns.
    """
    head = adjacency(graph, kind, loops) if head is None else head
    columns = columns or {}
    names = "".join(f", {c}" for c in columns)
    first = "".join(f", {v} AS {c}" for c, v in columns.items())
    s = prefix
    out = [head, f"{s}q AS MATERIALIZED (SELECT id, {seed} AS v FROM {nodes})", f"{s}n AS MATERIALIZED (SELECT sum(abs(v)) AS norm FROM {s}q)"]
    if tables:
        out.append(tables)
    joined = "".join(f" JOIN {t} USING (id)" for t in join)
    out.append(f"{s}p AS MATERIALIZED (SELECT id, v / norm AS p FROM {s}q, {s}n)")
    out.append(f"{s}0 AS MATERIALIZED (SELECT id, p, {start or 'p'} AS r{first} FROM {s}p{joined})")
    for k in range(1, steps + 1):
        new = {**{c: c for c in columns}, **(follow(k) if follow else {})}
        kept = "".join(f", {v} AS {c}" for c, v in new.items())
        out.append(f"{s}x{k} AS MATERIALIZED (SELECT {m}.dst AS id, sum(({moved}) * {m}.w) AS x FROM {s}{k - 1} JOIN {m} ON {s}{k - 1}.id = {m}.src GROUP BY {m}.dst)")
        body = f"SELECT id, p, {formula(k)} AS r{kept} FROM (SELECT s.id, p, r{names}, coalesce(x, 0) AS x FROM {s}{k - 1} s LEFT JOIN {s}x{k} ON s.id = {s}x{k}.id)"
        if quotient:
            out.append(f"{s}u{k} AS MATERIALIZED ({body})")
            out.append(f"{s}{k} AS MATERIALIZED (SELECT id, p, r / (SELECT sum(r) FROM {s}u{k}) AS r{names} FROM {s}u{k})")
        else:
            out.append(f"{s}{k} AS MATERIALIZED ({body})")
    out.append(f"{name} AS MATERIALIZED (SELECT id, ({end}) * norm AS value FROM {s}{steps}, {s}n)")
    return ",\n".join(out)


def closed(graph: str, kind: str, coefficients: list[float], **more) -> str:
    return diffusion(graph, kind, len(coefficients), lambda k: f"r + {coefficients[k - 1]!r}::DOUBLE * t", quotient=False, columns={"t": "p"}, moved="t", start="0.0::DOUBLE", follow=lambda k: {"t": "x"}, **more)


def pagerank(graph: str = "cs", kind: str = "symmetric", steps: int = 3, alpha: float = 0.85, **more) -> str:
    return diffusion(graph, kind, steps, lambda k: f"{alpha}::DOUBLE * x + {1 - alpha!r}::DOUBLE * p", **more)


def shown(chain: str, table: str = "scores") -> str:
    return f"{chain}\nSELECT id, {ROUND.format('value')} AS score FROM {table}"


def settled(chain: str, name: str = "base", table: str = "scores") -> str:
    return f"{chain},\n{name} AS MATERIALIZED (SELECT id, {ROUND.format('value')} AS value FROM {table})"
