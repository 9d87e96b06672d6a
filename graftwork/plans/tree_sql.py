"""SQL that builds iterated trees round by round: an independent statement of which edges are picked, in which order, at which score.

Each round is a handful of common table expressions over the graph that the round before left: distances by a recursive query, the
shortest-path graph, scores by enumerating paths, one pick. The graph has few nodes and the number of rounds is fixed, so the whole
tree is one statement.
"""

from __future__ import annotations

from graftwork import model as M

NODES = 25
HEAD = f"WITH RECURSIVE {M.NATION_SQL}, nodes AS (SELECT id::BIGINT AS id FROM range({NODES}) t(id))"
CENTERS = "(SELECT unnest([0, 7, 13])::BIGINT AS id)"


def _paths(at: str, adj: str, sources: str) -> str:
    """p: distances from the sources; g: the shortest-path graph (s, p, x)."""
    return f"""p{at} AS (WITH RECURSIVE r(s, n, d) USING KEY (s, n) AS (SELECT id, id, 0::BIGINT FROM {sources} UNION SELECT x.s, e.v, min(x.d + e.c) FROM r x JOIN {adj} e ON e.u = x.n
  LEFT JOIN recurring.r q ON q.s = x.s AND q.n = e.v WHERE q.d IS NULL OR x.d + e.c < q.d GROUP BY 1, 2) SELECT s, n, d FROM r),
g{at} AS (SELECT a.s, e.u AS p, e.v AS x, e.c FROM p{at} a JOIN {adj} e ON e.u = a.n JOIN p{at} b ON b.s = a.s AND b.n = e.v WHERE a.d + e.c = b.d)"""


def _betweenness(at: str, adj: str) -> str:
    """k: (u, v, score) over ordered pairs, from numbers of shortest paths; needs paths from all nodes."""
    return f"""s{at} AS (WITH RECURSIVE f(s, n) AS (SELECT s, n FROM p{at} WHERE s = n UNION ALL SELECT f.s, d.x FROM f JOIN g{at} d ON d.s = f.s AND d.p = f.n) SELECT s, n, count(*) AS c FROM f GROUP BY ALL),
b{at} AS (SELECT e.u, e.v, sum(x.c * y.c * 1.0 / z.c) AS score FROM {adj} e JOIN s{at} x ON x.n = e.u JOIN p{at} dx ON dx.s = x.s AND dx.n = x.n JOIN s{at} y ON y.s = e.v JOIN p{at} dy ON dy.s = y.s AND dy.n = y.n
  JOIN p{at} dz ON dz.s = x.s AND dz.n = y.n JOIN s{at} z ON z.s = x.s AND z.n = y.n WHERE dx.d + e.c + dy.d = dz.d AND x.s <> y.n GROUP BY 1, 2),
k{at} AS (SELECT least(u, v) AS u, greatest(u, v) AS v, round(sum(score), 9) AS score FROM b{at} GROUP BY 1, 2)"""


def _walks(at: str, first: str) -> str:
    """k: (u, v, score): walks from each target back to the sources along shortest paths."""
    return f"""k{at} AS (WITH RECURSIVE k(s, x, p) AS (SELECT s, x, p FROM g{at} WHERE {first} UNION ALL SELECT k.s, d.x, d.p FROM k JOIN g{at} d ON d.s = k.s AND d.x = k.p)
SELECT least(x, p) AS u, greatest(x, p) AS v, count(*)::DOUBLE AS score FROM k GROUP BY 1, 2)"""


def _picks(name: str, rounds: int) -> str:
    return " UNION ALL ".join(f"SELECT u, v, {r}::BIGINT AS step, score::DOUBLE AS score FROM t{name}{r}" for r in range(rounds))


def iterated(name: str, graph: str, scorer: str, rounds: int = NODES - 1, seeds: str = "(SELECT 0 AS u, 0 AS v WHERE false)") -> str:
    """TR-01 as CTEs, ending in picks{name} (u, v, step, score); `graph` gives (u, v, w), `seeds` the (u, v) that are highways from
    the start. Weights are scaled to integers."""
    sources = "nodes" if scorer == "exact" else CENTERS
    out = [
        f"w{name} AS ({graph})",
        f"b{name} AS (SELECT u, v, round(w::DOUBLE / (SELECT min(w) FROM w{name}) * 1000000)::BIGINT * {4 * NODES} AS b, (u, v) IN (SELECT (u, v) FROM {seeds}) AS road FROM w{name})",
        f"e{name}0 AS (SELECT u, v, b, CASE WHEN road THEN (SELECT min(b) FROM b{name}) // {4 * NODES} ELSE b END AS c, road, true AS live FROM b{name})",
    ]
    for r in range(rounds):
        at, adj = f"{name}{r}", f"a{name}{r}"
        out.append(f"{adj} AS (SELECT u, v, c FROM e{at} WHERE live UNION ALL SELECT v, u, c FROM e{at} WHERE live)")
        out.append(_paths(at, adj, sources))
        out.append(_betweenness(at, adj) if scorer == "exact" else _walks(at, "true" if scorer == "cluster_all" else f"x IN {CENTERS}"))
        out.append(f"z{at} AS (SELECT e.*, coalesce(k.score, 0) AS score FROM e{at} e LEFT JOIN k{at} k USING (u, v))")
        out.append(f"t{at} AS (SELECT u, v, score FROM z{at} WHERE live AND NOT road AND score > 0 ORDER BY score DESC, b, u, v LIMIT 1)")
        out.append(f"e{name}{r + 1} AS (SELECT z.u, z.v, b, CASE WHEN t.u IS NULL THEN c ELSE (SELECT min(b) FROM b{name}) // {4 * NODES} END AS c, road OR t.u IS NOT NULL AS road, live AND (road OR z.score > 0) AS live FROM z{at} z LEFT JOIN t{at} t USING (u, v))")
    return ",\n".join([*out, f"picks{name} AS ({_picks(name, rounds)})"])


def greedy(name: str, unit: int) -> str:
    """TR-08, TR-11: betweenness each round, the best edge that closes no cycle, whose weight becomes least / unit."""
    out = [f"e{name}0 AS (SELECT u, v, w, b, b * {unit} AS c, false AS road, true AS live FROM (SELECT u, v, w, round(w::DOUBLE / (SELECT min(w) FROM nation_edges) * 1000000)::BIGINT AS b FROM nation_edges))"]
    for r in range(NODES - 1):
        at, adj = f"{name}{r}", f"a{name}{r}"
        out.append(f"{adj} AS (SELECT u, v, c FROM e{at} WHERE live UNION ALL SELECT v, u, c FROM e{at} WHERE live)")
        out.append(_paths(at, adj, "nodes"))
        out.append(_betweenness(at, adj))
        out.append(f"h{at} AS (WITH RECURSIVE q(s, n) AS (SELECT id, id FROM nodes UNION SELECT q.s, x.v FROM q JOIN (SELECT u, v FROM e{at} WHERE road UNION ALL SELECT v, u FROM e{at} WHERE road) x ON x.u = q.n) SELECT s AS u, n AS v FROM q)")
        out.append(f"z{at} AS (SELECT e.*, coalesce(k.score, 0) AS score FROM e{at} e LEFT JOIN k{at} k USING (u, v))")
        out.append(f"t{at} AS (SELECT u, v, score FROM z{at} ANTI JOIN h{at} USING (u, v) WHERE live AND NOT road AND score > 0 ORDER BY score DESC, w, u, v LIMIT 1)")
        out.append(f"e{name}{r + 1} AS (SELECT z.u, z.v, w, b, CASE WHEN t.u IS NULL THEN c ELSE (SELECT min(b) FROM e{name}0) END AS c, road OR t.u IS NOT NULL AS road, live AND z.score > 0 AS live FROM z{at} z LEFT JOIN t{at} t USING (u, v))")
    return ",\n".join([*out, f"picks{name} AS ({_picks(name, NODES - 1)})"])


def merging(name: str) -> str:
    """TR-10: the best edge's ends become one node, of parallel edges the least stays; picks carry the edge's first ends."""
    out = [f"e{name}0 AS (SELECT u, v, w, u AS x, v AS y FROM nation_edges)"]
    for r in range(NODES - 1):
        at, adj = f"{name}{r}", f"a{name}{r}"
        out.append(f"i{at} AS (SELECT *, round(w::DOUBLE / (SELECT min(w) FROM nation_edges) * 1000000)::BIGINT AS c FROM e{at})")
        out.append(f"{adj} AS (SELECT u, v, c FROM i{at} UNION ALL SELECT v, u, c FROM i{at})")
        out.append(f"n{at} AS (SELECT DISTINCT u AS id FROM {adj})")
        out.append(_paths(at, adj, f"n{at}"))
        out.append(_betweenness(at, adj))
        out.append(f"o{at} AS (SELECT e.u AS a, e.v AS b, e.x, e.y, k.score FROM i{at} e JOIN k{at} k USING (u, v) ORDER BY k.score DESC, e.c, e.u, e.v LIMIT 1)")
        out.append(f"t{at} AS (SELECT least(x, y) AS u, greatest(x, y) AS v, score FROM o{at})")
        out.append(f"m{at} AS (SELECT CASE WHEN u = b THEN a ELSE u END AS u, CASE WHEN v = b THEN a ELSE v END AS v, w, x, y FROM e{at}, o{at} o(a, b, ox, oy, os))")
        out.append(f"e{name}{r + 1} AS (SELECT least(u, v) AS u, greatest(u, v) AS v, w, x, y FROM m{at} WHERE u <> v QUALIFY row_number() OVER (PARTITION BY least(u, v), greatest(u, v) ORDER BY w, x, y) = 1)")
    return ",\n".join([*out, f"picks{name} AS ({_picks(name, NODES - 1)})"])


def centroid(name: str, theta: float) -> str:
    """TR-13: nodes in the order of their mean distances, each hung where exp(-theta w) / mean tree distance is largest."""
    out = [
        f"w{name} AS (SELECT u, v, w AS c FROM nation_edges UNION ALL SELECT v, u, w FROM nation_edges)",
        _paths(f"{name}x", f"w{name}", "nodes"),
        f"d{name}0 AS (SELECT s, n, d FROM p{name}x)",
        f"i{name}0 AS (SELECT s AS id FROM d{name}0 GROUP BY s ORDER BY sum(d), s LIMIT 1)",
        f"l{name}0 AS (SELECT id AS a, id AS b, 0::BIGINT AS d FROM i{name}0)",
    ]
    for r in range(NODES - 1):
        at, nxt = f"{name}{r}", f"{name}{r + 1}"
        out.append(f"x{at} AS (SELECT s AS x, avg(d) AS far FROM d{at} WHERE s NOT IN (FROM i{at}) GROUP BY s ORDER BY sum(d), s LIMIT 1)")
        out.append(f"h{at} AS (SELECT x, l.a, far, any_value(e.c) AS c FROM x{at} JOIN w{name} e ON e.u = x JOIN l{at} l ON l.a = e.v GROUP BY 1, 2, 3 ORDER BY exp(-{theta} * any_value(e.c)) / (avg(l.d) + {1 if r == 0 else 0}) DESC, 2 LIMIT 1)")
        out.append(f"t{at} AS (SELECT least(a, x) AS u, greatest(a, x) AS v, far AS score FROM h{at})")
        out.append(f"i{nxt} AS (FROM i{at} UNION ALL SELECT x FROM h{at})")
        out.append(f"y{at} AS (SELECT h.x, l.b, l.d + h.c AS d FROM h{at} h JOIN l{at} l ON l.a = h.a)")
        out.append(f"l{nxt} AS (FROM l{at} UNION ALL SELECT x, b, d FROM y{at} UNION ALL SELECT b, x, d FROM y{at} UNION ALL SELECT x, x, 0 FROM h{at})")
        out.append(
            f"d{nxt} AS (SELECT m.s, m.n, least(m.d, sa.d + (SELECT min(w) FROM nation_edges) + xn.d, sx.d + (SELECT min(w) FROM nation_edges) + an.d) AS d FROM d{at} m, h{at} h"
            f" JOIN d{at} sa ON sa.n = h.a JOIN d{at} sx ON sx.n = h.x AND sx.s = sa.s JOIN d{at} an ON an.s = h.a JOIN d{at} xn ON xn.s = h.x AND xn.n = an.n WHERE sa.s = m.s AND an.n = m.n)"
        )
    return ",\n".join([*out, f"picks{name} AS ({_picks(name, NODES - 1)})"])


def tree(*parts: str, name: str = "a", columns: str = "u, v, step, round(score, 6) AS score") -> str:
    """The whole statement: the picks of the tree called `name`."""
    return ",\n".join([HEAD, *parts]) + f"\nSELECT {columns} FROM picks{name}"


def updated(cuts: int, factor: int) -> str:
    """TR-07: the tree by cluster_all, its heaviest edges cut, weights inside the parts divided, and the tree of that graph."""
    return tree(
        iterated("a", "SELECT u, v, w FROM nation_edges", "cluster_all"),
        "own AS (SELECT u, v, w FROM picksa JOIN nation_edges USING (u, v))",
        f"left_ AS (SELECT u, v FROM own ANTI JOIN (SELECT u, v FROM own ORDER BY w DESC, u, v LIMIT {cuts}) USING (u, v))",
        "part AS (WITH RECURSIVE q(s, n) AS (SELECT id, id FROM nodes UNION SELECT q.s, x.v FROM q JOIN (SELECT u, v FROM left_ UNION ALL SELECT v, u FROM left_) x ON x.u = q.n) SELECT n AS id, min(s) AS c FROM q GROUP BY n)",
        iterated("b", f"SELECT u, v, CASE WHEN x.c = y.c THEN w / {factor}.0::DOUBLE ELSE w::DOUBLE END AS w FROM nation_edges JOIN part x ON x.id = u JOIN part y ON y.id = v", "cluster_all"),
        name="b",
    )
