"""Measures under changes of edges against a recompute, and trees that have no SQL against plain loops."""

import itertools
import random

import numpy as np
import pytest

from graftwork.operators import centrality as C
from graftwork.operators import dynamic as DY
from graftwork.operators import kernels as K
from graftwork.operators import trees as T
from graftwork.operators.components import connected_components


def grid(r, n=6, heaviest=9):
    """A grid with some chords: sources far from a change aren't affected by it."""
    edges = {}
    for i, j in itertools.product(range(n), range(n)):
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < n and b < n:
                edges[i * n + j, a * n + b] = r.randint(2, heaviest)
    return edges


def frame(spark, edges):
    return spark.createDataFrame([(*e, w) for e, w in sorted(edges.items())], "u long, v long, w long")


def plain_paths(edges):
    """Distances and numbers of shortest paths by Floyd and counting, and node and edge betweenness over ordered pairs."""
    ids = sorted({x for e in edges for x in e})
    d = {(a, b): 0 if a == b else float("inf") for a in ids for b in ids}
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = min(w, d[a, b])
    for k, a, b in itertools.product(ids, ids, ids):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    count = {}
    for s in ids:
        for t in sorted(ids, key=lambda x: d[s, x]):
            if s == t:
                count[s, t] = 1
            elif d[s, t] < float("inf"):
                count[s, t] = sum(count[s, p] for e, w in edges.items() for p, q in (e, e[::-1]) if q == t and d[s, p] + w == d[s, t])
    node = {x: sum(count[s, x] * count[x, t] / count[s, t] for s in ids for t in ids if len({s, t, x}) == 3 and (s, t) in count and d[s, x] + d[x, t] == d[s, t]) for x in ids}
    edge = {e: sum(count[s, p] * count[q, t] / count[s, t] for s in ids for t in ids if s != t and (s, t) in count for p, q in (e, e[::-1]) if d[s, p] + w + d[q, t] == d[s, t]) for e, w in edges.items()}
    return d, count, node, edge


#: One change that no path takes, then lighter, heavier, new and gone edges, a new node, and that node's end.
BATCHES = [[(0, 18, 500)], [(0, 1, 1), (10, 15, None)], [(0, 24, 3), (7, 8, 30), (24, 99, 2)], [(24, 99, None), (0, 24, 40)]]


def apply(edges, batch):
    out = dict(edges)
    for u, v, w in batch:
        out.pop((min(u, v), max(u, v)), None)
        if w is not None:
            out[min(u, v), max(u, v)] = w
    return out


def test_dynamic_measures(spark):
    edges = grid(random.Random(3), 5)
    b, one, approx = DY.DynBetweenness(frame(spark, edges)), DY.DynBetweennessOneNode(frame(spark, edges), 14), DY.DynApproxBetweenness(frame(spark, edges), samples=100)
    ran = []
    for batch in BATCHES:
        before = {r.sample: (r.source, r.target, r.dist, r.sigma, tuple(r.path)) for r in approx.samples.collect()}
        edges = apply(edges, batch)
        for m in (b, one, approx):
            m.update_batch(batch)
        d, count, node, edge = plain_paths(edges)
        got = {(r.u, r.v): r.score for r in b.edge_scores().collect()}
        assert got.keys() == edge.keys() and all(abs(got[e] - edge[e]) < 1e-6 for e in edge)
        got = {r.id: r.score for r in b.nodes().collect()}
        assert got.keys() == node.keys() and all(abs(2 * got[x] - node[x]) < 1e-6 for x in node)
        assert abs(2 * one.score().first().score - node[14]) < 1e-6
        ran.append(b.ran)
        fresh = 0
        for r in approx.samples.collect():
            path = [(e.u, e.v) for e in r.path]
            assert (r.source, r.target) == before[r.sample][:2]
            assert r.dist == d[r.source, r.target] == sum(edges[e] for e in path) and r.sigma == count[r.source, r.target]
            if (r.dist, r.sigma) == before[r.sample][2:4] and not any((e.u, e.v) in {(min(u, v), max(u, v)) for u, v, _ in batch} for e in before[r.sample][4]):
                assert tuple(r.path) == before[r.sample][4]  # kept as it was
            else:
                fresh += 1
        assert approx.redrawn == fresh
    assert ran[0] == 2  # only affected sources run: here the new edge's ends


def test_dynamic_top_harmonic(spark):
    edges = {e: 1 for e in grid(random.Random(4), 5)}
    m = DY.DynTopHarmonicCloseness(frame(spark, edges), 3)
    for batch in ([(0, 24, 1)], [(12, 13, None), (0, 24, None)]):
        edges = apply(edges, batch)
        m.update_batch(batch)
        d = plain_paths(edges)[0]
        ids = {x for e in edges for x in e}
        want = sorted((-round(sum(1 / d[s, t] for t in ids if s != t), 9), s) for s in ids)[:3]
        assert [(-r.score, r.id) for r in m.top().collect()] == want


def test_incremental_trees_agree():
    r = random.Random(8)
    for n in (4, 6):
        e = sorted(grid(r, n).items())
        u, v, w = (np.array(x) for x in ([a for (a, _), _ in e], [b for (_, b), _ in e], [float(x) for _, x in e]))
        assert K.exact_picks(u, v, w, incremental=True) == K.exact_picks(u, v, w)
        g = K.Csr(u, v, np.rint(w * 1000).astype(np.int64))
        state = K.Dependencies(g)
        first = state.ran
        state.lighten(0, 1)
        assert state.ran - first <= g.n
        assert np.allclose(state.scores(), sum(g.brandes(s)[0] for s in range(g.n)))


def test_draws_follow_changes():
    r = random.Random(9)
    e = sorted(grid(r, 5).items())
    u, v, w = (np.array(x) for x in ([a for (a, _), _ in e], [b for (_, b), _ in e], [x * 100 for _, x in e]))
    g = K.Csr(u, v, w)
    rng = np.random.default_rng(1)
    draws = K.Draws(g, rng.integers(0, g.n, (200, 2)), rng)
    for k in (0, 7, 20):
        old, kept = list(draws.known), [list(p) for p in draws.paths]
        draws.lighten(k, 1)
        for i, (s, t) in enumerate(draws.pairs):
            assert sum(g.w[x] for x in draws.paths[i]) == (g.dijkstra(s)[t] if s != t else 0)
            if draws.known[i] == old[i]:
                assert draws.paths[i] == kept[i]


def plain_tree(edges, score_of, parts):
    """Greedy picks without cycles, scores anew each round from a plain function of the current weights."""
    low, current, out, gone = min(edges.values()) / parts, dict(edges), [], set()
    part = {x: x for e in edges for x in e}
    while len(out) < len(part) - 1:
        score = score_of({e: w for e, w in current.items() if e not in gone})
        gone |= {e for e in current if e not in gone and round(score[e], 9) <= 0}
        best = sorted((-round(score[e], 9), edges[e], e) for e in current if e not in gone and part[e[0]] != part[e[1]])
        if not best:
            break
        e = best[0][2]
        out.append(e)
        part = {x: part[e[0]] if c == part[e[1]] else c for x, c in part.items()}
        current[e] = low
    return out


def plain_flow(edges):
    ids = sorted({x for e in edges for x in e})
    n, at = len(ids), {x: i for i, x in enumerate(sorted({x for e in edges for x in e}))}
    lap = np.zeros((n, n))
    for (a, b), w in edges.items():
        i, j = at[a], at[b]
        lap[i, j] -= w
        lap[j, i] -= w
        lap[i, i] += w
        lap[j, j] += w
    inv = np.linalg.pinv(lap)
    out = {}
    for (a, b), w in edges.items():
        i, j = at[a], at[b]
        out[a, b] = sum(abs(w * (inv[i, s] - inv[i, t] - inv[j, s] + inv[j, t])) for s in range(n) for t in range(s)) / (n * (n - 1) / 2)
    return out


def plain_rsp(edges, theta):
    ids = sorted({x for e in edges for x in e})
    n, at = len(ids), {x: i for i, x in enumerate(ids)}
    mean = np.mean(list(edges.values()))
    c, a = np.zeros((n, n)), np.zeros((n, n))
    for (x, y), w in edges.items():
        c[at[x], at[y]] = c[at[y], at[x]] = w / mean
        a[at[x], at[y]] = a[at[y], at[x]] = 1
    wm = a / a.sum(1)[:, None] * np.exp(-theta * c)
    z = np.linalg.inv(np.eye(n) - wm)
    # W (Z (1/Z - n diag(1/Z)) Z) / (n (n - 1)), entry by entry
    out = {}
    for x, y in edges:
        both = 0.0
        for i, j in ((at[x], at[y]), (at[y], at[x])):
            for s, t in itertools.product(range(n), range(n)):
                both += wm[i, j] * z[i, s] * (1 / z[s, t] - (n / z[s, s] if s == t else 0)) * z[t, j]
        out[x, y] = both / (n * (n - 1))
    return out


def test_scores_without_sql(spark):
    edges = grid(random.Random(6), 4)
    df = frame(spark, edges)
    for got, want in ((C.flow_betweenness(df), plain_flow(edges)), (C.rsp_edge_betweenness(df, 2.0), plain_rsp(edges, 2.0))):
        got = {(r.u, r.v): r.score for r in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    got = [(r.u, r.v) for r in T.exact_tree(df, scorer="flow", unit="m").orderBy("step").collect()]
    assert got == plain_tree(edges, plain_flow, len(edges) + 1)


def test_cores(spark):
    edges = grid(random.Random(6), 5) | {(a, b): 1 for a, b in itertools.combinations(range(4), 2)}
    left, core, k = {frozenset(e) for e in edges}, {}, 0
    nodes = {x for e in edges for x in e}
    while nodes:
        low = [x for x in nodes if sum(x in e for e in left) <= k]
        for x in low:
            core[x] = k
            nodes.discard(x)
            left = {e for e in left if x not in e}
        k += not low
    assert {r.id: r.score for r in C.core_numbers(frame(spark, edges)).collect()} == core


def test_electrical(spark):
    """Closeness from resistances, each by solving for a unit current."""
    edges = {e: 1 for e in grid(random.Random(2), 3)}
    n = 9
    lap = np.zeros((n, n))
    for a, b in edges:
        lap[[a, b], [a, b]] += 1
        lap[[a, b], [b, a]] -= 1
    for r in C.electrical_closeness(frame(spark, edges)).collect():
        far = 0.0
        for t in range(n):
            if t != r.id:
                unit = np.zeros(n)
                unit[r.id], unit[t] = 1, -1
                x = np.linalg.lstsq(lap, unit, rcond=None)[0]
                far += x[r.id] - x[t]
        assert abs(r.score - (n - 1) / far) < 1e-9


def test_distinct_pairs(spark):
    for n, r in ((2, 1), (5, 10), (7, 9), (60, 500)):
        got = [(x.i, x.j) for x in C._distinct_pairs(spark, n, r, 3).collect()]
        assert len(got) == len(set(got)) == r and all(0 <= i < j < n for i, j in got)
    assert len({(x.i, x.j) for x in C._distinct_pairs(spark, 25, 300, 3).collect()}) == 300


def test_local_search_reaches_optimum(spark):
    """Every tree that no swap helps, under both costs, from several beginnings; and the searches end at the known optimum."""
    edges = {e: w for e, w in grid(random.Random(5), 3).items()}
    names = sorted(edges)
    u, v, w = (np.array(x) for x in ([a for a, _ in names], [b for _, b in names], [float(edges[e]) for e in names]))
    g = K.Csr(u, v, w)

    def spans(t):
        uf = K.UnionFind()
        return all(uf.join(int(g.a[e]), int(g.b[e])) for e in t)

    trees = [t for t in itertools.combinations(range(g.m), g.n - 1) if spans(t)]
    for cost in (T.gilbert_steiner(0, 0.5), T.centrality_cost(0.5)):
        best = min(cost(g, list(t)) for t in trees)
        for t in random.Random(1).sample(trees, 5):
            found = T.local_search(g, list(t), cost)
            value = cost(g, found)
            assert spans(found) and all(cost(g, [x for x in found if x != out] + [e]) >= value - 1e-9 for out in found for e in range(g.m) if e not in found and spans([x for x in found if x != out] + [e]))
        for search in (T.ant_colony, T.genetic_search):
            t = search(frame(spark, edges), cost, rounds=5)
            at = [names.index((r.u, r.v)) for r in t.collect()]
            assert abs(cost(g, at) - best) < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_grown_trees_span(spark, seed):
    edges = grid(random.Random(seed), 4)
    for r in T.grown(frame(spark, edges), [5], 3, seed).groupBy("tree").count().collect():
        assert r["count"] == 15
    one = T.grown(frame(spark, edges), [5], 1, seed)
    assert connected_components(one).select("component").distinct().count() == 1


def test_state_goes_on_after_a_restart(spark):
    """Versions and checkpoint in a folder: a new state, as after a crash, applies what is left, and nothing twice."""
    from graftwork.session import scratch_path
    from graftwork.streaming import graph_events as ST

    events, folder = scratch_path(spark, "events"), scratch_path(spark, "state")
    rows = [(0, "add", 1, 2, 1.0), (1, "increment", 1, 2, 2.0), (2, "add", 2, 3, 4.0), (3, "increment", 1, 2, 5.0), (4, "remove", 2, 3, 0.0), (5, "add", 3, 4, 1.0)]

    def put(some):
        spark.createDataFrame(some, ST.SCHEMA).coalesce(1).write.mode("append").parquet(events)

    put(rows[:2])
    ST.GraphState(spark, folder=folder).replay(events)
    put(rows[2:4])
    again = ST.GraphState(spark, folder=folder)
    assert again.batch == 0 and [tuple(r) for r in again.edges.collect()] == [(1, 2, 3.0)]
    again.replay(events)
    again.update(spark.createDataFrame(rows[2:4], ST.SCHEMA), again.batch)  # a batch that comes again
    put(rows[4:])
    last = ST.GraphState(spark, folder=folder)
    last.replay(events)
    assert sorted(tuple(r) for r in last.edges.collect()) == [(1, 2, 8.0), (3, 4, 1.0)]
    assert len(last._versions()) == 2


def test_motion_by_tick(spark):
    from graftwork.streaming import graph_events as ST

    p = spark.createDataFrame([(i, [1.0, 0.5], float(t)) for i in range(3) for t in range(3)], "id long, pos array<double>, t double")
    got = {(r.id, r.t): tuple(r.pos) for r in ST.motion(p, "gauss").collect()}
    assert len(set(got.values())) == 9 and got == {(r.id, r.t): tuple(r.pos) for r in ST.motion(p, "gauss").collect()}


def test_rounds_keep_one_table_a_name(spark):
    import os

    from graftwork.session import Rounds

    keep, seen = Rounds(spark), []
    for k in range(3):
        df = keep.written(spark.range(k + 1), "x")
        seen.append(keep.paths["x"].removeprefix("file://"))
    assert df.count() == 3 and [os.path.exists(s) for s in seen] == [False, False, True]


def test_spanning_shares(spark):
    """Shares of the spanning trees that hold each edge, by going through all trees."""
    edges = {e: 1 for e in grid(random.Random(2), 3)}
    names = sorted(edges)

    def spans(t):
        uf = K.UnionFind()
        return all(uf.join(*e) for e in t)

    trees = [t for t in itertools.combinations(names, 8) if spans(t)]
    want = {e: sum(e in t for t in trees) / len(trees) for e in names}
    got = {(r.u, r.v): r.score for r in C.spanning_edge(frame(spark, edges)).collect()}
    assert all(abs(got[e] - want[e]) < 1e-9 for e in names)
    drawn = {(r.u, r.v): r.score for r in C.sampled_spanning_edge(frame(spark, edges), 0.1, 0.01).collect()}
    assert all(abs(drawn[e] - want[e]) <= 0.1 for e in names)


def test_katz_bounds_hold(spark):
    edges = {e: 1 for e in grid(random.Random(2), 4)}
    a = np.zeros((16, 16))
    for x, y in edges:
        a[x, y] = a[y, x] = 1
    alpha = 1 / (a.sum(1).max() + 1)
    exact = np.linalg.solve(np.eye(16) - alpha * a, np.ones(16)) - 1
    got = C.dyn_katz_bounds(frame(spark, edges), 16, rounds=10).collect()
    assert len(got) == 16 and all(r.lower - 1e-9 <= exact[r.id] <= r.upper + 1e-9 for r in got)


def test_walks_that_meet_a_group(spark):
    """All walks counted one by one."""
    edges = {e: 1 for e in grid(random.Random(2), 3)}
    near = {x: [b if a == x else a for a, b in edges if x in (a, b)] for x in range(9)}
    alpha, steps = 1 / (1 + max(map(len, near.values()))), 4

    def met(group):
        total, walks = 0.0, [((x,), 1.0) for x in near]
        for _ in range(steps):
            walks = [((*w, y), f * alpha) for w, f in walks for y in near[w[-1]]]
            total += sum(f for w, f in walks if set(w) & set(group))
        return total

    first = max(near, key=lambda x: (round(met([x]), 9), -x))
    second = max((x for x in near if x != first), key=lambda x: (round(met([first, x]), 9), -x))
    group, score = C.ged_walk(frame(spark, edges), 2, steps=steps)
    assert group == [first, second] and abs(score - met(group)) < 1e-9
