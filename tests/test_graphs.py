"""Operators against brute force on small random graphs and the hand-checked ones."""

import itertools
import random

import numpy as np
import pytest

from graftwork.operators import centrality as C
from graftwork.operators import kernels as K
from graftwork.operators import paths as S
from graftwork.operators import transport as OT
from graftwork.operators import trees as T
from graftwork.operators.components import connected_components

DIAMOND = [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 4, 1)]
F2 = [(0, 1, 2), (1, 2, 2), (2, 3, 2), (0, 3, 5), (1, 3, 3)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long, w long")


def table(df):
    return {(r.u, r.v): r.score for r in df.collect()}


def random_graph(seed, n=10, p=0.4):
    r = random.Random(seed)
    e = {(i, i + 1): r.randint(1, 30) for i in range(n - 1)}
    e |= {x: r.randint(1, 30) for x in itertools.combinations(range(n), 2) if r.random() < p}
    return [(u, v, w) for (u, v), w in sorted(e.items())]


def test_hand_checked_scores(spark):
    e = frame(spark, DIAMOND)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert table(C.edge_betweenness(e)) == {(0, 1): 5, (0, 2): 5, (1, 3): 7, (2, 3): 7, (3, 4): 8}
    assert table(C.cluster_paths(e, ids(0, 4))) == {(0, 1): 2, (0, 2): 2, (1, 3): 2, (2, 3): 2, (3, 4): 3}
    assert table(C.cluster_to_all(e, ids(0))) == {(0, 1): 3, (0, 2): 3, (1, 3): 2, (2, 3): 2, (3, 4): 1}
    assert table(C.edge_betweenness(frame(spark, F2))) == {(0, 1): 5, (1, 2): 4, (1, 3): 3, (2, 3): 2, (0, 3): 1}


def test_picks_in_order(spark):
    u, v, w = map(np.array, zip(*F2, strict=True))
    for scorer, c in (("exact", None), ("cluster_all", np.array([0]))):
        assert [(a, b) for a, b, _ in K.iterate_tree(u, v, w, c, scorer, prune=False)] == [(0, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_walks_are_counted_paths(seed):
    """The recurrence against walking every shortest path."""
    e = random_graph(seed)
    u, v, w = map(np.array, zip(*e, strict=True))
    g = K.Csr(u, v, w)
    for s in range(g.n):
        _, pred = g.dag(g.dijkstra(s))
        want = np.zeros(g.m)
        for t in range(g.n):
            stack = [t] if t != s else []
            while stack:
                x = stack.pop()
                for p, k in pred[x]:
                    want[k] += 1
                    if p != s:
                        stack.append(p)
        assert np.array_equal(g.walks(s, np.ones(g.n, bool))[0], want)
        assert np.array_equal(g.weighted_walks(s, np.ones(g.n)), want)


@pytest.mark.parametrize("seed", range(4))
def test_trees_span(seed):
    e = random_graph(seed, 12)
    u, v, w = map(np.array, zip(*e, strict=True))
    for scorer, c in (("exact", None), ("cluster_all", np.array([0, 5]))):
        t = K.iterate_tree(u, v, w, c, scorer, prune=False)
        uf = K.UnionFind()
        assert len(t) == 11 and all(uf.join(a, b) for a, b, _ in t)


def test_minimum_spanning_tree(spark):
    for seed in range(2):
        e = random_graph(seed, 14)
        u, v, w = map(np.array, zip(*e, strict=True))
        want = {(int(u[k]), int(v[k])) for k in K.spanning_forest(u, v, w)}
        assert {(r.u, r.v) for r in T.minimum_spanning_tree(frame(spark, e)).collect()} == want


def test_relaxation_agrees_with_kernel(spark):
    e = frame(spark, random_graph(3, 12))
    ids = spark.range(12)
    a = {(r.source, r.id): r.dist for r in S.sssp_relax(e, ids).collect()}
    b = {(r.source, r.id): r.dist for r in S.sssp(e, ids).collect()}
    assert a == b


def test_components(spark):
    r = random.Random(5)
    e = [(r.randrange(300), r.randrange(300), 1) for _ in range(160)] + [(1000 + i, 1001 + i, 1) for i in range(70)]
    uf = K.UnionFind()
    for u, v, _ in e:
        uf.join(u, v)
    got = {x.id: x.component for x in connected_components(frame(spark, e)).collect()}
    nodes = {x for u, v, _ in e if u != v for x in (u, v)}
    assert got == {x: uf.find(x) for x in nodes}
    assert connected_components(frame(spark, [])).count() == 0


def test_exact_plan_is_least():
    rng = np.random.default_rng(1)
    for _ in range(5):
        c = rng.random((4, 4))
        f = OT.exact_plan(c, np.full(4, 0.25), np.full(4, 0.25))
        best = min(sum(c[i, p[i]] for i in range(4)) for p in itertools.permutations(range(4))) / 4
        assert abs((f * c).sum() - best) < 1e-9 and np.allclose(f.sum(0), 0.25) and np.allclose(f.sum(1), 0.25)


def test_exact_plan_with_ties_zeros_and_excess():
    rng = np.random.default_rng(2)
    for k in range(60):
        n, m = rng.integers(1, 9, 2)
        c, a, b = rng.integers(0, 3, (n, m)).astype(float), rng.integers(0, 4, n), rng.integers(1, 4, m)
        a[0] += 1
        f = OT.exact_plan(c, a, b)
        assert abs(f.sum() - min(a.sum(), b.sum())) < 1e-9 and (f.sum(1) < a + 1e-9).all() and (f.sum(0) < b + 1e-9).all()
        # the same with a unit of mass a row, by bottom-up choice of the rows' units
        best = {tuple([0] * m): 0.0}
        units, spare = [i for i in range(n) for _ in range(a[i])], max(0, int(a.sum() - b.sum()))
        for i in units:
            new: dict = {}
            for state, cost in best.items():
                for j in range(m):
                    if state[j] < b[j]:
                        t = (*state[:j], state[j] + 1, *state[j + 1 :])
                        new[t] = min(new.get(t, np.inf), cost + c[i, j])
                if spare:
                    new[state] = min(new.get(state, np.inf), cost)
            best = new
        assert abs((f * c).sum() - min(x for s, x in best.items() if sum(s) == min(a.sum(), b.sum()))) < 1e-9


def test_exact_edges_beyond_a_quarter_million_cells(spark):
    """600 x 610 segments moved by a constant; no plan is cheaper than the mean's move."""
    rng = np.random.default_rng(3)
    x, y = rng.random((600, 4)), rng.random((610, 4)) + 5
    a, b = (spark.createDataFrame([(i, r[:2].tolist(), r[2:].tolist(), 1 / len(z)) for i, r in enumerate(z)], "id long, p array<double>, q array<double>, mass double") for z in (x, y))
    plan = OT.earth_mover(OT.edge_costs(a, b), a.select("id", "mass"), b.select("id", "mass"), 0.0).collect()
    out = np.zeros(600)
    np.add.at(out, [r.i for r in plan], [r.flow for r in plan])
    assert np.allclose(out, 1 / 600) and 600 <= len(plan) <= 1209
    assert sum(r.flow * r.cost for r in plan) > np.hypot(*(y.reshape(-1, 2, 2).mean((0, 1)) - x.reshape(-1, 2, 2).mean((0, 1)))) - 1e-9


def test_registry_and_modes(spark):
    from graftwork.operators.construct import create_graph
    from graftwork.sources.datasets import Registry
    from graftwork.sources.generators import create_points

    with pytest.raises(KeyError):
        Registry().load("none")
    p = create_points(spark, 30, "uniform")
    for mode in ("Full", "Full+Exp-Triangle", "Delaunay", "knn", "K_Nearest", "K_Nearest+Triangle", "K_Nearest+Density", "K_Nearest+Density2"):
        assert create_graph(p, mode, k=4).count() > 0
    with pytest.raises(ValueError):
        create_graph(p, "none")


def test_delaunay(spark):
    """Edges of the triangles whose circle holds no other point."""
    from graftwork.operators.construct import delaunay

    rng = np.random.default_rng(8)
    p = rng.random((25, 2))
    want = set()
    for a, b, c in itertools.combinations(range(25), 3):
        m = 2 * np.array([p[b] - p[a], p[c] - p[a]])
        o = np.linalg.solve(m, [(p[b] ** 2 - p[a] ** 2).sum(), (p[c] ** 2 - p[a] ** 2).sum()])
        r = ((p[a] - o) ** 2).sum()
        if all(((p[i] - o) ** 2).sum() > r for i in range(25) if i not in (a, b, c)):
            want |= {(a, b), (a, c), (b, c)}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, pos array<double>")
    assert {(r.u, r.v) for r in delaunay(df).collect()} == want
    with pytest.raises(RuntimeError):
        delaunay(spark.createDataFrame([(0, [1.0])], "id long, pos array<double>"))


def test_tree_sides_both_ways(spark, monkeypatch):
    t = frame(spark, [(0, 1, 1), (1, 2, 1), (1, 3, 1), (3, 4, 1), (4, 5, 1)])
    a = {(r.u, r.v): min(r.below, r.n - r.below) for r in C.tree_sides(t).collect()}
    monkeypatch.setattr(C, "KERNEL_EDGES", 0)
    b = {(r.u, r.v): min(r.below, r.n - r.below) for r in C.tree_sides(t).collect()}
    assert a == b == {(0, 1): 1, (1, 2): 1, (1, 3): 3, (3, 4): 2, (4, 5): 1}


@pytest.mark.parametrize("cost", [T.gilbert_steiner(0, 0.9), T.centrality_cost(0.9)])
@pytest.mark.parametrize("seed", range(3))
def test_local_search_ends_where_no_swap_helps(seed, cost):
    """Wide cuts and many edges to improve, against all single swaps."""
    u, v, w = map(np.array, zip(*random_graph(seed, 18, 0.9), strict=True))
    g = K.Csr(u, v, w)
    tree = T.local_search(g, T.grow(g, np.ones(g.m), [0], np.random.default_rng(seed)), cost)
    value = cost(g, tree)
    for out, e in itertools.product(tree, set(range(g.m)) - set(tree)):
        new = [x for x in tree if x != out] + [e]
        if len(T._below(g, new, 0)) == g.n - 1:
            assert cost(g, new) >= value - 1e-9


def brute_pca_graph(x, n, mode, k, beta, delta=0.5):
    """{(u, v): w} by numpy: scaling, principal components, k nearest, neighbours in common."""
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
    y = z @ np.linalg.svd(z, full_matrices=False)[2][:n].T
    dist = lambda p: np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))
    full, red = dist(z), dist(y)
    near, base = {"PCA-k-nearest-only": (red, full), "PCA-distance-only": (full, red)}.get(mode, (red, red))
    order = np.argsort(near + np.diag(np.full(len(x), np.inf)), axis=1, kind="stable")[:, :k]
    edges = sorted({(min(i, j), max(i, j)) for i in range(len(x)) for j in order[i]})
    close = base <= beta * np.mean([base[e] for e in edges])
    both = {(u, v): (close[u] & close[v]).sum() for u, v in edges}
    return {(u, v): base[u, v] * ((close[u].sum() - c + 1) * (close[v].sum() - c + 1) / (c + 1) ** 2) ** delta for (u, v), c in both.items()}


def test_pca_graph_of_whole_vectors(spark):
    """Scaling, PCA and the graph against brute force, with a real reduction and as the query runs them."""
    from graftwork import model as M
    from graftwork.functions import fields as FI
    from graftwork.operators import construct
    from graftwork.plans import catalog

    def check(df, want):
        got = {(r.u, r.v): r.w for r in df.collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[e] - want[e]) < 1e-5 for e in want)

    sf = "/root/testdata/sf0.001"
    x = np.array([r.pos for r in M.points(spark, sf).orderBy("id").collect()])
    ids = [r.id for r in M.points(spark, sf).orderBy("id").collect()]
    named = lambda g: {(ids[u], ids[v]): w for (u, v), w in g.items()}
    few = spark.createDataFrame([(i, [float(c) * (1 + k) for k, c in enumerate(p)]) for i, p in zip(ids[:90], x[:90], strict=True)], "id long, pos array<double>")
    z, y = FI.scaled_and_reduced(few, 5)
    for mode in ("PCA-k-nearest-only", "PCA-distance-only", "PCA-density-only", "PCA"):
        check(construct.pca_graph(z, y, mode, 6, 1.0), named(brute_pca_graph(x[:90] * np.arange(1, 65), 5, mode, 6, 1.0)))
    check(catalog.QUERIES["gc17_scaled_pca_full"](spark, sf), named(brute_pca_graph(x, 100, "PCA", 6, 1.0)))


def covered(g, group):
    """The share of ordered pairs' shortest paths that have a node of the group inside."""
    total = 0.0
    for s in range(g.n):
        d = np.asarray(g.dijkstra(s))
        every, free = np.zeros(g.n), np.zeros(g.n)
        every[s] = free[s] = 1
        for x in np.argsort(d, kind="stable")[1:]:
            for y, _, w in g.adj[x]:
                if d[y] + w == d[x]:
                    every[x] += every[y]
                    free[x] += free[y] if y == s or y not in group else 0
            total += 1 - free[x] / every[x]
    return total / g.n**2


def test_samples_follow_eps(spark):
    """Counts grow as eps falls and with the graph; drawn scores and groups against exact ones."""
    assert C.share_samples(0, 0.05, 0.1) > 3 * C.share_samples(0, 0.1, 0.1) and C.share_samples(9, 0.1, 0.1) > C.share_samples(1, 0.1, 0.1)
    rows = random_graph(3, 12, 0.4)
    e, g = frame(spark, rows), K.Csr(*map(np.array, zip(*rows, strict=True)))
    chain = frame(spark, [(i, i + 1, 1) for i in range(9)])
    assert C.vertex_diameter(chain) == 10 and 2 < C.vertex_diameter(e) <= 12
    assert C.vertex_diameter(frame(spark, [(0, i, 1) for i in range(1, 9)])) in range(3, 6)
    exact, drawn = table(C.spanning_edge(e)), table(C.sampled_spanning_edge(e, 0.05))
    assert exact.keys() == drawn.keys() and max(abs(exact[x] - drawn[x]) for x in exact) <= 0.05
    group = C.group_betweenness(e, 2, 0.05)
    best = max(covered(g, {a, b}) for a, b in itertools.combinations(range(g.n), 2))
    assert covered(g, set(group)) >= (1 - 1 / np.e) * best - 2 * 0.05
    assert T.is_tree(T.approx_tree(e, 0.2, exact_below=5))


def test_searches_find_the_optimum(spark):
    """The defaults are the reference's, and the cost is the least of all spanning trees' of a small graph."""
    import inspect

    defaults = [{k: p.default for k, p in inspect.signature(f).parameters.items()} for f in (T.ant_colony, T.genetic_search)]
    assert [defaults[0][k] for k in ("ants", "rounds", "patience", "local")] == [200, 200, 10, 4]
    assert [defaults[1][k] for k in ("population", "decodings", "rounds", "patience", "tournaments")] == [50, 10, 200, 10, 20]
    rows = random_graph(5, 7, 0.6)
    g = K.Csr(*map(np.array, zip(*rows, strict=True)))
    for search, cost in ((T.ant_colony, T.gilbert_steiner(0, 0.5)), (T.genetic_search, T.centrality_cost(0.5))):
        best = min(cost(g, list(t)) for t in itertools.combinations(range(g.m), g.n - 1) if len(T._below(g, list(t), 0)) == g.n - 1)
        got = {(r.u, r.v) for r in search(frame(spark, rows), cost).collect()}
        assert abs(cost(g, [i for i, (u, v, _) in enumerate(rows) if (u, v) in got]) - best) < 1e-9


def test_backbone_segments_label_all_points(spark):
    """A path of 30 nodes on a line in segments of five: six labels of five, each node with its nearest end."""
    from pyspark.sql import functions as F

    from graftwork.operators import cluster as CL

    p = spark.range(30).select("id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("pos"))
    t = spark.range(29).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w"))
    centers, labels = CL.tree_segments(t, p, 5)
    by = {}
    for r in labels.collect():
        by.setdefault(r.label, []).append(r.id)
    assert sorted(sorted(x) for x in by.values()) == [list(range(k, k + 5)) for k in range(0, 30, 5)]
    assert centers.count() == 6


def test_endpoint_loop_weighs_leaves(spark):
    from pyspark.sql import functions as F

    from graftwork.operators import patch as PA

    e = frame(spark, random_graph(1))
    p = spark.range(10).select("id", F.array(F.col("id").cast("double"), (F.col("id") % 3).cast("double")).alias("pos"))
    tree, w = PA.endpoint_loop(e, p, spark.createDataFrame([(0,), (7,)], "id long"), 2)
    assert tree.count() == 9 and w.count() == 10


@pytest.mark.parametrize("w", [1, 40])
def test_counted_paths_after_a_weight_falls_or_rises(spark, w):
    e = [(u, v, 15 if (u, v) == (0, 1) else x) for u, v, x in random_graph(3)]
    ids = spark.range(10)
    rows = lambda df: sorted((r.source, r.id, r.dist, r.sigma) for r in df.collect())
    got = S.apsp_decrease_counted(frame(spark, e), S.sssp(frame(spark, e), ids), 0, 1, w)
    assert rows(got) == rows(S.sssp(frame(spark, [(u, v, w if (u, v) == (0, 1) else x) for u, v, x in e]), ids))


def test_no_top_node_where_no_path_has_an_inside(spark, monkeypatch):
    from graftwork.plans import q_paths as Q

    whole = frame(spark, [(u, v, 10 + u) for u, v in itertools.combinations(range(6), 2)])
    monkeypatch.setattr(Q, "kept", lambda s, d: whole)
    assert Q.cn09_kadabra(spark, "").collect() == []
    monkeypatch.setattr(Q, "kept", lambda s, d: frame(spark, DIAMOND))
    assert [r.id for r in Q.cn09_kadabra(spark, "").collect()] == [3]


@pytest.mark.parametrize("seed", range(6))
def test_local_search_of_equal_weights_ends_in_the_first_tree(seed):
    """Many ties: from any tree the search ends in the least one by (w, u, v)."""
    r = random.Random(seed)
    e = [(u, v, r.randint(7, 8)) for u, v in itertools.combinations(range(9), 2)]
    u, v, w = (np.array(c) for c in zip(*e, strict=True))
    g = K.Csr(u, v, w)
    got = T.local_search(g, T.grow(g, np.ones(g.m), [0], np.random.default_rng(seed)), T.centrality_cost(0.0))
    assert sorted(got) == sorted(K.spanning_forest(u, v, w).tolist())


def test_exact_line_beyond_a_quarter_million_cells(spark):
    """on a line the least cost is the area between the distribution functions."""
    rng = np.random.default_rng(4)
    x, y = rng.random(520), rng.random(500) ** 2
    a, b = (spark.createDataFrame([(i, [float(t)], 1 / len(z)) for i, t in enumerate(z)], "id long, pos array<double>, mass double") for z in (x, y))
    at = np.sort(np.r_[x, y])
    gap = np.searchsorted(np.sort(x), at, "right") / 520 - np.searchsorted(np.sort(y), at, "right") / 500
    got = OT.transport_cost(OT.earth_mover(OT.point_costs(a, b), a, b, 0)).first().distance
    assert abs(got - (np.abs(gap[:-1]) * np.diff(at)).sum()) < 1e-9


def test_flow_graph_beyond_a_quarter_million_cells(spark):
    """F8: all mass is in the graph's edges, a tree's worth of them at most."""
    c = spark.range(510).crossJoin(spark.range(505).withColumnRenamed("id", "j")).selectExpr("id as i", "j", "pmod(hash(id, j), 1000) / 1000 as cost")
    a, b = spark.range(510).selectExpr("id", "1 / 510D as mass"), spark.range(505).selectExpr("id", "1 / 505D as mass")
    w = [r.w for r in OT.flow_graph(OT.earth_mover(c, a, b, 0.0)).collect()]
    assert abs(sum(w) - 2000) < 1e-6 and len(w) <= 1014


@pytest.mark.parametrize("name", ("ot07_exact_line", "ot07_exact_edges", "ot08_flow_graph"))
def test_exact_plans_of_places_hold_no_cost_table(spark, monkeypatch, name):
    """beyond the bounds of tables of costs, which failed; no pair is written."""
    from graftwork.plans import q_trees as Q

    monkeypatch.setattr(OT, "EXACT_CELLS", 100)
    monkeypatch.setattr(OT, "COST_CELLS", 100)
    got = getattr(Q, name)(spark, "/root/testdata/sf0.01").first()
    assert {"ot07_exact_line": lambda: got.distance > 0, "ot07_exact_edges": lambda: got.mass == 1 and got.positive, "ot08_flow_graph": lambda: got.total == 2000}[name]()


def test_located_plan_prices_all_cells(monkeypatch):
    """far fewer near cells than the plan needs, and prices of a sample; on a line the least cost is known."""
    rng = np.random.default_rng(6)
    x, y = rng.random((300, 1)), rng.random((280, 1)) ** 2
    monkeypatch.setattr(OT, "NEAR_CELLS", 2)
    monkeypatch.setattr(OT, "START_CELLS", 1 << 10)
    at = np.sort(np.r_[x, y].ravel())
    gap = np.searchsorted(np.sort(x.ravel()), at, "right") / 300 - np.searchsorted(np.sort(y.ravel()), at, "right") / 280
    i, j, f, c = OT.least_plan(OT.Costs(x, y, OT.distances), np.full(300, 1 / 300), np.full(280, 1 / 280))
    assert abs((f * c).sum() - (np.abs(gap[:-1]) * np.diff(at)).sum()) < 1e-12 and np.array_equal(c, OT.distances(x, y)[i, j])
    assert np.allclose(np.bincount(i, f), 1 / 300) and np.allclose(np.bincount(j, f), 1 / 280)
    out, left = OT.least_plan(OT.Costs(x, y, OT.distances), np.ones(300), np.ones(280)), OT.exact_plan(OT.distances(x, y), np.ones(300), np.ones(280))
    assert abs((out[2] * out[3]).sum() - (left * OT.distances(x, y)).sum()) < 1e-9 and abs(out[2].sum() - 280) < 1e-9


def near_graph(n, k, seed, side=0):
    """Union neighbour graph of drawn plane points; on a grid of `side` places a side, with many ties."""
    rng = np.random.default_rng(seed)
    p = rng.integers(0, side, (n, 2)).astype(float) if side else rng.random((n, 2))
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    d[d == 0] = 1.0
    np.fill_diagonal(d, np.inf)
    u, v = np.array(sorted({(min(i, j), max(i, j)) for i in range(n) for j in np.argsort(d[i], kind="stable")[:k].tolist()})).T
    return u, v, d[u, v]


@pytest.mark.parametrize("side", (0, 5))
def test_all_paths_follow_lighter_edges(side, monkeypatch):
    """scores after each pick are those of all sources run anew, with ties and without; the trees are those of `Dependencies`."""
    u, v, w = near_graph(40, 5, 1, side)
    base = np.rint(w / w.min() * 1000).astype(np.int64) * 1000
    g, h = K.Csr(u, v, base), K.Csr(u, v, base.copy())
    state, rng = K.AllPaths(g), np.random.default_rng(2)
    for e in [None, *rng.permutation(len(u))[:30].tolist()]:
        if e is not None:
            state.lighten(e, 7)
            h.reweigh(e, 7)
        assert np.allclose(state.scores(), sum(h.brandes(s)[0] for s in range(h.n)))
    new = K.iterate_tree(u, v, w, None, "exact", True)
    monkeypatch.setattr(K.AllPaths, "fits", classmethod(lambda cls, weights: False))
    old = K.iterate_tree(u, v, w, None, "exact", True)
    assert [t[:2] for t in new] == [t[:2] for t in old] and np.allclose([t[2] for t in new], [t[2] for t in old])


def test_exact_tree_of_hundreds_of_nodes_in_seconds():
    """took minutes where each pick ran all sources anew."""
    import time

    start = time.time()
    assert len(K.iterate_tree(*near_graph(300, 12, 3), None, "exact", True)) == 299
    assert time.time() - start < 20


def test_tied_sources_keep_their_trees():
    """where many shortest paths tie, each pick folded all such sources anew, over every node's rank. Scores are those of
    all sources run anew, and only nodes where paths meet, or on the way to where they have parted, are looked at."""
    u, v, w = near_graph(90, 6, 2, 9)
    base = np.rint(w / w.min() * 1000).astype(np.int64) * 1000
    g, h = K.Csr(u, v, base), K.Csr(u, v, base.copy())
    state, rng = K.AllPaths(g), np.random.default_rng(3)
    assert state.tied.mean() > 0.9
    for e in rng.permutation(len(u))[:60].tolist():
        state.lighten(e, 7)
        h.reweigh(e, 7)
        assert np.allclose(state.scores(), sum(h.brandes(s)[0] for s in range(h.n)))
        assert not state.flow.any()
        at = state.last >= 0
        up = np.zeros_like(state.beyond)
        np.add.at(up, (np.nonzero(at)[0], state.last[at]), state.beyond[at])
        assert (state.beyond[at] == (up + 1)[at]).all() and (state.deep[at] == np.take_along_axis(state.deep, np.maximum(state.last, 0), 1)[at] + 1).all()


def test_counting_trees_takes_some_sources_at_a_time():
    """depths and nodes beyond took 28 bytes a pair of nodes and more besides the state; they are the same again."""
    import tracemalloc

    u, v, w = near_graph(1200, 5, 4)
    state = K.AllPaths(K.Csr(u, v, np.rint(w / w.min() * 1000).astype(np.int64) * 1000))
    was = [x.copy() for x in (state.deep, state.beyond, state.sum)]
    state.beyond[:] = 0
    tracemalloc.start()
    state._count()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * state.g.n**2 and all((x == y).all() for x, y in zip(was, (state.deep, state.beyond, state.sum), strict=True))


def test_each_graph_has_a_task_of_its_own(spark):
    """by a hash of their number some graphs shared a task."""
    from pyspark.sql import functions as F

    from graftwork.operators.trees import iterated_centrality_tree

    e = spark.createDataFrame([(10 * k + i, 10 * k + i + 1, 1.0 + i, k) for k in range(30) for i in range(1 + k % 4)], "u long, v long, w double, k long")
    t = iterated_centrality_tree(e, "exact", None, True, groups="k").withColumn("task", F.spark_partition_id())
    rows = t.select("grp", "task").distinct().collect()
    assert len(rows) == len({r.task for r in rows}) == len({r.grp for r in rows}) == 30 and t.count() == e.count()


def test_forest_betweenness(spark, monkeypatch):
    """a forest's scores come from the sizes of sides, without a run from every node; graphs with cycles go the long way."""
    from graftwork.operators import patch as PA

    e = [(0, 1, 1), (1, 2, 1), (1, 3, 2), (3, 4, 1), (10, 11, 1), (11, 12, 1)]
    f = frame(spark, e)
    comp = connected_components(f)
    side = {(0, 1): 4, (1, 2): 4, (1, 3): 6, (3, 4): 4, (10, 11): 2, (11, 12): 2}
    with monkeypatch.context() as m:
        m.setattr(PA, "edge_betweenness", None)
        assert {(r.u, r.v): r.score for r in PA.forest_betweenness(f, comp).collect()} == {k: 2.0 * x for k, x in side.items()}
    g = frame(spark, [*e, (0, 4, 9)])
    want = {(r.u, r.v): r.score for r in C.edge_betweenness(g).collect()}
    assert {(r.u, r.v): r.score for r in PA.forest_betweenness(g, connected_components(g)).collect()} == want


def test_delaunay_of_many_points_and_awkward_ones(spark):
    """more than 50,000 points; grids, copies and lines, where circles and turns tie."""
    from graftwork.operators.construct import delaunay, triangulate

    n = 50_100
    df = spark.range(n).selectExpr("id", "array(rand(3), rand(4)) as pos")
    e = np.array([(r.u, r.v) for r in delaunay(df).collect()])
    assert len(np.unique(e, axis=0)) == len(e) and 3 * n - 3 - 200 < len(e) <= 3 * n - 6 and len(np.unique(e)) == n
    g = np.array([(i / 3, j / 3) for i in range(9) for j in range(7)])
    d = lambda p, e: {round(float(((p[a] - p[b]) ** 2).sum() * 9), 6) for a, b in e}
    assert len(triangulate(g)) == 3 * 63 - 3 - 28 and d(g, triangulate(g)) == {1.0, 2.0}
    assert triangulate(np.vstack([g, g[:9]])) == triangulate(g)
    assert triangulate(np.array([[0, 0], [2, 2], [1, 1], [1, 1], [5, 5.0]])) == {(0, 2), (1, 2), (1, 4)}


def test_hop_sums_look_at_few_arcs(monkeypatch):
    """levels of few new nodes look at their neighbours alone; sums are those of plain searches."""
    n, looked, arcs = 400, [], K.Hops._arcs
    u, v = np.r_[np.arange(n - 1), 500], np.r_[np.arange(1, n), 501]
    monkeypatch.setattr(K.Hops, "_arcs", lambda self, rows, end: looked.append(len(out := arcs(self, rows, end))) or out)
    at = np.array([0, 3, 399, 400, 200])
    reached, far, near = K.Hops(u, v).sums(at)
    assert reached.tolist() == [n, n, n, 2, n]
    hops = [np.abs(np.arange(n) - s) if s < n else np.array([0, 1]) for s in at]
    assert far.tolist() == [h.sum() for h in hops] and np.allclose(near, [(1 / h[h > 0]).sum() for h in hops])
    assert sum(looked) < 0.1 * 400 * 2 * len(u)


@pytest.mark.parametrize("cells, most", ((1 << 25, 1.03), (1 << 15, 1.08)))
def test_first_tree_costs_little_more_than_the_least_plan(monkeypatch, cells, most):
    """F7, F8: 1.126 times as much where cells are taken by their cost alone. Prices come from all cells, or from some."""
    rng = np.random.default_rng(5)
    x, y = rng.random((400, 4)), rng.random((390, 4)) ** 2
    c, a, b = OT.segment_distances(x, y), rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 390).astype(float)
    b *= a.sum() / b.sum()
    best = (OT.exact_plan(c, a, b) * c).sum()
    monkeypatch.setattr(OT, "START_CELLS", cells)
    parent, flow, _ = OT._first_basis(c, *OT._matched(a, b))
    first = sum(f * (c[k, p - 400] if k < 400 else c[p, k - 400]) for k, (p, f) in enumerate(zip(parent, flow, strict=True)) if p >= 0) / 2**52 * a.sum()
    assert best <= first * (1 + 1e-9) and first < most * best
    assert abs((OT.exact_plan(c, a, b) * c).sum() - best) < 1e-9 * best
