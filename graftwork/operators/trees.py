"""Tree builders: minimum and maximum spanning trees, the iterated centrality trees and their variants, sampled and
searched trees."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.model import KERNEL_EDGES, canonical, nodes_of
from graftwork.operators import kernels as K
from graftwork.operators.components import connected_components
from graftwork.operators.graph import components, degrees
from graftwork.operators.paths import SharedGraph, one_task
from graftwork.session import Rounds, written

_TREE = "u long, v long, w double"


def minimum_spanning_tree(edges: DataFrame, largest: bool = False) -> DataFrame:
    """TR-16, TR-17: in rounds each component takes its least edge by (w, u, v), and components merge; any size of graph."""
    e = written(canonical(edges, "max" if largest else "min"), "edges")
    key = F.struct((-F.col("w") if largest else F.col("w")).alias("k"), "u", "v", "w")
    nodes = written(nodes_of(e), "nodes")
    keep = Rounds(edges.sparkSession)
    label = nodes.select("id", F.col("id").alias("component"))
    live, tree = e.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), None
    while not live.isEmpty():
        best = live.select(F.explode(F.array("cu", "cv")).alias("c"), key.alias("key")).groupBy("c").agg(F.min("key").alias("b")).select("b.u", "b.v", "b.w").distinct()
        tree = keep.written(best if tree is None else tree.unionByName(best), "tree")
        label = keep.written(components(tree, nodes), "label")
        a, b = label.select(F.col("id").alias("u"), F.col("component").alias("cu")), label.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        live = keep.written(live.select("u", "v", "w").join(a, "u").join(b, "v").where("cu <> cv").select("u", "v", "w", "cu", "cv"), "live")
    return tree if tree is not None else e


def euclidean_tree(points: DataFrame, k: int = 12) -> DataFrame:
    """TR-16 over all pairs of points, of which none but k neighbours each are written: in rounds each component takes its least edge by
    (w, u, v). That is in a point's list of neighbours, or, where all of a list is inside and ends no farther than the component's
    least edge so far, found by a scan for the nearest point outside."""
    from graftwork.operators import distance as D

    p = written(points.select("id", "pos"), "points")
    near = written(D.knn(p, k), "near")
    last = near.groupBy("u").agg(F.max("w").alias("last"))
    keep = Rounds(points.sparkSession)
    label, tree = p.select("id", F.col("id").alias("component")), None
    while True:
        a, b = label.select(F.col("id").alias("u"), F.col("component").alias("cu")), label.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        out = keep.written(near.select("u", "v", "w").join(a, "u").join(b, "v").where("cu <> cv").select("u", "v", "w", F.col("cu").alias("c")), "out")
        bound = out.groupBy("c").agg(F.min("w").alias("bound"))
        inner = label.withColumnRenamed("component", "c").join(out.select(F.col("u").alias("id")), "id", "left_anti").join(last.withColumnRenamed("u", "id"), "id", "left")
        inner = keep.written(inner.join(bound, "c", "left").where("bound is null or last is null or last <= bound").select("id", "c"), "inner")
        some = out
        if not inner.isEmpty():
            located = p.join(label.withColumnRenamed("component", "c"), "id")
            some = some.unionByName(D.nearest(p.join(inner, "id"), located, other="c").join(inner.withColumnRenamed("id", "u"), "u"))
        edge = F.struct("w", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        best = keep.written(some.groupBy("c").agg(F.min(edge).alias("b")).select("b.u", "b.v", "b.w").distinct(), "best")
        if best.isEmpty():
            return best if tree is None else tree
        tree = keep.written(best if tree is None else tree.unionByName(best), "tree")
        label = keep.written(components(tree, p), "label")


def iterated_centrality_tree(edges: DataFrame, scorer: str = "cluster_all", centers: DataFrame | None = None, zeros_stay_zeros: bool = False, groups: str | None = None, node_weights: DataFrame | None = None, seeds: list[tuple[int, int]] | None = None, per_round: int = 1, original_weights: bool = False) -> DataFrame:
    """TR-01: (u, v, w, step, score) of the picked edges; w is the highway weight, least / (4 n), or the edge's own.

    Scorers (TR-03): exact, cluster, cluster_all, cluster_all2, RK. One task a graph; with `groups` (a column of the edges) all
    graphs side by side. A graph must fit a task: `model.KERNEL_EDGES` edges.
    """
    if scorer not in ("exact", "cluster", "cluster_all", "cluster_all2", "RK"):
        raise ValueError(f"unknown scorer {scorer}")
    c = np.array(sorted(r.id for r in centers.select("id").distinct().collect()), np.int64) if centers is not None else None  # few by their meaning
    nw = {r.id: float(r.w) for r in node_weights.collect()} if node_weights is not None else None
    if not groups and edges.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        raise ValueError(f"more than {KERNEL_EDGES} edges for one task")
    g = edges.select("u", "v", F.col("w").cast("double").alias("w"), (F.col(groups) if groups else F.lit(0)).cast("long").alias("grp"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.r_[pdf["u"], pdf["v"]])
        weights = np.array([nw.get(int(i), 1.0) for i in ids]) if nw is not None else None
        got = K.iterate_tree(pdf["u"], pdf["v"], pdf["w"], c, scorer, zeros_stay_zeros, None, weights, seeds, per_round)
        own = {(int(a), int(b)): x for a, b, x in zip(pdf["u"], pdf["v"], pdf["w"], strict=True)}
        low = pdf["w"].min() / len(ids) / 4
        rows = [(pdf["grp"].iloc[0], a, b, own[a, b] if original_weights else low, i, s) for i, (a, b, s) in enumerate(got)]
        return pd.DataFrame(rows, columns=["grp", "u", "v", "w", "step", "score"])

    if groups:  # by number, as few small rows would else be one task's: each graph gets a task of its own, the largest first
        g = written(g, "graphs")
        place = F.row_number().over(W.orderBy(F.desc("size"), "grp")) - 1  # one task's window, over a row a graph
        place = written(g.groupBy("grp").agg(F.count("*").alias("size")).select("grp", place.alias("place")), "places")
        parts = min(1 << 14, max(1, place.count()))
        g = g.join(place.select("grp", (F.col("place") % parts).alias("task")), "grp").repartitionById(parts, F.col("task"))
    out = g.groupBy("task", "grp") if groups else g.groupBy("grp")
    out = out.applyInPandas(run, "grp long, u long, v long, w double, step int, score double")
    return out if groups else out.drop("grp")


def best_edge(edges: DataFrame, scores: DataFrame, highway: float) -> DataFrame:
    """TR-02: among edges above the highway weight, the largest score; ties by weight, u, v."""
    return edges.join(scores, ["u", "v"]).where((F.col("w") > highway) & (F.col("score") > 0)).orderBy(F.desc("score"), "w", "u", "v").limit(1)


def sure_edges(edges: DataFrame) -> DataFrame:
    """TR-04: edges of nodes with one edge."""
    leaf = degrees(edges).where("degree = 1").select("id")
    hit = edges.join(leaf.select(F.col("id").alias("u")), "u", "left_semi").select("u", "v", "w")
    return hit.union(edges.join(leaf.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "w")).distinct()


def finish_tree(edges: DataFrame, tree: DataFrame, n: int) -> DataFrame:
    """TR-05: where just n - 1 edges are left, all of them belong."""
    return tree.unionByName(edges.join(tree, ["u", "v"], "left_anti").select("u", "v", "w")) if edges.count() == n - 1 else tree


def tree_of(good: DataFrame, w: float) -> DataFrame:
    """TR-06."""
    return good.select("u", "v", F.lit(float(w)).alias("w"))


def update_tree(edges: DataFrame, tree: DataFrame, centers: DataFrame, cuts: int = 19, factor: float = 100.0) -> DataFrame:
    """TR-07: cut the tree's `cuts` largest edges (by the graph's weights), divide weights inside the parts, and build anew."""
    own = tree.select("u", "v").join(edges.select("u", "v", "w"), ["u", "v"])
    cut = own.orderBy(F.desc("w"), "u", "v").limit(cuts)
    part = components(own.join(cut.select("u", "v"), ["u", "v"], "left_anti"), nodes_of(edges))
    a, b = part.select(F.col("id").alias("u"), F.col("component").alias("cu")), part.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    new = edges.join(a, "u").join(b, "v").select("u", "v", F.when(F.col("cu") == F.col("cv"), F.col("w") / factor).otherwise(F.col("w")).alias("w"))
    return iterated_centrality_tree(written(new, "reweighed"), "cluster_all", centers, True)


_PICKED = "u long, v long, w double, step long, score double"


def _one_task(edges: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str = _TREE) -> DataFrame:
    """The rows that fn(u, v, w) gives, in one task over a graph of checked size."""
    names = [x.split()[0] for x in schema.split(", ")]
    return one_task(edges, lambda u, v, w: pd.DataFrame(fn(u, v, np.asarray(w, float)), columns=names), schema)


def exact_tree(edges: DataFrame, per_round: int = 1, scorer: str = "betweenness", dynamic: bool = False, unit: str = "n") -> DataFrame:
    """TR-08, TR-09, TR-11: (u, v, w, step, score): betweenness (or flow) each round, greedy picks without cycles, picked edges at
    least / (n + 1) (unit "m": least / (m + 1)); own weights stay. `dynamic` runs only the sources anew that a pick affects."""
    return _one_task(edges, lambda u, v, w: K.exact_picks(u, v, w, per_round, scorer, dynamic, unit), _PICKED)


def greedy_forest(edges: DataFrame, scores: DataFrame, most: int, whole_level: bool = False) -> DataFrame:
    """GP-13: (u, v, w, score, taken): edges by falling score, then rising weight, till `most` are taken; those that would close a
    cycle on the way come with taken false. In one task over a graph of checked size."""
    scored = written(edges.join(scores.select("u", "v", "score"), ["u", "v"]).select("u", "v", "w", "score"), "scored")
    if scored.limit(KERNEL_EDGES + 1).count() > KERNEL_EDGES:
        raise ValueError(f"more than {KERNEL_EDGES} edges for one task")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v, w, s = (pdf[c].to_numpy() for c in ("u", "v", "w", "score"))
        taken, cyclic = K.greedy_pick(u, v, w, s, K.UnionFind(), most, whole_level)
        out = pdf.iloc[[*taken, *cyclic]][["u", "v", "w", "score"]]
        return out.assign(w=out["w"].astype(float), taken=[True] * len(taken) + [False] * len(cyclic))

    return scored.groupBy().applyInPandas(run, "u long, v long, w double, score double, taken boolean")


def merge_tree(edges: DataFrame) -> DataFrame:
    """TR-10: (u, v, w, step, score): the best edge's ends merge; between two merged classes the cheapest own edge is taken; parallel edges keep the least."""

    def build(u, v, w):
        cls, out = {int(x): int(x) for x in np.r_[u, v]}, []
        cur = {(int(a), int(b)): (float(c), int(a), int(b)) for a, b, c in zip(u, v, w, strict=True)}
        while cur:
            keys = sorted(cur)
            g = K.Csr(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.rint(np.array([cur[k][0] for k in keys]) / w.min() * 1_000_000))
            score = np.round(sum(g.brandes(s)[0] for s in range(g.n)), 9)
            i = int(np.lexsort(([k[1] for k in keys], [k[0] for k in keys], g.w, -score))[0])
            a, b = keys[i]
            c, x, y = cur[keys[i]]
            out.append((min(x, y), max(x, y), c, len(out), float(score[i])))
            for n in cls:
                cls[n] = a if cls[n] == b else cls[n]
            new: dict[tuple[int, int], tuple] = {}
            for (p, q), e in cur.items():
                p, q = (a if p == b else p), (a if q == b else q)
                if p != q:
                    k = (min(p, q), max(p, q))
                    new[k] = min(new.get(k, e), e)
            cur = new
        return out

    return _one_task(edges, build, _PICKED)


def approx_tree(edges: DataFrame, eps: float = 0.1, delta: float = 0.1, seed: int = 42, per_round: int = 1, exact_below: int = 150, new_weight: float | None = None, samples: int | None = None) -> DataFrame:
    """TR-12: drawn paths instead of all, as many as (eps, delta) and the nodes ask for, kept from round to round where a pick leaves
    their ends' distance and number of paths alone (EC-09); up to `exact_below` nodes the exact tree."""
    from graftwork.operators.centrality import sample_size

    n = nodes_of(edges).count()
    if n <= exact_below:
        return exact_tree(edges, per_round).select("u", "v", "w")
    samples = samples or sample_size(n, eps, delta)
    return _one_task(edges, lambda u, v, w: [(a, b, float(w[(u == a) & (v == b)][0])) for a, b, _ in K.iterate_tree(u, v, w, None, "RK", False, new_weight, None, None, per_round, seed, samples)])


def centroid_order(dist: DataFrame) -> DataFrame:
    """TR-14: (id, far) by rising mean distance."""
    return dist.groupBy(F.col("source").alias("id")).agg(F.avg("dist").alias("far")).orderBy("far", "id")


def centroid_tree(edges: DataFrame, theta: float = 1.0, proportion: float = 1.0) -> DataFrame:
    """TR-13: (u, v, w, step, score): nodes join in the order of their mean distances (the score), each at the tree node next to it that is near and central in the
    tree: largest exp(-theta w) / mean tree distance; its edge then costs least * proportion in the distances."""

    def build(u, v, w):
        g = K.Csr(u, v, w)
        d = np.array([g.dijkstra(s) for s in range(g.n)])
        cost = np.full((g.n, g.n), np.inf)
        cost[g.a, g.b] = cost[g.b, g.a] = w
        first = np.lexsort((np.arange(g.n), d.mean(1)))[:1]
        inside, td, out = [int(first[0])], np.zeros((1, 1)), []
        while len(inside) < g.n:
            rest = [x for x in range(g.n) if x not in inside and np.isfinite(cost[x, inside]).any()]
            if not rest:
                break
            x = min(rest, key=lambda i: (d[i].mean(), i))
            mean = td.mean(1) + (1 if len(inside) == 1 else 0)
            t = max(range(len(inside)), key=lambda k: (math.exp(-theta * cost[x, inside[k]]) / mean[k], -inside[k]))
            a, c = inside[t], float(cost[x, inside[t]])
            row = td[t] + c
            td = np.block([[td, row[:, None]], [row[None, :], np.zeros((1, 1))]])
            inside.append(x)
            out.append((int(min(g.ids[a], g.ids[x])), int(max(g.ids[a], g.ids[x])), c, len(out), float(d[x].mean())))
            low = w.min() * proportion
            d = np.minimum(d, np.minimum(d[:, [a]] + low + d[[x], :], d[:, [x]] + low + d[[a], :]))
        return out

    return _one_task(edges, build, _PICKED)


def rsp_tree(edges: DataFrame, theta: float = 15.0) -> DataFrame:
    """TR-15, GP-14: (u, v, w, step, score): randomized shortest-path scores; the best edge that closes no cycle gets cheap, and Z follows by rank-one updates."""
    from graftwork.operators.centrality import rsp_matrices, rsp_scores

    def build(u, v, w):
        g = K.Csr(u, v, w)
        cost = np.zeros((g.n, g.n))
        cost[g.a, g.b] = cost[g.b, g.a] = w / w.mean()
        ref = (cost > 0) / (cost > 0).sum(1)[:, None]
        wm, z = rsp_matrices(cost, ref, theta)
        low, forest, out, done = cost[cost > 0].min() / (g.n + 1), K.UnionFind(), [], np.zeros(g.m, bool)
        while len(out) < g.n - 1:
            b = rsp_scores(z, wm)
            score = np.round(b[g.a, g.b] + b[g.b, g.a], 12)
            at = np.flatnonzero(~done)
            taken, cyclic = K.greedy_pick(u[at], v[at], w[at], score[at], forest, 1)
            done[at[cyclic]] = True
            if not taken:
                break
            k = int(at[taken[0]])
            done[k] = True
            out.append((int(u[k]), int(v[k]), float(w[k]), len(out), float(score[k])))
            for i, j in ((g.a[k], g.b[k]), (g.b[k], g.a[k])):
                new = ref[i, j] * math.exp(-theta * low)
                step = new - wm[i, j]
                z = z + np.outer(z[:, i], z[j, :]) * step / (1 - step * z[j, i])
                wm[i, j] = new
        return out

    return _one_task(edges, build, _PICKED)


def representatives_tree(tree: DataFrame, points: DataFrame, centers: DataFrame) -> DataFrame:
    """TR-18: the tree with lengths from positions; distances in it between the centers; their least tree, centers numbered from 0."""
    from graftwork.operators.graph import weights_from_positions
    from graftwork.operators.paths import sssp

    c = centers.select("id").distinct().withColumn("k", (F.row_number().over(W.orderBy("id")) - 1).cast("long"))  # few by their meaning
    c = written(c, "centers")
    d = sssp(weights_from_positions(tree, points), c)
    pairs = d.join(c.select(F.col("id").alias("source"), F.col("k").alias("u")), "source").join(c.select("id", F.col("k").alias("v")), "id").where("u < v").select("u", "v", F.col("dist").alias("w"))
    return minimum_spanning_tree(pairs)


def jitter_tree(points: DataFrame, jitter: float, seed: int = 42) -> DataFrame:
    """TR-19."""
    from graftwork.sources.generators import normal

    moved = points.withColumn("pos", F.transform("pos", lambda x, i: x + jitter * normal(F.col("id") * 1000 + i, seed, 1)))
    return euclidean_tree(moved)


def subgraph_tree(edges: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """TR-20: a drawn share of the nodes, their induced graph, its least forest."""
    from graftwork.operators.graph import subgraph

    n = nodes_of(edges).count()
    some = nodes_of(edges).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(1, round(share * n)))
    return minimum_spanning_tree(subgraph(edges, some))


def contraction_tree(edges: DataFrame, mu: float = 10.0, seed: int = 42) -> DataFrame:
    """TR-21: draws an edge in proportion to exp(-mu w) among those between different classes, merges, n - 1 times. Drawing without
    replacement in proportion to weights is taking edges by exponential clocks, so one pass over clock order that skips
    cycles has the same distribution."""

    def build(u, v, w):
        clock = np.random.default_rng(seed).exponential(size=len(u)) / np.exp(-mu * (w - w.min()))
        uf = K.UnionFind()
        return [(int(u[k]), int(v[k]), float(w[k])) for k in np.argsort(clock, kind="stable") if uf.join(int(u[k]), int(v[k]))]

    return _one_task(edges, build)


# ---- searched trees (TR-22 to TR-26) ---------------------------------------------------------------------------------------------


def grow(g: K.Csr, p: np.ndarray, roots: list[int], rng: np.random.Generator) -> list[int]:
    """TR-25: edge numbers of a tree grown from the roots, each step an edge on its border drawn by p."""
    inside = np.zeros(g.n, bool)
    inside[roots] = True
    out = []
    while True:
        at = np.flatnonzero(inside[g.a] != inside[g.b])
        if not len(at):
            return out
        q = p[at] + 1e-300
        e = int(at[rng.choice(len(at), p=q / q.sum())])
        out.append(e)
        inside[[g.a[e], g.b[e]]] = True


def gilbert_steiner(root: int, alpha: float) -> Callable:
    """TR-26: sum over edges of weight times (nodes below)^alpha."""

    def cost(g: K.Csr, tree: list[int]) -> float:
        return sum(float(g.w[e]) * below**alpha for e, below, _ in _below(g, tree, root))

    return cost


def centrality_cost(alpha: float) -> Callable:
    """TR-26: sum over edges of weight times (n1 n2)^alpha."""

    def cost(g: K.Csr, tree: list[int]) -> float:
        return sum(float(g.w[e]) * (b * (n - b)) ** alpha for e, b, n in _below(g, tree, 0))

    return cost


def _below(g: K.Csr, tree: list[int], root: int) -> list[tuple[int, int, int]]:
    adj: dict[int, list] = {}
    for e in tree:
        adj.setdefault(int(g.a[e]), []).append((int(g.b[e]), e))
        adj.setdefault(int(g.b[e]), []).append((int(g.a[e]), e))
    order, up, seen = [], {}, {root}
    stack = [root]
    while stack:
        x = stack.pop()
        order.append(x)
        for y, e in adj.get(x, []):
            if y not in seen:
                seen.add(y)
                up[y] = (x, e)
                stack.append(y)
    size = dict.fromkeys(order, 1)
    for x in reversed(order):
        if x in up:
            size[up[x][0]] += size[x]
    return [(e, size[x], len(order)) for x, (_, e) in up.items()]


def local_search(g: K.Csr, tree: list[int], cost: Callable, rounds: int | None = None) -> list[int]:
    """TR-24: passes over all tree edges, dear ones first; each goes for the first edge across its cut, cheap ones first, by
    which the cost falls, or stays and the new edge comes first by (weight, number), so that among trees of equal cost the end doesn't
    hang on the start. Ends with the pass that swaps nothing (then no single swap helps), or after `rounds` passes."""
    place = np.empty(g.m, int)
    place[np.argsort(np.asarray(g.w, float), kind="stable")] = np.arange(g.m)
    best, value, swapped = list(tree), cost(g, tree), True
    while swapped and rounds != 0:
        rounds, swapped = None if rounds is None else rounds - 1, False
        for out in sorted(best, key=lambda e: -float(g.w[e])):
            uf = K.UnionFind()
            for e in best:
                if e != out:
                    uf.join(int(g.a[e]), int(g.b[e]))
            side = [uf.find(x) for x in range(g.n)]
            cut = {side[g.a[out]], side[g.b[out]]}
            over = [e for e in range(g.m) if e != out and {side[g.a[e]], side[g.b[e]]} == cut]
            for e in sorted(over, key=lambda e: float(g.w[e])):
                new = [x for x in best if x != out] + [e]
                c = cost(g, new)
                if c < value - 1e-12 or (c <= value and place[e] < place[out]):
                    best, value, swapped = new, c, True
                    break
    return best


def _search(edges: DataFrame, cost: Callable, next_p: Callable, population: int, rounds: int, patience: int, seed: int, local: int) -> DataFrame:
    """Rounds of trees built side by side in tasks (one row a builder), the best kept; next_p makes the next probabilities."""
    spark = edges.sparkSession
    graph = SharedGraph(edges)
    load = graph.in_task()
    size = _Size(nodes_of(edges).count(), graph.m, np.array([r.w for r in edges.orderBy("u", "v").select("w").collect()], float))  # edges of a graph of checked size
    state, best, still = next_p(size, None, None), None, 0
    for r in range(rounds):
        probs = spark.sparkContext.broadcast(state["p"])

        def run(batches, r=r, probs=probs):
            graph = None
            for pdf in batches:
                graph = graph or K.Csr(*load())
                out = []
                for i in pdf["id"]:
                    rng = np.random.default_rng([seed, r, i])
                    p = probs.value[i % len(probs.value)]
                    t = grow(graph, p, [0], rng)
                    if i < local:
                        t = local_search(graph, t, cost, 2)
                    out.append((int(i), [int(x) for x in sorted(t)], float(cost(graph, t))))
                yield pd.DataFrame(out, columns=["id", "tree", "cost"])

        got = spark.range(population).repartition(min(8, population)).mapInPandas(run, "id long, tree array<int>, cost double").collect()  # a row for each builder
        got.sort(key=lambda x: (x.cost, x.id))
        still = still + 1 if best is not None and got[0].cost >= best[0] - 1e-12 else 0
        best = min(best, (got[0].cost, list(got[0].tree))) if best else (got[0].cost, list(got[0].tree))
        if still >= patience:
            break
        state = next_p(size, state, [(x.cost, list(x.tree)) for x in got])
    return improved(edges, best[1], cost)


class _Size(NamedTuple):
    """What the probabilities of a search need of its graph: numbers of nodes and edges, and weights by (u, v)."""

    n: int
    m: int
    w: np.ndarray


def improved(edges: DataFrame, tree: list[int], cost: Callable, rounds: int | None = None) -> DataFrame:
    """TR-24: (u, v, w) of the tree (edge numbers by (u, v)) after local search, in one task."""

    def build(u, v, w):
        g = K.Csr(u, v, w)
        return [(int(u[e]), int(v[e]), float(w[e])) for e in local_search(g, tree, cost, rounds)]

    return _one_task(edges, build)


def grown(edges: DataFrame, roots: list[int], trees: int, seed: int = 42) -> DataFrame:
    """TR-25: (tree, u, v, w) of trees grown from the roots, each step an edge on the border drawn by its weight's share."""
    load = SharedGraph(edges).in_task()

    def run(batches):
        g = None
        for pdf in batches:
            g = g or K.Csr(*load())
            at = [int(k) for k in np.searchsorted(g.ids, roots)]
            p = np.asarray(g.w, float) / float(np.sum(g.w))
            rows = [(int(i), int(g.ids[g.a[e]]), int(g.ids[g.b[e]]), float(g.w[e])) for i in pdf["id"] for e in grow(g, p, at, np.random.default_rng([seed, int(i)]))]
            yield pd.DataFrame(rows, columns=["tree", "u", "v", "w"])

    return edges.sparkSession.range(trees).mapInPandas(run, "tree long, u long, v long, w double")


def tree_cost(edges: DataFrame, tree: DataFrame, cost: Callable) -> DataFrame:
    """TR-26: (cost) of a tree of the graph's edges under a cost functional, in one task."""
    chosen = edges.join(tree.select("u", "v", F.lit(True).alias("in")), ["u", "v"], "left")
    marks = written(chosen.select("u", "v", "w", F.coalesce("in", F.lit(False)).alias("in")), "marks")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"])
        g = K.Csr(*(pdf[c].to_numpy() for c in ("u", "v", "w")))
        return pd.DataFrame({"cost": [float(cost(g, np.flatnonzero(pdf["in"].to_numpy()).tolist()))]})

    return marks.groupBy().applyInPandas(run, "cost double")


def ant_colony(edges: DataFrame, cost: Callable, ants: int = 200, rounds: int = 200, patience: int = 10, a: float = 1.0, b: float = -2.0, rho: float = 0.1, q: float = 2.0, p_best: float = 0.5, local: int = 4, seed: int = 42) -> DataFrame:
    """TR-22: trails evaporate by rho and grow where the round's best tree went, within bounds from the best cost so far."""

    def next_p(g, state, got):
        tau = np.ones(g.m) if state is None else state["tau"] * (1 - rho)
        if got:
            high = q / (rho * got[0][0])
            n = max(2, g.n)
            low = high * (1 - p_best ** (1 / n)) / max(1e-9, (g.m / n - 1) * p_best ** (1 / n))
            tau[got[0][1]] += q / got[0][0]
            tau = np.clip(tau, min(low, high), high)
        p = tau**a * np.asarray(g.w, float) ** b
        return {"tau": tau, "p": [p / p.sum()]}

    return _search(edges, cost, next_p, ants, rounds, patience, seed, local)


def genetic_search(edges: DataFrame, cost: Callable, population: int = 50, decodings: int = 10, rounds: int = 200, patience: int = 10, keep: float = 0.8, tournaments: int = 20, seed: int = 42) -> DataFrame:
    """TR-23: chromosomes are edge probabilities, judged by the best of a few trees grown from them; tournaments, crossing, mutation."""

    def next_p(g, state, got):
        rng = np.random.default_rng([seed, 0 if state is None else state["round"] + 1])
        if state is None:
            return {"p": [rng.random(g.m) for _ in range(population)], "round": 0}
        fit = np.full(population, np.inf)
        for i, (c, _) in enumerate(sorted(got, key=lambda x: x[0])):
            fit[i % population] = min(fit[i % population], c)
        old, new = state["p"], [state["p"][k] for k in np.argsort(fit)[: max(1, population - tournaments)]]
        while len(new) < population:
            x, y = (min(rng.integers(0, population, 3), key=lambda k: fit[k]) for _ in range(2))
            child = np.where(rng.random(g.m) < 0.5, old[x], old[y])
            flip = rng.random(g.m) < 0.05
            child = np.where(flip, rng.random(g.m), child)
            new.append(child)
        return {"p": new, "round": state["round"] + 1}

    return _search(edges, cost, next_p, population * decodings, rounds, patience, seed, 0)


def is_tree(edges: DataFrame) -> bool:
    """n - 1 edges and one component."""
    n = nodes_of(edges).count()
    return edges.count() == n - 1 and connected_components(edges).select("component").distinct().count() == 1
