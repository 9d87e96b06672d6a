"""Edge and node centralities. Exact path-based ones run one kernel a source over a graph of checked size that
tasks read for themselves, and sum scores within each task; degree-like, spectral and peeling ones are DataFrame plans; those that
need a dense inverse run in one task over a graph of checked size. `dynamic` updates path-based scores under changes of edges."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.model import KERNEL_EDGES, both_ways, nodes_of
from graftwork.operators.graph import degrees
from graftwork.operators.kernels import Csr
from graftwork.operators.paths import SharedGraph, hop_sums, one_task, sssp, sum_over_sources
from graftwork.session import Rounds, written

#: Nodes of graphs whose dense inverse one task may hold.
DENSE_NODES = 5000


# ---- results (CN-01, CN-38 to CN-40) ---------------------------------------------------------------------------------


class Scores:
    """(id, score) with the views that every centrality offers."""

    def __init__(self, scores: DataFrame) -> None:
        self.scores = scores.select("id", "score")

    def score(self, node: int) -> float | None:
        r = self.scores.where(F.col("id") == node).first()
        return r.score if r else None

    def ranking(self) -> DataFrame:
        return self.scores.orderBy(F.desc("score"), "id")

    def top(self, k: int, ties: bool = False) -> DataFrame:
        """The k best; with ties also those that equal the last."""
        best = self.ranking().limit(k)
        if not ties:
            return best
        edge = best.agg(F.min("score").alias("edge"))  # one row
        return self.scores.crossJoin(F.broadcast(edge)).where("score >= edge").select("id", "score").orderBy(F.desc("score"), "id")

    def maximum(self) -> DataFrame:
        return self.scores.agg(F.max("score").alias("maximum"))

    def centralization(self) -> DataFrame:
        return self.scores.agg((F.max("score") * F.count("score") - F.sum("score")).alias("centralization"))


def rank_per_node(scores: DataFrame) -> DataFrame:
    """CN-39: 0-based places, equal scores share the first. Counts of higher scores come from one row a score."""
    by = scores.groupBy("score").agg(F.count("*").alias("n"))
    place = by.withColumn("place", F.coalesce(F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return scores.join(place.select("score", "place"), "score").select("id", "place")


def relative_rank_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """CN-40: (id, error) = (place in a + 1) / (place in b + 1); nothing where lengths differ."""
    if a.count() != b.count():
        return a.limit(0).select("id", F.lit(0.0).alias("error"))
    x, y = rank_per_node(a), rank_per_node(b).withColumnRenamed("place", "other")
    return x.join(y, "id").select("id", ((F.col("place") + 1) / (F.col("other") + 1)).alias("error"))


# ---- path-based edge scores (EC-01 to EC-08) ------------------------------------------------------------------------------

def _edge_view(edges: DataFrame, parts: DataFrame, factor: float = 1.0) -> DataFrame:
    return edges.select("u", "v").join(parts.where("kind = 0").drop("kind"), ["u", "v"], "left").select("u", "v", (F.coalesce("score", F.lit(0.0)) * factor).alias("score"))


def _node_view(edges: DataFrame, parts: DataFrame, factor: float = 1.0) -> DataFrame:
    n = parts.where("kind = 1").select(F.col("u").alias("id"), "score")
    return nodes_of(edges).join(n, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) * factor).alias("score"))


def edge_betweenness(edges: DataFrame, pairs: str = "ordered", sources: DataFrame | None = None) -> DataFrame:
    """EC-01: over ordered pairs, or unordered ones at half."""
    return _edge_view(edges, sum_over_sources(edges, sources or nodes_of(edges), lambda g, s: (g.brandes(s)[0], None)), 1.0 if pairs == "ordered" else 0.5)


def betweenness(edges: DataFrame, normalized: bool = False, unweighted: bool = False, pairs: str = "unordered") -> DataFrame:
    """CN-02: node scores; normalized over (n - 1)(n - 2) ordered pairs."""
    parts = sum_over_sources(edges, nodes_of(edges), lambda g, s: (None, g.brandes(s, unweighted)[1]))
    out = _node_view(edges, parts, 1.0 if pairs == "ordered" or normalized else 0.5)
    if not normalized:
        return out
    n = nodes_of(edges).count()
    return out.withColumn("score", F.col("score") / max(1, (n - 1) * (n - 2)))


def cluster_paths(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """EC-02: walks between centers along shortest paths, each counted."""
    ids = np.array(sorted(r.id for r in centers.select("id").distinct().collect()), np.int64)  # centers are few by their meaning
    return _edge_view(edges, sum_over_sources(edges, centers, lambda g, s: (g.walks(s, np.isin(g.ids, ids))[0], None)))


def cluster_to_all(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """EC-03: walks from centers to all nodes."""
    return _edge_view(edges, sum_over_sources(edges, centers, lambda g, s: (g.walks(s, np.ones(g.n, bool))[0], None)))


def cluster_to_all_nodes(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """EC-05: inner visits of nodes."""
    return _node_view(edges, sum_over_sources(edges, centers, lambda g, s: (None, g.walks(s, np.ones(g.n, bool))[1])))


def cluster_to_all_weighted(edges: DataFrame, centers: DataFrame, node_weights: DataFrame) -> DataFrame:
    """EC-04: (id, w) weights of nodes, 1 where missing."""
    nw = {r.id: float(r.w) for r in nodes_of(edges).join(node_weights, "id").select("id", "w").collect()}  # nodes of a graph of checked size

    def fn(g: Csr, s: int):
        return g.weighted_walks(s, np.array([nw.get(int(i), 1.0) for i in g.ids])), None

    return _edge_view(edges, sum_over_sources(edges, centers, fn))


def sample_size(n_or_diameter: int, eps: float, delta: float, c: float = 1.0) -> int:
    """EC-07: how many paths give errors within eps with probability 1 - delta."""
    return math.ceil(c / eps**2 * (math.floor(math.log2(max(2, n_or_diameter - 1))) + 1 - math.log(delta)))


def share_samples(shares: float, eps: float, delta: float) -> int:
    """How many draws give so many shares errors within eps, all at once, with probability 1 - delta (Hoeffding); shares as a logarithm."""
    return math.ceil((shares + math.log(2 / delta)) / (2 * eps**2))


def vertex_diameter(edges: DataFrame, unweighted: bool = False) -> int:
    """EC-07: a bound of the nodes on any shortest path: twice a component's reach over the least weight, or all its nodes."""

    def run(u, v, w) -> pd.DataFrame:
        g = Csr(u, v, w)
        least = 1 if unweighted else g.w.min()
        seen, most = np.zeros(g.n, bool), 1
        for s in range(g.n):
            if not seen[s]:
                d = np.asarray(g.dijkstra(s, unweighted=unweighted))
                near = np.isfinite(d)
                seen |= near
                most = max(most, min(int(near.sum()), int(2 * d[near].max() / least) + 1 if least > 0 else g.n))
        return pd.DataFrame({"most": [most]})

    return one_task(edges, run, "most long").first().most


def _distinct_pairs(spark: SparkSession, n: int, r: int, seed: int) -> DataFrame:
    """(sample, i, j), i < j: r different pairs of n numbers. An affine map over a prime above the number of pairs permutes pair
    numbers, and those beyond it are stepped over; pair p stands in row i's place of the triangle."""
    pairs = n * (n - 1) // 2
    prime = next(p for p in range(max(3, pairs + 1), 2 * max(3, pairs) + 2) if all(p % q for q in range(2, math.isqrt(p) + 1)))
    rng = np.random.default_rng(seed)
    a, b = int(rng.integers(1, prime)), int(rng.integers(0, prime))
    # of the first r + (prime - pairs) numbers at most prime - pairs fall beyond the pairs
    p = spark.range(min(prime, r + prime - pairs)).select(F.col("id").alias("k"), F.expr(f"cast((cast(id as decimal(20,0)) * {a} + {b}) % {prime} as long)").alias("p")).where(F.col("p") < pairs)
    p = p.orderBy("k").limit(r)
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("p").cast("double"))) / 2)
    p = p.withColumn("j", j.cast("long"))
    low, high = F.expr("j * (j - 1) div 2"), F.expr("j * (j + 1) div 2")
    p = p.withColumn("j", F.when(F.col("p") < low, F.col("j") - 1).when(F.col("p") >= high, F.col("j") + 1).otherwise(F.col("j")))  # square roots round
    return p.select(F.col("k").alias("sample"), (F.col("p") - F.expr("j * (j - 1) div 2")).alias("i"), "j")


def sampled_edge_betweenness(edges: DataFrame, eps: float = 0.1, delta: float = 0.1, c: float = 1.0, seed: int = 42, replace: bool = True, samples: int | None = None) -> DataFrame:
    """EC-06 to EC-08: shares of drawn shortest paths that run over each edge. Pairs come from hashes of the sample's number."""
    from graftwork.operators.paths import random_paths
    from graftwork.sources.generators import uniform

    spark = edges.sparkSession
    ids = written(nodes_of(edges).withColumn("k", (F.row_number().over(W.orderBy("id")) - 1).cast("long")), "ids")  # nodes of a graph of checked size
    n = ids.count()
    r = samples or sample_size(n, eps, delta, c)
    if replace:
        draw = spark.range(r).select(F.col("id").alias("sample"), F.floor(uniform(F.col("id"), seed, 1) * n).alias("i"), F.floor(uniform(F.col("id"), seed, 2) * n).alias("j"))
    else:
        draw = _distinct_pairs(spark, n, min(r, n * (n - 1) // 2), seed)
        r = min(r, n * (n - 1) // 2)
    named = draw.join(ids.select(F.col("k").alias("i"), F.col("id").alias("source")), "i").join(ids.select(F.col("k").alias("j"), F.col("id").alias("target")), "j").where("source <> target")
    hits = random_paths(edges, named, seed).groupBy("u", "v").agg((F.count("*") / float(r)).alias("score"))
    return edges.select("u", "v").join(hits, ["u", "v"], "left").fillna(0.0, ["score"])


def sampled_betweenness(edges: DataFrame, eps: float = 0.1, delta: float = 0.1, seed: int = 42, samples: int | None = None) -> DataFrame:
    """CN-03: shares of drawn paths through each node's inside."""
    from graftwork.operators.paths import random_paths
    from graftwork.sources.generators import uniform

    ids = written(nodes_of(edges).withColumn("k", (F.row_number().over(W.orderBy("id")) - 1).cast("long")), "ids")
    n = ids.count()
    r = samples or sample_size(n, eps, delta)
    draw = edges.sparkSession.range(r).select(F.col("id").alias("sample"), F.floor(uniform(F.col("id"), seed, 1) * n).alias("i"), F.floor(uniform(F.col("id"), seed, 2) * n).alias("j"))
    named = draw.join(ids.select(F.col("k").alias("i"), F.col("id").alias("source")), "i").join(ids.select(F.col("k").alias("j"), F.col("id").alias("target")), "j").where("source <> target")
    steps = random_paths(edges, named, seed)
    inner = steps.select("sample", "source", "target", F.explode(F.array("u", "v")).alias("id")).where("id <> source and id <> target").distinct()
    return nodes_of(edges).join(inner.groupBy("id").agg((F.count("*") / float(r)).alias("score")), "id", "left").fillna(0.0, ["score"])


def estimate_betweenness(edges: DataFrame, n_samples: int, seed: int = 42) -> DataFrame:
    """CN-08: dependencies of drawn sources, scaled to all."""
    nodes = nodes_of(edges)
    n = nodes.count()
    some = nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_samples)
    return _node_view(edges, sum_over_sources(edges, some, lambda g, s: (None, g.brandes(s)[1])), n / max(1, min(n, n_samples)) / 2)


# ---- trees (EC-11 to EC-14) ----------------------------------------------------------------------------------------------


def tree_sides(tree: DataFrame) -> DataFrame:
    """(u, v, child, below, n): how many nodes hang on the child's side of the edge. Trees of a size that one task may hold are folded
    there; larger ones by leaves, level by level."""
    if tree.limit(KERNEL_EDGES + 1).count() <= KERNEL_EDGES:
        return _sides_kernel(tree)
    n = nodes_of(tree).count()
    live, done = written(tree.select("u", "v"), "live"), None
    mass = written(nodes_of(tree).select("id", F.lit(1).cast("long").alias("m")), "mass")
    while not live.isEmpty():
        deg = live.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
        leaf = deg.where("d = 1").select("id").join(mass, "id")
        a, b = leaf.select(F.col("id").alias("u"), F.col("m").alias("mu")), leaf.select(F.col("id").alias("v"), F.col("m").alias("mv"))
        cut = written(live.join(a, "u", "left").join(b, "v", "left").where("mu is not null or mv is not null").select("u", "v", "mu", "mv"), "cut")
        row = cut.select("u", "v", F.when(F.col("mu").isNull(), F.col("v")).otherwise(F.col("u")).alias("child"), F.coalesce("mu", "mv").alias("below"))
        done = row if done is None else done.unionByName(row)
        up = cut.where("mu is null or mv is null").select(F.when(F.col("mu").isNull(), F.col("u")).otherwise(F.col("v")).alias("id"), F.coalesce("mu", "mv").alias("add")).groupBy("id").agg(F.sum("add").alias("add"))
        mass = written(mass.join(up, "id", "left").select("id", (F.col("m") + F.coalesce("add", F.lit(0))).alias("m")), "mass")
        live = written(live.join(cut, ["u", "v"], "left_anti"), "live")
    return done.withColumn("n", F.lit(n))


def _sides_kernel(tree: DataFrame) -> DataFrame:
    def run(u, v, w) -> pd.DataFrame:
        g = Csr(u, v, np.ones(len(u)))
        seen, size, order, up = np.zeros(g.n, bool), np.ones(g.n, np.int64), [], np.full(g.n, -1)
        parent = np.full(g.n, -1)
        for root in range(g.n):
            stack = [] if seen[root] else [root]
            seen[root] = True
            while stack:
                x = stack.pop()
                order.append(x)
                for y, e, _ in g.adj[x]:
                    if not seen[y]:
                        seen[y], parent[y], up[y] = True, x, e
                        stack.append(y)
        below, child = np.zeros(g.m, np.int64), np.zeros(g.m, np.int64)
        for x in reversed(order):
            if up[x] >= 0:
                below[up[x]], child[up[x]] = size[x], g.ids[x]
                size[parent[x]] += size[x]
        return pd.DataFrame({"u": u, "v": v, "child": child, "below": below, "n": g.n})

    return one_task(tree.select("u", "v", F.lit(1).alias("w")), run, "u long, v long, child long, below long, n long")


def tree_edge_centrality(tree: DataFrame, alpha: float = 1.0, weighted: bool = False) -> DataFrame:
    """EC-11: (n1 n2)^alpha of each edge's sides, times the weight if asked."""
    s = tree_sides(tree).join(tree, ["u", "v"])
    c = F.pow((F.col("below") * (F.col("n") - F.col("below"))).cast("double"), F.lit(alpha))
    return s.select("u", "v", (c * F.col("w") if weighted else c).alias("score"))


def tree_node_centrality(tree: DataFrame) -> DataFrame:
    """EC-12: n - 1 and the pairs whose path runs through the node (unordered)."""
    # the branches at a node have, over its edges, the sizes of the far sides; pairs between different branches run through it
    s = written(tree_sides(tree), "sides")
    other = F.col("n") - F.col("below")
    at_u, at_v = (s.select(F.col(x).alias("id"), F.when(F.col("child") == F.col(x), other).otherwise(F.col("below")).alias("far"), "n") for x in "uv")
    n = F.max("n") - 1
    return at_u.unionAll(at_v).groupBy("id").agg(((n * n - F.sum(F.col("far") * F.col("far"))) / 2 + n).alias("score"))


def plot_widths(scores: DataFrame, most: float = 12.0) -> DataFrame:
    """EC-13."""
    top = scores.agg(F.max("score").alias("top"))  # one row
    return scores.crossJoin(F.broadcast(top)).select("u", "v", (F.sqrt(F.col("score") / F.col("top")) * most).alias("width"))


def centroid(edges: DataFrame) -> DataFrame:
    """EC-14: the node of largest generalised closeness, ties to the smaller id."""
    return closeness(edges, "generalized").agg(F.min(F.struct(-F.col("score"), "id")).alias("m")).select(F.col("m.id").alias("id"))


# ---- linear algebra in one task (EC-15, EC-16, CN-35 to CN-37) ----------------------------------------------------------------


def _dense(edges: DataFrame, fn: Callable[[Csr, np.ndarray], dict], schema: str) -> DataFrame:
    """fn(graph, weights) -> columns, in one task over a graph of at most `DENSE_NODES` nodes."""
    if nodes_of(edges).count() > DENSE_NODES:
        raise ValueError(f"more than {DENSE_NODES} nodes for a dense inverse")
    return one_task(edges, lambda u, v, w: pd.DataFrame(fn(Csr(u, v, w), np.array(w, float))), schema)


def _laplacian_inverse(g: Csr, w: np.ndarray) -> np.ndarray:
    lap = np.zeros((g.n, g.n))
    np.add.at(lap, (g.a, g.b), -w)
    np.add.at(lap, (g.b, g.a), -w)
    np.fill_diagonal(lap, -lap.sum(1))
    return np.linalg.pinv(lap, hermitian=True)


_EDGE = "u long, v long, score double"


def _edges_of(g: Csr, score: np.ndarray) -> dict:
    return {"u": g.ids[g.a], "v": g.ids[g.b], "score": score}


def flow_scores(g: Csr, w: np.ndarray) -> np.ndarray:
    """EC-15: mean over unordered pairs of the absolute current over each edge of a unit from s to t."""
    inv = _laplacian_inverse(g, w)
    pot = (inv[g.a] - inv[g.b]) * w[:, None]  # current over each edge for a unit into each node
    x = np.sort(pot, 1)
    return (x * (2 * np.arange(g.n) - g.n + 1)).sum(1) / max(1, g.n * (g.n - 1) / 2)  # sums of |x_s - x_t| over pairs


def flow_betweenness(edges: DataFrame) -> DataFrame:
    """EC-15: current-flow betweenness of edges."""
    return _dense(edges, lambda g, w: _edges_of(g, flow_scores(g, w)), _EDGE)


def rsp_matrices(cost: np.ndarray, reference: np.ndarray, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """W = reference exp(-theta cost) on edges, and Z = (I - W)^-1."""
    wmat = np.where(cost > 0, reference * np.exp(-theta * cost), 0.0)
    return wmat, np.linalg.inv(np.eye(len(cost)) - wmat)


def rsp_scores(z: np.ndarray, wmat: np.ndarray) -> np.ndarray:
    """EC-16: mean expected passages over each edge of randomized shortest paths between all pairs; the diagonal least."""
    n = len(z)
    bet = wmat * (z @ (1 / z - n * np.diag(1 / np.diag(z))) @ z) / (n * (n - 1)) if n > 1 else wmat * 0
    bet[np.arange(n), np.arange(n)] = bet.min() - 1
    return bet


def rsp_edge_betweenness(edges: DataFrame, theta: float = 15.0) -> DataFrame:
    def run(g: Csr, w: np.ndarray) -> dict:
        cost = np.zeros((g.n, g.n))
        cost[g.a, g.b] = cost[g.b, g.a] = w / w.mean()
        ref = (cost > 0) / np.maximum(1, (cost > 0).sum(1))[:, None]
        wmat, z = rsp_matrices(cost, ref, theta)
        b = rsp_scores(z, wmat)
        return _edges_of(g, b[g.a, g.b] + b[g.b, g.a])

    return _dense(edges, run, _EDGE)


def spanning_edge(edges: DataFrame, unweighted: bool = True) -> DataFrame:
    """CN-35: the share of spanning trees that hold the edge: its effective resistance (times its weight)."""

    def run(g: Csr, w: np.ndarray) -> dict:
        w = np.ones(g.m) if unweighted else w
        inv = _laplacian_inverse(g, w)
        return _edges_of(g, (inv[g.a, g.a] + inv[g.b, g.b] - 2 * inv[g.a, g.b]) * w)

    return _dense(edges, run, _EDGE)


def electrical_closeness(edges: DataFrame) -> DataFrame:
    """CN-36: (id, diagonal, score): (n - 1) / (n l_vv + trace) from the Laplacian's pseudo-inverse."""

    def run(g: Csr, w: np.ndarray) -> dict:
        d = np.diag(_laplacian_inverse(g, np.ones(g.m)))
        return {"id": g.ids, "diagonal": d, "score": (g.n - 1) / (g.n * d + d.sum())}

    return _dense(edges, run, "id long, diagonal double, score double")


def sampled_spanning_edge(edges: DataFrame, eps: float = 0.1, delta: float = 0.1, seed: int = 42, trees: int | None = None) -> DataFrame:
    """CN-37: shares of random spanning trees (loop-erased walks, a task's trees by their numbers) that hold each edge; as many
    trees as keep all edges within eps with probability 1 - delta."""
    graph = SharedGraph(edges)
    trees = trees or share_samples(math.log(max(1, graph.m)), eps, delta)
    load = graph.in_task()

    def run(batches):
        g = None
        for pdf in batches:
            g = g or Csr(*load())
            count = np.zeros(g.m)
            for k in pdf["id"]:
                rng = np.random.default_rng([seed, k])
                inside = np.zeros(g.n, bool)
                inside[0] = True
                step = [None] * g.n
                for x in range(1, g.n):
                    y = x
                    while not inside[y]:
                        step[y] = g.adj[y][int(rng.integers(len(g.adj[y])))]
                        y = step[y][0]
                    y = x
                    while not inside[y]:
                        inside[y] = True
                        count[step[y][1]] += 1
                        y = step[y][0]
            hit = np.flatnonzero(count)
            yield pd.DataFrame({"u": g.ids[g.a[hit]], "v": g.ids[g.b[hit]], "score": count[hit] / trees})

    got = edges.sparkSession.range(trees).repartition(8).mapInPandas(run, "u long, v long, score double").groupBy("u", "v").agg(F.sum("score").alias("score"))
    return edges.select("u", "v").join(got, ["u", "v"], "left").fillna(0.0, ["score"])


# ---- closeness (CN-13 to CN-18) ---------------------------------------------------------------------------------------------


def closeness(edges: DataFrame, variant: str = "standard", normalized: bool = True, unweighted: bool = False, sources: DataFrame | None = None) -> DataFrame:
    """CN-13: (reached - 1) / sum of distances; generalized: times (reached - 1) / (n - 1); not normalized: 1 / sum."""
    n = nodes_of(edges).count()
    if unweighted:
        d = hop_sums(edges, sources or nodes_of(edges)).select("id", F.col("far").cast("double").alias("far"), F.col("reached").alias("r"))
    else:
        d = sssp(edges, sources or nodes_of(edges)).groupBy(F.col("source").alias("id")).agg(F.sum("dist").alias("far"), F.count("*").alias("r"))
    c = F.when(F.col("far") > 0, ((F.col("r") - 1) if normalized else F.lit(1.0)) / F.col("far")).otherwise(0.0)
    if variant == "generalized":
        c = c * (F.col("r") - 1) / max(1, n - 1)
    elif variant != "standard":
        raise ValueError(f"unknown variant {variant}")
    return d.select("id", c.alias("score"))


def approx_closeness(edges: DataFrame, n_samples: int, seed: int = 42, unweighted: bool = False) -> DataFrame:
    """CN-14: distances to drawn pivots stand for those to all; with the squared error of the mean distance."""
    nodes = nodes_of(edges)
    n = nodes.count()
    pivots = nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n_samples)
    d = sssp(edges, pivots, unweighted).groupBy("id").agg(F.avg("dist").alias("m"), F.coalesce(F.var_samp("dist") / F.count("*"), F.lit(0.0)).alias("error"))
    return d.select("id", F.when(F.col("m") > 0, (n - 1) / (F.col("m") * n)).otherwise(0.0).alias("score"), "error")


def harmonic(edges: DataFrame, normalized: bool = True, unweighted: bool = False) -> DataFrame:
    """CN-16: sum of 1 / distance, over n - 1 if normalized."""
    n = nodes_of(edges).count()
    if unweighted:
        return hop_sums(edges, nodes_of(edges)).select("id", (F.col("near") / (n - 1 if normalized else 1)).alias("score"))
    return sssp(edges, nodes_of(edges)).groupBy(F.col("source").alias("id")).agg((F.sum(F.when(F.col("dist") > 0, 1 / F.col("dist")).otherwise(0.0)) / (n - 1 if normalized else 1)).alias("score"))


def top_closeness(edges: DataFrame, k: int = 1, trail: bool = False) -> DataFrame:
    """CN-17: hops."""
    return Scores(closeness(edges, unweighted=True)).top(k, trail)


def top_harmonic(edges: DataFrame, k: int = 1, trail: bool = False) -> DataFrame:
    """CN-18: hops."""
    return Scores(harmonic(edges, normalized=False, unweighted=True)).top(k, trail)


# ---- local measures -----------------------------------------------------------------------------------------------------------


def degree_centrality(edges: DataFrame, normalized: bool = False, ignore_loops: bool = True) -> DataFrame:
    """CN-15."""
    e = edges.where("u <> v") if ignore_loops else edges
    d = degrees(e).select("id", F.col("degree").cast("double").alias("score"))
    return d if not normalized else d.withColumn("score", F.col("score") / max(1, nodes_of(edges).count() - 1))


def partition_coverage(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """CN-20: the share of a node's neighbours in its own part."""
    adj = both_ways(edges).join(parts.select(F.col("id").alias("u"), F.col("part").alias("pu")), "u").join(parts.select(F.col("id").alias("v"), F.col("part").alias("pv")), "v")
    return adj.groupBy(F.col("u").alias("id")).agg(F.avg((F.col("pu") == F.col("pv")).cast("double")).alias("score"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a before b before c in the order of (degree, id): wedges start at the end of lower degree."""
    d = degrees(edges)
    e = edges.select("u", "v").join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    o = written(e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"), F.when(first, F.struct("dv", "v")).otherwise(F.struct(F.col("du").alias("dv"), F.col("u").alias("v"))).alias("at")), "oriented")
    x, y = o.select("a", "b", "at"), o.select("a", F.col("b").alias("c"), F.col("at").alias("at_c"))
    return x.join(y, "a").where("at < at_c").join(o.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"]).select("a", "b", "c")


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """CN-28: triangles over pairs of neighbours; 0 below two neighbours."""
    t = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    d = degrees(edges).join(t, "id", "left")
    return d.select("id", F.when(F.col("degree") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("score"))


def sfigality(edges: DataFrame) -> DataFrame:
    """CN-29: the share of neighbours of larger degree."""
    d = degrees(edges)
    adj = both_ways(edges).join(d.select(F.col("id").alias("u"), F.col("degree").alias("du")), "u").join(d.select(F.col("id").alias("v"), F.col("degree").alias("dv")), "v")
    return adj.groupBy(F.col("u").alias("id")).agg(F.avg((F.col("dv") > F.col("du")).cast("double")).alias("score"))


def permanence(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """CN-30: (id, permanence, intra): inner neighbours over the most in another part (at least 1) and the degree, less 1 - intra,
    intra being the clustering among inner neighbours."""
    p = parts.select("id", "part")
    adj = both_ways(edges).select("u", "v").join(p.select(F.col("id").alias("u"), F.col("part").alias("pu")), "u").join(p.select(F.col("id").alias("v"), F.col("part").alias("pv")), "v")
    by = adj.groupBy("u", "pu", "pv").agg(F.count("*").alias("n"))
    s = by.groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("degree"), F.coalesce(F.sum(F.when(F.col("pu") == F.col("pv"), F.col("n"))), F.lit(0)).alias("inner"), F.coalesce(F.max(F.when(F.col("pu") != F.col("pv"), F.col("n"))), F.lit(0)).alias("outer"))
    own = adj.where("pu = pv").select("u", "v").where("u < v")
    t = triangles(own.withColumn("w", F.lit(1))).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    s = s.join(t, "id", "left").withColumn("intra", F.when(F.col("inner") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("inner") * (F.col("inner") - 1))).otherwise(0.0))
    return s.select("id", (F.col("inner") / F.greatest("outer", F.lit(1)) / F.col("degree") - 1 + F.col("intra")).alias("permanence"), "intra")


def laplacian_centrality(edges: DataFrame, normalized: bool = False) -> DataFrame:
    """CN-31: the drop of the graph's Laplacian energy without the node: d^2 + sum w^2 over its edges + 2 sum w d of its neighbours."""
    adj = both_ways(edges)
    s = adj.groupBy("u").agg(F.sum("w").alias("s"))
    j = adj.join(s, "u").join(s.select(F.col("u").alias("v"), F.col("s").alias("sv")), "v")
    c = j.groupBy(F.col("u").alias("id")).agg((F.max("s") * F.max("s") + F.sum(2 * F.col("w") * F.col("sv") + F.col("w") * F.col("w"))).cast("double").alias("score"))
    if not normalized:
        return c
    total = s.agg(F.sum(F.col("s") * F.col("s")).alias("a")).crossJoin(adj.agg(F.sum(F.col("w") * F.col("w")).alias("b")))  # one row
    return c.crossJoin(F.broadcast(total)).select("id", (F.col("score") / (F.col("a") + F.col("b"))).alias("score"))


def core_numbers(edges: DataFrame) -> DataFrame:
    """CN-32: (id, score): in rounds, a node's number falls to the largest h such that h neighbours have h or more (H-index)."""
    adj = written(both_ways(edges).select("u", "v"), "adj")
    core = written(degrees(edges).select("id", F.col("degree").alias("core")), "core")
    while True:
        j = adj.join(core.select(F.col("id").alias("v"), F.col("core").alias("c")), "v").groupBy("u", "c").agg(F.count("*").alias("n"))
        run = F.sum("n").over(W.partitionBy("u").orderBy(F.desc("c")))
        h = j.withColumn("at", run).groupBy("u").agg(F.max(F.least("c", "at")).alias("h"))
        new = written(core.join(h.withColumnRenamed("u", "id"), "id").select("id", F.least("core", "h").alias("core"), (F.col("h") < F.col("core")).alias("moved")), "core")
        if new.where("moved").isEmpty():
            return new.select("id", F.col("core").alias("score"))
        core = new.select("id", "core")


# ---- spectral (CN-26, CN-27, CN-33, CN-34, CN-41) -------------------------------------------------------------------------------


def _iterate(nodes: DataFrame, adj: DataFrame, start, step, tolerance: float, max_rounds: int, norm) -> tuple[DataFrame, int]:
    """x -> step(sums of neighbours' x), till the norm of the change is at most the tolerance."""
    keep = Rounds(nodes.sparkSession)
    x = keep.written(nodes.withColumn("x", start), "x")
    for k in range(1, max_rounds + 1):
        s = adj.join(x.select(F.col("id").alias("v"), F.col("x").alias("xv")), "v").groupBy(F.col("u").alias("id")).agg(F.sum(F.col("xv") * F.col("w")).alias("s"))
        y = keep.written(step(x.join(s, "id", "left").fillna(0.0, ["s"])).select(*nodes.columns, "x", F.abs(F.col("x") - F.col("old")).alias("d")), "x")
        change = y.agg(norm("d").alias("d")).first().d or 0.0
        x = y.drop("d")
        if change <= tolerance:
            break
    return x, k


def _l2(c: str):
    return F.sqrt(F.sum(F.col(c) * F.col(c)))


def katz(edges: DataFrame, alpha: float = 0.0, beta: float = 0.1, tolerance: float = 1e-8, max_rounds: int = 200) -> DataFrame:
    """CN-26: x = alpha A x + beta, in 2-norm 1; alpha 0 stands for 1 / (largest degree + 1)."""
    d = degrees(edges)
    alpha = alpha or 1.0 / (d.agg(F.max("degree")).first()[0] + 1)
    adj = written(both_ways(edges).select("u", "v", F.lit(1.0).alias("w")), "adj")
    x, _ = _iterate(d.select("id"), adj, F.lit(1.0), lambda t: t.select("id", F.col("x").alias("old"), (alpha * F.col("s") + beta).alias("x")), tolerance, max_rounds, _l2)
    n = x.agg(_l2("x").alias("n"))
    return x.crossJoin(F.broadcast(n)).select("id", (F.col("x") / F.col("n")).alias("score"))  # one row


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, max_rounds: int = 200, weighted: bool = True) -> DataFrame:
    """CN-33: the leading eigenvector of A + I (the same as A's), in 2-norm 1."""
    adj = written(both_ways(edges).select("u", "v", F.col("w").cast("double").alias("w") if weighted else F.lit(1.0).alias("w")), "adj")

    def step(t: DataFrame) -> DataFrame:
        y = written(t.select("id", F.col("x").alias("old"), (F.col("s") + F.col("x")).alias("y")), "y")
        return y.crossJoin(F.broadcast(y.agg(_l2("y").alias("n")))).select("id", "old", (F.col("y") / F.col("n")).alias("x"))  # one row

    n = nodes_of(edges)
    x, _ = _iterate(n, adj, F.lit(1.0 / math.sqrt(max(1, n.count()))), step, tolerance, max_rounds, _l2)
    return x.select("id", F.col("x").alias("score"))


def pagerank(edges: DataFrame, damp: float = 0.85, tolerance: float = 1e-9, max_rounds: int = 200, weighted: bool = True, norm: str = "L2") -> DataFrame:
    """CN-34: moves in proportion to weights; every node of an undirected graph has a way on, so no mass is lost."""
    adj = both_ways(edges).select("u", "v", F.col("w").cast("double").alias("w") if weighted else F.lit(1.0).alias("w"))
    out = adj.groupBy("v").agg(F.sum("w").alias("out"))
    adj = written(adj.join(out, "v").select("u", "v", (F.col("w") / F.col("out")).alias("w")), "adj")
    nodes = written(nodes_of(edges), "nodes")
    n = nodes.count()
    x, _ = _iterate(nodes, adj, F.lit(1.0 / max(1, n)), lambda t: t.select("id", F.col("x").alias("old"), (damp * F.col("s") + (1 - damp) / n).alias("x")), tolerance, max_rounds, _l2 if norm == "L2" else F.sum)
    return x.select("id", F.col("x").alias("score"))


def dyn_katz_bounds(edges: DataFrame, k: int, alpha: float = 0.0, rounds: int = 30) -> DataFrame:
    """CN-27: (id, lower, upper): walks of up to `rounds` steps, and the most that longer ones can add."""
    d = degrees(edges)
    most = d.agg(F.max("degree")).first()[0]
    alpha = alpha or 1.0 / (most + 1)
    adj = written(both_ways(edges).select("u", "v", F.lit(1.0).alias("w")), "adj")
    x = written(d.select("id", F.lit(1.0).alias("x"), F.lit(0.0).alias("sum")), "walks")
    for _ in range(rounds):
        s = adj.join(x.select(F.col("id").alias("v"), "x"), "v").groupBy(F.col("u").alias("id")).agg((alpha * F.sum("x")).alias("s"))
        x = written(x.join(s, "id", "left").select("id", F.coalesce("s", F.lit(0.0)).alias("x"), (F.col("sum") + F.coalesce("s", F.lit(0.0))).alias("sum")), "walks")
    rest = alpha * most / (1 - alpha * most)
    top = x.agg(F.max("x").alias("most"))  # one row
    return x.crossJoin(F.broadcast(top)).select("id", F.col("sum").alias("lower"), (F.col("sum") + rest * F.col("most")).alias("upper")).orderBy(F.desc("lower"), "id").limit(k)


# ---- groups (CN-21 to CN-24), walks (CN-25) ------------------------------------------------------------------------------------------


def group_degree(edges: DataFrame, k: int, count_group: bool = True) -> tuple[list[int], int]:
    """CN-21: in turn the node that covers most nodes not covered yet (ties: smaller id)."""
    adj = written(both_ways(edges).select("u", "v").unionAll(nodes_of(edges).select("id", F.col("id").alias("x"))), "adj")
    group: list[int] = []
    for _ in range(k):
        covered = adj.where(F.col("u").isin(group)).select("v").distinct() if group else adj.limit(0).select("v")
        gain = adj.where(~F.col("u").isin(group) if group else F.lit(True)).join(covered, "v", "left_anti").groupBy("u").agg(F.count("*").alias("n"))
        best = gain.orderBy(F.desc("n"), "u").first()
        if best is None:
            break
        group.append(best.u)
    return group, group_degree_score(edges, group, count_group)


def group_degree_score(edges: DataFrame, group: list[int], count_group: bool = True) -> int:
    n = both_ways(edges).where(F.col("u").isin(group)).select("v").where(~F.col("v").isin(group)).distinct().count()
    return n + (len(group) if count_group else 0)


def group_closeness(edges: DataFrame, k: int, unweighted: bool = True) -> tuple[list[int], float]:
    """CN-24: in turn the node that lowers the sum of distances to the group most."""
    d = written(sssp(edges, nodes_of(edges), unweighted).select("source", "id", "dist"), "apsp")
    cur, group = None, []
    for _ in range(k):
        t = d if cur is None else d.join(cur, "id").select("source", "id", F.least("dist", "cur").alias("dist"))
        best = t.groupBy("source").agg(F.sum("dist").alias("far")).orderBy("far", "source").first()
        group.append(best.source)
        one = d.where(F.col("source").isin(group)).groupBy("id").agg(F.min("dist").alias("cur"))
        cur = written(one, "cur")
    return group, group_farness(d, group)


def group_farness(dist: DataFrame, group: list[int]) -> float:
    return float(dist.where(F.col("source").isin(group)).groupBy("id").agg(F.min("dist").alias("d")).agg(F.sum("d")).first()[0] or 0.0)


def group_closeness_score(edges: DataFrame, group: list[int], unweighted: bool = True) -> float:
    d = sssp(edges, edges.sparkSession.createDataFrame([(g,) for g in group], "id long"), unweighted)
    far = group_farness(d, group)
    return (nodes_of(edges).count() - len(group)) / far if far else 0.0


def group_betweenness(edges: DataFrame, k: int, eps: float = 0.05, delta: float = 0.1, seed: int = 42, samples: int | None = None) -> list[int]:
    """CN-23: drawn shortest paths, covered in turn by the node inside most that aren't yet; as many paths as keep what any k nodes
    cover within eps with probability 1 - delta."""
    from graftwork.operators.paths import random_paths
    from graftwork.sources.generators import uniform

    ids = written(nodes_of(edges).withColumn("k", (F.row_number().over(W.orderBy("id")) - 1).cast("long")), "ids")
    n = ids.count()
    samples = samples or share_samples(k * math.log(max(1, n)), eps, delta)
    draw = edges.sparkSession.range(samples).select(F.col("id").alias("sample"), F.floor(uniform(F.col("id"), seed, 1) * n).alias("i"), F.floor(uniform(F.col("id"), seed, 2) * n).alias("j"))
    named = draw.join(ids.select(F.col("k").alias("i"), F.col("id").alias("source")), "i").join(ids.select(F.col("k").alias("j"), F.col("id").alias("target")), "j")
    inner = written(random_paths(edges, named, seed).select("sample", F.explode(F.array("u", "v")).alias("id"), "source", "target").where("id <> source and id <> target").select("sample", "id").distinct(), "inner")
    group: list[int] = []
    for _ in range(k):
        left = inner.join(inner.where(F.col("id").isin(group)).select("sample").distinct(), "sample", "left_anti") if group else inner
        best = left.groupBy("id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").first()
        if best is None:
            break
        group.append(best.id)
    return group


def ged_walk(edges: DataFrame, k: int, alpha: float | None = None, steps: int = 12) -> tuple[list[int], float]:
    """CN-22: in turn the node whose joining the group adds most walks (of up to `steps`, discounted by alpha a step) that meet it."""

    def run(u, v, w) -> pd.DataFrame:
        g = Csr(u, v, w)
        a = alpha or 1.0 / (1 + max(map(len, g.adj)))

        def walks(out: np.ndarray) -> float:
            x, total, f = (~out).astype(float), 0.0, 1.0
            for _ in range(steps):
                y = np.zeros(g.n)
                np.add.at(y, g.a, x[g.b])
                np.add.at(y, g.b, x[g.a])
                x, f = np.where(out, 0.0, y), f * a
                total += f * x.sum()
            return total

        every = walks(np.zeros(g.n, bool))
        out, group = np.zeros(g.n, bool), []
        for _ in range(min(k, g.n)):
            best = min((walks(out | (np.arange(g.n) == i)), int(g.ids[i]), i) for i in range(g.n) if not out[i])
            out[best[2]] = True
            group.append(best[1])
        return pd.DataFrame({"id": group, "score": float(every - walks(out))})

    rows = one_task(edges, run, "id long, score double").collect()  # k rows
    return [r.id for r in rows], rows[0].score if rows else 0.0


def k_path(edges: DataFrame, alpha: float = 0.2, k: int = 0, seed: int = 42) -> DataFrame:
    """CN-25: shares of drawn self-avoiding walks of up to k steps that come to the node; less-walked edges are likelier."""
    load = SharedGraph(edges).in_task()
    n = nodes_of(edges).count()
    k = k or max(1, round(math.log(max(2, n + edges.count()))))
    t = max(1, int(2 * k**2 * n ** (1 - 2 * alpha) * math.log(max(2, n))))

    def run(batches):
        g = None
        for pdf in batches:
            g = g or Csr(*load())
            count = np.zeros(g.n)
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, i])
                x = int(rng.integers(g.n))
                seen = {x}
                for _ in range(int(rng.integers(1, k + 1))):
                    nxt = [(y, 1.0 / float(w)) for y, _, w in g.adj[x] if y not in seen]
                    if not nxt:
                        break
                    p = np.array([c for _, c in nxt])
                    x = nxt[int(rng.choice(len(nxt), p=p / p.sum()))][0]
                    seen.add(x)
                    count[x] += 1
            yield pd.DataFrame({"id": g.ids, "score": count * n * k / t})

    return edges.sparkSession.range(t).repartition(8).mapInPandas(run, "id long, score double").groupBy("id").agg((F.sum("score") / k).alias("score"))


def kadabra(edges: DataFrame, k: int, error: float = 0.05, delta: float = 0.1, batch: int = 500, seed: int = 42) -> tuple[DataFrame, int]:
    """CN-09: batches of drawn paths till the scores' error bounds are within `error`, or the fixed sample size is reached."""
    n = nodes_of(edges).count()
    omega = sample_size(n, error, delta)
    total, at = None, 0
    while at < omega:
        take = min(batch, omega - at)
        s = sampled_betweenness(edges, seed=seed + at, samples=take).select("id", (F.col("score") * take).alias("hits"))
        total = written(s if total is None else total.unionAll(s).groupBy("id").agg(F.sum("hits").alias("hits")), "hits")
        at += take
        top = total.agg(F.max("hits")).first()[0] / at
        if math.sqrt(2 * top * (1 - top) * math.log(4 * n / delta) / at) + 3 * math.log(4 * n / delta) / at <= error:
            break
    return Scores(total.select("id", (F.col("hits") / at).alias("score"))).top(k), at
