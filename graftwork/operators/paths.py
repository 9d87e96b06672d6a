"""Shortest paths (SP-01 to SP-10): DataFrame relaxation for graphs of any size, kernels over a bounded graph for many sources."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.model import KERNEL_EDGES, both_ways
from graftwork.operators.kernels import Csr, Hops
from graftwork.session import Rounds, read_in_task, write_table, written


def sssp_relax(edges: DataFrame, sources: DataFrame, unweighted: bool = False, max_rounds: int = 10_000) -> DataFrame:
    """(source, id, dist): every round relaxes the edges of the nodes whose distance fell, all sources at once; no size bound."""
    adj = written(both_ways(edges).select("u", "v", F.lit(1).alias("w") if unweighted else "w"), "adj")
    kind = adj.schema["w"].dataType
    keep = Rounds(edges.sparkSession)
    dist = keep.written(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast(kind).alias("dist")), "dist")
    front = keep.written(dist, "front")
    for _ in range(max_rounds):
        step = front.join(adj, front["id"] == adj["u"]).groupBy("source", F.col("v").alias("id")).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        front = keep.written(step.join(dist, ["source", "id"], "left").where("dist is null or new < dist").select("source", "id", F.col("new").alias("dist")), "front")
        if front.isEmpty():
            return dist
        dist = keep.written(dist.unionAll(front).groupBy("source", "id").agg(F.min("dist").alias("dist")), "dist")
    raise RuntimeError("distances did not settle")


def predecessors(edges: DataFrame, dist: DataFrame) -> DataFrame:
    """(source, pred, id): the shortest-path graph, by exact equality of lengths."""
    adj = both_ways(edges)
    a = dist.select("source", F.col("id").alias("u"), F.col("dist").alias("du"))
    return a.join(adj, "u").join(dist.select("source", F.col("id").alias("v"), F.col("dist").alias("dv")), ["source", "v"]).where("du + w = dv").select("source", F.col("u").alias("pred"), F.col("v").alias("id"))


class SharedGraph:
    """A graph of at most `KERNEL_EDGES` edges as a written table that tasks read for themselves; the driver never holds it."""

    def __init__(self, edges: DataFrame) -> None:
        self.spark, self.path = edges.sparkSession, write_table(edges.select("u", "v", "w"), "graph")
        self.m = self.spark.read.parquet(self.path).count()
        if self.m > KERNEL_EDGES:
            raise ValueError(f"more than {KERNEL_EDGES} edges: use the DataFrame relaxation")

    def in_task(self) -> Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """What a task calls to get the arrays u, v, w, sorted by (u, v)."""
        path = self.path

        def load() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            t = read_in_task(path).sort_by([("u", "ascending"), ("v", "ascending")])
            return tuple(t.column(c).to_numpy() for c in ("u", "v", "w"))

        return load


def one_task(edges: DataFrame, fn: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """The rows of fn(u, v, w), run in one task over a graph of checked size."""
    graph = SharedGraph(edges)
    load = graph.in_task()

    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield fn(*load())

    return graph.spark.range(1).mapInPandas(run, schema)


def _sources_in_tasks(graph: SharedGraph, sources: DataFrame) -> DataFrame:
    return sources.select("id").distinct().repartition(max(1, graph.spark.sparkContext.defaultParallelism), "id")


def _numbers(g: Csr, ids: list[int]) -> list[int]:
    """The numbers of the sources that the graph has."""
    at = np.searchsorted(g.ids, ids)
    return [int(k) for k, s in zip(at, ids, strict=True) if k < g.n and g.ids[k] == s]


def per_source(edges: DataFrame, sources: DataFrame, fn: Callable[[Csr, int], pd.DataFrame], schema: str) -> DataFrame:
    """fn(graph, source number) for each source, in tasks that each read the graph of checked size once."""
    graph = SharedGraph(edges)
    load = graph.in_task()

    def run(batches):
        g = None
        for pdf in batches:
            if g is None and len(pdf):
                g = Csr(*load())
            for k in _numbers(g, pdf["id"].tolist()) if g else ():
                yield fn(g, k)

    return _sources_in_tasks(graph, sources).mapInPandas(run, schema)


def sum_over_sources(edges: DataFrame, sources: DataFrame, fn: Callable[[Csr, int], tuple[np.ndarray | None, np.ndarray | None]]) -> DataFrame:
    """(kind, u, v, score): the (edge, node) arrays that fn(graph, source number) gives, summed within each task over all its sources and
    then over tasks. kind 0: an edge; kind 1: u = v = a node."""
    graph = SharedGraph(edges)
    load = graph.in_task()

    def run(batches):
        g = total = None
        for pdf in batches:
            if g is None and len(pdf):
                g = Csr(*load())
                total = [np.zeros(g.m), np.zeros(g.n)]
            for k in _numbers(g, pdf["id"].tolist()) if g else ():
                for t, x in zip(total, fn(g, k), strict=True):
                    if x is not None:
                        t += x
        if g:
            e, n = (np.flatnonzero(t) for t in total)
            yield pd.DataFrame({"kind": np.r_[np.zeros(len(e), int), np.ones(len(n), int)], "u": np.r_[g.ids[g.a[e]], g.ids[n]], "v": np.r_[g.ids[g.b[e]], g.ids[n]], "score": np.r_[total[0][e], total[1][n]]})

    return _sources_in_tasks(graph, sources).mapInPandas(run, "kind int, u long, v long, score double").groupBy("kind", "u", "v").agg(F.sum("score").alias("score"))


def sssp(edges: DataFrame, sources: DataFrame, unweighted: bool = False) -> DataFrame:
    """(source, id, dist, sigma) of reached nodes: distances and numbers of shortest paths (SP-01, SP-02)."""

    def fn(g: Csr, s: int) -> pd.DataFrame:
        d = g.dijkstra(s, unweighted=unweighted)
        dag = g.dag(d, unweighted)
        ok = np.isfinite(d)
        return pd.DataFrame({"source": g.ids[s], "id": g.ids[ok], "dist": d[ok], "sigma": g.counts(*dag, s)[ok]})

    return per_source(edges, sources, fn, "source long, id long, dist double, sigma double")


def hop_sums(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, reached, far, near): for each source the nodes it reaches (itself too), the sums of their hops and of 1 / hops; no pair of
    nodes is kept."""
    graph = SharedGraph(edges)
    load = graph.in_task()

    def run(batches):
        g = None
        for pdf in batches:
            if g is None and len(pdf):
                g = Hops(*load()[:2])
            at = np.array(_numbers(g, pdf["id"].tolist()) if g else [], int)
            for k in range(0, len(at), 512):
                reached, far, near = g.sums(at[k : k + 512])
                yield pd.DataFrame({"id": g.ids[at[k : k + 512]], "reached": reached, "far": far, "near": near})

    return _sources_in_tasks(graph, sources).mapInPandas(run, "id long, reached long, far long, near double")


def distance_between(edges: DataFrame, source: int, target: int) -> float:
    """SP-03: stops at the target."""

    def run(u, v, w) -> pd.DataFrame:
        g = Csr(u, v, w)
        s, t = (int(np.searchsorted(g.ids, x)) for x in (source, target))
        return pd.DataFrame({"dist": [float(g.dijkstra(s, t)[t])]})

    return one_task(edges, run, "dist double").first().dist


def apsp(edges: DataFrame, unweighted: bool = False) -> DataFrame:
    """SP-04."""
    return sssp(edges, both_ways(edges).select(F.col("u").alias("id")), unweighted).select("source", "id", "dist")


def apsp_decrease(dist: DataFrame, u: int, v: int, w: float) -> DataFrame:
    """SP-05: distances after an edge's weight fell to w (or it came in): one join with the rows of its ends."""
    ru, rv = (dist.where(F.col("source") == x).select(F.col("id").alias("k"), F.col("dist").alias(f"d{c}")) for x, c in ((u, "u"), (v, "v")))
    ends = ru.join(rv, "k")
    s = ends.select(F.col("k").alias("source"), F.col("du").alias("su"), F.col("dv").alias("sv"))
    t = ends.select(F.col("k").alias("id"), F.col("du").alias("tu"), F.col("dv").alias("tv"))
    return dist.join(s, "source", "left").join(t, "id", "left").select("source", "id", F.least("dist", F.col("su") + w + F.col("tv"), F.col("sv") + w + F.col("tu")).alias("dist"))


def affected_sources(dist: DataFrame, u: int, v: int, w: float) -> DataFrame:
    """SP-07: sources from which the edge (u, v) of weight w is on a shortest path to v, or makes one shorter."""
    du, dv = (dist.where(F.col("id") == x).select("source", F.col("dist").alias(c)) for x, c in ((u, "du"), (v, "dv")))
    return du.join(dv, "source").where(F.col("du") + w <= F.col("dv")).select(F.col("source").alias("id"))


def apsp_decrease_counted(edges: DataFrame, paths: DataFrame, u: int, v: int, w: float) -> DataFrame:
    """SP-06, SP-08: (source, id, dist, sigma) after the edge's weight became w: only affected sources are run anew. Should w be above
    the weight so far, those are the sources with shortest paths over the edge as it was."""
    from graftwork.model import canonical

    a, b = min(u, v), max(u, v)
    kind = edges.schema["w"].dataType
    one = edges.sparkSession.range(1).select(F.lit(a).cast("long").alias("u"), F.lit(b).cast("long").alias("v"), F.lit(w).cast(kind).alias("w"))
    here = ((F.col("u") == a) & (F.col("v") == b)) | ((F.col("u") == b) & (F.col("v") == a))
    old = edges.where(here).agg(F.min("w")).first()[0]
    new = written(canonical(edges.select("u", "v", "w").where(~here).unionAll(one)), "edges")
    d, low = paths.select("source", "id", "dist"), w if old is None else min(w, old)
    hit = written(affected_sources(d, u, v, low).union(affected_sources(d, v, u, low)).distinct(), "affected")
    return paths.join(hit.select(F.col("id").alias("source")), "source", "left_anti").select("source", "id", "dist", "sigma").unionByName(sssp(new, hit))


def tree_append(dist: DataFrame, at: int, new: int, w: float) -> DataFrame:
    """SP-09: tree distances with a leaf `new` hung on `at` at weight w."""
    row = dist.where(F.col("source") == at).select(F.lit(new).cast("long").alias("source"), "id", (F.col("dist") + w).alias("dist"))
    return dist.select("source", "id", "dist").unionAll(row).unionAll(row.select(F.col("id").alias("source"), F.col("source").alias("id"), "dist")).unionAll(row.limit(1).select("source", F.col("source").alias("id"), F.lit(0.0).alias("dist")))


def random_paths(edges: DataFrame, pairs: DataFrame, seed: int = 42) -> DataFrame:
    """SP-10: (sample, source, target, step, u, v): a shortest path for each (sample, source, target), drawn among all alike."""
    load = SharedGraph(edges).in_task()

    def run(batches):
        g, memo = None, {}
        for pdf in batches:
            g = g or Csr(*load())
            out = []
            for k, s, t in pdf.itertuples(index=False):
                i, j = np.searchsorted(g.ids, (s, t))
                if i not in memo:
                    memo.clear()
                    d = g.dijkstra(int(i))
                    dag = g.dag(d)
                    memo[i] = (d, dag, g.counts(*dag, int(i)))
                d, dag, sigma = memo[i]
                if s == t or not np.isfinite(d[j]):
                    continue
                steps = g.random_path(dag, sigma, int(i), int(j), np.random.default_rng([seed, k % (1 << 62)]))
                out += [(k, s, t, n, *sorted((int(g.ids[g.a[e]]), int(g.ids[g.b[e]])))) for n, (_, e) in enumerate(steps)]
            yield pd.DataFrame(out, columns=["sample", "source", "target", "step", "u", "v"])

    return pairs.select("sample", "source", "target").repartition("source").sortWithinPartitions("source", "sample").mapInPandas(run, "sample long, source long, target long, step int, u long, v long")
