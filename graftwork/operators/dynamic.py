"""Path-based measures that follow changes of edges.

A change sets an edge's weight, brings it in, or takes it away. From most sources no shortest path runs over it before or after, and
what those add to a score stays: only affected sources are run anew, on the graph before and after. A source s is affected by
an edge (u, v) if d(s, u) + w <= d(s, v) or the reverse, d before the change and w the lesser of the weights before and after. The
first changed edge on a new path meets this with old distances, and so does each changed edge on an old path, so that batches of
changes need no more than the union of their edges' affected sources. Distances to an edge's ends are those from them, as graphs
are undirected: no all-pairs table is kept for the test.

Graphs are of checked size (`model.KERNEL_EDGES`), as in `centrality`; integer weights make ties exact.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.model import nodes_of
from graftwork.operators.centrality import sample_size
from graftwork.operators.kernels import Csr
from graftwork.operators.paths import SharedGraph, hop_sums, sssp, sum_over_sources
from graftwork.session import written
from graftwork.sources.generators import uniform

#: A change: (u, v, weight), None for an edge that goes.
Change = tuple[int, int, float | None]


def changed_edges(edges: DataFrame, changes: Iterable[Change]) -> DataFrame:
    """(u, v, old, new): each changed edge once, the last change counts; null where it isn't there."""
    last = {(min(u, v), max(u, v)): w for u, v, w in changes if u != v}
    kind = edges.schema["w"].dataType
    rows = edges.sparkSession.createDataFrame([(a, b, None if w is None else float(w)) for (a, b), w in last.items()], "u long, v long, new double")
    return written(rows.join(edges.select("u", "v", F.col("w").alias("old")), ["u", "v"], "left").select("u", "v", "old", F.col("new").cast(kind).alias("new")), "changes")


def after_changes(edges: DataFrame, changed: DataFrame) -> DataFrame:
    kept = edges.select("u", "v", "w").join(changed, ["u", "v"], "left_anti")
    return written(kept.unionByName(changed.where("new is not null").select("u", "v", F.col("new").alias("w"))), "edges")


def affected(edges: DataFrame, changed: DataFrame, unweighted: bool = False) -> DataFrame:
    """(id) of the sources whose shortest paths the changes may touch; nodes that come in or lose all their edges among them."""
    ends = changed.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    d = written(sssp(edges, ends, unweighted).select("source", "id", "dist"), "ends")
    w = F.lit(1.0) if unweighted else F.least(F.coalesce("old", "new"), F.coalesce("new", "old"))
    c = changed.where("old is not null or new is not null").select("u", "v", w.alias("w"))
    du = d.select(F.col("source").alias("u"), F.col("id").alias("iu"), F.col("dist").alias("du"))
    dv = d.select(F.col("source").alias("v"), F.col("id").alias("iv"), F.col("dist").alias("dv"))
    # ends that aren't in the graph yet, or from which a node can't be reached, are infinitely far
    far = F.lit(float("inf"))
    at_u, at_v = c.join(du, "u"), c.join(dv, "v")
    near = at_u.join(dv.withColumnRenamed("v", "o"), F.expr("v = o and iu = iv"), "left").select(F.col("iu").alias("id"), "w", "du", F.coalesce("dv", far).alias("dv"))
    back = at_v.join(du.withColumnRenamed("u", "o"), F.expr("u = o and iu = iv"), "left").select(F.col("iv").alias("id"), "w", F.coalesce("du", far).alias("du"), "dv")
    return near.unionByName(back).where("(du < dv and du + w <= dv) or (dv < du and dv + w <= du)").select("id").union(ends).distinct()


def betweenness_delta(edges: DataFrame, new_edges: DataFrame, scores: DataFrame, sources: DataFrame, unweighted: bool = False) -> DataFrame:
    """EC-10: (kind, u, v, score) after the change: less what the affected sources gave before, and what they give now. Sums within a
    billionth of 0 are 0; the score of an edge that went goes with it."""
    key = ["kind", "u", "v"]
    both = None
    for graph, sign in ((edges, -1.0), (new_edges, 1.0)):
        part = sum_over_sources(graph, sources, lambda g, s: g.brandes(s, unweighted)).withColumn("score", F.col("score") * sign)
        both = part if both is None else both.unionByName(part)
    total = scores.select(*key, "score").unionByName(both).groupBy(*key).agg(F.sum("score").alias("score"))
    return total.where("abs(score) > 1e-9")


class DynBetweenness:
    """CN-10, EC-10: exact betweenness of nodes and edges under changes; `ran` counts the sources that the last update ran anew."""

    def __init__(self, edges: DataFrame, unweighted: bool = False) -> None:
        self.unweighted, self.edges = unweighted, written(edges.select("u", "v", "w"), "edges")
        self.parts = written(sum_over_sources(self.edges, nodes_of(self.edges), lambda g, s: g.brandes(s, unweighted)), "parts")
        self.ran = nodes_of(self.edges).count()

    def update(self, u: int, v: int, w: float | None) -> None:
        self.update_batch([(u, v, w)])

    def update_batch(self, changes: Iterable[Change]) -> None:
        changed = changed_edges(self.edges, changes)
        hit = written(affected(self.edges, changed, self.unweighted), "affected")
        new = after_changes(self.edges, changed)
        self.parts = written(betweenness_delta(self.edges, new, self.parts, hit, self.unweighted), "parts")
        self.edges, self.ran = new, hit.count()

    def nodes(self) -> DataFrame:
        """(id, score) over unordered pairs."""
        s = self.parts.where("kind = 1").select(F.col("u").alias("id"), "score")
        return nodes_of(self.edges).join(s, "id", "left").select("id", (F.coalesce("score", F.lit(0.0)) / 2).alias("score"))

    def edge_scores(self) -> DataFrame:
        """(u, v, score) over ordered pairs."""
        s = self.parts.where("kind = 0").select("u", "v", "score")
        return self.edges.select("u", "v").join(s, ["u", "v"], "left").fillna(0.0, ["score"])


class DynPaths:
    """Distances and numbers of shortest paths between all nodes, of which a change runs only the affected sources anew (SP-08)."""

    def __init__(self, edges: DataFrame, unweighted: bool = False) -> None:
        self.unweighted, self.edges = unweighted, written(edges.select("u", "v", "w"), "edges")
        self.paths = written(sssp(self.edges, nodes_of(self.edges), unweighted), "paths")
        self.ran = nodes_of(self.edges).count()

    def update_batch(self, changes: Iterable[Change]) -> None:
        changed = changed_edges(self.edges, changes)
        hit = written(affected(self.edges, changed, self.unweighted), "affected")
        self.edges = after_changes(self.edges, changed)
        stay = self.paths.join(hit.select(F.col("id").alias("source")), "source", "left_anti")
        self.paths = written(stay.select(*self.paths.columns).unionByName(sssp(self.edges, hit, self.unweighted)), "paths")
        self.ran = hit.count()

    def update(self, u: int, v: int, w: float | None) -> None:
        self.update_batch([(u, v, w)])


class DynBetweennessOneNode(DynPaths):
    """CN-12: one node's betweenness, from the kept distances and path counts by joins alone."""

    def __init__(self, edges: DataFrame, x: int, unweighted: bool = False) -> None:
        super().__init__(edges, unweighted)
        self.x = x

    def through(self) -> DataFrame:
        """(source, id, dist, sigma, sigma_x): ordered pairs of other nodes, with the shortest paths that run through x."""
        p = self.paths.select("source", "id", "dist", "sigma").where(f"source <> {self.x} and id <> {self.x} and source <> id")
        from_x = self.paths.where(f"source = {self.x} and id <> {self.x}")
        a = from_x.select(F.col("id").alias("source"), F.col("dist").alias("da"), F.col("sigma").alias("sa"))
        b = from_x.select("id", F.col("dist").alias("db"), F.col("sigma").alias("sb"))
        inside = F.col("da") + F.col("db") == F.col("dist")
        return p.join(a, "source").join(b, "id").select("source", "id", "dist", "sigma", F.when(inside, F.col("sa") * F.col("sb")).otherwise(0.0).alias("sigma_x"))

    def score(self) -> DataFrame:
        """(id, score) of x over unordered pairs: one row."""
        s = F.coalesce(F.sum(F.col("sigma_x") / F.col("sigma")), F.lit(0.0)) / 2
        return self.through().agg(s.alias("score")).select(F.lit(self.x).cast("long").alias("id"), "score")


class DynTopHarmonicCloseness(DynPaths):
    """CN-19: the k nodes of largest harmonic closeness; only affected sources' distances are run anew. By hops, a sum is kept for each
    source instead of its distances."""

    def __init__(self, edges: DataFrame, k: int = 1, unweighted: bool = True) -> None:
        self.k = k
        if not unweighted:
            super().__init__(edges, unweighted)
            return
        self.unweighted, self.edges = unweighted, written(edges.select("u", "v", "w"), "edges")
        self.near = written(hop_sums(self.edges, nodes_of(self.edges)).select("id", "near"), "near")
        self.ran = self.near.count()

    def update_batch(self, changes: Iterable[Change]) -> None:
        if not self.unweighted:
            super().update_batch(changes)
            return
        changed = changed_edges(self.edges, changes)
        hit = written(affected(self.edges, changed, True), "affected")
        self.edges = after_changes(self.edges, changed)
        self.near = written(self.near.join(hit, "id", "left_anti").unionByName(hop_sums(self.edges, hit).select("id", "near")), "near")
        self.ran = hit.count()

    def top(self) -> DataFrame:
        """(id, score), best first, ties to the smaller id."""
        if self.unweighted:
            return self.near.where("near > 0").select("id", F.round("near", 9).alias("score")).orderBy(F.desc("score"), "id").limit(self.k)
        far = self.paths.where("dist > 0").groupBy(F.col("source").alias("id")).agg(F.round(F.sum(1.0 / F.col("dist")), 9).alias("score"))
        return far.orderBy(F.desc("score"), "id").limit(self.k)


class DynApproxBetweenness:
    """CN-11, EC-09: shares of drawn shortest paths, under changes. Samples keep their ends; a sample's path is drawn anew only if its
    ends' distance or number of shortest paths changed, or an edge on it did. `redrawn` counts those of the last update."""

    def __init__(self, edges: DataFrame, eps: float = 0.1, delta: float = 0.1, seed: int = 42, samples: int | None = None, unweighted: bool = False) -> None:
        self.edges, self.seed, self.unweighted, self.version = written(edges.select("u", "v", "w"), "edges"), seed, unweighted, 0
        spark = edges.sparkSession
        number = (F.row_number().over(W.orderBy("id")) - 1).cast("long")  # nodes of a graph of checked size
        numbered = written(nodes_of(self.edges).select("id", number.alias("k")), "ids")
        n = numbered.count()
        self.r = samples or sample_size(n, eps, delta)
        draw = spark.range(self.r).select(F.col("id").alias("sample"), F.floor(uniform(F.col("id"), seed, 1) * n).alias("i"), F.floor(uniform(F.col("id"), seed, 2) * n).alias("j"))
        pairs = draw.join(numbered.select(F.col("k").alias("i"), F.col("id").alias("source")), "i").join(numbered.select(F.col("k").alias("j"), F.col("id").alias("target")), "j")
        pairs = written(pairs.where("source <> target").select("sample", "source", "target"), "pairs")
        self.samples = written(self._draw(pairs.withColumn("dist", F.lit(None).cast("double")).withColumn("sigma", F.lit(None).cast("double"))).drop("fresh"), "samples")
        self.redrawn = pairs.count()

    def _draw(self, known: DataFrame) -> DataFrame:
        """(sample, source, target, dist, sigma, path, fresh): paths drawn where distance or number differ from what is known."""
        load, seed, version, unweighted = SharedGraph(self.edges).in_task(), self.seed, self.version, self.unweighted

        def run(batches):
            g, at = None, (None, None, None, None)
            for pdf in batches:
                g = g or Csr(*load())
                rows = []
                for k, s, t, d0, c0 in pdf[["sample", "source", "target", "dist", "sigma"]].itertuples(index=False):
                    i, j = (int(x) for x in np.searchsorted(g.ids, (s, t)))
                    there = i < g.n and j < g.n and g.ids[i] == s and g.ids[j] == t
                    if there and at[0] != i:
                        dist = g.dijkstra(i, unweighted=unweighted)
                        dag = g.dag(dist, unweighted)
                        at = (i, dist, dag, g.counts(*dag, i))
                    d, c = (float(at[1][j]), float(at[3][j])) if there and np.isfinite(at[1][j]) else (None, None)
                    same = d is not None and d0 is not None and d == d0 and c == c0
                    path = []
                    if d is not None and not same:
                        steps = g.random_path(at[2], at[3], i, j, np.random.default_rng([seed, version, int(k)]))
                        path = [{"u": int(min(g.ids[g.a[e]], g.ids[g.b[e]])), "v": int(max(g.ids[g.a[e]], g.ids[g.b[e]]))} for _, e in steps]
                    rows.append((k, s, t, d, c, path, not same))
                yield pd.DataFrame(rows, columns=["sample", "source", "target", "dist", "sigma", "path", "fresh"])

        schema = "sample long, source long, target long, dist double, sigma double, path array<struct<u:long,v:long>>, fresh boolean"
        return known.repartition("source").sortWithinPartitions("source", "sample").mapInPandas(run, schema)

    def update_batch(self, changes: Iterable[Change]) -> None:
        changed = changed_edges(self.edges, changes)
        hit = written(affected(self.edges, changed, self.unweighted), "affected").select(F.col("id").alias("source"))
        self.edges, self.version = after_changes(self.edges, changed), self.version + 1
        touched = self.samples.select("sample", F.explode("path").alias("e")).select("sample", "e.u", "e.v").join(changed, ["u", "v"], "left_semi").select("sample").distinct()
        mine = self.samples.join(hit, "source", "left_semi").join(touched.withColumn("over", F.lit(True)), "sample", "left")
        known = mine.select("sample", "source", "target", F.when(F.col("over").isNull(), F.col("dist")).alias("dist"), F.when(F.col("over").isNull(), F.col("sigma")).alias("sigma"))
        drawn = written(self._draw(known), "drawn")
        fresh = drawn.where("fresh")
        self.samples = written(self.samples.join(fresh.select("sample"), "sample", "left_anti").select(*self.samples.columns).unionByName(fresh.drop("fresh")), "samples")
        self.redrawn = fresh.count()

    def update(self, u: int, v: int, w: float | None) -> None:
        self.update_batch([(u, v, w)])

    def edge_scores(self) -> DataFrame:
        """(u, v, score): shares of samples whose path runs over the edge."""
        hits = self.samples.select(F.explode("path").alias("e")).groupBy("e.u", "e.v").agg((F.count("*") / float(self.r)).alias("score"))
        return self.edges.select("u", "v").join(hits, ["u", "v"], "left").fillna(0.0, ["score"])

    def nodes(self) -> DataFrame:
        """(id, score): shares of samples whose path runs through the node."""
        inner = self.samples.select("sample", "source", "target", F.explode("path").alias("e")).select("sample", "source", "target", F.explode(F.array("e.u", "e.v")).alias("id"))
        hits = inner.where("id <> source and id <> target").distinct().groupBy("id").agg((F.count("*") / float(self.r)).alias("score"))
        return nodes_of(self.edges).join(hits, "id", "left").fillna(0.0, ["score"])
