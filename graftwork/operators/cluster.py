"""Clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.operators import distance as D
from graftwork.operators.distance import euclid
from graftwork.session import written


def representative_count(n: int, eps: float = 0.03, delta: float = 0.1) -> int:
    """CL-01."""
    r = 1 / eps**2 * (int(math.log2(max(2, n - 1))) + 1 + math.log(1 / delta))
    return min(int(math.sqrt(r)), n)


def nearest_point(targets: DataFrame, points: DataFrame) -> DataFrame:
    """(label, center_id): the point nearest to each target (label, pos)."""
    near = D.nearest(targets.select(F.col("label").cast("long").alias("id"), "pos"), points.select("id", "pos"))
    return near.select(F.col("u").alias("label"), F.col("v").alias("center_id"))


def cluster_means(points: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, pos) of means."""
    long = points.select("id", F.posexplode("pos").alias("k", "x")).join(labels.select("id", "label"), "id").groupBy("label", "k").agg(F.avg("x").alias("m"))
    return long.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("a")).select("label", F.transform("a", lambda x: x["m"]).alias("pos"))


def k_means(points: DataFrame, k: int, seed: int = 42, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """CL-02: (label, center_id) and (id, label) by k-means, each centre being the point nearest to its centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = points.select("id", "pos", array_to_vector("pos").alias("features"))
    m = KMeans(k=k, seed=seed, maxIter=rounds, initMode="k-means||").fit(v)
    labels = m.transform(v).select("id", F.col("prediction").alias("label"))
    c = points.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m.clusterCenters())], "label long, pos array<double>")  # k rows
    return nearest_point(c, points), labels


def graph_centers(dist: DataFrame, k: int, seed: int = 42, rounds: int = 10) -> tuple[DataFrame, DataFrame]:
    """CL-03: k-means by path lengths (source, id, dist): first centres far from each other, then in each cluster the node of least
    largest distance, till nothing moves."""
    d = written(dist.select("source", "id", "dist"), "dist")
    nodes = d.select(F.col("source").alias("id")).distinct()
    chosen = [nodes.orderBy(F.xxhash64(F.lit(seed), "id"), "id").first().id]
    for i in range(1, k):
        far = d.where(F.col("source").isin(chosen)).groupBy("id").agg(F.min("dist").alias("m")).where("m > 0")
        # the largest of m times a hashed exponential clock: a draw in proportion to m
        clock = -F.log((F.pmod(F.xxhash64(F.lit(seed + i), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)) / F.col("m")
        nxt = far.orderBy(clock, "id").first()
        if nxt is None:
            break
        chosen.append(nxt.id)
    labels = None
    for _ in range(rounds):
        labels = written(d.where(F.col("source").isin(chosen)).groupBy("id").agg(F.min(F.struct("dist", "source")).alias("m")).select("id", F.col("m.source").alias("center")), "labels")
        own = d.join(labels.select(F.col("id").alias("source"), F.col("center").alias("cs")), "source").join(labels, "id").where("cs = center")
        new = own.groupBy("center", "source").agg(F.max("dist").alias("r")).groupBy("center").agg(F.min(F.struct("r", "source")).alias("m")).select("center", F.col("m.source").alias("id")).collect()  # k rows
        moved = sorted(r.id for r in new)
        if moved == sorted(chosen):
            break
        chosen = moved
    names = {c: i for i, c in enumerate(sorted(chosen))}
    spark = dist.sparkSession
    c = spark.createDataFrame([(i, n) for n, i in names.items()], "label long, center_id long")
    return c, labels.join(c.withColumnRenamed("center_id", "center"), "center").select("id", "label")


def farthest_members(points: DataFrame, labels: DataFrame) -> DataFrame:
    """CL-04: (label, center_id): in each cluster the node of largest summed distance to all centroids."""
    means = cluster_means(points, labels).select(F.col("label").cast("long").alias("id"), "pos")
    total = D.block_join(points.select("id", "pos"), means, lambda u, x, v, y: (u, D.distances(x, y).sum(1)), "id long, s double", _SUMS).groupBy("id").agg(F.sum("s").alias("s"))
    return total.join(labels, "id").groupBy("label").agg(F.min(F.struct(-F.round("s", 9), "id")).alias("m")).select("label", F.col("m.id").alias("center_id"))


import pyarrow as pa  # noqa: E402

_SUMS = pa.schema([("id", pa.int64()), ("s", pa.float64())])


def filter_clusters(labels: DataFrame, least: int = 5) -> DataFrame:
    """CL-05: (old_id, id, label): nodes of clusters with at least `least`, labels and ids numbered anew without gaps."""
    size = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    new = size.withColumn("new_label", (F.row_number().over(W.orderBy("label")) - 1).cast("long"))  # one row a label
    kept = written(labels.join(new.select("label", "new_label"), "label").select("id", "new_label"), "kept")
    part = written(kept.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "parts")
    base = part.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return part.join(base, "part").select(F.col("id").alias("old_id"), (F.col("base") + F.row_number().over(W.partitionBy("part").orderBy("id")) - 1).alias("id"), F.col("new_label").alias("label"))


def assign_small_clusters(points: DataFrame, labels: DataFrame, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """CL-06: in the order of labels, the nodes of clusters that have `least` or fewer when their turn comes go to the cluster of
    their nearest node outside; then labels without gaps, and the point nearest to each mean. (label, center_id), (id, label)."""
    cur = written(labels.select("id", F.col("label").cast("long").alias("label")), "labels")
    for r in cur.select("label").distinct().orderBy("label").collect():  # one row a label
        members = cur.where(F.col("label") == r.label)
        if members.count() > least:
            continue
        p = points.select("id", "pos")
        near = D.nearest(p.join(members, "id").select("id", "pos"), p.join(cur.where(F.col("label") != r.label), "id").select("id", "pos"))
        to = near.select(F.col("u").alias("id"), "v").join(cur.select(F.col("id").alias("v"), F.col("label").alias("to")), "v").select("id", "to")
        cur = written(cur.join(to, "id", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
    new = cur.select("label").distinct().withColumn("k", (F.row_number().over(W.orderBy("label")) - 1).cast("long"))
    out = written(cur.join(new, "label").select("id", F.col("k").alias("label")), "labels")
    return nearest_point(cluster_means(points, out), points), out


def members_of(labels: DataFrame) -> DataFrame:
    """CL-08: (label, ids); an array of a label's ids is one row, so this is for small clusters."""
    return labels.groupBy("label").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def label_distances(points: DataFrame, labels: DataFrame) -> DataFrame:
    """CL-09: (a, b, d): the least distance between the points of two labels; of one label 0."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float64())])

    def fn(u, x, v, y, le, ri):
        d = D.distances(x, y)
        la, lb = np.unique(le[0]), np.unique(ri[0])
        rows = [(a, b, d[np.ix_(le[0] == a, ri[0] == b)].min()) for a in la for b in lb]
        return [list(c) for c in zip(*rows, strict=True)]

    p = points.select("id", "pos").join(labels.select("id", F.col("label").cast("long").alias("label")), "id")
    return D.block_join(p, p, fn, "a long, b long, d double", arrow, extra=("label",)).groupBy("a", "b").agg(F.min("d").alias("d"))


def tree_segments(tree: DataFrame, points: DataFrame, length: int = 15, branches: int = 0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """CL-07: the tree's backbone cut into segments of about `length` nodes; ends of segments seed clusters, other nodes join the
    cluster of their nearest end. (label, center_id), (id, label)."""
    from graftwork.operators.patch import backbone

    if length < 4:
        raise ValueError("segments need four nodes or more")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        ends, label = [], 0
        for _, path in pdf.sort_values(["path", "place"]).groupby("path"):
            nodes = path["id"].tolist()
            k = max(1, len(nodes) // length)
            sizes = [length] * k
            for i in rng.permutation(np.arange(len(nodes) - k * length) % k if len(nodes) > k * length else np.zeros(0, int)):
                sizes[int(i)] += 1
            at = 0
            for s in sizes:
                seg = nodes[at : at + s]
                if seg:
                    ends += [(seg[0], label), (seg[-1], label)]
                    label += 1
                at += s
        return pd.DataFrame(ends, columns=["id", "label"])

    # one task, as the backbone's walk is; the driver holds no path
    e = written(backbone(tree, branches).groupBy().applyInPandas(cut, "id long, label long").groupBy("id").agg(F.min("label").alias("label")), "ends")
    near = D.nearest(points.select("id", "pos"), points.select("id", "pos").join(e.select("id"), "id"))
    labels = written(near.select(F.col("u").alias("id"), F.col("v")).join(e.select(F.col("id").alias("v"), "label"), "v").select("id", "label"), "labels")
    return nearest_point(cluster_means(points, labels), points), labels


def edge_lengths(edges: DataFrame, points: DataFrame) -> DataFrame:
    a, b = points.select(F.col("id").alias("u"), F.col("pos").alias("p")), points.select(F.col("id").alias("v"), F.col("pos").alias("q"))
    return edges.join(a, "u").join(b, "v").select("u", "v", euclid("p", "q").alias("w"))
