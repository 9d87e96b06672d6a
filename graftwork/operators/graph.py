"""Edge and graph primitives (GP-01 to GP-18), all as plain DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.model import both_ways, canonical
from graftwork.operators.components import connected_components
from graftwork.operators.distance import euclid
from graftwork.session import written

#: Weight transforms by name (GC-19): functions of a column and gamma.
TRANSFORMS = {
    "squared": lambda w, g: w * w,
    "exponential": lambda w, g: F.exp(g * w) - 1,
    "piecewise_exp_squared": lambda w, g: F.when(w < F.log(F.lit(2.0)) / (g * 0.41421356237309515), F.exp(g * w) - 1).otherwise((F.exp(F.log(F.lit(2.0)) / 0.41421356237309515) - 1) / F.pow(F.log(F.lit(2.0)) / (g * 0.41421356237309515), 2) * w * w),
}


def weight_stats(edges: DataFrame) -> DataFrame:
    """GP-01, GP-02: least, largest (infinities for none) and mean weight, and how many edges."""
    w = F.col("w").cast("double")
    return edges.agg(F.coalesce(F.min(w), F.lit(float("inf"))).alias("min_w"), F.coalesce(F.max(w), F.lit(float("-inf"))).alias("max_w"), F.avg(w).alias("mean_w"), F.count("*").alias("n_edges"))


def highway_weight(edges: DataFrame) -> DataFrame:
    """GP-03: the least weight over four times the nodes: a path of such edges is shorter than any other edge."""
    n = both_ways(edges).agg(F.countDistinct("u").alias("n"))
    return edges.agg(F.min("w").alias("m")).crossJoin(n).select((F.col("m") / F.col("n") / 4).alias("highway"))  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("id")).agg(F.count("*").alias("degree"))


def leaves(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("id")


def weights_from_positions(edges: DataFrame, points: DataFrame) -> DataFrame:
    """GP-05."""
    a, b = points.select(F.col("id").alias("u"), F.col("pos").alias("pu")), points.select(F.col("id").alias("v"), F.col("pos").alias("pv"))
    return edges.select("u", "v").join(a, "u").join(b, "v").select("u", "v", euclid("pu", "pv").alias("w"))


def map_weights(edges: DataFrame, fn: Column) -> DataFrame:
    return edges.withColumn("w", fn)


def substitute_weights(edges: DataFrame, widths: DataFrame) -> DataFrame:
    """GP-07: weights from (u, v, width) on the edge's key."""
    return edges.select("u", "v").join(widths.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("width").alias("w")), ["u", "v"])


def compact(edges: DataFrame) -> DataFrame:
    """GP-09: ids 0..n-1 in the old order. Ranks come from counts of id ranges, not from one sorted task."""
    ids = written(both_ways(edges).select(F.col("u").alias("id")).distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ids")
    before = ids.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = before.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    new = ids.join(before, "part").select("id", (F.col("base") + F.row_number().over(W.partitionBy("part").orderBy("id")) - 1).alias("new"))
    e = edges.join(new.select(F.col("id").alias("u"), F.col("new").alias("nu")), "u").join(new.select(F.col("id").alias("v"), F.col("new").alias("nv")), "v")
    return e.select(F.col("nu").alias("u"), F.col("nv").alias("v"), "w")


def used_edges(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """GP-10: edges with a score above 0."""
    return edges.join(scores.where("score > 0").select("u", "v"), ["u", "v"], "left_semi")


def is_connected(edges: DataFrame, nodes: DataFrame | None = None) -> bool:
    """GP-11: one component, over the edges' nodes or those given."""
    c = connected_components(edges)
    ids = nodes.select("id") if nodes is not None else c.select("id")
    return ids.join(c, "id", "left").select(F.coalesce("component", "id").alias("c")).distinct().limit(2).count() <= 1


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, component) of all nodes, those without edges too."""
    return nodes.select("id").join(connected_components(edges), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """GP-15: the induced subgraph."""
    return edges.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v", "w")


def contract(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """GP-16: nodes become their class (id, component); parallel edges keep the least weight, loops go."""
    a, b = classes.select(F.col("id").alias("u"), F.col("component").alias("cu")), classes.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    e = edges.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"), "w")
    return canonical(e)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """GC-21: edges of a that b lacks."""
    return a.join(b.select("u", "v"), ["u", "v"], "left_anti").select("u", "v", "w")


def closes_cycle(tree: DataFrame, candidates: DataFrame) -> DataFrame:
    """GP-12: (u, v, cycle): whether each candidate's ends are in one class (represented by its least id) of the forest."""
    c = connected_components(tree)
    a, b = c.select(F.col("id").alias("u"), F.col("component").alias("cu")), c.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    j = candidates.join(a, "u", "left").join(b, "v", "left")
    return j.select("u", "v", (F.coalesce("cu", "u") == F.coalesce("cv", "v")).alias("cycle"))
