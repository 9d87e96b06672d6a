"""The data model: points(id, pos), edges(u < v, w), labels(id, label), scores; and how the driver's tables map to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.session import load

#: Edges that a single task's kernel may hold; larger graphs take the DataFrame loops.
KERNEL_EDGES = 5_000_000


def canonical(edges: DataFrame, how: str = "min") -> DataFrame:
    """Undirected edges once each with u < v; parallel ones keep the least (or, by how, another aggregate) weight; loops go."""
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    return e.groupBy("u", "v").agg(getattr(F, how)("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, w) in both directions."""
    return edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("u").alias("id")).distinct()


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pos"), "label")


def plane_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-dimensional points: the first two components of the vectors."""
    return points(spark, sf_dir).select("id", F.slice("pos", 1, 2).alias("pos"), "label")


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade graph of nations: line items between a customer's and a supplier's nation; few weigh much."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("a"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    t = li.join(o, "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").where("a <> b")
    t = t.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))
    return t.select("u", "v", F.floor(F.lit(1000000) / F.col("n") + 0.5).cast("long").alias("w"))


def part_supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse bipartite graph of parts and suppliers; suppliers have negative ids."""
    li = load(spark, sf_dir, "lineitem")
    return li.groupBy((-F.col("l_suppkey") - 1).alias("u"), F.col("l_partkey").alias("v")).agg(F.count("*").alias("w"))


NATION_SQL = """nation_edges AS (SELECT u, v, floor(1000000.0/n + 0.5)::BIGINT AS w FROM (
  SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2))"""
POINTS_SQL = "points AS (SELECT vec_id AS id, embedding::DOUBLE[] AS pos, label FROM embeddings)"
PLANE_SQL = "plane AS (SELECT vec_id AS id, (embedding::DOUBLE[])[1:2] AS pos, label FROM embeddings)"
PART_SQL = "part_edges AS (SELECT -l_suppkey - 1 AS u, l_partkey AS v, count(*) AS w FROM lineitem GROUP BY ALL)"
