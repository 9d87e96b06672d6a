"""Edge lists and positions as files (SRC-07 to SRC-09, SNK-01 to SNK-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t", base: int = 1) -> DataFrame:
    """u, v, w from separated text; `base` is the number that the file gives its first node."""
    e = spark.read.schema("u long, v long, w double").csv(path, sep=sep)
    return e.select((F.col("u") - base).alias("u"), (F.col("v") - base).alias("v"), "w")


def write_edge_list(edges: DataFrame, path: str, sep: str = "\t", base: int = 1, mode: str = "overwrite") -> None:
    edges.select((F.col("u") + base).alias("u"), (F.col("v") + base).alias("v"), F.col("w").cast("double")).write.mode(mode).csv(path, sep=sep)


def graph_path(folder: str, n: int, mode: str, seed: int, distribution: str = "any", kind: str = "graph") -> str:
    return f"{folder}/{kind}/mode={mode}/distribution={distribution}/n={n}-seed={seed}"


def save_graph(edges: DataFrame, folder: str, **named) -> None:
    write_edge_list(edges, graph_path(folder, **named), sep=" ", base=0)


def load_graph(spark: SparkSession, folder: str, **named) -> DataFrame:
    return read_edge_list(spark, graph_path(folder, **named), sep=" ", base=0)


def save_points(points: DataFrame, folder: str, **named) -> None:
    points.write.mode("overwrite").parquet(graph_path(folder, kind="points", **named))


def load_points(spark: SparkSession, folder: str, **named) -> DataFrame:
    return spark.read.parquet(graph_path(folder, kind="points", **named))
