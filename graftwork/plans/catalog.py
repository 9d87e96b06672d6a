"""All queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graftwork.plans import q_graph, q_paths, q_trees

_PARTS = [q_graph, q_paths, q_trees]
QUERIES = {k: f for m in _PARTS for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _PARTS for k, s in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["m0_knn_degree"](spark, sf_dir)
