"""The dataset registry, CSV scans and the read-or-compute cache (SRC-01, SRC-02, SRC-06)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Registry:
    """Names -> loaders of points; unknown names raise KeyError."""

    def __init__(self) -> None:
        self._loaders: dict[str, Callable[[], DataFrame]] = {}

    def add(self, name: str, loader: Callable[[], DataFrame]) -> None:
        self._loaders[name] = loader

    def names(self) -> list[str]:
        return sorted(self._loaders)

    def load(self, name: str) -> DataFrame:
        return self._loaders[name]()


def read_obs_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_matrix_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos) from headless lines of an id and comma-separated components."""
    raw = F.split("value", ",")
    return spark.read.text(path).select(raw[0].cast("long").alias("id"), F.transform(F.slice(raw, 2, F.size(raw) - 1), lambda x: x.cast("double")).alias("pos"))


def write_matrix_csv(points: DataFrame, path: str) -> None:
    points.select(F.concat_ws(",", F.col("id").cast("string"), F.transform("pos", lambda x: x.cast("string")))).write.text(path)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        compute().write.parquet(path)
        return spark.read.parquet(path)
