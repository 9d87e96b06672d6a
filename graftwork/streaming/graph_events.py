"""Incremental graph state under edge events: a Structured Streaming source, micro-batches applied in order to tables in
the shared folder. An event is (seq, type, u, v, w): add, remove, weight (set) or increment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.session import Rounds, delete_path, scratch_path

_EDGES = "u long, v long, w double"
SCHEMA = "seq long, type string, u long, v long, w double"


def empty_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "u long, v long, w double")


def apply_events(edges: DataFrame, events: DataFrame) -> DataFrame:
    """ST-01, ST-02: the edges after the events in the order of seq; unknown types and loops change nothing.

    Only what an edge's events since its last add, weight or remove say can matter: the last of these sets the weight, and later
    increments add up. Both are plain aggregates of the edge's own events.
    """
    e = events.where("u <> v and type in ('add', 'weight', 'remove', 'increment')").select("seq", "type", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.coalesce("w", F.lit(1.0)).alias("w"))
    last = e.where("type <> 'increment'").groupBy("u", "v").agg(F.max(F.struct("seq", "type", "w")).alias("l"))
    j = e.where("type = 'increment'").join(last.select("u", "v", F.col("l.seq").alias("at")), ["u", "v"], "left")
    grown = j.where("at is null or seq > at").groupBy("u", "v").agg(F.sum("w").alias("more"))
    touched = last.join(grown, ["u", "v"], "full").select("u", "v", "l", "more")
    out = edges.select("u", "v", F.col("w").cast("double").alias("w")).join(touched, ["u", "v"], "full")
    base = F.when(F.col("l").isNull(), F.col("w")).when(F.col("l.type") != "remove", F.col("l.w"))
    return out.select("u", "v", base.alias("b"), "more").where("b is not null or more is not null").select("u", "v", (F.coalesce("b", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("w"))


class GraphState:
    """The current edges as a written table; each micro-batch makes the next version, and a batch that comes again is skipped.

    With a `folder` the state outlives the session: versions and the stream's checkpoint stand there, and a state that is made
    anew goes on from the last version. The batch's number is part of its version's name, and a version counts once its writer's
    success mark is there, so that a batch is applied once even if the driver goes between writing and the stream's own commit.
    Versions before the last two are deleted.
    """

    def __init__(self, spark: SparkSession, edges: DataFrame | None = None, measure: Callable[[DataFrame], DataFrame] | None = None, folder: str | None = None) -> None:
        self.spark, self.measure = spark, measure
        self.folder = folder or scratch_path(spark, "state")
        self.scores: DataFrame | None = None
        found = self._versions()
        if found:
            self.batch = found[-1]
            self.edges = spark.read.schema(_EDGES).parquet(self._place(self.batch))
        else:
            self.batch = -1
            self.edges = self._write(edges if edges is not None else empty_edges(spark))
        self.rounds = Rounds(spark)

    def _place(self, batch: int) -> str:
        return f"{self.folder}/edges/batch-{batch + 1:012d}"

    def _versions(self) -> list[int]:
        """Numbers of the complete versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges/batch-*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName()[6:]) - 1 for f in found or ())

    def _write(self, edges: DataFrame) -> DataFrame:
        edges.select("u", "v", F.col("w").cast("double").alias("w")).write.mode("overwrite").parquet(self._place(self.batch))
        return self.spark.read.schema(_EDGES).parquet(self._place(self.batch))

    def update(self, events: DataFrame, batch: int | None = None) -> None:
        batch = self.batch + 1 if batch is None else batch
        if batch <= self.batch:
            return
        new = apply_events(self.edges, events)
        self.batch = batch
        self.edges = self._write(new)
        for old in self._versions()[:-2]:
            delete_path(self.spark, self._place(old))
        if self.measure:
            self.scores = self.rounds.written(self.measure(self.edges), "scores")

    def follow(self, stream: DataFrame):
        """Starts the streaming query; its checkpoint stands beside the versions."""
        return stream.writeStream.foreachBatch(lambda df, k: self.update(df, k)).option("checkpointLocation", f"{self.folder}/stream").start()

    def replay(self, folder: str, files_a_batch: int = 1) -> None:
        """All of a folder's event files, as a stream, to its end."""
        q = self.follow(self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder))
        q.processAllAvailable()
        q.stop()


class DistanceState:
    """ST-03: all distances under edges that come in or get lighter: one join a change."""

    def __init__(self, dist: DataFrame) -> None:
        self.rounds = Rounds(dist.sparkSession)
        self.dist = self.rounds.written(dist.select("source", "id", "dist"), "dist")

    def decrease(self, u: int, v: int, w: float) -> None:
        from graftwork.operators.paths import apsp_decrease

        self.dist = self.rounds.written(apsp_decrease(self.dist, u, v, w), "dist")


def motion(stream: DataFrame, kind: str = "uniform", seed: int = 42) -> DataFrame:
    """ST-04: the places of (id, pos, t) rows at their ticks: a stateless map. Uniform points bounce; Gaussian ones take the Langevin
    step of their tick, whose noise is drawn by id and tick."""
    from graftwork.functions.fields import move

    return move(stream, kind, F.col("t"), seed)
