"""Session helpers: the shared scratch folder, written tables that cut lineage, table loading."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, list[str]] = {}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one, in local mode alone."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = f"file://{tempfile.mkdtemp(prefix='graftwork-')}"
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d) if not spark.sparkContext.getCheckpointDir() else None
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/graftwork/{uuid.uuid4().hex}-{name}"
    _scratch.setdefault("paths", []).append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def write_table(df: DataFrame, name: str = "t") -> str:
    """The folder of a Parquet table of the rows in the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows as a written Parquet table in the shared folder: cuts lineage and survives lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, name))


class Rounds:
    """Written tables of a loop's state: a name's next table replaces the one before, whose files are deleted, so that a loop holds
    as many tables as names, however many rounds it takes. The last ones stay."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = write_table(df, name)
        if old := self.paths.get(name):
            delete_path(self.spark, old)
            _scratch["paths"].remove(old)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)


def read_in_task(path: str):
    """A written table as an Arrow table, read by the task that asks: for tables of checked size."""
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("part-"))
    return pa.concat_tables([pq.read_table(f, filesystem=store) for f in files])


def batches_in_task(path: str, rows: int):
    """A written table's record batches of up to so many rows, read by the task that asks: for tables of any size."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    for f in sorted(f.path for f in store.get_file_info(fs.FileSelector(place)) if f.base_name.startswith("part-")):
        with store.open_input_file(f) as source:
            yield from pq.ParquetFile(source).iter_batches(rows)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _scratch.pop("paths", []):
        try:
            delete_path(spark, path)
        except Exception:  # the session may be gone; the folder's owner cleans what stays
            return
