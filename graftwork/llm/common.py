"""What several of the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.session import written

#: Rows of a labelled sample that a classifier is fitted on at most (its documented bound).
FIT_ROWS = 20_000


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def release() -> None:
    """Gives memory that a task no longer needs back to the system; workers live on and would keep it."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few bytes, so that long texts don't meet in memory."""
    for b in batches:
        n = max(1, min(b.num_rows, int(b.num_rows * most_bytes / max(1, b.nbytes))))
        for at in range(0, b.num_rows, n):
            yield b.slice(at, n)
    release()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents outside the held-out fold: those with the smallest hashes.

    Labels that are null or neither 0 nor 1 don't count; a document with contradicting labels takes the larger one, and an id
    that stands on several rows gives the text with the least hash. The ids that are broadcast number `rows` at most.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held_out))
    y = y.select("doc_id", F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    y = F.broadcast(written(y, "labelled"))
    found = docs.select("doc_id", "text").join(y, "doc_id")
    # ids that stand on several rows, `rows` at most, found without reading texts; where there are none, no text is shuffled
    many = docs.select("doc_id").join(y, "doc_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    many = written(many, "many")
    if many.isEmpty():
        return found
    again = found.join(F.broadcast(many), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("y").alias("y"))
    return found.join(F.broadcast(many), "doc_id", "left_anti").unionByName(again)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights with the intercept last, by damped Newton steps; columns of x should be of order one."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Keys that are split off a join as hot at most; each stands for at least this share's inverse of the rows that meet.
HOT_KEYS = 10_000


def join_hot(left: DataFrame, right: DataFrame, on: list[str], rows: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The inner join of `left` with `right`, whose keys are unique and whose column `rows` counts the rows of `left` that have them.

    Keys of more than 1 / hot_keys of all rows that meet number fewer than `hot_keys`, however much data there is: these go
    by broadcast and their rows stay where they are. The others' rows are shuffled, no key having more than that share.
    `right` should be a written table, as it is read twice.
    """
    total = right.agg(F.sum(rows).alias("n")).first().n or 0
    hot = right.where(F.col(rows) * hot_keys > F.lit(total)).drop(rows)
    cold = right.where(F.col(rows) * hot_keys <= F.lit(total)).drop(rows)
    if hot.isEmpty():
        return left.join(cold, on)
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on))


def file_count(df: DataFrame, most_bytes: int) -> int:
    """Files that a written form of the rows is dealt out to: by Catalyst's estimate of their bytes, the shuffle's partitions at least."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-size // most_bytes)) if size < 1 << 60 else least  # beyond that nothing is known


def lean_written(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """`written`, with Arrow batches of `rows` rows on the way: where rows hold whole texts or sets, so that few of them meet in memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def open_store(uri: str):
    """The file system of a path that Spark names, and the path in it: for reads by range in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def stream(rows: DataFrame, name: str, parts: int = 4) -> Iterator:
    """The rows, brought to the driver part by part: for results of bounded size. A job a part, not one a shuffle partition."""
    return lean_written(rows, name).coalesce(parts).toLocalIterator()


#: Bits of a broadcast membership sketch at most (16 MiB).
BLOOM_BITS = 1 << 27
_BLOCK = 1 << 12  # bytes


def _places(h: bytes, bits: int) -> tuple[int, int, int]:
    a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:16], "little") | 1
    return a & (bits - 1), (a + b) & (bits - 1), (a + 2 * b) & (bits - 1)


def bloom_has(table: bytes, h: bytes) -> bool:
    """False only for a 16-byte hash that wasn't put in."""
    bits = len(table) << 3
    return all(table[p >> 3] >> (p & 7) & 1 for p in _places(h, bits))


def bounded_bloom(hashes: DataFrame) -> bytes:
    """A Bloom filter over a column of 16-byte hashes: 16 to 32 bits each, `BLOOM_BITS` in all at most.

    Beyond that bound it only lets more pass that wasn't put in, so that users must give right results for these too.
    """
    hashes = written(hashes, "hashes")
    n = hashes.count()
    bits = min(BLOOM_BITS, max(8 * _BLOCK, 1 << (16 * max(1, n) - 1).bit_length()))

    def blocks(batches):
        table = np.zeros(bits >> 3, np.uint8)
        for b in batches:
            for h in b.column(0).to_pylist():
                for p in _places(h, bits):
                    table[p >> 3] |= 1 << (p & 7)
        t = table.reshape(-1, _BLOCK)
        at = np.flatnonzero(t.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([t[i].tobytes() for i in at], pa.binary())], names=["block", "bits"])

    def either(key, batch):
        t = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in batch.column("bits").to_pylist()])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([t.tobytes()], pa.binary())})

    out = bytearray(bits >> 3)
    for r in stream(hashes.mapInArrow(blocks, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary"), "bloom"):
        out[r.block * _BLOCK : (r.block + 1) * _BLOCK] = r.bits
    return bytes(out)
