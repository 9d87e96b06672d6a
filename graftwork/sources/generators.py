"""Point generators and rasters (SRC-10 to SRC-17). Random draws are hashes of (seed, id, use), so that reruns and any
partitioning give the same points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(key: Column, seed: int, use: int) -> Column:
    """In [0, 1)."""
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(use)), F.lit(1 << 53)) / float(1 << 53)


def normal(key: Column, seed: int, use: int) -> Column:
    return F.sqrt(-2 * F.log(1 - uniform(key, seed, use))) * F.cos(2 * math.pi * uniform(key, seed, use + 1000))


def create_points(spark: SparkSession, n: int = 100, distribution: str = "gauss", seed: int = 42, sigma1: float = 1.0, sigma2: float = 4.0, levels: int = 3) -> DataFrame:
    """SRC-12, SRC-14: (id, pos) of a named cloud; unknown names raise ValueError."""
    ids = spark.range(n)
    k = F.col("id")
    if distribution.startswith("gauss"):
        pos = F.array(sigma1 * normal(k, seed, 1), sigma2 * normal(k, seed, 2))
    elif distribution == "uniform":
        pos = F.array(4 * uniform(k, seed, 1), uniform(k, seed, 2))
    elif distribution == "circle":
        a = 2 * math.pi * uniform(k, seed, 1)
        pos = F.array(3.8 * F.cos(a), 3.8 * F.sin(a))
    elif distribution == "line":
        pos = F.array(4 * uniform(k, seed, 1), F.lit(1.0))
    elif distribution == "meshgrid":
        side = math.isqrt(n)
        if side * side != n:
            raise ValueError("meshgrid needs a square number of points")
        pos = F.array(F.floor(k / side) * 4.0 / max(1, side - 1), (k % side) * 1.0 / max(1, side - 1))
    elif distribution == "space_filling_tree":
        return space_filling_tree(spark, levels)
    else:
        raise ValueError(f"unknown distribution {distribution}")
    return ids.select("id", pos.alias("pos"))


def space_filling_tree(spark: SparkSession, levels: int) -> DataFrame:
    """SRC-13: from the origin, each vertex has four diagonal children, at half the step of its own level."""
    level = spark.range(1).select(F.array(F.lit(0.0), F.lit(0.0)).alias("pos"), F.lit(0).alias("level"))
    out = level
    for lv in range(1, levels + 1):
        step = 0.5**lv
        moves = F.explode(F.array(*(F.array(F.lit(a * step), F.lit(b * step)) for a in (1, -1) for b in (1, -1))))
        level = level.select("pos", moves.alias("m")).select(F.zip_with("pos", "m", lambda x, y: x + y).alias("pos"), F.lit(lv).alias("level"))
        out = out.unionByName(level)
    return out.withColumn("id", F.xxhash64("pos", "level"))


def branching(spark: SparkSession, branches: int = 3, length: int = 2500, dims: int = 2, seed: int = 37, sigma: float = 1.0, step: float = 2.0) -> DataFrame:
    """SRC-15: branches of diffusing steps, each from where the one before it ended."""
    w = W.partitionBy("branch").orderBy("t")
    walk = spark.range(branches * length).select("id", F.floor(F.col("id") / length).alias("branch"), (F.col("id") % length).alias("t"))
    for i in range(dims):
        walk = walk.withColumn(f"x{i}", F.sum(step * (uniform(F.col("id"), seed, 10 + i) - 0.5) + step * (uniform(F.col("branch"), seed, 50 + i) - 0.5)).over(w))
    ends = walk.where(F.col("t") == length - 1).groupBy("branch").agg(*(F.max(f"x{i}").alias(f"e{i}") for i in range(dims)))  # a row for each branch
    starts = ends.select("branch", *(F.coalesce(F.sum(f"e{i}").over(W.orderBy("branch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias(f"s{i}") for i in range(dims)))
    pos = F.array(*(F.col(f"x{i}") + F.col(f"s{i}") + sigma * normal(F.col("id"), seed, 90 + i) for i in range(dims)))
    return walk.join(starts, "branch").select("id", "branch", pos.alias("pos"))


def serpentines(spark: SparkSession, seed: int = 42) -> DataFrame:
    """SRC-16: three long slabs joined by two short ones at alternating ends."""
    slabs = [(300, 0.0, 10.0, 0.0, 1.0), (15, 9.0, 10.0, 1.0, 2.0), (300, 0.0, 10.0, 2.0, 3.0), (15, 0.0, 1.0, 3.0, 4.0), (300, 0.0, 10.0, 4.0, 5.0)]
    out, at = None, 0
    for i, (n, x0, x1, y0, y1) in enumerate(slabs):
        k = F.col("id")
        s = spark.range(at, at + n).select("id", F.lit(i).alias("slab"), F.array(x0 + (x1 - x0) * uniform(k, seed, 1), y0 + (y1 - y0) * uniform(k, seed, 2)).alias("pos"))
        out, at = s if out is None else out.unionByName(s), at + n
    return out


def luma_mask(pixels: DataFrame) -> DataFrame:
    """SRC-10: (i, j, r, g, b) -> (i, j, val)."""
    return pixels.select("i", "j", (0.2989 * F.col("r") + 0.5870 * F.col("g") + 0.1140 * F.col("b") > 0).alias("val"))


def read_image(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: pixels (i, j, r, g, b) of images that Spark's image source reads (bytes in blue, green, red order)."""
    img = spark.read.format("image").load(path).select("image.*")
    at = F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("k")
    px = img.select("width", "nChannels", "data", at)
    byte = lambda o: F.conv(F.hex(F.substring("data", (F.col("k") * F.col("nChannels") + o + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return px.select(F.floor(F.col("k") / F.col("width")).cast("int").alias("i"), (F.col("k") % F.col("width")).alias("j"), byte(F.least(F.lit(2), F.col("nChannels") - 1)).alias("r"), byte(F.least(F.lit(1), F.col("nChannels") - 1)).alias("g"), byte(F.lit(0)).alias("b"))


def sample_mask(pixels: DataFrame, n: int, seed: int = 42, scaled: bool = False) -> DataFrame:
    """SRC-11: n distinct set pixels by the order of their hashes; scaled to 4 over the larger side."""
    s = pixels.where("val").select("i", "j").distinct().orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j").limit(n)
    if not scaled:
        return s
    side = pixels.agg((F.greatest(F.max("i"), F.max("j")) + 1).alias("side"))
    return s.crossJoin(F.broadcast(side)).select((F.col("i") * 4.0 / F.col("side")).alias("x"), (F.col("j") * 4.0 / F.col("side")).alias("y"))  # one row


def microstructure(spark: SparkSession, side: int = 256, seed: int = 1, reach: int = 3) -> DataFrame:
    """SRC-17: (i, j, val): seeds smoothed by a Gaussian kernel on the torus, set where above the mean."""
    px = spark.range(side * side).select(F.floor(F.col("id") / side).alias("i"), (F.col("id") % side).alias("j"), (uniform(F.col("id"), seed, 1) < 10.0 / side).cast("int").alias("s"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(math.exp(-(a * a + b * b) / (reach * reach / 2))).alias("k")) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1))))
    spread = px.where("s = 1").select("i", "j", steps.alias("m")).groupBy(F.pmod(F.col("i") + F.col("m.a"), F.lit(side)).alias("i"), F.pmod(F.col("j") + F.col("m.b"), F.lit(side)).alias("j")).agg(F.round(F.sum("m.k"), 9).alias("f"))
    field = px.select("i", "j").join(spread, ["i", "j"], "left").fillna(0.0, ["f"])
    mean = field.agg(F.avg("f").alias("mean"))
    return field.crossJoin(F.broadcast(mean)).select("i", "j", (F.col("f") > F.col("mean")).alias("val"))  # one row
