"""Scaling, density fields, rasters and motion as column plans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.operators import distance as D
from graftwork.session import written


def extents(points: DataFrame, margin: float = 0.1) -> DataFrame:
    """SNK-06: (dim, lo, hi) of axes with a margin, dims from 1."""
    e = points.select(F.posexplode("pos").alias("k", "x")).groupBy((F.col("k") + 1).alias("dim")).agg(F.min("x").alias("a"), F.max("x").alias("b"))
    pad = margin * (F.col("b") - F.col("a"))
    return e.select("dim", (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))


def first_appearance(points: DataFrame, label: str = "label") -> DataFrame:
    """FE-12: labels in the order of their first ids (windows over one row a label)."""
    f = points.groupBy(label).agg(F.min("id").alias("first_id"))
    return f.withColumn("place", (F.row_number().over(W.orderBy("first_id")) - 1).cast("long"))


def standardize(points: DataFrame) -> DataFrame:
    """FE-01: less the mean, over the population deviation (0: over 1), each component by itself."""
    long = points.select("id", F.posexplode("pos").alias("k", "x"))
    s = long.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # a row for each component
    z = long.join(F.broadcast(s), "k").select("id", "k", ((F.col("x") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).alias("z"))
    packed = z.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("a")).select("id", F.transform("a", lambda x: x["z"]).alias("pos"))
    return packed.join(points.drop("pos"), "id")


def pca(points: DataFrame, n: int) -> DataFrame:
    """FE-02: the first n principal components of the centred points; signs are arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = points.withColumn("v", array_to_vector("pos"))
    v = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    out = PCA(k=n, inputCol="c", outputCol="p").fit(v).transform(v)
    return out.select("id", vector_to_array("p").alias("pos"), *[c for c in points.columns if c not in ("id", "pos")])


def scale_or_reduce(points: DataFrame, dims: int, n: int = 100, most: int = 500) -> DataFrame:
    """Scaling, and the first n components where there are more than `most` dimensions."""
    z = standardize(points)
    return pca(z, n) if dims > most else z


def scaled_and_reduced(points: DataFrame, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The scaled points and their first n principal components (all, where there are fewer), both from whole vectors (GC-14 to GC-17)."""
    z = written(standardize(points.select("id", "pos")), "scaled")
    dims = z.agg(F.max(F.size("pos"))).first()[0]
    return z, written(pca(z, min(n, dims)), "reduced")


def mean_neighbour_distance(points: DataFrame) -> DataFrame:
    """FE-04: the mean over points of the least distance above 0."""
    return D.nearest(points, points, nonzero=True).agg(F.avg("w").alias("mean_nn"))


def grid(points: DataFrame, radius: float, dims: int = 2) -> DataFrame:
    """FE-05: (id, pos) of cell centres that cover the plane points; cells have sides radius (2 / sqrt(dims)) 0.9."""
    a = radius * (2 / math.sqrt(dims)) * 0.9
    box = points.agg(F.min(F.col("pos")[0]).alias("x0"), F.max(F.col("pos")[0]).alias("x1"), F.min(F.col("pos")[1]).alias("y0"), F.max(F.col("pos")[1]).alias("y1"))  # one row
    xs = box.select("x0", "y0", F.explode(F.sequence(F.lit(0), F.ceil((F.col("x1") - F.col("x0")) / a).cast("int"))).alias("i"), F.ceil((F.col("y1") - F.col("y0")) / a).cast("int").alias("nj"))
    c = xs.select("x0", "y0", "i", "nj", F.explode(F.sequence(F.lit(0), F.col("nj"))).alias("j"))
    return c.select((F.col("i") * (F.col("nj") + 1) + F.col("j")).cast("long").alias("id"), F.array(F.col("x0") + a * F.col("i"), F.col("y0") + a * F.col("j")).alias("pos"), "i", "j")


def sphere_density(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """FE-06: (id, n): points strictly within the radius of each cell; distances of exactly 0 count."""
    return D.counts_within(cells, points, radius, inclusive=False)


def gauss_density(cells: DataFrame, points: DataFrame, c: float) -> DataFrame:
    """FE-07."""
    return D.kernel_sums(cells, points, c)


def quantize(x: Column, steps: list[float]) -> Column:
    """FE-08: how many of the rising thresholds x has reached."""
    out = F.lit(0)
    for s in steps:
        out = out + (x >= s).cast("int")
    return out


def medial_axis(pixels: DataFrame, rounds: int | None = None) -> DataFrame:
    """FE-09: (i, j, layer): peel the set pixels' border layer by layer; one with two or fewer live neighbours of four is axis.

    Each round is one self join on neighbours; `rounds` bounds the layers (default: till nothing is left).
    """
    live = written(pixels.where("val").select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")), "live")
    axis, layer = None, 0
    while not live.isEmpty() and (rounds is None or layer < rounds):
        layer += 1
        sides = live.select(F.explode(F.array(*(F.struct((F.col("i") + a).alias("i"), (F.col("j") + b).alias("j")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))).alias("p")).select("p.*")
        n = live.join(sides.groupBy("i", "j").agg(F.count("*").alias("n")), ["i", "j"], "left").fillna(0, ["n"])
        n = written(n, "peel")
        found = n.where("n <= 2").select("i", "j", F.lit(layer).alias("layer"))
        axis = found if axis is None else axis.unionByName(found)
        live = written(n.where("n = 4").select("i", "j"), "live")
    return axis if axis is not None else live.select("i", "j", F.lit(0).alias("layer"))


def bounce(x: Column, v: Column, t: Column | float, size: float) -> Column:
    """DY-01: a point's place after time t when it is thrown back at 0 and size: a triangle wave."""
    p = F.pmod(x + v * t, F.lit(2.0 * size))
    return F.when(p > size, 2.0 * size - p).otherwise(p)


def wrap(x: Column, v: Column, t: Column | float, size: float) -> Column:
    return F.pmod(x + v * t, F.lit(float(size)))


def langevin(points: DataFrame, step: float = 0.01, sigmas: tuple[float, ...] = (1.0, 4.0), seed: int = 42, tick: int | Column = 0) -> DataFrame:
    """DY-02: one step of each point towards the origin with Gaussian noise, drawn by seed, tick and id."""
    from graftwork.sources.generators import normal

    pos = F.array(*(F.col("pos")[i] * (1 - step / s) + math.sqrt(2 * step) * normal(F.col("id"), seed + tick, 10 * i) for i, s in enumerate(sigmas)))
    return points.withColumn("pos", pos)


def move(points: DataFrame, kind: str = "uniform", t: float | Column = 1.0, seed: int = 42, speed: float = 0.1) -> DataFrame:
    """DY-03: Gaussian clouds take a Langevin step; uniform ones move in a seeded direction and bounce in [0, 4] x [0, 1]."""
    from graftwork.sources.generators import uniform

    if kind.startswith("gauss"):
        return langevin(points, seed=seed, tick=F.floor(t).cast("int") if isinstance(t, Column) else int(t))
    a = 2 * math.pi * uniform(F.col("id"), seed, 1)
    return points.withColumn("pos", F.array(bounce(F.col("pos")[0], speed * F.cos(a), t, 4.0), bounce(F.col("pos")[1], speed * F.sin(a), t, 1.0)))
