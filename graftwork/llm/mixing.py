"""Mixing sources to target weights by entropy balancing (DataFrame operations only).

Targets: sources in code-point order, null last, take the weights in turn; they share `share` times all words, no target above
`cap` times its source's words, what is above being shared anew by weight. That is water filling: the level at which the capped
sources are those with the smallest words a weight.

Rates: of all document rates within [0, cap], those of least relative entropy to one copy each that meet a source's
word target are min(cap, exp(lambda * size)), one multiplier a source, the maximum of a convex dual. Damped Newton steps find it,
kept inside brackets by bisection: first on a histogram of the source's sizes with a bounded number of bins (every size up to
`FINE` alone, then `PER_OCTAVE` bins an octave), all steps in one expression; then on the exact counts of (source, size), each step
a distributed aggregate for all sources at once, until all meet their targets. The histogram only decides where the exact steps
begin. Sums are decimal, so that they don't depend on the order of rows and reruns agree.

Copies: within a source, documents in order of size, then hash, take floor(c) - floor(c') copies, c and c' being the running
sums of rates with and without the document. Running sums have two levels: over a source's counts of each size, and over the salts
(`RANKED` documents each, `SALTS` of them at most) that one size of one source is dealt out to. A few rounds then name the
document of each source whose copy more or less brings its words nearest to the target; they work on one row a (source, size).

Null texts have size 0 and, like all of size 0, one copy or none and no words. Rows with equal ids count one by one. Sources
whose documents have no words have target 0. Extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.llm.common import join_hot
from graftwork.session import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one window partition ranks, about; and the salts of one (source, size) at most, beyond which partitions grow.
RANKED, SALTS = 512, 1 << 16
#: Sizes that have a bin of their own in the histogram, and bins of each octave of the others.
FINE, PER_OCTAVE = 64, 32
_BY = ["no_source", "src"]
_CELL = [*_BY, "size"]


def document_sizes(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("src"), size.alias("size"))


def targets(cells: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row for each source of the counts (source, size, n): words, weight, target. Windows here run over one row a source."""
    filled = F.col("size") > 0
    s = cells.groupBy(*_BY).agg(
        F.sum(F.col("n") * F.col("size")).alias("words"),
        F.min(F.when(filled, F.col("size"))).alias("least"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("filled"),
    )
    turn = (F.row_number().over(W.orderBy(*_BY)) - 1) % len(weights)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    s = s.withColumn("at", cap * F.col("words") / F.col("weight"))  # the level from which it is capped
    w = W.orderBy("at", *_BY)
    before, behind = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy(F.lit(0))
    capped = F.coalesce(F.sum(cap * F.col("words")).over(before), F.lit(0.0))
    s = s.withColumn("level", (share * F.sum("words").over(everything) - capped) / F.sum("weight").over(behind))
    # the first source in this order that isn't capped sets the level for all
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", *_BY, "level"))).over(everything)["level"])
    most = cap * F.col("words")
    return s.select(*_BY, "words", "weight", "least", "filled", F.least(most, F.coalesce(F.col("level") * F.col("weight"), most)).alias("target"))


def _newton(x: Column, lo: Column, hi: Column, g: Column, d: Column, target: Column, tolerance: float) -> list[Column]:
    """The next x, lo, hi and whether x meets the target, from the words g at x and their slope d."""
    done = F.abs(g - target) <= tolerance * target
    lo, hi = F.when(g < target, x).otherwise(lo), F.when(g > target, x).otherwise(hi)
    step = x + (F.log(target) - F.log(F.greatest(g, F.lit(1e-300)))) * g / F.when(d > 0, d)
    inside = F.coalesce((step > lo) & (step < hi), F.lit(False))
    return [F.when(done, x).when(inside, step).otherwise((lo + hi) / 2).alias("x"), lo.alias("lo"), hi.alias("hi"), done.alias("done")]


def _mass(x: Column, unit: Column, size: Column, n: Column, cap: float) -> tuple[Column, Column]:
    """Words that n documents of a size give at x, and their slope."""
    u = size / unit
    free = x * u < F.log(F.lit(cap))
    words = n * size * F.when(free, F.exp(x * u)).otherwise(F.lit(cap))
    return words, F.when(free, words * u).otherwise(F.lit(0.0))


def _begin(cells: DataFrame, cap: float, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """(source, x, lo, hi) where the exact steps begin: damped Newton steps over each source's histogram, in one expression."""
    fine = F.col("size") < FINE
    bin_ = F.when(fine, F.col("size")).otherwise((F.log2("size") * PER_OCTAVE).cast("long") + FINE)
    bins = cells.where("size > 0").groupBy(*_BY, bin_.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("w"), F.max("target").alias("target"), F.max("unit").alias("unit"), F.max("least").alias("least"))
    bars = F.array_sort(F.collect_list(F.struct((F.col("w") / F.col("n")).alias("s"), F.col("n").cast("double").alias("n"))))
    s = bins.groupBy(*_BY).agg(bars.alias("bars"), F.max("target").alias("target"), F.max("unit").alias("unit"), F.max("least").alias("least"))
    lo, hi = -700.0 * F.col("unit") / F.col("least"), F.log(F.lit(cap)) * F.col("unit") / F.col("least")
    start = F.struct(F.lit(0.0).alias("x"), lo.alias("lo"), hi.alias("hi"), F.lit(False).alias("done"))

    def add(x: Column):
        def fn(total: Column, bar: Column) -> Column:
            g, d = _mass(x, F.col("unit"), bar["s"], bar["n"], cap)
            return F.struct((total["g"] + g).alias("g"), (total["d"] + d).alias("d"))

        return fn

    def step(state: Column, _: Column) -> Column:
        sums = F.aggregate("bars", F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("d")), add(state["x"]))
        # an array of one, so that the sums are taken once
        after = F.transform(F.array(sums), lambda t: F.struct(*_newton(state["x"], state["lo"], state["hi"], t["g"], t["d"], F.col("target"), tolerance)))
        return F.when(state["done"], state).otherwise(F.element_at(after, 1))

    near = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return s.select(*_BY, "target", "unit", near["x"].alias("x"), lo.alias("lo"), hi.alias("hi"))


def multipliers(cells: DataFrame, sources: DataFrame, cap: float = 2.0, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """(source, lambda a word): Newton steps on log words against log target, for all sources at once."""
    wanted = sources.where("words > 0 and target > 0").select(*_BY, "target", "least", (F.col("words") / F.col("filled")).alias("unit"))
    state = written(_begin(cells.join(wanted, _BY), cap), "dual")
    exact = "decimal(38,9)"
    for _ in range(rounds):
        mass, slope = _mass(F.col("x"), F.col("unit"), F.col("size"), F.col("n"), cap)
        at = cells.where("size > 0").join(state, _BY)
        same = [F.max(c).alias(c) for c in ("target", "unit", "x", "lo", "hi")]
        s = at.groupBy(*_BY).agg(F.sum(mass.cast(exact)).cast("double").alias("g"), F.sum(slope.cast(exact)).cast("double").alias("d"), *same)
        after = _newton(*(F.col(c) for c in ("x", "lo", "hi", "g", "d", "target")), tolerance)
        state = written(s.select(*_BY, "target", "unit", *after), "dual")
        if state.where("not done").isEmpty():
            break
    return state.select(*_BY, (F.col("x") / F.col("unit")).alias("lambda"))


def _rated(cells: DataFrame, sources: DataFrame, lam: DataFrame, cap: float) -> DataFrame:
    """Each (source, size) with its rate, the rates' running sum before it and its number of salts."""
    none = F.when(F.col("words") > 0, F.lit(0.0)).otherwise(F.lit(1.0))
    rate = F.when(F.col("target") <= 0, none).otherwise(F.least(F.lit(cap), F.exp(F.coalesce("lambda", F.lit(0.0)) * F.col("size"))))
    rated = cells.join(sources, _BY).join(lam, _BY, "left").select(*_CELL, "n", "words", "target", rate.alias("rate"))
    run = W.partitionBy(*_BY).orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("n") * F.col("rate")).over(run), F.lit(0.0))
    return rated.select(*_CELL, "n", "words", "target", "rate", before.alias("before"), F.least(F.ceil(F.col("n") / RANKED), F.lit(SALTS)).alias("salts"))


def _copies(rows: DataFrame, cap: int) -> DataFrame:
    """The rows with their copies: systematic draws along the running sum of rates."""
    parts = rows.groupBy(*_CELL, "salt").agg(F.count("*").alias("n"), F.first("rate").alias("r"))
    run = W.partitionBy(*_CELL).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*_CELL, "salt", F.coalesce(F.sum(F.col("n") * F.col("r")).over(run), F.lit(0.0)).alias("inner"))
    rank = F.row_number().over(W.partitionBy(*_CELL, "salt").orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id"))
    ranked = rows.withColumn("k", rank).join(parts, [*_CELL, "salt"]).withColumn("at", F.col("before") + F.col("inner"))
    copies = F.floor(F.col("at") + F.col("rate") * F.col("k") + 0.5) - F.floor(F.col("at") + F.col("rate") * (F.col("k") - 1) + 0.5)
    return ranked.select("doc_id", *_CELL, F.col("words").alias("source_size"), "target", "rate", "k", "salt", F.least(F.lit(cap), F.greatest(F.lit(0), copies)).cast("int").alias("copies"))


def _fixes(out: DataFrame, cap: int, rounds: int) -> list[DataFrame]:
    """For each round (source, size, salt, k, way): the document that takes one copy more or less, a row a source at most."""
    who = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "salt", "k")
    ends = out.groupBy(*_CELL).agg(
        F.max("target").alias("target"),
        F.sum(F.col("copies") * F.col("size")).alias("taken"),
        F.min(F.when(F.col("copies") < cap, who)).alias("up"),
        F.min(F.when(F.col("copies") > 0, who)).alias("down"),
    )
    ends = written(ends, "ends")
    off = ends.groupBy(*_BY).agg((F.max("target") - F.sum("taken")).alias("off"))
    left = ends.where("size > 0").select(*_CELL, "up", "down")
    found: list[DataFrame] = []
    for _ in range(rounds):
        c = left.join(off, _BY).withColumn("way", F.signum("off").cast("int"))
        c = c.withColumn("b", F.when(F.col("way") > 0, F.col("up")).otherwise(F.col("down"))).where("way <> 0 and b is not null and abs(abs(off) - size) < abs(off)")
        best = c.groupBy(*_BY).agg(F.min(F.struct(F.abs(F.abs("off") - F.col("size")).alias("e"), "size", F.col("b.h").alias("h"), F.col("b.doc_id").alias("doc_id"), F.col("b.salt").alias("salt"), F.col("b.k").alias("k"), "way")).alias("b"), F.max("off").alias("off"))
        best = written(best.select(*_BY, *(F.col(f"b.{x}").alias(x) for x in ("size", "salt", "k", "way")), (F.col("off") - F.col("b.way") * F.col("b.size")).alias("off")), "fix")
        if best.isEmpty():
            break
        found.append(best.drop("off"))
        off = best.select(*_BY, "off")
        left = left.join(best.select(*_CELL), _CELL, "left_anti")  # a size gives one document at most
    return found


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, cap: int = 2, fixes: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, rate and copies of every document; source and no_source (true for null) come along."""
    sizes = written(document_sizes(docs), "sizes")
    cells = written(sizes.groupBy(*_CELL).agg(F.count("*").alias("n")), "cells")
    sources = written(targets(cells, weights, share, float(cap)), "sources")
    rated = written(_rated(cells, sources, multipliers(cells, sources, float(cap)), float(cap)), "rates")
    rows = join_hot(sizes, rated, _CELL, "n").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))
    rows = written(rows.select("doc_id", *_CELL, "words", "target", "rate", "before", "salt"), "rated")
    out = written(_copies(rows, cap), "copies")
    changed = _fixes(out, cap, fixes)
    if changed:
        all_ = changed[0]
        for c in changed[1:]:
            all_ = all_.unionByName(c)
        out = out.join(all_, [*_CELL, "salt", "k"], "left").withColumn("copies", F.col("copies") + F.coalesce("way", F.lit(0))).drop("way")
    return out.drop("k", "salt")
