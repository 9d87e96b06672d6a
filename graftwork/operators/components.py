"""Connected components by label propagation with pointer jumping (GP-11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.session import Rounds


#: Edges that one task handles; the number of tasks follows the edges.
EDGES_A_TASK = 200_000


def _forest(batches):
    """A task's edges as stars around the least node of each tree that they make: no more edges than nodes."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def out():
        nodes = [(x, find(x)) for x in list(parent)]
        rows = [(x, r) for x, r in nodes if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["u", "v"])

    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            i, j = find(x), find(y)
            if i != j:
                parent[max(i, j)] = min(i, j)
        if len(parent) > 2_000_000:  # bounded memory: later edges make trees of their own
            yield out()
            parent.clear()
    yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges over longs -> (id, component), component the smallest id that is reachable.

    Each round hooks every node's label onto the smallest label next to it and then halves the label
    chains, so the number of rounds follows the logarithm of the diameter, not the diameter. Every step is an
    equi-join or a min aggregate (partial sums on the map side), so that no adjacency list is ever gathered. Null ends
    and loops are ignored; nodes without an edge don't appear.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    keep = Rounds(edges.sparkSession)
    e = keep.written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(_forest, "u long, v long").distinct(), "edges")
    parts = max(4, -(-e.count() // EDGES_A_TASK))
    # every node points at its smallest neighbour or itself
    labels = keep.written(e.union(e.select("v", "u")).groupBy(F.col("u").alias("id")).agg(F.min("v").alias("m")).select("id", F.least("id", "m").alias("component")).coalesce(parts), "labels")
    for _ in range(max_rounds):
        a, b = labels.select(F.col("id").alias("u"), F.col("component").alias("cu")), labels.select(F.col("id").alias("v"), F.col("component").alias("cv"))
        # contract: edges between labels; those within one label are done
        e = keep.written(e.join(a, "u").join(b, "v").where("cu <> cv").select(F.greatest("cu", "cv").alias("u"), F.least("cu", "cv").alias("v")).distinct().coalesce(parts), "edges")
        hook = e.groupBy("u").agg(F.min("v").alias("to"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = labels.join(jump, "component", "left").select("id", F.coalesce("next", "component").alias("component"), (F.col("next") != F.col("component")).alias("moved"))
        step = step.join(hook, step.component == hook.u, "left").select("id", F.coalesce("to", "component").alias("component"), (F.coalesce("moved", F.lit(False)) | F.col("to").isNotNull()).alias("moved"))
        step = keep.written(step.coalesce(parts), "labels")
        labels = step.select("id", "component")
        if step.where("moved").isEmpty():
            return labels
    raise RuntimeError("components did not settle")
