"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one a shard, searched by beam.

Vectors get one more component that makes all norms equal, so that nearness by inner product is nearness by distance. In a
shard, points enter in batches: a greedy search of the graph so far proposes neighbours (with the batch's own), robust
pruning keeps an edge to the nearest proposal and drops others that `ALPHA` times their distance to a kept one doesn't
exceed, and edges back are pruned likewise when a point has too many. A query's beam runs over every shard; scores of what
it finds are inner products of the original vectors in double precision.

Equal vectors are one point with its smallest ids (as many as an answer can name), gathered by partial aggregates, so that a
vector that stands a million times is no burden and nothing is lost. Shards are dealt by a hash of the vector and hold about
`SHARD` points at most; each has a graph, however few points it holds. A task reads a shard's graph once and then all queries
as a stream, so that its memory is bounded by the shard.

Null, empty and zero vectors and those with null or non-finite components take no part; vectors of different lengths
don't meet. Ties go to the smaller id, of what the beams hold: where more distinct vectors tie at the edge than a beam has places,
some of them aren't seen. Rows with equal ids count as one candidate each, but a query never finds its own id; as queries, those
with different vectors have a ranking each, exact repeats one together. Null ids take no part. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.session import written

DEGREE, SLACK, BUILD_BEAM, BEAM, ALPHA = 32, 48, 64, 128, 1.2
SHARDS, SHARD = 8, 1 << 16
#: Points that a graph begins with, and that enter at once at most.
FIRST, BATCH = 8, 512


def _d2(x: np.ndarray, norms: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances less the query's norm, (A, K) from ids (A, K) and q (A, d)."""
    return norms[ids] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0]


class Graph:
    def __init__(self, x: np.ndarray) -> None:
        self.x = np.ascontiguousarray(x, np.float32)
        self.norms = (self.x**2).sum(1)
        n = len(x)
        self.edges = np.repeat(np.arange(n, dtype=np.int32)[:, None], SLACK, 1)  # padded with the point itself
        self.degree = np.zeros(n, np.int32)
        self.entries = np.zeros(0, np.int32)

    def search(self, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the beam's points, best first; id -1 where there are fewer."""
        n, m = len(self.x), len(q)
        ids = np.full((m, beam), -1, np.int32)
        dist = np.full((m, beam), np.inf, np.float32)
        e = self.entries[:beam]
        ids[:, : len(e)] = e
        dist[:, : len(e)] = self.norms[e] - 2 * (q @ self.x[e].T)
        open_ = ids >= 0
        seen = np.zeros((m, n), bool)
        seen[:, e] = True
        act = np.arange(m)
        while len(act):
            d = np.where(open_[act], dist[act], np.inf)
            k = np.argpartition(d, width - 1, 1)[:, :width]
            dk = np.take_along_axis(d, k, 1)
            live = np.isfinite(dk)
            keep = live.any(1)
            act, k, live = act[keep], k[keep], live[keep]
            if not len(act):
                break
            cur = np.where(live, np.take_along_axis(ids[act], k, 1), -1)
            o = open_[act]
            np.put_along_axis(o, k, False, 1)
            open_[act] = o
            nb = self.edges[np.maximum(cur, 0)]
            rows = np.arange(len(act))[:, None]
            new = np.zeros(nb.shape, bool)
            for w in range(width):  # in turn, so that a point that two of them name counts once
                new[:, w] = ~seen[act[:, None], nb[:, w]] & live[:, w, None]
                seen[act[:, None], nb[:, w]] |= new[:, w]
            nb, new = nb.reshape(len(act), -1), new.reshape(len(act), -1)
            dn = np.where(new, _d2(self.x, self.norms, nb, q[act]), np.inf).astype(np.float32)
            ai, ad, ao = np.hstack([ids[act], nb]), np.hstack([dist[act], dn]), np.hstack([open_[act], new])
            best = np.argpartition(ad, beam - 1, 1)[:, :beam]
            ids[act], dist[act], open_[act] = ai[rows, best], ad[rows, best], ao[rows, best] & np.isfinite(ad[rows, best])
        order = np.argsort(dist, 1, kind="stable")
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return np.where(np.isfinite(dist), ids, -1), dist

    def prune(self, points: np.ndarray, cand: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges padded with the point, degrees) that robust pruning keeps of candidates (-1: none); distances true squares."""
        dist = np.where((cand < 0) | (cand == points[:, None]), np.inf, dist)
        order = np.argsort(dist, 1, kind="stable")
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        cand = np.maximum(cand, 0)
        v = self.x[cand]
        nn = self.norms[cand]
        mutual = nn[:, :, None] + nn[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        alive = np.isfinite(dist)
        out = np.repeat(points[:, None], SLACK, 1).astype(np.int32)
        deg = np.zeros(len(points), np.int32)
        rows = np.arange(len(points))
        for r in range(DEGREE):
            k = alive.argmax(1)
            any_ = alive[rows, k]
            if not any_.any():
                break
            out[any_, r] = cand[rows, k][any_]
            deg += any_
            drop = ALPHA**2 * np.maximum(mutual[rows, k], 0) <= dist
            alive &= ~(drop & any_[:, None])
            alive[rows, k] = False
        return out, deg

    def _true(self, points: np.ndarray, cand: np.ndarray) -> np.ndarray:
        return np.maximum(_d2(self.x, self.norms, np.maximum(cand, 0), self.x[points]) + self.norms[points][:, None], 0)

    def _set(self, points: np.ndarray, cand: np.ndarray, step: int = 256) -> None:
        for k in range(0, len(points), step):
            p, c = points[k : k + step], cand[k : k + step]
            self.edges[p], self.degree[p] = self.prune(p, c, self._true(p, c))

    def _back(self, points: np.ndarray) -> None:
        """Edges back from the neighbours of the points."""
        e = self.edges[points]
        has = np.arange(SLACK)[None, :] < self.degree[points][:, None]
        to, frm = e[has], np.repeat(points, self.degree[points])
        order = np.lexsort((frm, to))
        to, frm = to[order], frm[order]
        starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, int)
        counts = np.diff(np.r_[starts, len(to)])
        rank = np.arange(len(to)) - np.repeat(starts, counts)
        hub = to[starts]
        known = (self.edges[to] == frm[:, None]).any(1)
        fits = np.repeat(self.degree[hub] + counts <= SLACK, counts)
        add = fits & ~known
        for r in range(int(rank[add].max()) + 1 if add.any() else 0):  # one edge a hub at a time
            i = np.flatnonzero(add & (rank == r))
            self.edges[to[i], self.degree[to[i]]] = frm[i]
            self.degree[to[i]] += 1
        over = hub[~(self.degree[hub] + counts <= SLACK) & ~fits[starts]]
        if len(over):
            where = {int(h): (int(s), int(c)) for h, s, c in zip(hub, starts, counts, strict=True)}
            for k in range(0, len(over), 256):
                part = over[k : k + 256]
                most = max(where[int(h)][1] for h in part)
                cand = np.full((len(part), SLACK + most), -1, np.int32)
                cand[:, :SLACK] = self.edges[part]
                for j, h in enumerate(part):
                    s, c = where[int(h)]
                    cand[j, SLACK : SLACK + c] = frm[s : s + c]
                cand.sort(1)
                cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
                self._set(part, cand)

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 5) -> Graph:
        g = cls(x)
        n = len(x)
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        first = order[:FIRST]
        g.entries = first
        d = g.norms[first][None, :] - 2 * (g.x[first] @ g.x[first].T)
        near = np.argsort(d, 1, kind="stable")[:, : BUILD_BEAM + 1]
        g._set(first, first[near])
        g._back(first)
        at = len(first)
        while at < n:
            batch = order[at : at + min(BATCH, at)]
            cand, _ = g.search(g.x[batch], BUILD_BEAM)
            d = g.norms[batch][None, :] - 2 * (g.x[batch] @ g.x[batch].T)
            near = batch[np.argpartition(d, min(8, len(batch) - 1), 1)[:, :9]]
            both = np.hstack([cand, near])
            both.sort(1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            g._set(batch, both)
            g._back(batch)
            at += len(batch)
        mean = g.x.mean(0)
        g.entries = np.unique(np.r_[np.argmin(g.norms - 2 * (g.x @ mean)), order[:15]]).astype(np.int32)
        return g


def _clean(k: int):
    """(vector, ids) with each task's smallest ids of equal vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sorted(v)[:k] for v in held.values()], pa.list_(pa.int64()))], names=["v", "ids"])

        for b in batches:
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                raw = usable(v)
                if raw is not None:
                    ids = held.setdefault(raw, [])
                    ids.append(i)
                    if len(ids) > 4 * k:
                        ids[:] = sorted(ids)[:k]
            if len(held) > 100_000:
                yield out()
                held.clear()
        yield out()

    return run


def usable(v: list | None) -> bytes | None:
    """The vector's doubles, or None if it takes no part."""
    if not v or any(c is None for c in v):
        return None
    a = np.array(v, np.float64) + 0.0  # no negative zeros
    return a.tobytes() if np.isfinite(a).all() and a.any() else None


def _keep_usable(batches):
    for b in batches:
        raw = [usable(v) for v in b.column("v").to_pylist()]
        keep = [r is not None for r in raw]
        yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep, pa.bool_())), pa.array([r for r in raw if r is not None], pa.binary())], names=["id", "v"])


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


_INDEX = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("place", pa.int32()), ("v", pa.binary()), ("ids", pa.list_(pa.int64())), ("edges", pa.binary()), ("entry", pa.bool_())])
_INDEX_DDL = "dim int, shard int, place int, v binary, ids array<long>, edges binary, entry boolean"


def _level(x: np.ndarray, largest: float) -> np.ndarray:
    """The vectors with one more component that makes all norms the largest one."""
    return np.hstack([x, np.sqrt(np.maximum(largest - (x**2).sum(1), 0))[:, None]])


def _build(largest: dict[int, float]):
    def run(key, t):
        t = t.sort_by("v")  # runs agree
        dim, shard, n = key[0].as_py(), key[1].as_py(), t.num_rows
        g = Graph.build(_level(_matrix(t.column("v")), largest[dim]))
        edges = [e[:d].tobytes() for e, d in zip(g.edges, g.degree, strict=True)]
        return pa.Table.from_arrays([pa.array([dim] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), t.column("v"), t.column("ids"), pa.array(edges, pa.binary()), pa.array(np.isin(np.arange(n), g.entries))], schema=_INDEX)

    return run


class _Shard:
    """One shard's graph, from its rows in order of place."""

    def __init__(self, rows: pa.Table, largest: float) -> None:
        self.x = _matrix(rows.column("v"))
        self.ids = rows.column("ids").to_pylist()
        self.graph = Graph(_level(self.x, largest))
        for i, e in enumerate(rows.column("edges").to_pylist()):
            a = np.frombuffer(e, np.int32)
            self.graph.edges[i, : len(a)] = a
        self.graph.entries = np.flatnonzero(rows.column("entry").to_numpy()).astype(np.int32)

    def answer(self, names: list[int], q: np.ndarray, k: int, beam: int) -> tuple[list, list]:
        """For each query the ids and the scores of its k nearest found."""
        found, _ = self.graph.search(np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32), max(beam, k + 2))
        score = np.where(found >= 0, np.einsum("akd,ad->ak", self.x[np.maximum(found, 0)], q), -np.inf)
        ids, scores = [], []
        for name, f, s in zip(names, found.tolist(), score, strict=True):
            best = np.argsort(-s, kind="stable")[: k + 1].tolist()
            edge = s[best[-1]]
            more = [j for j in range(len(f)) if s[j] == edge and j not in best] if len(f) > k + 1 else []
            pairs = sorted((-s[j], i) for j in [*best, *more] if f[j] >= 0 for i in self.ids[f[j]] if i != name)[:k]
            ids.append([i for _, i in pairs])
            scores.append([-z for z, _ in pairs])
        return ids, scores


def _search(k: int, largest: dict[int, float], beam: int):
    """Each shard's rows come first, in order of place, then its queries."""
    schema = pa.schema([("query_id", pa.int64()), ("ask", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(batches):
        shard, key, held = None, None, []
        for b in batches:
            at = 0
            while at < b.num_rows:
                mine = (b.column("dim")[at].as_py(), b.column("shard")[at].as_py())
                if mine != key:
                    shard, key, held = None, mine, []
                same = np.flatnonzero((b.column("dim").to_numpy()[at:] != mine[0]) | (b.column("shard").to_numpy()[at:] != mine[1]))
                part = b.slice(at, int(same[0]) if len(same) else b.num_rows - at)
                at += part.num_rows
                asks = part.column("asks").to_numpy(zero_copy_only=False)
                held += [part.filter(pa.array(~asks))] * bool((~asks).any())
                queries = part.filter(pa.array(asks))
                if not queries.num_rows or not held and shard is None:
                    continue
                if shard is None:
                    shard, held = _Shard(pa.Table.from_batches(held), largest[mine[0]]), []
                step = max(16, min(512, (64 << 20) // len(shard.x)))
                for a in range(0, queries.num_rows, step):
                    q = queries.slice(a, step)
                    ids, scores = shard.answer(q.column("id").to_pylist(), _matrix(q.column("v")), k, beam)
                    yield pa.RecordBatch.from_arrays([q.column("id"), q.column("ask"), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], schema=schema)

    return run


def build_index(points: DataFrame, largest: dict[int, float], count: Column) -> DataFrame:
    """The shards' graphs (dim, shard, place, v, ids, edges, entry) of the points (v, ids, dim), as a written table."""
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), count).cast("int"))
    return written(dealt.groupBy("dim", "shard").applyInArrow(_build(largest), _INDEX_DDL), "index")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shards: int | None = None, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k nearest found, of all rows but its own."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    found = rows.select("id", "v").mapInArrow(_clean(k + 1), "v binary, ids array<long>").groupBy("v").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    dim = (F.octet_length("v") / 8).cast("int")
    points = written(found.select("v", "ids", dim.alias("dim")), "points")
    norms = points.select("dim", "v").mapInArrow(_norms, "dim int, n long, most double").groupBy("dim").agg(F.sum("n").alias("n"), F.max("most").alias("most")).collect()  # a row for each length of vectors
    largest = {r.dim: r.most for r in norms}
    counts = {r.dim: max(shards or SHARDS, -(-r.n // SHARD)) for r in norms}
    count = F.element_at(F.create_map(*[F.lit(x) for item in (counts or {0: 1}).items() for x in item]), F.col("dim"))
    index = build_index(points, largest, count)
    asked = rows.where("asks").select("id", "v").mapInArrow(_keep_usable, "id long, v binary").dropDuplicates(["id", "v"]).withColumn("dim", dim)
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))).alias("shard"), "v", "id", F.xxhash64("v").alias("ask"), F.lit(True).alias("asks"))
    both = index.withColumn("asks", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    parts = max(sum(counts.values()), 1)
    hits = both.repartition(parts, "dim", "shard").sortWithinPartitions("dim", "shard", "asks", "place").mapInArrow(_search(k, largest, beam), "query_id long, ask long, ids array<long>, scores array<double>")
    flat = hits.select("query_id", "ask", F.explode(F.arrays_zip("ids", "scores")).alias("h")).select("query_id", "ask", F.col("h.ids").alias("vec_id"), F.col("h.scores").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return flat.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(batches):
    for b in batches:
        most: dict[int, list] = {}
        for d, v in zip(b.column("dim").to_pylist(), b.column("v").to_pylist(), strict=True):
            m = most.setdefault(d, [0, 0.0])
            m[0] += 1
            m[1] = max(m[1], float((np.frombuffer(v, np.float64) ** 2).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(list(most), pa.int32()), pa.array([m[0] for m in most.values()], pa.int64()), pa.array([m[1] for m in most.values()], pa.float64())], names=["dim", "n", "most"])
