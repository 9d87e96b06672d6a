"""Tree distances and optimal transport."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.operators.distance import distances, euclid, scan
from graftwork.session import batches_in_task, read_in_task, write_table, written

#: Cells of a written cost table that one task may hold for the exact plan; `located_plan` holds none and has no bound.
EXACT_CELLS = 1 << 27
#: Cells of a cost matrix at all.
COST_CELLS = 1 << 28
#: Cells from which the simplex takes its first prices; of more, every so many rows and columns.
START_CELLS = 1 << 25
#: Cells of a row, and of a column, that the simplex looks at between its passes over all cells.
NEAR_CELLS = 32


def discretize(tree: DataFrame, points: DataFrame, resolution: int = 10) -> DataFrame:
    """OT-01: (pos, mass): nodes with the mean weight of their edges, and resolution - 2 places inside each edge with its weight;
    of places that fall together the largest mass stays."""
    p = points.select("id", "pos")
    node = tree.select(F.explode(F.array("u", "v")).alias("id"), "w").groupBy("id").agg(F.avg("w").alias("mass")).join(p, "id").select("pos", "mass")
    ends = tree.join(p.select(F.col("id").alias("u"), F.col("pos").alias("p")), "u").join(p.select(F.col("id").alias("v"), F.col("pos").alias("q")), "v")
    if resolution > 2:
        step = ends.select("p", "q", F.col("w").cast("double").alias("mass"), F.explode(F.sequence(F.lit(1), F.lit(resolution - 2))).alias("k"))
        t = F.col("k") / float(resolution - 1)
        node = node.unionAll(step.select(F.zip_with("p", "q", lambda x, y: x + (y - x) * t).alias("pos"), "mass"))
    return node.groupBy("pos").agg(F.max("mass").alias("mass"))


def histogram(measure: DataFrame) -> DataFrame:
    """OT-02: masses over their sum."""
    total = measure.agg(F.sum("mass").alias("total"))  # one row
    return measure.crossJoin(F.broadcast(total)).withColumn("mass", F.col("mass") / F.col("total")).drop("total")


def _all_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every row of a with every row of b, at most `COST_CELLS`: a cost matrix is all pairs by its meaning, so its size is checked."""
    _check_cells(a, b)
    return a.crossJoin(b)


def _check_cells(a: DataFrame, b: DataFrame) -> None:
    n, m = a.count(), b.count()
    if n * m > COST_CELLS:
        raise ValueError(f"{n} x {m} cells: more than {COST_CELLS}; discretize more coarsely")


def point_costs(a: DataFrame, b: DataFrame) -> DataFrame:
    """OT-03: (i, j, cost) of all pairs of (id, pos); the cost matrix is the result itself."""
    return _all_pairs(a.select(F.col("id").alias("i"), F.col("pos").alias("p")), b.select(F.col("id").alias("j"), F.col("pos").alias("q"))).select("i", "j", euclid("p", "q").alias("cost"))


def segment_distance(u1: Column, v1: Column, u2: Column, v2: Column) -> Column:
    """OT-04: root mean square distance of two plane segments run through alike, oriented by the nearer ends."""
    x = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    turn = euclid(u1, v2) + euclid(v1, u2) < euclid(u1, u2) + euclid(v1, v2)
    s, t = F.when(turn, v2).otherwise(u2), F.when(turn, u2).otherwise(v2)
    b = x(v1, t)
    a = x(x(u1, s), b)
    return F.sqrt(F.greatest(F.lit(0.0), dot(a, a) / 3 + dot(a, b) + dot(b, b)))


def segment_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """OT-04 of all pairs of rows, each both ends of a segment one after the other."""
    d = x.shape[1] // 2
    (u1, v1), (u2, v2) = ((z[:, :d], z[:, d:]) for z in (x, y))
    turn = distances(u1, v2) + distances(v1, u2) < distances(u1, u2) + distances(v1, v2)
    aa, ab, bb = (np.zeros(turn.shape) for _ in range(3))
    for c in range(d):
        b = v1[:, c, None] - np.where(turn, u2[None, :, c], v2[None, :, c])
        a = u1[:, c, None] - np.where(turn, v2[None, :, c], u2[None, :, c]) - b
        aa += a * a
        ab += a * b
        bb += b * b
    return np.sqrt(np.maximum(0.0, aa / 3 + ab + bb))


def edge_costs(a: DataFrame, b: DataFrame) -> DataFrame:
    """OT-05: (i, j, cost) of all pairs of (id, p, q) edges, block by block."""
    _check_cells(a, b)
    arrow = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("cost", pa.float64())])

    def fn(i, x, _, chunks):
        step = 256
        for j, y, _ in chunks:
            for k in range(0, len(i), step):
                c = segment_distances(x[k : k + step], y)
                yield np.repeat(i[k : k + step], len(j)), np.tile(j, len(c)), c.ravel()

    return scan(*(t.select("id", F.concat("p", "q").alias("pos")) for t in (a, b)), fn, "i long, j long, cost double", arrow)


def sinkhorn(costs: DataFrame, a: DataFrame, b: DataFrame, reg: float = 0.1, rounds: int = 50) -> DataFrame:
    """OT-06, reg > 0: (i, j, flow, cost): the kernel scaled by rows and columns in turn: two aggregates a round. a and b: (id, mass)."""
    k = written(costs.select("i", "j", "cost", F.exp(-F.col("cost") / reg).alias("k")), "kernel")
    v = written(b.select(F.col("id").alias("j"), F.lit(1.0).alias("v")), "v")
    u = None
    for _ in range(rounds):
        s = k.join(v, "j").groupBy("i").agg(F.sum(F.col("k") * F.col("v")).alias("s"))
        u = written(s.join(a.select(F.col("id").alias("i"), "mass"), "i").select("i", (F.col("mass") / F.col("s")).alias("u")), "u")
        s = k.join(u, "i").groupBy("j").agg(F.sum(F.col("k") * F.col("u")).alias("s"))
        v = written(s.join(b.select(F.col("id").alias("j"), "mass"), "j").select("j", (F.col("mass") / F.col("s")).alias("v")), "v")
    return k.join(u, "i").join(v, "j").select("i", "j", (F.col("u") * F.col("k") * F.col("v")).alias("flow"), "cost")


def _matched(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Masses in whole units, 2^52 for the larger side; both sides alike where their totals agree to rounding."""
    total, unit = max(a.sum(), b.sum()), 1 << 52
    x, y = ([round(m) for m in (t / total * unit).tolist()] for t in (a, b))
    gap = sum(x) - sum(y)
    if gap and abs(gap) <= unit * 1e-9:
        t = x if gap < 0 else y
        t[max(range(len(t)), key=t.__getitem__)] += abs(gap)
    return x, y


class Costs:
    """A cost matrix by its blocks: of a matrix, or of the distances between rows of x and of y, which are reckoned anew each time and
    not kept. `more` rows and columns of zeros follow."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None = None, distance: Callable | None = None, more: tuple[int, int] = (0, 0)) -> None:
        self.x, self.y, self.distance, self.more = x, y, distance, more
        self.real = x.shape if y is None else (len(x), len(y))
        self.shape = n, m = self.real[0] + more[0], self.real[1] + more[1]
        self.step = max(1, (1 << 17) // max(1, m))  # rows whose cells stay in a processor's cache

    def taken(self, rows: np.ndarray, cols: np.ndarray, more: tuple[int, int]) -> Costs:
        if self.y is not None:
            return Costs(self.x[rows], self.y[cols], self.distance, more)
        return Costs(self.x if (len(rows), len(cols)) == self.x.shape else self.x[np.ix_(rows, cols)], None, None, more)

    def __call__(self, i: slice, j: slice = slice(None)) -> np.ndarray:
        got = self.x[i, j] if self.y is None else self.distance(self.x[i], self.y[j])
        if not any(self.more):
            return got
        out = np.zeros([len(range(*t.indices(k))) for t, k in zip((i, j), self.shape, strict=True)])
        out[: got.shape[0], : got.shape[1]] = got
        return out

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out, ok = np.zeros(len(i)), np.flatnonzero((i < self.real[0]) & (j < self.real[1]))
        if self.y is None:
            out[ok] = self.x[i[ok], j[ok]]
        else:
            for k in range(0, len(ok), 32):
                t = ok[k : k + 32]
                out[t] = self.distance(self.x[i[t]], self.y[j[t]]).diagonal()
        return out

    def blocks(self, s: int = 1) -> Iterator[slice]:
        """All rows in blocks, or every s-th."""
        return (slice(k, min(k + self.step * s, self.shape[0]), s) for k in range(0, self.shape[0], self.step * s))


def _first_prices(cost: np.ndarray | Costs, a: np.ndarray, b: np.ndarray, levels: int = 8, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Prices of rows and columns near those of a least plan, whatever they are taken for: kernels of ever smaller reg, scaled by rows and
    columns in turn, in single precision, on `START_CELLS` at most; other rows and columns follow from their cells."""
    cost = cost if isinstance(cost, Costs) else Costs(cost)
    n, m = cost.shape
    s = math.ceil(math.sqrt(n * m / START_CELLS))
    a, b = a[::s], b[::s]
    c, low, high, k = np.empty((len(a), len(b)), np.float32), np.inf, -np.inf, 0
    for i in cost.blocks(s):
        part = cost(i, slice(None, None, s))
        low, high = min(low, float(part.min())), max(high, float(part.max()))
        c[k : k + len(part)] = part
        k += len(part)
    if not 0 < high - low < np.inf:
        return np.zeros(n), np.zeros(m)
    c -= np.float32(low)
    c /= np.float32(high - low)
    a, b = ((t / t.sum()).astype(np.float32) for t in (a, b))
    u, v, reg = np.zeros_like(a), np.zeros_like(b), float(c.mean()) / 4
    k, tiny = np.empty_like(c), np.float32(1e-30)
    with np.errstate(all="ignore"):
        for _ in range(levels):
            for i in range(0, len(c), 256):
                k[i : i + 256] = np.exp(np.clip((u[i : i + 256, None] + v - c[i : i + 256]) / reg, -60, 30))
            y = np.ones_like(v)
            for _ in range(rounds):
                x = a / np.maximum(k @ y, tiny)
                y = b / np.maximum(x @ k, tiny)
            u, v = (p + reg * np.log(np.clip(np.nan_to_num(q, nan=1.0), 1e-30, 1e30)).astype(np.float32) for p, q in ((u, x), (v, y)))
            reg /= 2
    u, v = u.astype(float) * (high - low) + low, v.astype(float) * (high - low)
    if s > 1:
        few, v = u, np.full(m, np.inf)
        for i in cost.blocks(s):
            v = np.minimum(v, (cost(i) - few[i.start // s :][: len(range(*i.indices(n))), None]).min(0))
        u = np.concatenate([(cost(i) - v).min(1) for i in cost.blocks()])
    return u, v


def _near_cells(cost: Costs, u: np.ndarray, v: np.ndarray, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, float]:
    """(row, column, cost) of every row's and every column's `most` cells of least cost above the prices, what each row's others cost
    above the columns' at least, and the largest cost."""
    n, m = cost.shape
    found, edge, largest = [], np.full(n, np.inf), 0.0
    top, rest = np.zeros((0, m), np.int64), np.zeros((0, m))
    for i in cost.blocks():
        at = np.arange(*i.indices(n))
        c = cost(i)
        largest = max(largest, float(np.abs(c).max()))
        r = c - v
        j = np.argpartition(r, most - 1, 1)[:, :most] if most < m else np.broadcast_to(np.arange(m), r.shape)
        if most < m:
            edge[i] = np.take_along_axis(r, j, 1).max(1)
        found.append((np.repeat(at, j.shape[1]), j.ravel(), np.take_along_axis(c, j, 1).ravel()))
        rest, top = np.concatenate([rest, c]), np.concatenate([top, np.broadcast_to(at[:, None], c.shape)])
        if len(rest) > 4 * most or at[-1] == n - 1:
            if most < len(rest):
                k = np.argpartition(rest - u[top], most - 1, 0)[:most]
                rest, top = np.take_along_axis(rest, k, 0), np.take_along_axis(top, k, 0)
    j = np.broadcast_to(np.arange(m), top.shape)
    found.append((top.ravel(), j.ravel(), rest.ravel()))
    return tuple(np.concatenate(t) for t in zip(*found, strict=True)), edge, largest


def _by_row(cells: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells by row, each once, and where rows start."""
    i, j, c = cells
    order = np.lexsort((j, i))
    i, j, c = i[order], j[order], c[order]
    new = np.r_[True, (np.diff(i) != 0) | (np.diff(j) != 0)]
    i, j, c = i[new], j[new], c[new]
    return i, j, c, np.searchsorted(i, np.arange(n + 1))


def _first_basis(cost: np.ndarray | Costs, left: list[int], need: list[int], near: tuple | None = None) -> tuple[list[int], list[int], list[int]]:
    """(parent, flow, order) of a tree over rows and columns (numbered after them): cells by rising cost above the first prices take what
    they can, and the side that runs out hangs on the other. Arcs without flow lead from a row up to a column, so that no pivots cycle."""
    cost = cost if isinstance(cost, Costs) else Costs(cost)
    n, m = cost.shape
    u, v, (_, cj, cc, start), edge, _ = near or _near(cost, left, need)
    left, need, start = list(left), list(need), start.tolist()
    parent, flow, order = [-1] * (n + m), [0] * (n + m), []
    free, rows, cols = -v, n, m  # free: infinite where a column is closed

    def least(i: int) -> tuple[float, int]:
        r = cc[start[i] : start[i + 1]] + free[cj[start[i] : start[i + 1]]]
        k = int(r.argmin())
        if r[k] <= edge[i] and r[k] < np.inf:
            return float(r[k] - u[i]), int(cj[start[i] + k])
        r = cost(slice(i, i + 1))[0] + free
        k = int(r.argmin())
        return float(r[k] - u[i]), k

    got = [least(i) for i in range(n)]
    best = [j for _, j in got]
    heap = [(c, i) for i, (c, _) in enumerate(got)]
    heapq.heapify(heap)
    open_ = [True] * m
    while heap:
        c, i = heap[0]
        j = best[i]
        if not open_[j]:
            c, best[i] = least(i)
            heapq.heapreplace(heap, (c, i))
            continue
        x = min(left[i], need[j])
        if rows == cols == 1:
            parent[i], flow[i] = n + j, x
            return parent, flow, [*order, i, n + j]
        left[i] -= x
        need[j] -= x
        if rows == 1 or (cols > 1 and not need[j]):
            open_[j], free[j], parent[n + j], flow[n + j] = False, np.inf, i, x
            cols -= 1
            order.append(n + j)
        else:
            heapq.heappop(heap)
            parent[i], flow[i] = n + j, x
            rows -= 1
            order.append(i)
    raise AssertionError("masses don't match")


def _near(cost: Costs, left: list[int], need: list[int]) -> tuple:
    """First prices, the cells near them by row, and the rest of `_near_cells`."""
    u, v = _first_prices(cost, np.array(left, float), np.array(need, float))
    cells, edge, largest = _near_cells(cost, u, v, NEAR_CELLS)
    return u, v, _by_row(cells, cost.shape[0]), edge, largest


def least_plan(cost: np.ndarray | Costs, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, flow, cost) of a least-cost flow between masses a and b, of as much as both sides have: the transportation simplex, on
    whole units of 2^-52 of the mass. It is least among some near cells; then all cells are priced, and those that make it cheaper join
    these, until none does. Trees keep strongly feasible, so that it ends."""
    rows, cols = np.flatnonzero(a > 0), np.flatnonzero(b > 0)
    if not len(rows) or not len(cols):
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)
    left, need = _matched(a[rows], b[cols])
    rows, cols = rows[np.array(left, float) > 0], cols[np.array(need, float) > 0]
    left, need = [x for x in left if x], [x for x in need if x]
    gap = sum(left) - sum(need)
    if gap:  # what one side has too much goes nowhere, at no cost
        (left if gap < 0 else need).append(abs(gap))
    cost = (cost if isinstance(cost, Costs) else Costs(cost)).taken(rows, cols, (int(gap < 0), int(gap > 0)))
    n, m = cost.shape
    near = _near(cost, left, need)
    parent, flow, hung = _first_basis(cost, left, need, near)
    cells, root = near[2][:3], hung[-1]
    tol = 1e-12 * max(1e-300, near[4])
    child = np.array(hung[:-1])
    above = np.array(parent)[child]
    price = np.zeros(n + m)  # of the arc to a node's parent
    price[child] = cost.at(np.minimum(child, above), np.maximum(child, above) - n)
    price = price.tolist()
    size, kids = [1] * (n + m), [[] for _ in range(n + m)]
    for x in hung[:-1]:  # a node comes before its parent
        size[parent[x]] += size[x]
        kids[parent[x]].append(x)
    walk, todo = [], [root]
    while todo:
        walk.append(x := todo.pop())
        todo.extend(kids[x])
    del kids
    walk = np.array(walk)  # nodes, each before those that hang on it and these together
    place = np.empty(n + m, int)
    place[walk] = np.arange(n + m)
    pot = np.zeros(n + m)  # cost of a tree's arc: pot[row] - pot[column]

    def settle() -> None:
        at = [0.0] * (n + m)
        for x in walk[1:].tolist():
            at[x] = at[parent[x]] + price[x] if x < n else at[parent[x]] - price[x]
        pot[:] = at

    def pivot(i: int, j: int, gain: float, c: float) -> None:
        """The cell (i, j) enters; of the arcs that run dry the last on the cycle from its top along its way leaves."""
        p, q = i, n + j
        least, out, side = None, -1, 0
        while p != q:
            if size[p] < size[q]:
                if p < n and (least is None or flow[p] < least):
                    least, out, side = flow[p], p, 0
                p = parent[p]
            else:
                if q >= n and (least is None or flow[q] <= least):
                    least, out, side = flow[q], q, 1
                q = parent[q]
        top, p, q = p, i, n + j
        if least:
            while p != top:
                flow[p] += -least if p < n else least
                p = parent[p]
            while q != top:
                flow[q] += -least if q >= n else least
                q = parent[q]
        x, up, f = (n + j, i, least) if side else (i, n + j, least)
        count, start, to = size[out], int(place[out]), int(place[up]) + 1
        p, q = parent[out], up
        while p != top:
            size[p] -= count
            p = parent[p]
        while q != top:
            size[q] += count
            q = parent[q]
        on, end, below, parts = int(place[x]), 0, 0, []
        while True:  # turn the way from the cell's end to the leaving arc round
            old, g, h, k = parent[x], flow[x], price[x], size[x]
            if below:
                first = int(place[x])
                parts += walk[first:on], walk[end : first + k]
                on, end = first, first + k
            else:
                end = on + k
                parts.append(walk[on:end])
            parent[x], flow[x], price[x], size[x] = up, f, c, count - below
            if x == out:
                break
            x, up, f, c, below = old, x, g, h, k
        moved = np.concatenate(parts)
        pot[moved] += -gain if side else gain
        if to <= start:
            low, high = to, start + count
            walk[low:high] = np.concatenate([moved, walk[to:start]])
        else:
            low, high = start, to
            walk[low:high] = np.concatenate([walk[start + count : to], moved])
        place[walk[low:high]] = np.arange(low, high)

    while True:
        ci, cj, cc, start = _by_row(cells, n)
        first, begin = np.flatnonzero(np.diff(start)), start.tolist()
        while True:
            settle()
            worst = np.minimum.reduceat(cc + pot[n + cj] - pot[ci], start[first])
            todo = np.argsort(worst, kind="stable")
            todo = todo[worst[todo] < -tol]
            if not len(todo):
                break
            for i in first[todo].tolist():
                s, e = begin[i], begin[i + 1]
                r = cc[s:e] + pot[n + cj[s:e]]
                k = int(r.argmin())
                if (gain := float(r[k] - pot[i])) < -tol:
                    pivot(i, int(cj[s + k]), gain, float(cc[s + k]))
        more = [(ci, cj, cc)]
        for block in cost.blocks():
            c = cost(block)
            r = c + pot[n:] - pot[block, None]
            hit = np.flatnonzero(r.min(1) < -tol)
            if len(hit):
                k = min(m, NEAR_CELLS)
                j = np.argpartition(r[hit], k - 1, 1)[:, :k]
                i = np.repeat(hit, k)
                j = j.ravel()
                ok = r[i, j] < -tol
                i, j = i[ok], j[ok]
                more.append((block.start + i, j, c[i, j]))
        if len(more) == 1:
            break
        cells = tuple(np.concatenate(t) for t in zip(*more, strict=True))
    total = max(a.sum(), b.sum())
    got = [(x, y - n, f, c) if x < n else (y, x - n, f, c) for x, (y, f, c) in enumerate(zip(parent, flow, price, strict=True)) if y >= 0 and f > 4096]
    got = [t for t in got if t[0] < cost.real[0] and t[1] < cost.real[1]]
    i, j, f, c = (np.array(t) for t in zip(*got, strict=True)) if got else (np.zeros(0, int),) * 4
    return rows[i], cols[j], f * (total / (1 << 52)), c.astype(float)


def exact_plan(cost: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least-cost flow as a matrix."""
    flow = np.zeros(cost.shape)
    i, j, f, _ = least_plan(cost, np.asarray(a, float), np.asarray(b, float))
    flow[i, j] = f
    return flow


def earth_mover(costs: DataFrame, a: DataFrame, b: DataFrame, reg: float = 0.1, rounds: int = 50) -> DataFrame:
    """OT-06, OT-07: the plan (i, j, flow, cost) between histograms (id, mass); reg 0: exactly, in one task of checked size."""
    if reg > 0:
        return sinkhorn(costs, a, b, reg, rounds)
    if (cells := a.count() * b.count()) > EXACT_CELLS:
        raise ValueError(f"{cells} cells, more than {EXACT_CELLS}, for the exact plan: give reg > 0")
    table = write_table(costs.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("cost").cast("double")), "cells")
    sides = [write_table(t.select(F.col("id").cast("long"), F.col("mass").cast("double")), "cells") for t in (a, b)]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (read_in_task(t).sort_by("id") for t in sides)
                (r, xm), (s, ym) = ((t.column("id").to_numpy(), t.column("mass").to_numpy()) for t in (x, y))
                c = np.full((len(r), len(s)), np.nan)
                for t in batches_in_task(table, 1 << 18):
                    i, j, k = (np.asarray(t.column(e)) for e in ("i", "j", "cost"))
                    p, q = (np.minimum(np.searchsorted(e, o), len(e) - 1) for e, o in ((r, i), (s, j)))
                    ok = (r[p] == i) & (s[q] == j)
                    c[p[ok], q[ok]] = k[ok]
                if np.isnan(c).any():
                    raise ValueError("the plan needs the cost of every pair")
                i, j, f, k = least_plan(c, xm, ym)
                yield pd.DataFrame({"i": r[i], "j": s[j], "flow": f, "cost": k})

    return costs.sparkSession.range(1).mapInPandas(run, "i long, j long, flow double, cost double")


def located_plan(a: DataFrame, b: DataFrame, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] = distances) -> DataFrame:
    """OT-07: as `earth_mover` with reg 0, between (id, pos, mass), costs being the distances of all pairs of rows. The task reckons costs
    block by block as it needs them; no cost is written, and it holds some cells a row."""
    sides = [write_table(t.select(F.col("id").cast("long"), F.col("pos").cast("array<double>"), F.col("mass").cast("double")), "masses") for t in (a, b)]

    def run(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (read_in_task(t).combine_chunks().sort_by("id") for t in sides)
                if not len(x) or not len(y):
                    continue
                (r, p, xm), (s, q, ym) = ((t.column("id").to_numpy(), np.array(t.column("pos").to_pylist(), float), t.column("mass").to_numpy()) for t in (x, y))
                i, j, f, k = least_plan(Costs(p, q, distance), xm, ym)
                yield pd.DataFrame({"i": r[i], "j": s[j], "flow": f, "cost": k})

    return a.sparkSession.range(1).repartition(1).mapInPandas(run, "i long, j long, flow double, cost double")


def transport_cost(plan: DataFrame) -> DataFrame:
    return plan.agg(F.sum(F.col("flow") * F.col("cost")).alias("distance"))


def flow_graph(plan: DataFrame, scale: float = 2000.0) -> DataFrame:
    """OT-08: (u, v, w) of flows above 1e-8, scaled."""
    return plan.where("flow > 1e-8").select(F.col("i").alias("u"), F.col("j").alias("v"), (F.col("flow") * scale).alias("w"))


def tree_edges_located(tree: DataFrame, points: DataFrame) -> DataFrame:
    """(id, p, q, mass): a tree's edges with their ends' places; ids from the ends."""
    p = points.select("id", "pos")
    e = tree.join(p.select(F.col("id").alias("u"), F.col("pos").alias("p")), "u").join(p.select(F.col("id").alias("v"), F.col("pos").alias("q")), "v")
    return e.select((F.col("u") * 1_000_000 + F.col("v")).alias("id"), "p", "q", F.col("w").cast("double").alias("mass"))
