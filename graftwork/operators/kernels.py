"""Numpy kernels over one graph: shortest paths, path counts, dependencies. Weights may be integers or floats; ties are exact
equality of path lengths, so that integer weights make them independent of the order of sums."""

from __future__ import annotations

import heapq

import numpy as np


class Csr:
    """An undirected graph with nodes 0..n-1 named by `ids` and edges in the order given."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, ids: np.ndarray | None = None) -> None:
        self.ids = np.unique(np.concatenate([u, v]) if ids is None else ids)
        self.n, self.m = len(self.ids), len(u)
        self.a, self.b, self.w = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v), np.asarray(w)
        src, dst, eid = np.r_[self.a, self.b], np.r_[self.b, self.a], np.r_[np.arange(self.m), np.arange(self.m)]
        order = np.lexsort((dst, src))
        self.dst, self.eid = dst[order], eid[order]
        self.start = np.searchsorted(src[order], np.arange(self.n + 1))
        self._lists()

    def _lists(self) -> None:
        w = self.w.tolist()
        dst, eid = self.dst.tolist(), self.eid.tolist()
        self.adj = [[(dst[k], eid[k], w[eid[k]]) for k in range(self.start[x], self.start[x + 1])] for x in range(self.n)]

    def reweigh(self, e: int, w) -> None:
        self.w[e] = w
        for x, y in ((self.a[e], self.b[e]), (self.b[e], self.a[e])):
            self.adj[x] = [(d, k, w if k == e else o) for d, k, o in self.adj[x]]

    def drop(self, gone: set[int]) -> None:
        at = np.fromiter(gone, np.int64, len(gone))
        for x in np.unique(np.r_[self.a[at], self.b[at]]).tolist():
            self.adj[x] = [t for t in self.adj[x] if t[1] not in gone]

    def dijkstra(self, source: int, target: int = -1, unweighted: bool = False) -> np.ndarray:
        """Distances from the source, infinite where there is no path; stops at the target."""
        dist = [float("inf")] * self.n
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            if x == target:
                break
            for y, _, w in self.adj[x]:
                c = d + (1 if unweighted else w)
                if c < dist[y]:
                    dist[y] = c
                    heapq.heappush(heap, (c, y))
        return np.array(dist, float)

    def dag(self, dist: np.ndarray, unweighted: bool = False) -> tuple[list[int], list[list[tuple[int, int]]]]:
        """Reached nodes by rising distance, and each one's (predecessor, edge) pairs on shortest paths."""
        order = [x for x in np.argsort(dist, kind="stable").tolist() if np.isfinite(dist[x])]
        d = dist.tolist()
        return order, [[(p, e) for p, e, w in self.adj[x] if d[p] + (1 if unweighted else w) == d[x]] if np.isfinite(d[x]) else [] for x in range(self.n)]

    def counts(self, order: list[int], pred: list, source: int) -> np.ndarray:
        """Numbers of shortest paths."""
        sigma = np.zeros(self.n)
        sigma[source] = 1
        for x in order:
            if x != source:
                sigma[x] = sum(sigma[p] for p, _ in pred[x])
        return sigma

    def brandes(self, source: int, unweighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(edge, node) dependencies of one source."""
        dist = self.dijkstra(source, unweighted=unweighted)
        order, pred = self.dag(dist, unweighted)
        sigma, delta, edge = self.counts(order, pred, source), np.zeros(self.n), np.zeros(self.m)
        for x in reversed(order):
            for p, e in pred[x]:
                c = sigma[p] / sigma[x] * (1 + delta[x])
                edge[e] += c
                delta[p] += c
        delta[source] = 0
        return edge, delta

    def walks(self, source: int, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edge, node) visits when every shortest path from each target back to the source is walked: many paths count
        many times. visits(x) = [x is a target] + visits of those x precedes, summed from far to near."""
        order, pred = self.dag(self.dijkstra(source))
        visits, edge = targets.astype(float), np.zeros(self.m)
        visits[source] = 0
        inner = np.zeros(self.n)
        for x in reversed(order):
            if x == source:
                continue
            for p, e in pred[x]:
                edge[e] += visits[x]
                if p != source:
                    visits[p] += visits[x]
                    inner[p] += visits[x]
        return edge, inner

    def weighted_walks(self, source: int, nw: np.ndarray) -> np.ndarray:
        """Edge visits of walks from all nodes where the first step counts max(nw[target], nw[predecessor]) and a later step into x
        counts max(nw[target], nw[x]). Each node passes on how many walks of which target weight run through it."""
        order, pred = self.dag(self.dijkstra(source))
        through: list[dict[float, float]] = [{} for _ in range(self.n)]
        edge = np.zeros(self.m)
        for x in reversed(order):
            if x == source:
                continue
            mine = through[x]
            for p, e in pred[x]:
                edge[e] += max(nw[x], nw[p]) + sum(c * max(t, nw[x]) for t, c in mine.items())
                if p != source:
                    into = through[p]
                    for t, c in mine.items():
                        into[t] = into.get(t, 0.0) + c
                    into[nw[x]] = into.get(nw[x], 0.0) + 1.0
            through[x] = {}
        return edge

    def random_path(self, order_pred: tuple, sigma: np.ndarray, source: int, target: int, rng: np.random.Generator) -> list[tuple[int, int]]:
        """(node, edge) pairs of a shortest path drawn backwards, predecessors in proportion to their path counts."""
        _, pred = order_pred
        out, x = [], target
        while x != source:
            c = np.array([sigma[p] for p, _ in pred[x]])
            p, e = pred[x][int(rng.choice(len(c), p=c / c.sum()))]
            out.append((p, e))
            x = p
        return out


class Hops:
    """Breadth-first searches from many sources at once, a bit for each in every node's words."""

    def __init__(self, u: np.ndarray, v: np.ndarray) -> None:
        self.ids = np.unique(np.concatenate([u, v]))
        self.n = len(self.ids)
        a, b = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        src, dst = np.r_[a, b], np.r_[b, a]
        order = np.argsort(src, kind="stable")
        self.dst, self.start = dst[order], np.searchsorted(src[order], np.arange(self.n))  # every node has an edge

    def sums(self, sources: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each source: how many nodes it reaches, itself too, the sum of their hops, and of 1 / hops. A level goes to the
        neighbours of few new nodes, or to all nodes that some source hasn't seen, a slice of them at a time."""
        k, words = len(sources), -(-len(sources) // 64)
        seen, front = (np.zeros((self.n, words), np.uint64) for _ in range(2))
        for j, s in enumerate(sources):
            front[s, j // 64] |= np.uint64(1 << (j % 64))
        whole = np.bitwise_or.reduce(front, axis=0)
        seen |= front
        new = np.unique(sources)  # rows of front that hold anything
        open_ = np.ones(self.n, bool)  # some source hasn't seen them
        end = np.append(self.start[1:], len(self.dst))
        reached, far, near, level = np.ones(k, np.int64), np.zeros(k, np.int64), np.zeros(k), 0
        while True:
            rows = np.flatnonzero(open_)
            if 4 * (end[new] - self.start[new]).sum() < len(self.dst):
                touched = np.zeros(self.n, bool)
                touched[self._arcs(new, end)] = True
                rows = np.flatnonzero(touched & open_)
            got, found = np.zeros_like(front), []
            for x in range(0, len(rows), 1 << 11):
                at = rows[x : x + (1 << 11)]
                size = end[at] - self.start[at]
                hit = np.bitwise_or.reduceat(front[self._arcs(at, end)], np.cumsum(size) - size, axis=0)
                hit &= ~seen[at]
                some = hit.any(1)
                at, hit = at[some], hit[some]
                got[at] = hit
                seen[at] |= hit
                open_[at] = (seen[at] != whole).any(1)
                found.append(at)
            new, front = np.concatenate(found) if found else np.zeros(0, int), got
            if not len(new):
                return reached, far, near
            level += 1
            c = np.zeros(k, np.int64)
            for x in range(0, len(new), 255):  # so few rows that bytes hold their sums
                c += np.unpackbits(front[new[x : x + 255]].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)[:k]
            reached, far, near = reached + c, far + level * c, near + c / level

    def _arcs(self, rows: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The neighbours of the rows, one row's after the other's."""
        size = end[rows] - self.start[rows]
        return self.dst[np.repeat(self.start[rows] - (np.cumsum(size) - size), size) + np.arange(size.sum())]


class UnionFind:
    """Classes named by their least member (GP-12)."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while self.parent.get(root, root) != root:
            root = self.parent[root]
        while self.parent.get(x, x) != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, x: int, y: int) -> bool:
        """False if they were in one class already."""
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True


def spanning_forest(u, v, w) -> np.ndarray:
    """Positions of the least-weight forest's edges, ties by (u, v)."""
    uf = UnionFind()
    return np.array([k for k in np.lexsort((v, u, w)) if uf.join(int(u[k]), int(v[k]))], int)


def greedy_pick(u, v, w, score, forest: UnionFind, most: int, whole_level: bool = False) -> tuple[list[int], list[int]]:
    """GP-13: edges by falling score, then rising weight, that close no cycle; with those that would. `whole_level` goes on to the
    end of the last score's level."""
    taken, cyclic = [], []
    order = np.lexsort((v, u, w, -score))
    for i, k in enumerate(order):
        if len(taken) >= most and not (whole_level and i and score[k] == score[order[i - 1]]):
            break
        (taken if forest.join(int(u[k]), int(v[k])) else cyclic).append(int(k))
    return taken, cyclic


class Dependencies:
    """Edge dependencies of every source, kept up to date when an edge's weight falls: only the sources from which the edge is now on
    a shortest path are run anew (SP-07, EC-10). `ran` counts the sources run in all; `incremental` off runs all each time."""

    def __init__(self, g: Csr, incremental: bool = True) -> None:
        self.g, self.incremental, self.ran = g, incremental, 0
        self.dist, self.part = np.zeros((g.n, g.n)), np.zeros((g.n, g.m))
        self._run(range(g.n))

    def _run(self, sources) -> None:
        for s in sources:
            self.ran += 1
            self.dist[s] = self.g.dijkstra(s)
            self.part[s] = self.g.brandes(s)[0]

    def scores(self) -> np.ndarray:
        return sum(self.part)  # in the order of sources, so that runs agree whichever sources were run

    def lighten(self, e: int, w) -> None:
        du, dv = self.dist[:, self.g.a[e]], self.dist[:, self.g.b[e]]
        hit = (du + float(w) <= dv) | (dv + float(w) <= du)
        self.g.reweigh(e, w)
        self._run(np.flatnonzero(hit).tolist() if self.incremental else range(self.g.n))


class AllPaths:
    """The scores of `Dependencies` while weights fall below all others so far, for integer weights. Kept are, for all pairs of nodes at
    once, distances, numbers of shortest paths, and each source's tree: the last edge of every path and how many nodes lie beyond
    it. A lighter edge makes shorter only paths between the nodes nearer to its one end and those nearer to the other; their
    trees' branches move, and counts change on the ways to where they were and are. Where a source has several shortest paths to a
    node, its tree holds one of them, and what the others take from it is reckoned anew for the scores (`_splits`)."""

    FAR = 1 << 60

    @classmethod
    def fits(cls, weights) -> bool:
        """Whether sums of the weights stay below FAR."""
        return sum(int(x) for x in weights) < cls.FAR

    def __init__(self, g: Csr) -> None:
        self.g, n, m = g, g.n, g.m
        self.w = w = np.array([int(x) for x in g.w], np.int64)
        self.src = src = np.repeat(np.arange(n), np.diff(g.start))
        self.dist = self._distances(w)
        self.sigma = (self.dist < self.FAR).astype(float)
        self.last, self.edge = np.full((n, n), -1, np.int32), np.full((n, n), -1, np.int32)
        self.beyond, self.deep = np.zeros((n, n), np.int32), np.zeros((n, n), np.int32)
        self.flow, self.seat = np.zeros(n * n, np.int32), np.zeros(n * n, np.int32)  # scratch of `_flows`
        step = max(1, (1 << 22) // max(1, len(src)))
        for k in range(0, n, step):
            d = self.dist[k : k + step]
            i, j = np.nonzero((d[:, src] + w[g.eid] == d[:, g.dst]) & (d[:, src] < self.FAR))
            self.last[k + i, g.dst[j]], self.edge[k + i, g.dst[j]] = src[j], g.eid[j]
            more = np.bincount(i * n + g.dst[j], minlength=d.size).reshape(d.shape) > 1
            for x in np.flatnonzero(more.any(1)).tolist():
                far = np.where(d[x] < self.FAR, d[x], np.inf)
                self.sigma[k + x] = g.counts(*g.dag(far), k + x)
        self.tied = (self.sigma > 1).any(1)
        self._count()

    def _distances(self, w: np.ndarray, width: int = 32) -> np.ndarray:
        """Of all pairs: sources that lie together at once, each round only at the neighbours of nodes that came nearer."""
        g, out = self.g, np.full((self.g.n, self.g.n), self.FAR, np.int64)
        step, size = w[g.eid][:, None], np.diff(g.start)

        def arcs(rows: np.ndarray) -> np.ndarray:
            k = size[rows]
            return np.repeat(g.start[rows] - (np.cumsum(k) - k), k) + np.arange(k.sum())

        for block in self._blocks(width):
            d = np.full((g.n, len(block)), self.FAR, np.int64)
            d[block, np.arange(len(block))] = 0
            new = block
            while len(new):
                rows = np.unique(g.dst[arcs(new)])
                if not len(rows):
                    break
                at = arcs(rows)
                low = np.minimum.reduceat(d[g.dst[at]] + step[at], np.cumsum(size[rows]) - size[rows], axis=0)
                nearer = (low < d[rows]).any(1)
                new = rows[nearer]
                d[new] = np.minimum(d[new], low[nearer])
            out[:, block] = d
        return out

    def _blocks(self, width: int) -> list[np.ndarray]:
        """The nodes in blocks of neighbours, so many at most."""
        free, out = [True] * self.g.n, []
        for x in range(self.g.n):
            if free[x]:
                free[x], block = False, [x]
                for y in block:  # grows on the way
                    for z in self.g.dst[self.g.start[y] : self.g.start[y + 1]].tolist() if len(block) < width else ():
                        if free[z] and len(block) < width:
                            free[z] = False
                            block.append(z)
                out.append(np.array(block))
        return out

    def _count(self) -> None:
        """Depths in all trees, how many nodes lie beyond each, and the sums over edges; some sources at a time."""
        n, self.sum = self.g.n, np.zeros(self.g.m, np.int64)
        step = max(1, (1 << 17) // max(1, n))
        for k in range(0, n, step):
            last, edge, beyond, depth = (x[k : k + step].ravel() for x in (self.last, self.edge, self.beyond, self.deep))
            at = np.flatnonzero(last >= 0)
            beyond[at] = 1
            on, deep = at - at % n + last[at], np.ones(len(at), np.int32)
            while True:
                up = last[on]
                more = np.flatnonzero(up >= 0)
                if not len(more):
                    break
                deep[more] += 1
                on[more] += up[more] - on[more] % n
            depth[at] = deep
            order = np.argsort(deep, kind="stable")
            cut = np.searchsorted(deep[order], np.arange(int(deep.max(initial=0)) + 2)).tolist()
            for j in range(len(cut) - 2, 1, -1):
                x = at[order[cut[j] : cut[j + 1]]]
                np.add.at(beyond, x - x % n + last[x], beyond[x])
            self.sum += np.rint(np.bincount(edge[at], beyond[at], self.g.m)).astype(np.int64)

    def scores(self) -> np.ndarray:
        rows = np.flatnonzero(self.tied)
        return self.sum + self._splits(rows) if len(rows) else self.sum.astype(float)

    def _splits(self, rows: np.ndarray) -> np.ndarray:
        """What edges gain and lose against the sources' trees where shortest paths meet: at such a node its load is shared by numbers
        of paths. Of each source the farthest node comes first, until all that was moved has met again."""
        g, n, w, dist, sigma, last, edge, beyond = self.g, self.g.n, self.w, self.dist.ravel(), self.sigma.ravel(), self.last.ravel(), self.edge.ravel(), self.beyond.ravel()
        s, up = self.sigma[rows], self.last[rows]
        i, y = np.nonzero((s != np.take_along_axis(s, np.maximum(up, 0), 1)) & (up >= 0))
        node, size = rows[i] * n + y, np.diff(g.start)[y]
        m = np.repeat(np.arange(len(y)), size)
        arc = np.repeat(g.start[y] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        way = node[m] - y[m] + g.dst[arc]
        ok = dist[way] + w[g.eid[arc]] == dist[node[m]]
        m, way, on = m[ok], way[ok], g.eid[arc[ok]]
        share, first = sigma[way] / sigma[node[m]], np.searchsorted(m, np.arange(len(y) + 1))
        tree = np.where(way == node[m] - y[m] + last[node[m]], beyond[node[m]], 0)
        meets, out = node, np.zeros(g.m)
        self.flow[meets] = np.arange(1, len(y) + 1)  # zero again below
        more = np.zeros(len(node))
        far = np.zeros(n, np.int64)
        while len(node):
            row, d = node // n, dist[node]
            far[rows] = 0
            np.maximum.at(far, row, d)
            now = d == far[row]
            at, back = np.unique(node[now], return_inverse=True)
            c = np.bincount(back, more[now])
            k = self.flow[at] - 1
            j = np.flatnonzero((k < 0) & (np.abs(c) > 1e-12) & (edge[at] >= 0))
            x, cx = at[j], c[j]
            out += np.bincount(edge[x], cx, g.m)
            met = np.flatnonzero(k >= 0)
            k, load = k[met], beyond[at[met]] + c[met]
            size = first[k + 1] - first[k]
            q = np.repeat(first[k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            part = share[q] * np.repeat(load, size) - tree[q]
            out += np.bincount(on[q], part, g.m)
            node, more = np.concatenate([node[~now], x - x % n + last[x], way[q]]), np.concatenate([more[~now], cx, part])
        self.flow[meets] = 0
        return out

    def lighten(self, e: int, w) -> None:
        g, d, w = self.g, self.dist, int(w)
        a, b = int(g.a[e]), int(g.b[e])
        g.reweigh(e, w)
        self.w[e] = w
        here, there = np.flatnonzero(d[a] + w <= d[b]), np.flatnonzero(d[b] + w <= d[a])
        here, there = here[d[a][here] < self.FAR], there[d[b][there] < self.FAR]
        at = np.ix_(here, there)
        old, via = d[at], (d[a][here] + w)[:, None] + d[b][there][None, :]
        less, same = via < old, via == old
        tied = self.tied.copy()
        if same.any() or tied.any():
            ways = self.sigma[a][here][:, None] * self.sigma[b][there][None, :]
            new = np.where(less, ways, self.sigma[at] + same * ways)
            self.sigma[at], self.sigma[np.ix_(there, here)] = new, new.T
            for x in (here, there):
                tied[x] = (self.sigma[x] > 1).any(1)
        d[at] = low = np.minimum(old, via)
        d[np.ix_(there, here)] = low.T
        some = tied | self.tied
        self.tied, twice = tied, not (some[here].any() or some[there].any())  # then each path has its way back in a tree of the other side
        self._move(here, there, a, b, e, less, 2 if twice else 1)
        self._move(there, here, b, a, e, np.ascontiguousarray(less.T), 0 if twice else 1)

    def _move(self, sources: np.ndarray, targets: np.ndarray, a: int, b: int, e: int, less: np.ndarray, count: int) -> None:
        """Of each source the targets that are nearer by the edge from a to b now hang in its tree as in that of b; what edges gain
        and lose by that is counted so many times."""
        n, q, last, edge, beyond = self.g.n, len(targets), self.last.ravel(), self.edge.ravel(), self.beyond.ravel()
        new_last, new_edge = self.last[b][targets], self.edge[b][targets]
        new_last[targets == b], new_edge[targets == b] = a, e
        whole = less.all(1)
        every = bool(whole.all())
        if not every:
            some = less.any(1)
            sources, less, whole = sources[some], less[some], whole[some]
        if not len(sources):
            return
        start = sources * n
        at = start[:, None] + targets
        was, above = beyond[at], last[at]
        size, depth, place = self._walk(b, targets, not every)
        if every:
            moved = np.zeros(n, bool)
            moved[targets] = True
            top = ~moved[above]
            now, total = np.broadcast_to(size, less.shape), np.full(len(sources), q, np.int32)
        else:
            column = np.full(n, q)
            column[targets] = np.arange(q)
            known = np.zeros((len(sources), q + 1), bool)
            known[:, :q] = less
            top = less & ~known.ravel()[column[above] + (np.arange(len(sources)) * (q + 1))[:, None]]
            total = less.sum(1, dtype=np.int32)
            order, part = np.argsort(place), np.flatnonzero(~whole)
            sums = np.zeros((len(part), q + 1), np.int32)
            np.cumsum(less[part][:, order], axis=1, out=sums[:, 1:])
            now = np.empty(less.shape, np.int32)
            now[whole] = size
            now[part] = sums[:, place + size] - sums[:, place]
            now = np.where(less, now, was)
        change = np.zeros(self.g.m)
        if count:
            old = edge[at]
            gain = now if every else np.where(less, now, 0)
            change += np.bincount(new_edge, gain.sum(0), self.g.m)
            change -= np.bincount(old.ravel(), (was if every else np.where(less, was, 0)).ravel(), self.g.m)
        k = np.flatnonzero(top)
        i, lost, here = k // q, -was.ravel()[k], start + a
        node = start[i] + above.ravel()[k]
        beyond[at] = now
        last[at], edge[at] = (new_last, new_edge) if every else (np.where(less, new_last, above), np.where(less, new_edge, edge[at]))
        low = self.deep.ravel()[here][:, None] + depth + 1
        self.deep.ravel()[at] = low if every else np.where(less, low, self.deep.ravel()[at])
        on, more = self._flows(np.r_[node, here], np.r_[i, np.arange(len(start))], np.r_[lost, total])
        if count:
            change += np.bincount(edge[on], more, self.g.m)
            self.sum += count * np.rint(change).astype(np.int64)

    def _flows(self, node: np.ndarray, row: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Adds to what lies beyond the nodes and all nodes above them, and gives what each got. What comes from several sides meets
        where it joins, as the deepest of a row go first; a row's amounts add up to nothing and so end where all have met."""
        n, last, beyond, deep = self.g.n, self.last.ravel(), self.beyond.ravel(), self.deep.ravel()[node]
        most = np.zeros(int(row.max()) + 1, np.int32)
        np.maximum.at(most, row, deep)
        wait = most[row] - deep
        order = np.argsort(wait, kind="stable")
        node, more, cut = node[order], more[order], np.searchsorted(wait[order], np.arange(int(wait.max()) + 2)).tolist()
        at, much, got, step = node[:0], more[:0], [(node[:0], more[:0])], 0
        while len(at) or step < len(cut) - 1:
            if step < len(cut) - 1 and cut[step] < cut[step + 1]:
                at, much = np.r_[at, node[cut[step] : cut[step + 1]]], np.r_[much, more[cut[step] : cut[step + 1]]]
            step += 1
            if not len(at):
                continue
            np.add.at(self.flow, at, much)
            self.seat[at] = seat = np.arange(len(at), dtype=np.int32)
            at = at[self.seat[at] == seat]
            much = self.flow[at]
            self.flow[at] = 0
            ok = np.flatnonzero(much)
            at, much = at[ok], much[ok]
            beyond[at] += much
            got.append((at, much))
            at = at - at % n + last[at]
        return np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])

    def _walk(self, b: int, targets: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Of the targets' branches in the tree of b: their sizes and depths, and the targets' places in a walk over it, parents first
        and branches together."""
        column = np.zeros(self.g.n, int)
        column[targets] = np.arange(len(targets))
        up = column[self.last[b][targets]].tolist()
        order = np.argsort(self.dist[b][targets], kind="stable").tolist()  # parents are nearer; b comes first
        size, depth = [1] * len(up), [0] * len(up)
        for k in order[:0:-1]:
            size[up[k]] += size[k]
        for k in order[1:]:
            depth[k] = depth[up[k]] + 1
        if not places:
            return np.array(size, np.int32), np.array(depth, np.int32), None
        place, free = [0] * len(up), [1] * len(up)
        for k in order[1:]:
            place[k] = x = free[up[k]]
            free[up[k]] = x + size[k]
            free[k] = x + 1
        return np.array(size, np.int32), np.array(depth, np.int32), np.array(place)


class Draws:
    """Drawn shortest paths between fixed pairs of nodes; after an edge's weight fell, those paths are drawn anew whose ends are now
    nearer or joined by another number of shortest paths (EC-09), or which ran over an edge that went."""

    def __init__(self, g: Csr, pairs: np.ndarray, rng: np.random.Generator) -> None:
        self.g, self.rng, self.drawn = g, rng, 0
        self.pairs = [(int(s), int(t)) for s, t in pairs]
        self.known: list[tuple[float, float]] = [(float("nan"), 0.0)] * len(self.pairs)  # distance, number of paths
        self.paths: list[list[int]] = [[] for _ in self.pairs]
        self.refresh(range(len(self.pairs)))

    def refresh(self, samples) -> None:
        """Draws anew where distance or number of paths differ from what is known."""
        by: dict[int, list[int]] = {}
        for i in samples:
            by.setdefault(self.pairs[i][0], []).append(i)
        for s, mine in sorted(by.items()):
            dist = self.g.dijkstra(s)
            dag = self.g.dag(dist)
            sigma = self.g.counts(*dag, s)
            for i in mine:
                t = self.pairs[i][1]
                now = (float(dist[t]), float(sigma[t]))
                if now != self.known[i]:
                    self.known[i] = now
                    self.drawn += 1
                    self.paths[i] = [e for _, e in self.g.random_path(dag, sigma, s, t, self.rng)] if s != t and np.isfinite(dist[t]) else []

    def scores(self) -> np.ndarray:
        edges = [e for p in self.paths for e in p]
        return np.bincount(edges, minlength=self.g.m) / max(1, len(self.pairs))

    def lighten(self, e: int, w) -> None:
        du, dv = self.g.dijkstra(int(self.g.a[e])), self.g.dijkstra(int(self.g.b[e]))  # of an undirected graph: from every source
        hit = (du + float(w) <= dv) | (dv + float(w) <= du)
        self.g.reweigh(e, w)
        self.refresh([i for i, (s, _) in enumerate(self.pairs) if hit[s]])


def exact_picks(u: np.ndarray, v: np.ndarray, w: np.ndarray, per_round: int = 1, scorer: str = "betweenness", incremental: bool = False, unit: str = "n") -> list[tuple[int, int, float, int, float]]:
    """TR-08, TR-09, TR-11: (u, v, w, round, score) of the edges in the order they are picked: each round the best that close no cycle,
    whose weight falls to least / (n + 1), or (unit "m") least / (m + 1); edges of score 0 go.

    scorer: betweenness, or flow (currents, weights being conductances). Weights are scaled to integers, so that ties are exact.
    """
    w = np.asarray(w, float)
    n = len(np.unique(np.r_[u, v]))
    parts = (n if unit == "n" else len(u)) + 1
    g = Csr(u, v, np.rint(w / w.min() * 1_000_000).astype(np.int64) * parts)
    low, forest, out = int(g.w.min()) // parts, UnionFind(), []
    live, done = np.ones(g.m, bool), np.zeros(g.m, bool)
    state = Dependencies(g, incremental) if scorer == "betweenness" else None
    level = 0
    while len(out) < n - 1:
        if state:
            score = np.round(state.scores(), 9)
        else:
            from graftwork.operators.centrality import flow_scores

            score = np.round(flow_scores(g, np.where(live, np.asarray(g.w, float), 0.0)), 9)
        live &= score > 0
        at = np.flatnonzero(live & ~done)
        taken, cyclic = greedy_pick(u[at], v[at], w[at], score[at], forest, per_round)
        if not taken:
            break
        done[at[cyclic]] = True
        g.drop(set(np.flatnonzero(~live).tolist()))
        for k in at[taken].tolist():
            done[k] = True
            out.append((int(u[k]), int(v[k]), float(w[k]), level, float(score[k])))
            if state:
                state.lighten(k, low)
            else:
                g.reweigh(k, low)
        level += 1
    return out


def iterate_tree(u, v, w, sources: np.ndarray | None, scorer: str = "cluster_all", prune: bool = True, highway: float | None = None, node_weights: np.ndarray | None = None, seeds: list[tuple[int, int]] | None = None, per_round: int = 1, seed: int = 42, samples: int = 500) -> list[tuple[int, int, float]]:
    """TR-01 to TR-05: (u, v, score) of the edges in the order they are picked.

    In each round edges are scored, the best one that isn't a highway yet (ties: least weight, then u, v) gets the highway
    weight, and with `prune` edges of score 0 go for good. Ends at score 0 or n - 1 edges. Weights are scaled to integers, so that
    the highway weight, least / (4 n), is one too and ties are exact. `seeds` are highways from the start.
    """
    u, v, w = np.asarray(u, np.int64), np.asarray(v, np.int64), np.asarray(w, float)
    order = np.lexsort((v, u))
    u, v, w = u[order], v[order], w[order]
    if not len(u):
        return []
    n = len(np.unique(np.r_[u, v]))
    base = np.rint(w / w.min() * 1_000_000).astype(object) * (4 * n)
    low = int(base.min()) // (4 * n) if highway is None else max(1, round(highway / w.min() * 1_000_000 * 4 * n))
    g = Csr(u, v, base)
    g.w = base.copy()
    near = base.astype(float)
    c = np.arange(g.n) if sources is None or scorer == "exact" else np.searchsorted(g.ids, np.intersect1d(sources, g.ids))
    targets = np.zeros(g.n, bool)
    targets[c if scorer == "cluster" else slice(None)] = True
    nw = np.ones(g.n) if node_weights is None else np.asarray(node_weights, float)
    rng = np.random.default_rng(seed)
    live, road, out = np.ones(g.m, bool), np.zeros(g.m, bool), []
    draws = Draws(g, rng.integers(0, g.n, (samples, 2)), rng) if scorer == "RK" else None
    exact = None
    if scorer == "exact":
        exact = AllPaths(g) if low < base.min() and AllPaths.fits(base) else Dependencies(g)

    def take(e: int, s: float) -> None:
        road[e] = True
        state = draws or exact
        if state:
            state.lighten(e, low)
        else:
            g.reweigh(e, low)
        out.append((int(u[e]), int(v[e]), float(s)))

    at = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(u, v, strict=True))}
    for a, b in seeds or []:
        take(at[min(a, b), max(a, b)], float("inf"))
    while len(out) < n - 1:
        if exact:
            score = np.round(exact.scores(), 9)
        elif draws:
            score = draws.scores()
        elif scorer == "cluster_all2":
            score = sum(g.weighted_walks(int(s), nw) for s in c)
        else:
            score = sum(g.walks(int(s), targets)[0] for s in c)
        if prune:
            gone = live & ~road & (score == 0)
            if gone.any():
                live &= ~gone
                g.drop(set(np.flatnonzero(gone).tolist()))
        open_ = np.flatnonzero(live & ~road & (score > 0))
        if not len(open_):
            break
        if per_round < len(open_):  # those that can be among the first
            open_ = open_[score[open_] >= -np.partition(-score[open_], per_round - 1)[per_round - 1]]
        best = open_[np.lexsort((v[open_], u[open_], near[open_], -score[open_]))[:per_round]]
        for e in best:
            take(int(e), score[e])
    return out
