"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document's set is its distinct 5-word shingles (fewer words: the whole sequence as one), each a 64-bit hash of its words'
64-bit hashes; documents with equal sets are one class (128-bit digest of the sorted set), and only classes are compared.

The global order puts rare shingles first: by a count-min estimate over all documents (a sketch with a counter for each 16 bytes
of text, up to a bound), then by hash. Any order gives right results; the estimate only decides how much work they take. Pivots cut the order into fragments
that hold about equally many of all shingles. Of a set of n, the first n - ceil(t n) + l in this order are its prefix, l
growing with n: two sets of similarity t or more share at least the smaller l of shingles in their prefixes, and at the first
shared one, at places i and j (from 0), min(n - i, m - j) is at least the overlap that they need.

Candidates: each fragment of the order takes the prefixes' shingles that fall into it, and counts the shared ones of sets that pass
the size filter: all pairs of a short list; of a long one, each set with the few that have least of their own before the shingle.
Lists that the sketch takes for very long are dealt out by salts of the set as well, so that no task holds one as a whole. Counts are
summed over fragments, and pairs with too few are dropped, places in long lists being counted for them.

Verification: each set that may be a candidate is cut into `cuts` pieces at pivots of the same order and written once, a row a fragment; the
overlap of each fragment is counted by itself, and counts are summed for each pair. Pairs that reach the threshold link.

What long lists still miss comes in further rounds over those whose members aren't all in one component yet: each member with
the list's hubs, as joins in which hot lists are split off, and last all members of different components. So no link between
different components is lost, and a group of near copies doesn't make a pair for each two of its members.

Null and blank texts have an empty set, no links, and are their own component. Each row counts as a document of its own: rows
with equal ids and different texts are linked by their own texts only, and their component is the smallest id of the rows that
these reach. Rows with a null id link with nothing and have a null component. Ids are compared as numbers; other columns play no part.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.llm.common import bloom_has, bounded_bloom, join_hot, pieces, release, stream
from graftwork.llm.common import lean_written as written
from graftwork.operators.components import connected_components

WORDS = 5
NUM, DEN = 75, 100
#: Counters of one row of the sketch, and bytes of text that one counter stands for.
SKETCH_ROW, BYTES_A_COUNTER = 1 << 12, 16


@dataclasses.dataclass(frozen=True)
class Work:
    """How work is dealt out; results don't depend on it.

    sketch: counters at most (16 bits each; what exceeds 15 bits is kept as a logarithm). fragment: prefix shingles that one fragment
    holds, about. cuts: pieces that whole sets are cut into. short: lists up to here are compared in full at once; hubs: members
    that longer lists are compared with, round by round. long: members of a list that one task holds, about, by the estimate;
    salts: parts that a list is dealt out to at most.
    """

    sketch: int = 1 << 24
    fragment: int = 500_000
    cuts: int = 4
    short: int = 12
    hubs: tuple[int, ...] = (3, 12)
    long: int = 200_000
    salts: int = 1 << 16


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0xA0761D6478BD642F


class Shingler:
    """Sets of shingle hashes."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << n.bit_length()
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)

    def word_hashes(self, text: str) -> np.ndarray:
        """A polynomial hash of each word's bytes, with A-Z as a-z; only ASCII blanks part words."""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
        solid = np.zeros(len(b) + 2, bool)
        solid[1:-1] = ~_BLANK[b]
        edge = np.flatnonzero(solid[1:] != solid[:-1])
        start, end = edge[::2], edge[1::2]
        self._grow(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.powers[: len(b)], out=sums[1:])
        h = (sums[end] - sums[start]) * self.inverse[start]
        h ^= h >> np.uint64(31)
        h *= _MIX[3]
        return h ^ (h >> np.uint64(29))

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct shingles, unsigned 64 bits."""
        if not text:
            return np.zeros(0, np.uint64)
        h = self.word_hashes(text)
        k = self.words
        if len(h) == 0:
            return h
        if len(h) < k:
            import xxhash

            return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64)
        n = len(h) - k + 1
        s = np.zeros(n, np.uint64)
        for i in range(k):
            s += h[i : i + n] * _MIX[i % len(_MIX)]
            s ^= s >> np.uint64(29)
        s *= _MIX[1]
        s ^= s >> np.uint64(32)
        s *= _MIX[4]
        s.sort()
        return s[np.r_[True, s[1:] != s[:-1]]]


def least_shared(n):
    """Prefix shingles that two sets which link share at least: the smaller one's value."""
    return 1 + n // 12


def least_shared_sql():
    """The same for columns n and m."""
    return F.expr("1 + least(n, m) div 12")


def digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def short_name(d: bytes) -> int:
    """Eight bytes of a class's digest, by which lists name it; two classes of one short name are both taken up later."""
    return int.from_bytes(d[:8], "little", signed=True)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int):
    """The overlap from which sets of n and m link: DEN * o >= NUM * (n + m - o)."""
    return -(-(NUM * (n + m)) // (NUM + DEN))


def text_key(text) -> object:
    """Sixteen bytes that tell texts apart; null as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _scan(counters: int):
    """kind 0: (doc_id, n, class, text key); kind 1: rows of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler()
        sketch = np.zeros(counters, np.uint16)
        held, n_held = [], 0

        def rows(kind, ids, n, data, keys):
            short = [short_name(d) if kind == 0 and d else None for d in data]
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), ids, pa.array(n, pa.int64()), pa.array(data, pa.binary()), keys, pa.array(short, pa.int64())], names=["kind", "doc_id", "n", "data", "key", "short"])

        def put():
            at, c = np.unique(np.concatenate(held), return_counts=True)
            sketch[at] = np.minimum(sketch[at] + c, 65535)  # of one task's documents

        for b in pieces(batches):
            n, d = [], []
            for t in b.column("text").to_pylist():
                s = shingle(t)
                n.append(len(s))
                d.append(digest(s) if len(s) else None)
                held.append((s & np.uint64(counters - 1)).astype(np.uint32))
                n_held += len(s)
            yield rows(0, b.column("doc_id").cast(pa.int64()), n, d, b.column("key"))
            if n_held > 500_000:
                put()
                held, n_held = [], 0
        if held:
            put()
        t = sketch.reshape(-1, min(counters, SKETCH_ROW))
        at = np.flatnonzero(t.any(1))
        for k in range(0, len(at), 256):
            part = at[k : k + 256]
            yield rows(1, pa.nulls(len(part), pa.int64()), part, [_pack_row(t[i]) for i in part], pa.nulls(len(part), pa.binary()))

    return run


def _short_count(c: np.ndarray) -> np.ndarray:
    """Counts in 16 bits, in the same order: exact below 2^15, their logarithm above."""
    c = np.maximum(c, 0).astype(np.float64)
    return np.where(c < 32768, c, 32768 + np.minimum(32767, np.log2(np.maximum(c, 32768) / 32768) * 1024)).astype(np.uint16)


def _long_count(c: np.ndarray) -> np.ndarray:
    return np.where(c < 32768, c, 32768 * 2.0 ** ((c.astype(np.float64) - 32768) / 1024)).astype(np.int64)


def _pack_row(row: np.ndarray) -> bytes:
    """Which counters aren't 0, and what they are."""
    return zlib.compress(np.packbits(row > 0).tobytes() + _short_count(row[row > 0]).tobytes(), 1)


def _unpack_row(raw: bytes, width: int) -> np.ndarray:
    raw = zlib.decompress(raw)
    out = np.zeros(width, np.int64)
    out[np.unpackbits(np.frombuffer(raw, np.uint8, width // 8)).astype(bool)] = _long_count(np.frombuffer(raw, np.uint16, offset=width // 8))
    return out


def _add_rows(width: int):
    def run(key, batches):
        total = np.zeros(width, np.int64)
        for b in batches:
            for x in b.column("data").to_pylist():
                total += _unpack_row(x, width)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([_short_count(total).tobytes()], pa.binary())], names=["n", "data"])

    return run


def _grouped(fn, schema: pa.Schema):
    """The generator of batches as a function of one group's table."""

    def run(key, table):
        out = pa.Table.from_batches(list(fn(key, table.to_batches())), schema)
        if table.nbytes > 1 << 20:
            release()
        return out

    return run


def _counts(s: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    return sketch[(s & np.uint64(len(sketch) - 1)).astype(np.int64)]


def _order(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places in the global order, as numbers: by estimate, then by the hash's upper 48 bits."""
    return (counts.astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16))


def pivots(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """The fragments - 1 places at which the global order is cut into parts of about equally many shingles."""
    seen = np.zeros(65536)
    for k in range(0, len(sketch), 1 << 20):
        seen += np.bincount(sketch[k : k + (1 << 20)], minlength=65536)
    seen *= _long_count(np.arange(65536))
    before = np.concatenate([[0.0], np.cumsum(seen)])
    if not before[-1]:
        return np.zeros(0, np.uint64)
    want = before[-1] * np.arange(1, fragments) / fragments
    count = np.clip(np.searchsorted(before, want, "right") - 1, 0, 65535)
    within = (want - before[count]) / np.maximum(seen[count], 1)
    return np.unique((count.astype(np.uint64) << np.uint64(48)) | (np.clip(within, 0, 1) * ((1 << 48) - 1)).astype(np.uint64))


def _deals(counts: np.ndarray, short: np.ndarray, work: Work) -> np.ndarray:
    """0 for lists that one task holds; else 1 to `salts`, by the set, as many as the estimate asks for."""
    salts = np.minimum(1 + _long_count(counts) // work.long, work.salts).astype(np.uint64)
    return np.where(salts > 1, 1 + short % salts, 0).astype(np.int64)


def _prefixes(sketch, cut: np.ndarray, work: Work):
    """Prefixes packed by (fragment of the order, deal): shingles, places, number of the class here, sizes, classes."""

    def run(batches):
        shingle, table = Shingler(), np.frombuffer(sketch.value, np.uint16)
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray, int]] = []
        names: list[bytes] = []
        n_held = 0

        def out():
            s = np.concatenate([p for p, _, _ in held])
            counts = np.concatenate([c for _, c, _ in held])
            own = np.repeat(np.arange(len(held)), [len(p) for p, _, _ in held])
            place = np.concatenate([np.arange(len(p)) for p, _, _ in held])
            size = np.array([n for _, _, n in held], np.int64)
            short = np.frombuffer(b"".join(names), np.uint64)
            part = np.searchsorted(cut, _order(s, counts), "right") * (work.salts + 1) + _deals(counts, short[own], work)
            order = np.argsort(part, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(part[order]) > 0])
            cols = []
            for a, b in zip(starts, [*starts[1:], len(order)], strict=True):
                i = order[a:b]
                mine, local = np.unique(own[i], return_inverse=True)
                # beyond 65,535 an earlier place stands: a looser filter
                cols.append((part[i[0]], s[i].tobytes(), np.minimum(place[i], 65535).astype(np.uint16).tobytes(), local.astype(np.uint16).tobytes(), size[mine].astype(np.uint32).tobytes(), short[mine].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cols, strict=True), (pa.int64(), *[pa.binary()] * 5), strict=True)], names=["part", "shingles", "places", "own", "sizes", "classes"])

        for b in pieces(batches):
            for t in b.column("text").to_pylist():
                s = shingle(t)
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                n = len(s)
                counts = _counts(s, table)
                first = np.argsort(counts, kind="stable")[: n - -(-NUM * n // DEN) + least_shared(n)]  # s is sorted
                held.append((s[first], counts[first], n))
                names.append(d[:8])
                n_held += len(first)
                if n_held > 250_000 or len(held) == 65536:
                    yield out()
                    held, names, n_held = [], [], 0
        if held:
            yield out()

    return run


def _sizes_of(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b])


def _pairs_of(n: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of positions a, b pass the size and place filters."""
    return (DEN * np.minimum(n[a], n[b]) >= NUM * np.maximum(n[a], n[b])) & (np.minimum(n[a] - place[a], n[b] - place[b]) >= least_overlap(n[a], n[b]))


def _hub_pairs(n, place, comp, hubs: int) -> tuple[np.ndarray, np.ndarray]:
    """Each set with the `hubs` sets of other components that have least of their own before the shingle."""
    order = np.argsort(place / n, kind="stable")[:hubs]
    a, b = np.repeat(order, len(n)), np.tile(np.arange(len(n)), len(order))
    keep = (comp[a] != comp[b]) & _pairs_of(n, place, a, b)
    return a[keep], b[keep]


_LISTS = pa.schema([("kind", pa.int32()), ("shingle", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("place", pa.int64())])
_LISTS_DDL = "kind int, shingle long, a long, b long, n long, m long, place long"


def _batch(kind: int, shingle, a, b, n, m, place) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.int32()), pa.array(shingle, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64()), pa.array(place, pa.int64())], schema=_LISTS)


def _join_range(work: Work):
    """kind 0: pairs (a, b, sizes) with the shingles shared here (place) and whether places allow a link (shingle); kind 1: members
    (a, size, place) of long lists and of lists that are dealt out to several tasks, named by the shingle."""

    def run(key, batches):
        sh, pl, own, size, shorts, n_names = [], [], [], [], [], 0
        for b in batches:
            for s, p, o, z, c in zip(*(b.column(k).to_pylist() for k in ("shingles", "places", "own", "sizes", "classes")), strict=True):
                sh.append(np.frombuffer(s, np.uint64))
                pl.append(np.frombuffer(p, np.uint16))
                own.append(np.frombuffer(o, np.uint16).astype(np.int64) + n_names)
                n_names += len(z) // 4
                size.append(np.frombuffer(z, np.uint32).astype(np.int64))
                shorts.append(np.frombuffer(c, np.int64))
        names, same = np.unique(np.concatenate(shorts), return_inverse=True)
        sh, pl, own, size = (np.concatenate(x) for x in (sh, pl, own, size))
        n_of = np.zeros(len(names), np.int64)
        n_of[same] = size
        own = same[own]
        order = np.lexsort((own, sh))
        sh, pl, own = sh[order], pl[order].astype(np.int64), own[order]
        first = np.ones(len(sh), bool)
        first[1:] = (sh[1:] != sh[:-1]) | (own[1:] != own[:-1])  # a class that several tasks sent counts once
        sh, pl, own = sh[first], pl[first], own[first]
        starts = np.flatnonzero(np.r_[True, sh[1:] != sh[:-1]])
        counts = np.diff(np.r_[starts, len(sh)])
        pairs: list[np.ndarray] = []  # first * names + second, twice that, and one more where the places allow a link

        def flush():
            p, c = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            pairs.clear()
            q, placed = p >> 1, p & 1
            last = np.r_[q[1:] != q[:-1], True] if len(q) else np.zeros(0, bool)
            total = np.add.reduceat(c, np.flatnonzero(np.r_[True, q[1:] != q[:-1]])) if len(q) else c
            q, placed = q[last], placed[last]
            a, b = q // len(names), q % len(names)
            for k in range(0, len(q), 50_000):
                x, y = a[k : k + 50_000], b[k : k + 50_000]
                yield _batch(0, placed[k : k + 50_000], names[x], names[y], n_of[x], n_of[y], total[k : k + 50_000])

        def ordered(a, b, placed):
            return (np.minimum(a, b) * len(names) + np.maximum(a, b)) * 2 + placed  # names are sorted

        held = 0
        whole = key[0].as_py() % (work.salts + 1) == 0  # else a part of each list: its sets meet the other parts' later
        for size_of_list in range(2, work.short + 1 if whole else 2):  # all lists of one length at a time
            at = starts[counts == size_of_list]
            if not len(at):
                continue
            i, j = np.triu_indices(size_of_list, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            keep = _sizes_of(n_of[own], a, b)
            a, b = a[keep], b[keep]
            pairs.append(ordered(own[a], own[b], _pairs_of(n_of[own], pl, a, b)))
        long = counts > (work.short if whole else 0)
        for at, c in zip(starts[long].tolist(), counts[long].tolist(), strict=True):
            o, p = own[at : at + c], pl[at : at + c]
            a, b = _hub_pairs(n_of[o], p, o, work.hubs[0])
            pairs.append(ordered(o[a], o[b], 1))
            held += len(a)
            yield _batch(1, [int(sh[at].view(np.int64))] * c, names[o], [None] * c, n_of[o], [None] * c, p)
            if held > 2_000_000:
                yield from flush()
                held = 0
        yield from flush()

    return run


def _fragments(bits, sketch, cut: np.ndarray):
    """(class, fragment, shingles) of the sets that may be candidates, each once a task: cut at pivots of the global order."""

    def run(batches):
        shingle, table = Shingler(), np.frombuffer(sketch.value, np.uint16)
        seen: set[bytes] = set()
        for b in pieces(batches):
            names, frag, seg = [], [], []
            for t, k in zip(b.column("text").to_pylist(), b.column("key").to_pylist(), strict=True):
                if not t or not bloom_has(bits.value, k):
                    continue
                s = shingle(t)
                if not len(s) or (d := digest(s)) in seen:
                    continue
                seen.add(d)
                part = np.searchsorted(cut, _order(s, _counts(s, table)), "right")
                for f in np.unique(part).tolist():
                    names.append(d)
                    frag.append(f)
                    seg.append(s[part == f].tobytes())  # sorted by hash, as s is
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(frag, pa.int32()), pa.array(seg, pa.binary())], names=["class", "fragment", "seg"])

    return run


def _overlaps(batches):
    for b in batches:
        x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
        n = [len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y, strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("u", "v", "n", "m")), pa.array(n, pa.int64())], names=["u", "v", "n", "m", "part"])


def verify(pairs: DataFrame, seg: DataFrame) -> DataFrame:
    """(u, v) of the candidate pairs (classes a, b, their nodes u, v and sizes n, m) that link: overlaps counted by fragment and summed."""
    left = pairs.join(seg.select(F.col("class").alias("a"), "fragment", F.col("seg").alias("x")), "a")
    both = left.join(seg.select(F.col("class").alias("b"), "fragment", F.col("seg").alias("y")), ["b", "fragment"]).select("u", "v", "n", "m", "x", "y")
    sums = both.mapInArrow(_overlaps, "u long, v long, n long, m long, part long").groupBy("u", "v", "n", "m").agg(F.sum("part").alias("o"))
    return sums.where(f"{DEN} * o >= {NUM} * (n + m - o)").select("u", "v")


#: The filters of `_pairs_of` on members (a, n, place, component) and others (b, m, q, other) of a list.
_MAY_LINK = f"component <> other and {DEN} * least(n, m) >= {NUM} * greatest(n, m) and least(n - place, m - q) >= ceil({NUM} * (n + m) / {NUM + DEN})"


def _open(members: DataFrame) -> DataFrame:
    """(shingle, size) of the lists whose members aren't all in one component."""
    return members.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("shingle", "size")


def _candidates(members: DataFrame, lists: DataFrame, hubs: int | None) -> DataFrame:
    """(a, b) of unfinished lists' members of different components: with the list's hubs, or (None) all."""
    if hubs is None:
        most = members.groupBy("shingle", "component").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max(F.struct("n", "component"))["component"].alias("most"))
        minor = join_hot(members, lists.join(most, "shingle"), ["shingle"], "size").where("component <> most")
        other = minor.select("shingle", F.col("a").alias("b"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("component").alias("other"))
        pairs = members.join(other, "shingle")
    else:
        rank = F.row_number().over(W.partitionBy("shingle").orderBy(F.col("place") / F.col("n"), "a"))
        top = members.withColumn("rank", rank).where(F.col("rank") <= hubs).groupBy("shingle").agg(F.collect_list(F.struct(F.col("a").alias("b"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("component").alias("other"))).alias("hubs"))
        pairs = join_hot(members, written(lists.join(top, "shingle"), "hubs"), ["shingle"], "size").select("a", "n", "place", "component", F.inline("hubs"))
    return pairs.where(_MAY_LINK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sketch(scan: DataFrame, counters: int) -> bytes:
    """The sketch's rows added up: counters of 16 bits."""
    width = min(counters, SKETCH_ROW)
    table = bytearray(counters * 2)
    rows = scan.where("kind = 1").select("n", "data").groupBy("n").applyInArrow(_grouped(_add_rows(width), pa.schema([("n", pa.int64()), ("data", pa.binary())])), "n long, data binary")
    for r in stream(rows, "sketch", 16):
        table[r.n * 2 * width : (r.n + 1) * 2 * width] = r.data
    return bytes(table)


def near_copies(docs: DataFrame, work: Work = Work()) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, stays) of every row; key tells its text apart, stays marks the row of each component that
    represents it (where it is repeated exactly, all of its rows); blank texts and rows with null ids all stay."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(text_key(F.col("text")).alias("key"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    counters = min(work.sketch, max(1 << 10, 1 << (size // BYTES_A_COUNTER).bit_length()))
    fragments = max(12, size // 18 // work.fragment)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text")
    scan = written(rows.mapInArrow(_scan(counters), "kind int, doc_id long, n long, data binary, key binary, short long"), "classes")
    ids = scan.where("kind = 0").select("doc_id", "n", F.col("data").alias("class"), "key", "short")
    table = _sketch(scan, counters)
    cut, pieces_cut = (pivots(np.frombuffer(table, np.uint16), k) for k in (fragments, work.cuts))
    sketch = sc.broadcast(table)
    del table
    packed = texts.select("text").mapInArrow(_prefixes(sketch, cut, work), "part long, shingles binary, places binary, own binary, sizes binary, classes binary")
    lists = written(packed.groupBy("part").applyInArrow(_grouped(_join_range(work), _LISTS), _LISTS_DDL), "lists")
    heads = ids.where("class is not null and doc_id is not null").groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.min("short").alias("short"), F.max("n").alias("n"), F.count("*").alias("docs"))
    heads = written(heads.select("class", F.col("first.doc_id").alias("head"), F.col("first.key").alias("key"), "short", "n", "docs", F.monotonically_increasing_id().alias("node")), "heads")
    open_lists = lists.where("kind = 1").select("shingle", "a", "n", "place")
    in_long = open_lists.groupBy("a").agg(F.count("*").alias("long"))
    counted = lists.where("kind = 0").groupBy("a", "b", "n", "m").agg(F.sum("place").alias("shared"), F.max("shingle").alias("placed")).where("placed = 1")
    counted = counted.join(in_long.select("a", F.col("long").alias("long_a")), "a", "left").join(in_long.select(F.col("a").alias("b"), F.col("long").alias("long_b")), "b", "left")
    enough = F.col("shared") + F.least(F.coalesce("long_a", F.lit(0)), F.coalesce("long_b", F.lit(0))) >= least_shared_sql()

    def named(pairs: DataFrame) -> DataFrame:
        h = heads.select("short", "class", "node", "n")
        a = h.select(F.col("short").alias("a"), F.col("class").alias("ca"), F.col("node").alias("u"), "n")
        b = h.select(F.col("short").alias("b"), F.col("class").alias("cb"), F.col("node").alias("v"), F.col("n").alias("m"))
        return written(pairs.select("a", "b").join(a, "a").join(b, "b").where("u <> v").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "u", "v", "n", "m"), "pairs")

    pairs = named(counted.where(enough))
    # the sets that this and later rounds may compare
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).union(open_lists.join(heads.select(F.col("short").alias("a"), "class"), "a").select("class")).distinct()
    bits = sc.broadcast(bounded_bloom(wanted.join(heads.select("class", "key"), "class").select("key")))
    seg = texts.mapInArrow(_fragments(bits, sketch, pieces_cut), "class binary, fragment int, seg binary").groupBy("class", "fragment").agg(F.first("seg").alias("seg"))
    seg = written(seg, "segments")
    for b in (bits, sketch):
        b.destroy()
    found = connected_components(verify(pairs, seg))
    for hubs in (*work.hubs[1:], None):
        at = heads.join(found.withColumnRenamed("id", "node"), "node", "left").select(F.col("short").alias("a"), F.coalesce("component", "node").alias("component"))
        members = written(open_lists.join(at, "a"), "members")
        left = written(_open(members), "open")
        if left.isEmpty():
            break
        members = written(members.join(left, "shingle", "left_semi"), "members")
        new = written(verify(named(_candidates(members, left, hubs)), seg), "edges")
        if not new.isEmpty():
            found = connected_components(new.union(found.select("id", "component")))
    linked = written(heads.join(found.withColumnRenamed("id", "node"), "node").select("node", "class", "head", "component"), "linked")
    lowest = written(linked.groupBy("component").agg(F.min(F.struct("head", "class")).alias("low"), F.count("*").alias("size")), "lowest")
    into = join_hot(linked.select("node", "component"), lowest, ["component"], "size").select("node", "low")
    low = F.coalesce("low", F.struct("head", "class"))
    classes = written(heads.join(into, "node", "left").select("class", "docs", F.col("key").alias("first"), low.alias("low")), "components")
    n = F.col("n").alias("n_shingles")
    joined = join_hot(ids.where("class is not null and doc_id is not null"), classes, ["class"], "docs")
    stays = F.expr("class = low.class and doc_id = low.head and key = first").alias("stays")
    joined = joined.select("doc_id", "key", n, F.col("low.head").alias("component_id"), stays)
    alone = ids.where("class is null or doc_id is null").select("doc_id", "key", n, F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return joined.unionByName(alone)


def jaccard_components(docs: DataFrame, work: Work = Work()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return near_copies(docs, work).select("doc_id", "n_shingles", "component_id")
