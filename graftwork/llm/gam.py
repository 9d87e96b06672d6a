"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shares and shapes of the whole text, counted over its bytes and words. Each is binned by quantiles of the fitting
sample; shallow trees over one feature's bins, boosted feature by feature in turn, add up to one lookup
table a feature; then trees with one cut on either axis, boosted over the pairs whose residuals gain most, add up to small
two-way tables. A document's score is the logistic of the sum of its bins' entries.

Fitted on a bounded labelled sample (`common.FIT_ROWS`); every text is scored whole. Null and empty texts have
all features zero and are scored like others. Without labels of both kinds the score is the share of label 1 (0.5 for none).
Tied or repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graftwork.llm.common import FIT_ROWS, labelled_sample, pieces, texts

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "spaces", "exclaims", "bars", "stars", "stops", "commas", "quotes", "brackets", "other_signs", "beyond_ascii", "repeated_next", "distinct_words", "longest_word", "line_words", "repeated_lines", "short_words", "signed_words")

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b"!", b"|", b"*%#$&~^", b".?", b",;:", b"\"'`", b"()[]{}<>", b"-_+=/\\@"), 1):
    for _c in _chars:
        _CLASS[_c] = _k
_CLASS[128:] = 12
_SIGNS = frozenset("*%#$&~^!|")


def features(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    if not raw:
        return out
    n = len(raw)
    c = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=13)
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = raw.split(b"\n")
    solid = [x for x in lines if x.strip()]
    out[:] = (
        np.log1p(n), np.log1p(len(words)), lengths.mean(), c[1] / n, c[2] / n, c[3] / n, c[4] / w, c[5] / w, c[6] / w, c[7] / w, c[8] / w, c[9] / w, c[10] / w, c[11] / w, c[12] / n,
        sum(map(bytes.__eq__, words, words[1:])) / w, len(set(words)) / w, np.log1p(lengths.max()), np.log1p(w / max(1, len(solid))), 1 - len(set(solid)) / max(1, len(solid)), (lengths <= 3).mean(), sum(x[-1] in b"*%#$&~^!|" for x in words) / w,
    )
    return out


@dataclasses.dataclass
class Model:
    """cuts: of each feature; tables: of each feature; pairs: (feature, feature, cuts, cuts, table); base: intercept."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for j, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += t[np.searchsorted(c, x[:, j], "right")]
        for a, b, ca, cb, t in self.pairs:
            z += t[np.searchsorted(ca, x[:, a], "right"), np.searchsorted(cb, x[:, b], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
    return q[q > v.min()] if len(q) else q


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """The steps of a tree with few leaves over ordered bins, split greedily."""
    out, spans = np.zeros(len(g)), [(0, len(g))]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def split(a: int, b: int) -> tuple[float, int]:
        k = np.arange(a + 1, b)
        if not len(k):
            return 0.0, a
        gl, hl = cg[k] - cg[a], ch[k] - ch[a]
        gr, hr = cg[b] - cg[k], ch[b] - ch[k]
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
        gain[(hl < least) | (hr < least)] = 0
        i = int(gain.argmax())
        return float(gain[i]), int(k[i])

    while len(spans) < leaves:
        best = max(((*split(a, b), a, b) for a, b in spans), default=(0.0, 0, 0, 0))
        if best[0] <= 1e-9:
            break
        _, k, a, b = best
        spans.remove((a, b))
        spans += [(a, k), (k, b)]
    for a, b in spans:
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and steps of the best tree with one cut on either axis."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    a, b = slice(0, -1), slice(0, -1)
    parts = []
    for cs in (cg, ch):
        q = cs[a, b]
        top, left = cs[a, -1][:, None], cs[-1, b][None, :]
        parts.append((q, top - q, left - q, cs[-1, -1] - top - left + q))
    gain = sum(x**2 / (np.maximum(y, 0) + ridge) for x, y in zip(*parts, strict=True)) - tg**2 / (th + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(g)
    for (x, y), rows, cols in zip(zip(*[[p[i, j] if p.shape == gain.shape else np.broadcast_to(p, gain.shape)[i, j] for p in q] for q in parts], strict=True), (slice(0, i + 1), slice(0, i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(0, j + 1), slice(j + 1, None), slice(0, j + 1), slice(j + 1, None)), strict=True):
        step[rows, cols] = -x / (max(y, 0) + ridge)
    return float(gain[i, j]), step


def fit_arrays(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 60, pair_rounds: int = 30, n_pairs: int = 6, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0) -> Model:
    n, d = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], bins) if n else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    if n == 0 or y.min() == y.max():
        return Model(cuts, tables, [], base)
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    z = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j in range(d):
            g, h = slopes()
            k = len(tables[j])
            step = rate * _tree(np.bincount(at[j], g, k), np.bincount(at[j], h, k), leaves, ridge, 1.0)
            tables[j] += step
            z += step[at[j]]
    coarse = [_cuts(x[:, j], 8) for j in range(d)]
    bt = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(coarse)]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        s = (len(coarse[a]) + 1, len(coarse[b]) + 1)
        return np.bincount(bt[a] * s[1] + bt[b], v, s[0] * s[1]).reshape(s)

    g, h = slopes()
    gains = sorted(((_cross(grid(a, b, g), grid(a, b, h), ridge)[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)[:n_pairs]
    pairs = [(a, b, coarse[a], coarse[b], np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for v, a, b in gains if v > 1e-6]
    for _ in range(pair_rounds):
        for a, b, _, _, t in pairs:
            g, h = slopes()
            step = rate * _cross(grid(a, b, g), grid(a, b, h), ridge)[1]
            t += step
            z += step[bt[a], bt[b]]
    return Model(cuts, tables, pairs, base)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        x = [features(t).tolist() for t in texts(b)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("y").cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0, rows: int = FIT_ROWS) -> Model:
    # of bounded size, and straight to the driver: a file a task would have the executors fork a chmod each
    sample = labelled_sample(docs, labels, label, folds, held_out, rows).mapInArrow(_feature_rows, "doc_id long, y int, x array<double>").toPandas()
    x = np.array(sample["x"].tolist(), float).reshape(-1, len(FEATURES))
    y = sample["y"].to_numpy(float)
    order = np.lexsort([*x.T, y, sample["doc_id"].to_numpy()])  # sums don't depend on the rows' order
    return fit_arrays(x[order], y[order])


def _scores(model: Model, keep: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            x = np.array([features(t) for t in texts(b)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(model.score(x))], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(_scores(model, (id_col,)), f"{id_col} {kind}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is at least the threshold, all columns."""

    def run(batches):
        for b in pieces(batches):
            x = np.array([features(t) for t in texts(b)]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
