"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding, normalised by length, with exception phrases.

Folding: lower case, accents off, look-alike letters of other scripts and digits or signs inside words replaced by the letter
they imitate, invisible characters dropped, all else than letters and digits turned into one space. Entries of the
lexicon are whole words (" word ") or beginnings of words (" stem"), each with a weight; one automaton holds them and the
exception phrases. A hit inside an exception phrase doesn't count. Of nested hits at one word the heaviest counts.

The lexicon is learned from a bounded labelled sample (`common.FIT_ROWS`), folded once: documents of either label that hold a word
or stem are counted in a distributed aggregate, and all entries with strong log odds are kept (`entries` sets a bound). How much surprise an entry needs grows with the number of terms it was picked from
(`level`), so that few labels teach a short lexicon rather than none. The default lexicon fills in the words that the labels
say nothing about. Two-word phrases that hold an entry and stand mostly in clean documents
become exceptions. A logistic curve over the total weight and the weight by length gives the score.

Null and empty texts have no hits and the score of none. Without usable labels, or where they teach no entry, the default
lexicon serves with a fixed curve. Tied or repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

import bisect
import dataclasses
import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.common import FIT_ROWS, fit_logistic, labelled_sample, pieces, texts
from graftwork.session import written

STEMS = range(3, 9)
#: Log likelihood ratio from which a term counts as more than chance, whatever the number of terms.
SURPRISE = 14
#: Terms of the labelled sample that stand in as many documents are candidates; so many of them may pass by chance.
LEAST_DOCS, BY_CHANCE = 3, 4
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ø": "o", "ł": "l", "đ": "d"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
DEFAULT_LEXICON = {" idiot ": 3.0, " moron ": 3.0, " scum ": 3.0, " stupid ": 2.0, " worthless ": 2.0, " pathetic ": 2.0, " disgusting ": 2.0}
DEFAULT_CURVE = (1.0, 1.0, -2.0)

_LOOK = str.maketrans(LOOKALIKES)
_SUB = str.maketrans(SUBSTITUTES)
#: Words that hold a digit or sign; begun at word starts alone and never tried again, so that time follows the length.
_MIXED = re.compile(r"(?<![\w$])(?=[\w$])[^\W0-9]*+[0-9@$][\w@$]*+")
_OTHER = re.compile(r"[\W_]+")
_MARKS = re.compile("[̀-ͯ­​-‏⁠﻿]")


def _letters(m: re.Match) -> str:
    """A word with at least two letters has its digits and signs read as letters; signs at its end stay signs."""
    core = m[0].rstrip("@$")
    return core.translate(_SUB) + " " if sum(map(str.isalpha, core)) >= 2 else m[0]


def fold(text: str) -> str:
    """The folded text, between single spaces."""
    t = text.lower()
    if not t.isascii():
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t)).translate(_LOOK)
    t = _MIXED.sub(_letters, t)
    return f" {_OTHER.sub(' ', t).strip()} "


@dataclasses.dataclass
class Model:
    """entries: pattern -> weight; exceptions: phrases between spaces; curve: weights of total, by length, intercept."""

    entries: dict[str, float]
    exceptions: list[str]
    curve: tuple[float, float, float] = (1.0, 0.5, -2.0)

    def automaton(self):
        """Of entries and exceptions: each pattern's length and weight, None for an exception."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for e, w in (self.entries | dict.fromkeys(self.exceptions)).items():
            a.add_word(e, (len(e), w))
        if len(a):
            a.make_automaton()
        return a

    def hits(self, automaton, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the hits that count in the folded text, one a word at most."""
        found, skip = {}, []
        if not len(automaton):
            return []
        for end, (n, w) in automaton.iter(folded):
            start = end - n + 1
            if w is None:
                skip.append((start, end))
            elif w > found.get(start, (0, 0.0))[1]:
                found[start] = (end, w)
        if skip:
            skip.sort()
            starts, reach = [a for a, _ in skip], list(itertools.accumulate((b for _, b in skip), max))
            # a hit is quiet if a phrase that begins at or before it ends at or behind it
            found = {s: x for s, x in found.items() if not (k := bisect.bisect_right(starts, s)) or reach[k - 1] < x[0]}
        return [(s, e, w) for s, (e, w) in sorted(found.items())]

    def features(self, automaton, folded: str) -> tuple[float, float, int]:
        """Logarithm of the total weight, the weight by length, and the number of hits of a folded text."""
        total = 0.0
        n = 0
        for _, _, w in self.hits(automaton, folded):
            total, n = total + w, n + 1
        return np.log1p(total), total / np.sqrt(1 + folded.count(" ")) , n

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x[:, 0] * self.curve[0] + x[:, 1] * self.curve[1] + self.curve[2], -30, 30)))


def _terms(folded: str) -> set[str]:
    seen = set(folded.split())
    out = {f" {w} " for w in seen}
    for w in seen:
        out.update(f" {w[:n]}" for n in STEMS if n <= len(w))
    return out


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bad, good = Counter(), Counter()

    def out():
        keys = list(bad.keys() | good.keys())
        return pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "bad": pa.array([bad[k] for k in keys], pa.int64()), "good": pa.array([good[k] for k in keys], pa.int64())})

    for b in pieces(batches):
        for t, y in zip(texts(b), b.column("y").to_pylist(), strict=True):
            (bad if y else good).update(_terms(t))
        if len(bad) + len(good) > 150_000:
            yield out()
            bad.clear()
            good.clear()
    yield out()


def _phrases(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, bad, good = model.automaton(), Counter(), Counter()
        for b in pieces(batches):
            for t, y in zip(texts(b), b.column("y").to_pylist(), strict=True):
                f, mine = t, set()
                for s, e, _ in model.hits(a, f):
                    e = f.index(" ", max(e, s + 1))
                    before, after = f.rfind(" ", 0, s), f.find(" ", e + 1)
                    if before >= 0 and s > 0:
                        mine.add(f[before : e + 1])
                    if after > 0:
                        mine.add(f[s : after + 1])
                (bad if y else good).update(mine)
        keys = list(good.keys() | bad.keys())
        yield pa.RecordBatch.from_pydict({"term": pa.array(keys, pa.string()), "bad": pa.array([bad[k] for k in keys], pa.int64()), "good": pa.array([good[k] for k in keys], pa.int64())})

    return run


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in texts(b)], pa.string()), b.column("y")], names=["text", "y"])


def _features(model: Model, keep: tuple[str, ...], folded: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = model.automaton()
        for b in pieces(batches):
            x = np.array([model.features(a, t if folded else fold(t)) for t in texts(b)], float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(x[:, 2].astype(np.int32)), pa.array(model.score(x))], names=[*keep, "total", "by_length", "hits", "score"])

    return run


def choose(counts: Iterable[tuple[str, int, int]], n_bad: int, n_good: int, odds: float = 2.0, most: int | None = None) -> dict[str, float]:
    """Entries by log odds: of a stem and what extends it, the longest that most of the stem's documents share."""
    scored = {}
    for term, bad, good in counts:
        w = np.log((bad + 0.25) / (n_bad + 0.5)) - np.log((good + 0.25) / (n_good + 0.5))
        if w >= odds:
            scored[term] = (float(min(w, 6.0)), bad)

    def stems(term: str) -> list[str]:
        return [p for n in STEMS if n <= len(term.strip()) and (p := f" {term.strip()[:n]}") != term]

    narrower = dict.fromkeys(scored, 0)  # the largest support of what extends it
    for term, (_, bad) in scored.items():
        for p in stems(term):
            if p in narrower:
                narrower[p] = max(narrower[p], bad)
    kept: dict[str, float] = {}
    for term in sorted(scored, key=lambda t: (len(t.strip()), t)):
        w, bad = scored[term]
        if narrower[term] < 0.7 * bad and all(w > kept[p] + 1.0 for p in stems(term) if p in kept):
            kept[term] = w
    return dict(sorted(kept.items(), key=lambda kv: (-kv[1] * np.sqrt(scored[kv[0]][1]), kv[0]))[:most])


def level(candidates: int) -> float:
    """The log likelihood ratio x that `BY_CHANCE` of the candidates reach by chance (each with odds exp(-x)), `SURPRISE` at most."""
    return float(min(SURPRISE, np.log(max(1.0, candidates / BY_CHANCE))))


def filled(learned: dict[str, float], seen: Iterable[tuple[str, int, int]], base: float) -> dict[str, float]:
    """The learned entries and those of the default lexicon that they don't cover; not those that stand mostly in clean documents."""
    clean = {term for term, bad, good in seen if bad <= base * (bad + good)}
    return learned | {e: w for e, w in DEFAULT_LEXICON.items() if e not in clean and not any(e.startswith(k) for k in learned)}


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, rows: int = FIT_ROWS, entries: int | None = None) -> Model:
    """The model of a labelled sample of `rows` documents at most; `entries` bounds lexicon and exceptions (None: all that qualify)."""
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, rows).select("text", "y").mapInArrow(_fold_rows, "text string, y int")
    sample = written(sample, "toxic-sample")
    n = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model(dict(DEFAULT_LEXICON), [], DEFAULT_CURVE)
    both = (F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = sample.mapInArrow(_count_terms, "term string, bad long, good long").groupBy("term").agg(*both)
    counts = written(counts.where(f"bad + good >= {LEAST_DOCS}"), "toxic-terms")
    least = level(counts.count())
    base = n[1] / (n[1] + n[0])
    surprise = F.expr(f"bad * ln(bad / ((bad + good) * {base}D)) + if(good = 0, 0D, good * ln(good / ((bad + good) * {1 - base}D)))")
    strong = counts.where(f"bad >= {LEAST_DOCS} and bad > {2 * base}D * (bad + good)").where(surprise >= least).collect()  # terms of the sample
    learned = choose(((r.term, r.bad, r.good) for r in strong), n[1], n[0], most=entries)
    if not learned:
        return Model(dict(DEFAULT_LEXICON), [], DEFAULT_CURVE)
    model = Model(filled(learned, counts.where(F.col("term").isin(*DEFAULT_LEXICON)).collect(), base), [])
    phrases = sample.mapInArrow(_phrases(model), "term string, bad long, good long").groupBy("term").agg(*both)
    quiet = [r.term for r in phrases.where("good >= 5 and good > 9 * bad").orderBy(F.desc("good"), "term").collect() if r.term not in model.entries]
    model.exceptions = quiet[:entries]
    x = sample.mapInArrow(_features(model, ("y",), folded=True), "y int, total double, by_length double, hits int, score double").select("y", "total", "by_length").toPandas()
    w = fit_logistic(x[["total", "by_length"]].to_numpy(), x["y"].to_numpy(float))
    model.curve = tuple(float(v) for v in w)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, total, by_length, hits, score) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(_features(model, (id_col,)), f"{id_col} {kind}, total double, by_length double, hits int, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows whose score is below the threshold, all columns."""

    def run(batches):
        a = model.automaton()
        for b in pieces(batches):
            x = np.array([model.features(a, fold(t)) for t in texts(b)], float).reshape(-1, 3)
            yield b.filter(pa.array(model.score(x) < threshold))

    return docs.mapInArrow(run, docs.schema)
