"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text splits after blank lines into sections, after line ends into paragraphs and after sentence ends into leaves; the
separators stay with the piece before them, so that the leaves join to the text; a leaf has 256 characters before its end at
most. A node's digest is the SHA-256 of its level and its children's digests, cut to 16 bytes; the root's digest tests equality,
and the walk down differing branches locates edits: `edits` counts the leaves that it finds in a text against its edited text. The
likeness of two trees is the Dice share of leaf bytes in common, as multisets (1 for equal trees, of two empty ones too), so
that moved paragraphs still count.

Null counts as empty text; the empty text's tree is the root alone. Documents are put in order by id, null ids first, then by
their texts' hashes, so that rows with equal ids have a defined order. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.llm.common import file_count, pieces
from graftwork.session import written

_SECTIONS = re.compile(r".*?(?:\n[ \t\r]*\n\s*|\Z)", re.S)
_SENTENCES = re.compile(r"[^.!?]{0,255}[.!?]+\s*|[^.!?]{1,256}", re.S)


#: Bytes of input, as Catalyst estimates them, that one range is swept over, about.
RANGE = 1 << 30


def _digest(level: bytes, parts: list[bytes]) -> bytes:
    return hashlib.sha256(level + b"".join(parts)).digest()[:16]


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def split_sections(text: str) -> list[str]:
    return [s for s in _SECTIONS.findall(text) if s]


def split_paragraphs(section: str) -> list[str]:
    return section.splitlines(keepends=True) if "\r" not in section else re.findall(r"[^\n]*\n|[^\n]+", section)


def split_sentences(paragraph: str) -> list[str]:
    return _SENTENCES.findall(paragraph)


class Tree:
    """sections: (digest, [(digest, [(leaf digest, leaf bytes)])]); root: digest."""

    def __init__(self, text: str) -> None:
        self.sections = []
        for s in split_sections(text):
            paragraphs = []
            for p in split_paragraphs(s):
                leaves = [(_digest(b"L", [raw := _utf8(x)]), len(raw)) for x in split_sentences(p)]
                paragraphs.append((_digest(b"P", [d for d, _ in leaves]), leaves))
            self.sections.append((_digest(b"S", [d for d, _ in paragraphs]), paragraphs))
        self.root = _digest(b"R", [d for d, _ in self.sections])

    def leaves(self) -> Counter:
        out: Counter = Counter()
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                for d, n in leaves:
                    out[d] += n
        return out


def likeness(a: Tree, b: Tree) -> float:
    if a.root == b.root:
        return 1.0
    x, y = a.leaves(), b.leaves()
    total = sum(x.values()) + sum(y.values())
    return 2.0 * sum(min(n, y[d]) for d, n in x.items() if d in y) / total if total else 1.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int, int]]:
    """(section, paragraph, sentence) positions in `a` that stand under differing branches and are nowhere below the same node of `b`."""
    out = []
    if a.root == b.root:
        return out
    for i, (ds, paragraphs) in enumerate(a.sections):
        if i < len(b.sections) and b.sections[i][0] == ds:
            continue
        theirs = b.sections[i][1] if i < len(b.sections) else []
        for j, (dp, leaves) in enumerate(paragraphs):
            if j < len(theirs) and theirs[j][0] == dp:
                continue
            other = {d for d, _ in theirs[j][1]} if j < len(theirs) else set()
            out += [(i, j, k) for k, (d, _) in enumerate(leaves) if d not in other]
    return out


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edits", pa.int64())])
_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits long"
_SWEPT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), *_SCHEMA, ("text", pa.string())])
_ROW = f"kind int, part int, {_OUT}, text string"


def _compare(text: str, tree: Tree, following: str, next_tree: Tree) -> tuple:
    e = edited(text, following)
    other = Tree(e)
    return len(text), hashlib.sha256(_utf8(e)).hexdigest(), tree.root.hex(), other.root.hex(), likeness(tree, other), likeness(tree, next_tree), len(differing(tree, other))


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted partition: kind 0 for each document whose follower is here, 1 for the first and 2 for the last document's text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    none, last = (None,) * 7, None
    for b in pieces(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            tree = Tree(text)
            if last is None:
                rows.append((1, part, doc_id, *none, text))
            else:
                rows.append((0, part, last[0], *_compare(last[1], last[2], text, tree), None))
            last = (doc_id, text, tree)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SWEPT, strict=True)], schema=_SWEPT) if rows else pa.RecordBatch.from_pylist([], _SWEPT)
    if last is not None:
        yield pa.RecordBatch.from_pylist([{"kind": 2, "part": part, "doc_id": last[0], "text": last[1]}], _SWEPT)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, *_compare(t, Tree(t), n, Tree(n))) for d, t, n in zip(*(b.column(k).to_pylist() for k in ("doc_id", "text", "following")), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in rows], _SCHEMA)


def fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Each document's root, that of its text edited with the next document's, and the likenesses; one shuffle of the texts.

    Documents are dealt out by ranges of (id, text) and swept in order. A range's last document meets the next
    non-empty range's first one afterwards: two rows a range.
    """
    n = partitions or file_count(docs.select("text"), RANGE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    swept = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_sweep, _ROW), "merkle")
    firsts = swept.where("kind = 1").select(F.col("part").alias("after"), F.col("text").alias("following"))
    # the window sees the numbers of the ranges alone, one row a range; the last one is followed by the first
    turn = firsts.select(F.col("after").alias("part"), F.coalesce(F.lead("after").over(W.orderBy("after")), F.min("after").over(W.partitionBy(F.lit(0)))).alias("after"))
    closing = swept.where("kind = 2").select("part", "doc_id", "text").join(turn, "part").join(firsts, "after").select("doc_id", "text", "following")
    return swept.where("kind = 0").select(*_SCHEMA.names).unionByName(closing.mapInArrow(_close, _OUT))
