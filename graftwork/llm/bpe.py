"""BPE encoding and decoding with content-defined chunk reuse.

`Encoder` encodes as the tokenizers library does with a byte-level BPE file: a text is cut into the pre-tokenizer's
pieces, distinct pieces are encoded by the library's model and remembered, and ids are joined. Files with another
pre-tokenizer, a normalizer, a post-processor or added tokens with special handling go to the library as whole texts.

`encode_documents` cuts texts at places chosen by a rolling hash of the last 16 bytes. Chunks that stand more than once in the
corpus are encoded once, by a distributed count and an equi-join from which the most frequent chunks are split off; documents
that share nothing are encoded where they are read, and only the others (compressed) and the ids of their shared chunks are
shuffled. A cut may fall anywhere, so
joins are repaired: text between the last place before and the first place behind a cut where pieces must end (a visible
ASCII sign before a blank) is encoded anew, and ids on either side are kept where their bytes end exactly there;
a chunk without such places, or whose ids don't end there, is encoded anew with its neighbours. That rule has its ground in the
byte-level pre-tokenizer, so that with files of another kind nothing is cut: whole texts go to the library.

Null counts as empty text, with no ids. Rows are matched by a hash of id and text, so that repeated rows and ids are all kept.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graftwork.llm.common import bloom_has, bounded_bloom, join_hot, pieces
from graftwork.llm.common import lean_written as written

#: The published pre-tokenizer pattern of byte-level BPE; its white space is Unicode's.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts whose characters are ASCII or the Latin letters up to U+024F.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
LATIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^ \t-\r{LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pieces that one process remembers; beyond that the later ones go.
MEMO = 350_000
LEAST, MOST, MEAN_BITS = 256, 8192, 10
#: Chunks that are broadcast with their ids at most (16 MiB in the worst case).
HOT_CHUNKS = 1000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memo(dict):
    """Ids of pieces; encodes what it hasn't seen."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


def by_piece(spec: dict) -> bool:
    """Whether pieces of the byte-level pre-tokenizer are encoded each by itself, and nothing else changes the text."""
    added, pre = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    special = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
    return bool(plain and spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not special)


class Encoder:
    def __init__(self, path: str) -> None:
        import re

        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = spec.get("added_tokens") or []
        self.by_piece = by_piece(spec)
        self.find, self.find_latin = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.latin = re.compile(rf"[\x00-\x7f{LATIN[6:]}]*").fullmatch
        self.special = {t["content"]: t["id"] for t in added}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = _byte_letters()
        size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length_of = np.fromiter(map(len, self.bytes_of), np.int64, size)
        self.packed = "<u2" if size <= 1 << 16 else "<u4"  # as ids travel
        self.decimals = [str(i) for i in range(size)]
        self.letters = {b: c for c, b in letters.items()}
        self.ascii_letters = {b: self.letters[b] for b in range(128)}
        self.tokenize = self.library.model.tokenize
        self.memo = _Memo(self._piece)

    def _split(self, text: str) -> list[str]:
        return self.find_latin(text) if text.isascii() or self.latin(text) else self.find(text)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, by the library's model."""
        if piece in self.special:
            return array("I", [self.special[piece]]).tobytes()
        letters = piece.translate(self.ascii_letters) if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode("utf-8", "surrogatepass")))
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids (unsigned 32 bits) of each text."""
        if not self.by_piece:
            return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        split: list[list] = []
        for t in texts:
            if self.cut and any(s in t for s in self.special):
                parts, at = [], 0
                for m in self.cut.finditer(t):
                    parts += [*self._split(t[at : m.start()]), m[0]]
                    at = m.end()
                split.append([*parts, *self._split(t[at:])])
            else:
                split.append(self._split(t))
        if len(self.memo) > MEMO:  # what came early is common
            for p in list(itertools.islice(self.memo, MEMO // 2, None)):
                del self.memo[p]
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), np.uint32) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimals.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each process and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def cuts(raw: bytes) -> list[int]:
    """Ends of the chunks: behind bytes whose rolling hash ends in zeros, at starts of characters, `LEAST` to about `MOST` bytes apart."""
    n = len(raw)
    if n <= LEAST:
        return [n]
    b = np.frombuffer(raw, np.uint8)
    h = _GEAR[b]
    for s in (1, 2, 4, 8):
        g = h.copy()
        g[s:] += h[:-s] << np.uint32(s)
        h = g
    marks = (np.flatnonzero((h >> np.uint32(32 - MEAN_BITS)) == 0) + 1).tolist()
    out, last = [], 0
    for m in [*marks, n]:
        if m - last < LEAST and m != n:
            continue
        while m - last > MOST:
            last = _character(raw, last + MOST)
            out.append(last)
        m = _character(raw, m)
        if m > last and (m - last >= LEAST or m == n):
            out.append(m)
            last = m
    return out


def _character(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(raw: bytes) -> list[bytes]:
    ends = cuts(raw)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_hash(chunk: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(chunk)


def _safe(raw: bytes, lo: int, hi: int, step: int) -> int:
    """The first (step 1) or last (step -1) place in lo..hi where a visible ASCII sign stands before a blank; -1 for none."""
    at = lo if step > 0 else hi
    while True:
        a = raw.find(b" ", at, hi) if step > 0 else raw.rfind(b" ", lo, at)
        if a < 0:
            return -1
        if a > 0 and 33 <= raw[a - 1] <= 126 and a > lo:
            return a
        at = a + 1 if step > 0 else a


def assemble(enc: Encoder, raw: bytes, ends: list[int], known: dict[int, np.ndarray]) -> np.ndarray:
    """The whole text's ids, from ids that are known of some chunks and new ones of the rest and of all joins."""
    parts: list = []
    strip = 0  # where text that isn't encoded yet begins
    start = 0
    for i, end in enumerate(ends):
        ids = known.get(i)
        if ids is not None:
            lo = 0 if start == 0 else _safe(raw, start, end, 1)
            hi = len(raw) if end == len(raw) else _safe(raw, start, end, -1)
            if lo >= 0 and hi > lo:
                at = start + np.concatenate([[0], np.cumsum(enc.length_of[ids])])
                a, b = np.searchsorted(at, lo), np.searchsorted(at, hi)
                if at[-1] == end and at[a] == lo and at[b] == hi:  # ids agree with the places
                    if lo > strip:
                        parts.append(raw[strip:lo])
                    parts.append(ids[a:b])
                    strip = hi
        start = end
    if strip < len(raw):
        parts.append(raw[strip:])
    new = iter(enc.encode_batch([p.decode("utf-8", "surrogatepass") for p in parts if isinstance(p, bytes)]))
    out = [next(new) if isinstance(p, bytes) else p for p in parts]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["hash", "n"])

    for b in pieces(batches):
        for t in b.column("text").to_pylist():
            seen.update(map(chunk_hash, chunks(_raw(t))))
        if len(seen) > 500_000:
            yield out()
            seen.clear()
    yield out()


def _row_key(doc_id, raw: bytes) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(repr(doc_id).encode() + b"\0" + raw)


def _shared_chunks(bits):
    """(hash, chunk) of chunks that may be shared, each once a task."""

    def run(batches):
        seen: set = set()
        for b in pieces(batches):
            hashes, found = [], []
            for t in b.column("text").to_pylist():
                for c in chunks(_raw(t)):
                    h = chunk_hash(c)
                    if bloom_has(bits.value, h) and h not in seen:
                        seen.add(h)
                        hashes.append(h)
                        found.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(found, pa.binary())], names=["hash", "chunk"])

    return run


def _encode_chunks(path: str):
    def run(batches):
        enc = encoder(path)
        for b in pieces(batches):
            ids = enc.encode_batch([c.decode("utf-8", "surrogatepass") for c in b.column("chunk").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("hash"), pa.array([i.astype(enc.packed).tobytes() for i in ids], pa.binary())], names=["hash", "ids"])

    return run


def _digests(enc: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(enc.decimal(ids).encode()).hexdigest(), hashlib.sha256(enc.decode(ids).encode()).hexdigest()


def _result(doc_ids: pa.Array, ids: list[np.ndarray], enc: Encoder, full: bool) -> pa.RecordBatch:
    if full:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([enc.decode(i) for i in ids], pa.string())], names=["doc_id", "ids", "decoded"])
    n, a, b = zip(*(_digests(enc, i) for i in ids), strict=True) if ids else ((), (), ())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _whole(path: str, full: bool):
    """Results of the library for whole texts."""

    def run(batches):
        enc = encoder(path)
        for b in pieces(batches, 4 << 20):
            yield _result(b.column("doc_id"), enc.encode_batch([t or "" for t in b.column("text").to_pylist()]), enc, full)

    return run


_REFS = pa.list_(pa.struct([("seq", pa.int32()), ("hash", pa.binary())]))


def _first(path: str, bits, full: bool):
    """Results of the documents that share no chunk; key, packed text and places of chunks that may be shared of the others."""
    import zlib

    def run(batches):
        enc = encoder(path)
        for b in pieces(batches, 4 << 20):
            alone, mine, texts, rest = [], [], [], []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = _raw(t)
                refs = [{"seq": i, "hash": h} for i, c in enumerate(chunks(raw)) if bloom_has(bits.value, h := chunk_hash(c))] if raw else []
                alone.append(not refs)
                if refs:
                    rest.append((_row_key(d, raw), zlib.compress(raw, 1), refs))
                else:
                    texts.append(t or "")
                mine.append(d)
            kind = b.column("doc_id").type
            r = _result(pa.array([d for d, a in zip(mine, alone, strict=True) if a], kind), enc.encode_batch(texts), enc, full)
            n, m = r.num_rows, len(rest)
            none = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, _REFS)]
            yield pa.RecordBatch.from_arrays([*r.columns, *none], names=[*r.schema.names, "key", "packed", "refs"])
            k, z, f = zip(*rest, strict=True) if rest else ((), (), ())
            shared = [pa.array(k, pa.binary()), pa.array(z, pa.binary()), pa.array(f, _REFS)]
            ids = pa.array([d for d, a in zip(mine, alone, strict=True) if not a], kind)
            yield pa.RecordBatch.from_arrays([ids, *(pa.nulls(m, c.type) for c in r.columns[1:]), *shared], names=[*r.schema.names, "key", "packed", "refs"])

    return run


def _assembled(path: str, full: bool):
    import zlib

    def run(batches):
        enc = encoder(path)
        for b in pieces(batches, 4 << 20):
            ids = []
            for z, got in zip(b.column("packed").to_pylist(), b.column("got").to_pylist(), strict=True):
                raw = zlib.decompress(z)
                ids.append(assemble(enc, raw, cuts(raw), {g["seq"]: np.frombuffer(g["ids"], enc.packed).astype(np.uint32) for g in got or []}))
            yield _result(b.column("doc_id"), ids, enc, full)

    return run


def encode_documents(docs: DataFrame, path: str, full: bool = False) -> DataFrame:
    """doc_id with n_tokens and digests of ids and decoded text, or (full) with ids and decoded."""
    rows = docs.select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, ids array<int>, decoded string" if full else f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    with open(path, encoding="utf-8") as f:
        plain = by_piece(json.load(f))
    if not plain:
        return rows.mapInArrow(_whole(path, full), out)
    counts = rows.select("text").mapInArrow(_count_chunks, "hash binary, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    shared = written(counts.where("n > 1"), "shared")
    bits = sc.broadcast(bounded_bloom(shared.select("hash")))
    once = rows.select("text").mapInArrow(_shared_chunks(bits), "hash binary, chunk binary").groupBy("hash").agg(F.first("chunk").alias("chunk"))
    coded = written(once.mapInArrow(_encode_chunks(path), "hash binary, ids binary").join(shared, "hash"), "coded")
    first = written(rows.mapInArrow(_first(path, bits, full), f"{out}, key binary, packed binary, refs array<struct<seq:int,hash:binary>>"), "first")
    bits.destroy()
    alone, sharing = first.where("key is null").drop("key", "packed", "refs"), first.where("key is not null").select("key", "doc_id", "packed", "refs")
    refs = sharing.select("key", F.explode("refs").alias("r")).select("key", "r.seq", "r.hash").distinct()
    got = join_hot(refs, coded, ["hash"], "n", HOT_CHUNKS).groupBy("key").agg(F.collect_list(F.struct("seq", "ids")).alias("got"))
    joined = sharing.join(got, "key", "left").select("doc_id", "packed", "got")
    return alone.unionByName(joined.mapInArrow(_assembled(path, full), out))
