"""Token-id files of patched frame-of-reference blocks.

A file holds the documents of one range of doc_id, in ascending order (nulls first, ties by the text's hash). It is a sequence of
frames, each ended by `MARK`:

    frame    := kind (1 byte) payload_length (u32) payload
    "B"      := blocks of `BLOCK` ids one after another (the last one shorter)
    block    := count u16, width u8, exceptions u16, minimum u32, ids packed at `width` bits (little-endian bit order),
                exception positions u16 each, exception high parts u32 each
    "I"      := n_docs u64, n_null u64, n_ids u64, n_blocks u64, doc ids i64 (those of the first n_null are null), ids of each
                document u32, start of each block in the file u64, length of this payload u64

A block subtracts its minimum and packs the low bits at the width that the `PERCENTILE` smallest values need; the rest's high
parts go to the exception list. The index frame stands last and ends in its own length, so that a reader finds it from the file's
end, and its block starts are places in the file, so that any id range is read by seeking to its blocks; nothing reads a file
whole. A document's place in the corpus is its file's base (ids of all files before, one number a file) plus its place in the file.

Files are written by Spark's own committer, so that lost executors' tasks are run again and leave no half files; they number
as many as `FILE` bytes of estimated input ask for (`spark.sql.shuffle.partitions` at least).
Null counts as empty text; null ids come first; rows with equal ids are all kept, in order of their texts' hashes. Ids must fit 32
bits. Other columns play no part.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.bpe import encoder
from graftwork.llm.common import file_count, open_store, pieces
from graftwork.session import written

BLOCK = 4096
PERCENTILE = 0.95
MARK = "\x03PFOR\x04\n"
_END = MARK.encode("latin-1")
_HEAD = struct.Struct("<HBHI")
#: Ids in a B frame, bytes that one read fetches, about, and bytes of input, as Catalyst estimates them, of one file.
FRAME, SPAN, FILE = 1 << 18, 4 << 20, 1 << 30


def _pack_bits(v: np.ndarray, width: int) -> bytes:
    if not width:
        return b""
    bits = ((v[:, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def _unpack_bits(raw: bytes, n: int, width: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").reshape(n)


def _widths(v: np.ndarray) -> np.ndarray:
    return np.searchsorted(2 ** np.arange(33, dtype=np.uint64), v, "right")


def encode_block(ids: np.ndarray) -> bytes:
    low = int(ids.min())
    v = (ids - np.uint32(low)).astype(np.uint32)
    k = max(0, int(np.ceil(PERCENTILE * len(v))) - 1)
    width = int(_widths(np.partition(v, k)[k : k + 1].astype(np.uint64))[0])
    mask = np.uint32((1 << width) - 1)
    at = np.flatnonzero(v > mask)
    return _HEAD.pack(len(v), width, len(at), low) + _pack_bits(v & mask, width) + at.astype("<u2").tobytes() + (v[at] >> np.uint32(width) if width < 32 else v[at] * 0).astype("<u4").tobytes()


def decode_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids, and where the block ends."""
    n, width, odd, low = _HEAD.unpack_from(raw, at)
    at += _HEAD.size
    size = (n * width + 7) // 8
    v = _unpack_bits(raw[at : at + size], n, width)
    at += size
    if odd:
        where = np.frombuffer(raw, "<u2", odd, at)
        v[where] |= np.frombuffer(raw, "<u4", odd, at + 2 * odd) << np.uint32(width)
    return v + np.uint32(low), at + 6 * odd


_FRAME_HEAD = 5


def _frame(kind: bytes, payload: bytes) -> bytes:
    return kind + struct.pack("<I", len(payload)) + payload


def _index(doc_ids: list, counts: list[int], starts: list[int]) -> bytes:
    n_null = sum(d is None for d in doc_ids)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    out = struct.pack("<QQQQ", len(ids), n_null, sum(counts), len(starts)) + ids.tobytes() + np.array(counts, "<u4").tobytes() + np.array(starts, "<u8").tobytes()
    return out + struct.pack("<Q", len(out) + 8)


def _writer(path: str, end_id: int):
    """Frames of a sorted partition, as rows for Spark's writer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        doc_ids, counts, starts, offset = [], [], [], 0
        held: list[np.ndarray] = []
        n_held = 0

        def blocks(ids: np.ndarray) -> bytes:
            nonlocal offset
            out = []
            offset += _FRAME_HEAD
            for at in range(0, len(ids), BLOCK):
                starts.append(offset)
                out.append(encode_block(ids[at : at + BLOCK]))
                offset += len(out[-1])
            offset += len(_END)
            return _frame(b"B", b"".join(out))

        for b in pieces(batches, 4 << 20):
            rows = []
            ids = enc.encode_batch([t or "" for t in b.column("text").to_pylist()])
            doc_ids += b.column("doc_id").to_pylist()
            end = np.array([end_id], np.uint32)
            for i in ids:
                counts.append(len(i) + 1)
                held += [i, end]
                n_held += len(i) + 1
            if n_held >= FRAME:
                whole = np.concatenate(held)
                cut = n_held // BLOCK * BLOCK
                rows = [blocks(whole[a : min(a + FRAME, cut)]) for a in range(0, cut, FRAME)]
                held, n_held = [whole[cut:]], n_held - cut
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["value"])
        if doc_ids:
            rows = [blocks(np.concatenate(held))] if n_held else []
            yield pa.RecordBatch.from_arrays([pa.array([*rows, _frame(b"I", _index(doc_ids, counts, starts))], pa.binary())], names=["value"])

    return run


def write_token_files(docs: DataFrame, path: str, out: str, end_id: int = 2, partitions: int | None = None) -> None:
    """Encodes every text, appends the end id, and writes a file for each range of doc_id into the folder `out`."""
    n = partitions or file_count(docs.select("text"), FILE)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"))
    frames = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_writer(path, end_id), "value binary")
    frames.select(F.col("value").cast("string")).write.option("lineSep", MARK).option("encoding", "ISO-8859-1").text(out)


class TokenFile:
    """One file, read by ranges: doc_ids (None: null), counts (ids of each document) and starts come from the index frame."""

    def __init__(self, uri: str) -> None:
        store, place = open_store(uri)
        self.file = store.open_input_file(place)
        size = self.file.size()
        self.doc_ids, self.counts, self.starts, self.end = [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if not size:
            return
        tail = self._read(size - len(_END) - 8, size)
        if tail[8:] != _END:
            raise ValueError("a token file doesn't end in its mark")
        length = struct.unpack_from("<Q", tail)[0]
        self.end = size - len(_END) - length - _FRAME_HEAD  # where the index frame begins
        frame = self._read(self.end, size - len(_END))
        if frame[:_FRAME_HEAD] != b"I" + struct.pack("<I", length):
            raise ValueError("a token file's index isn't where its end says")
        n_docs, n_null, n_ids, n_blocks = struct.unpack_from("<QQQQ", frame, _FRAME_HEAD)
        at = _FRAME_HEAD + 32
        self.doc_ids = [None] * n_null + np.frombuffer(frame, "<i8", n_docs, at)[n_null:].tolist()
        self.counts = np.frombuffer(frame, "<u4", n_docs, at + 8 * n_docs).astype(np.int64)
        self.starts = np.frombuffer(frame, "<u8", n_blocks, at + 12 * n_docs).astype(np.int64)
        if self.counts.sum() != n_ids:
            raise ValueError("a token file's index disagrees with its counts")

    def _read(self, start: int, end: int) -> bytes:
        self.file.seek(start)
        return self.file.read(end - start)

    def blocks(self, first: int, end: int) -> Iterator[np.ndarray]:
        """The ids of blocks first..end - 1, neighbours fetched together."""
        while first < end:
            last = max(first + 1, min(end, int(np.searchsorted(self.starts, self.starts[first] + SPAN))))
            raw = self._read(int(self.starts[first]), int(self.starts[last]) if last < len(self.starts) else self.end)
            for i in range(first, last):
                yield decode_block(raw, int(self.starts[i] - self.starts[first]))[0]
            first = last

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids first..first + count - 1 of the file: only the blocks that hold them are read."""
        # a B frame may end in a short block only at the file's end, so that block i begins with id i * BLOCK
        a, b = first // BLOCK, min(len(self.starts), -(-(first + count) // BLOCK))
        got = list(self.blocks(a, b))
        return np.concatenate(got)[first - a * BLOCK :][:count] if got else np.zeros(0, np.uint32)


_ROW = pa.schema([("path", pa.string()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            f = TokenFile(path)
            blocks, rest, local = f.blocks(0, len(f.starts)), np.zeros(0, np.uint32), 0
            for at in range(0, len(f.doc_ids), 10_000):
                counts, crcs = f.counts[at : at + 10_000], []
                for n in counts.tolist():
                    crc = 0
                    while n:
                        if not len(rest):
                            rest = next(blocks)
                        take, rest = rest[:n], rest[n:]
                        crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                        n -= len(take)
                    crcs.append(crc)
                places = local + np.concatenate([[0], np.cumsum(counts)])
                local = int(places[-1])
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(crcs), pa.string()), pa.array(f.doc_ids[at : at + 10_000], pa.int64()), pa.array(places[:-1]), pa.array(counts), pa.array(crcs, pa.int64())], schema=_ROW)


def file_number(path: str) -> int:
    """The place of a file among its folder's: the number that Spark's writer gives it (names sort otherwise from 100,000 on)."""
    return int(re.search(r"part-(\d+)", path.rsplit("/", 1)[-1])[1])


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files in the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")  # contents aren't read
    local = written(files.mapInArrow(_read, "path string, doc_id long, local long, n_tokens long, ids_crc32 long"), "read")
    sums = local.groupBy("path").agg(F.sum("n_tokens").alias("n")).collect()  # a number for each file
    base, total = {}, 0
    for r in sorted(sums, key=lambda r: file_number(r.path)):  # numbers follow the ranges
        base[r.path], total = total, total + r.n
    bases = spark.createDataFrame(list(base.items()), "path string, base long")
    return local.join(F.broadcast(bases), "path").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
