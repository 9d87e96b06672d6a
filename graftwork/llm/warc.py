"""WARC archives with a two-level capture index.

Archives are files of gzip members, one record each, written by Spark's own committer (lost tasks are run again and leave no half
files): a member a row, with an empty gzip member as the line separator. Of records with equal payloads of at least
`LEAST_PAYLOAD` bytes, that with the smallest page id is the response; the others are revisits that carry its
id, the payload's digest and its length. Equal payloads are found by digest, so that only digests are shuffled for it.

The index follows from reading the archives: one line a capture (key, page id, file, offset, length), the key being the reversed
host and path of the url. Lines are sorted by (key, page id), cut into blocks of at least `BLOCK` lines, and
compressed. The directory keeps each block's first line only, `DIRECTORY` entries at most (blocks grow beyond that), so that
it may be broadcast. A lookup finds the block in the directory by binary search, the lines in the block by binary search, and then
reads just the record's bytes from the archive.

Archives number as many as `FILE` bytes of estimated input ask for (`spark.sql.shuffle.partitions` at least), and are only ever
read as streams of bounded slices or by ranges, so that no file has to fit in memory.

Null html is an empty payload; null urls have an empty key. Page ids should be unique; of rows with equal ids and urls each
keeps its own record, and a lookup gives all of them. Null page ids stay null; they are a response only where all equal payloads
have null ids (each of these then is one). Other columns play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.llm.common import file_count, join_hot, open_store, pieces
from graftwork.session import written

LEAST_PAYLOAD = 100
BLOCK = 3000
DIRECTORY = 1 << 16
#: Bytes of neighbouring records that one read fetches at most.
SPAN = 4 << 20
#: Bytes of a slice that archives are scanned in, and of a member that is decompressed at a time.
SLICE, STEP = 1 << 20, 1 << 12
#: Bytes of input, as Catalyst estimates them, that one archive holds, about.
FILE = 1 << 30


def _gzip(raw: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


_EMPTY = _gzip(b"")
SEPARATOR = _EMPTY.decode("latin-1")


def _target(url: str | None) -> str:
    """The url, or its JSON where a header line couldn't hold it or null couldn't be told from it."""
    plain = url is not None and url != "null" and not url.startswith('"') and "\r" not in url and "\n" not in url
    return url if plain else json.dumps(url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to) holds headers alone."""
    kind = "response" if refers_to is None else "revisit"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_target(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(h["content-length"])]
    return h, body.partition(b"\r\n\r\n")[2]


def members(read) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member that isn't empty; `read(n)` gives the next n bytes or fewer, b"" at the end.

    A member is fed in steps of `STEP` bytes, so that what is left over behind its end is never more than a step.
    """
    held, pos, at = b"", 0, 0  # the slice, the place in it, and that place's offset in the file
    while True:
        d, parts, start = zlib.decompressobj(31), [], at
        while not d.eof:
            if pos == len(held):
                held, pos = read(SLICE), 0
                if not held:
                    if at > start:
                        raise ValueError("an archive ends within a member")
                    return
            step = held[pos : pos + STEP]
            parts.append(d.decompress(step))
            used = len(step) - len(d.unused_data)
            pos, at = pos + used, at + used
        content = b"".join(parts)
        if content:
            yield start, at - start, content


def surt(url: str | None) -> str:
    """The reversed host, a bracket, and the rest of the url."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    cut = min(ends, default=len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def _write_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches):
        out = []
        for p, u, h, d, n, r in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "size", "refers_to")), strict=True):
            out.append(_gzip(record(p, u, (h or "").encode("utf-8", "surrogatepass"), d, n, r)))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


def write_archives(pages: DataFrame, folder: str) -> None:
    """A record a row into gzip WARC files in the folder."""
    raw = F.coalesce("html", F.lit("")).cast("binary")
    page_id = F.col("page_id").cast("long")
    rows = pages.select(page_id.alias("page_id"), F.coalesce(page_id.cast("string"), F.lit("")).alias("row"), "url", "html", F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("size"))
    keys = rows.where(F.col("size") >= LEAST_PAYLOAD).select("page_id", "row", "digest", "size")
    firsts = keys.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    firsts = written(firsts, "firsts")
    revisits = join_hot(keys, firsts, ["digest", "size"], "n").where("not page_id <=> refers_to")
    # rows may repeat: one line for each (row, digest, size), dealt out as the join below wants it
    revisits = revisits.groupBy("row", "digest", "size").agg(F.min("refers_to").alias("refers_to"))
    n = file_count(pages.select("html"), FILE)
    out = rows.repartition(n, "row", "digest", "size").join(revisits, ["row", "digest", "size"], "left")
    out.mapInArrow(_write_records, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(folder)


_CAPTURE = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())])


def _capture_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path in b.column("path").to_pylist():
            store, place = open_store(path)
            with store.open_input_stream(place) as f:
                found = members(f.read)
                while rows := [_capture(path, *m) for m in itertools.islice(found, 5000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _CAPTURE, strict=True)], schema=_CAPTURE)


def _capture(path: str, at: int, size: int, content: bytes) -> tuple:
    h, _ = parse_record(content)
    url = h["warc-target-uri"]
    url = json.loads(url) if url == "null" or url.startswith('"') else url
    page = h["warc-record-id"][10:-1]
    return surt(url), int(page) if page else None, path, at, size


def _blocks(per_block: int):
    def run(batches):
        from pyspark import TaskContext

        part, k, held = TaskContext.get().partitionId(), 0, []

        def out(lines):
            nonlocal k
            raw = "\n".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in lines).encode("utf-8", "surrogatepass")
            k += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + k - 1], pa.int64()), pa.array([lines[0][0]], pa.string()), pa.array([lines[0][1]], pa.int64()), pa.array([len(lines)], pa.int32()), pa.array([zlib.compress(raw)], pa.binary())], names=["block", "first_key", "first_id", "lines", "data"])

        for b in batches:
            held += zip(*(b.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "size")), strict=True)
            while len(held) >= per_block:
                yield out(held[:per_block])
                held = held[per_block:]
        if held:
            yield out(held)

    return run


def build_index(spark: SparkSession, folder: str, index: str, partitions: int | None = None) -> DataFrame:
    """Writes the blocks (block, first_key, first_id, lines, data) under `index` and returns them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path")  # contents aren't read
    lines = written(files.mapInArrow(_capture_lines, "key string, page_id long, file string, at long, size long"), "captures")
    per_block = max(BLOCK, -(-lines.count() // (DIRECTORY // 2)))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("key", "page_id", "file", "at")
    n = min(n, DIRECTORY // 2)
    blocks = lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_blocks(per_block), "block long, first_key string, first_id long, lines int, data binary")
    blocks.write.parquet(index)
    return spark.read.parquet(index)


def _place(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """The order of lines: by key, then by page id, nulls first."""
    return key, page_id is not None, page_id or 0


def directory(blocks: DataFrame) -> list[tuple[tuple[str, bool, int], int]]:
    """(place of the first line, block) in order: a bounded number of entries."""
    rows = blocks.select("first_key", "first_id", "block").collect()
    return sorted((_place(r.first_key, r.first_id), r.block) for r in rows)


def lines_of(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")]


def _read_spans(wanted: list[tuple[str, int, int]]) -> dict[tuple[str, int], bytes]:
    """The records' bytes by (file, offset): neighbours in one range read."""
    out, k = {}, 0
    wanted = sorted(set(wanted))
    opened: tuple[str, object] | None = None
    while k < len(wanted):
        file, start, size = wanted[k]
        end, j = start + size, k + 1
        while j < len(wanted) and wanted[j][0] == file and wanted[j][1] - end <= 65536 and wanted[j][1] + wanted[j][2] - start <= SPAN:
            end, j = wanted[j][1] + wanted[j][2], j + 1
        if opened is None or opened[0] != file:
            store, path = open_store(file)
            opened = (file, store.open_input_file(path))
        opened[1].seek(start)
        raw = opened[1].read(end - start)
        for f, at, n in wanted[k:j]:
            out[f, at] = raw[at - start : at - start + n]
        k = j
    return out


def _row(page_id: int | None, raw: bytes) -> tuple:
    h, payload = parse_record(zlib.decompress(raw, 31))
    refers = h.get("warc-refers-to")
    digest = h["warc-payload-digest"].split(":")[1]
    size = int(h["x-payload-length"])
    if refers is None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {page_id} doesn't hold the payload that its headers name")
    return page_id, size, digest, h["warc-type"], int(refers[10:-1]) if refers else None, payload


_FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _find_in_block(key, asked: pa.Table, block: pa.Table) -> pa.Table:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    rows = []
    if asked.num_rows and block.num_rows:
        lines = lines_of(block.column("data")[0].as_py())
        keys = [_place(x[0], x[1]) for x in lines]
        hits = []
        for want in sorted(set(map(_place, asked.column("key").to_pylist(), asked.column("page_id").to_pylist()))):
            i = bisect.bisect_left(keys, want)
            while i < len(keys) and keys[i] == want:
                hits.append(lines[i])
                i += 1
        for at in range(0, len(hits), 500):  # whole records of 500 captures at a time
            part = hits[at : at + 500]
            raw = _read_spans([(f, o, n) for _, _, f, o, n in part])
            rows += [_row(p, raw[f, o])[:5] for _, p, f, o, _ in part]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [()] * 5, schema, strict=True)], schema=schema)


def _routes(firsts: list[tuple[str, bool, int]], want: tuple[str, bool, int]) -> Iterator[int]:
    """Places in the directory of the blocks that may hold the line; equal lines may go on in the next block."""
    i = max(0, bisect.bisect_left(firsts, want) - 1)
    while i < len(firsts) and firsts[i] <= want:
        if i + 1 >= len(firsts) or firsts[i + 1] >= want:
            yield i
        i += 1


def lookup(requests: DataFrame, blocks: DataFrame) -> DataFrame:
    """Captures of each (page_id, url) asked for: directory, block, range read. Requests are sent to their block, no block to all."""
    entries = requests.sparkSession.sparkContext.broadcast(directory(blocks))

    def route(batches):
        firsts = [k for k, _ in entries.value]
        seen: set = set()  # repeated requests go once a task, about
        for b in batches:
            out = []
            for p, u in zip(b.column("page_id").to_pylist(), b.column("url").to_pylist(), strict=True):
                want = (surt(u), p)
                if want in seen:
                    continue
                seen.add(want)
                out += [(entries.value[i][1], *want) for i in _routes(firsts, _place(*want))]
            if len(seen) > 200_000:
                seen.clear()
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["block", "key", "page_id"])

    asked = requests.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(route, "block long, key string, page_id long")
    return asked.groupBy("block").cogroup(blocks.select("block", "data").groupBy("block")).applyInArrow(_find_in_block, _FOUND)


def fetch(spark: SparkSession, blocks: DataFrame, url: str) -> list[tuple[int, bytes]]:
    """(page id, payload) of all captures of one url, on the driver; of revisits the payload is empty."""
    entries, key = directory(blocks), surt(url)
    firsts = [k for k, _ in entries]
    lo = max(0, bisect.bisect_left(firsts, (key, False, 0)) - 1)
    hi = bisect.bisect_right(firsts, (key, True, 1 << 63))
    hits = []
    for r in blocks.where(F.col("block").isin([b for _, b in entries[lo:hi]])).select("data").collect() if hi > lo else []:
        lines = lines_of(r.data)
        i = bisect.bisect_left([x[0] for x in lines], key)
        while i < len(lines) and lines[i][0] == key:
            hits.append(lines[i])
            i += 1
    raw = _read_spans([(f, o, n) for _, _, f, o, n in hits])
    return sorted(((p, _row(p, raw[f, o])[5]) for _, p, f, o, _ in hits), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
