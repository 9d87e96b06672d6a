"""The operators of graftwork.llm against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns of clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from oracle import same

public_tokenizers = pytest.importorskip("public_tokenizers")

from graftwork.llm import ann, bpe, gam, jaccard, merkle, mixing, queries, token_files, toxicity, url_rules, warc  # noqa: E402
from graftwork.session import scratch_path  # noqa: E402

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int, n int, size int, id long"


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def words(r, n):
    return " ".join(r.choice(("ab", "cde", "the", "über", "ion", "x1", "naïve", "中文")) + r.choice("aeiou") * r.randint(0, 2) for _ in range(n))


def awkward(spark, seed=1):
    """Documents with nulls, empty and long texts, copies, near copies and repeated rows."""
    r = random.Random(seed)
    base = [words(r, r.randint(1, 120)) for _ in range(25)]
    texts = [*base, None, "", "   ", "<|endoftext|> a <|endoftext|>", words(r, 9000), "x" * 20000, base[0], base[0], base[1].upper(), base[2] + " more", "\n\n" + base[3], "a\u00a0b  c\t\td\r\n e"]
    rows = [(i * 3, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4]]
    rows += [(None, base[5], "en", "s1", 1), (None, base[5], "en", "s1", 1), (None, None, None, None, None)]  # no ids
    rows += [(9, base[6], "en", "s1", 1), (500, " ".join(words(r, 40000).split()), "en", "s2", 1)]  # an id twice; over a megabyte with the next
    rows += [(501, words(r, 3) + "long" * 300_000, "en", "s2", 1)]
    return spark.createDataFrame([(*x, 0.5, 1, 2, 3, 4) for x in rows], DOCS), rows


def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


# ---- nearest neighbours ----------------------------------------------------------------------------------------------


def test_ann(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[7].tolist()) for i in range(60)]
    rows += [(9000, None), (9001, [0.0] * 12), (9002, [float("nan")] * 12), (9003, [None, 1.0]), (None, x[0].tolist()), (9004, [])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS rank", "2L AS query_id", "array(1.0D) AS ids", "0 AS dim", "'x' AS v")

    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20, shards=2).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = [(i, np.array(v)) for i, v in rows[:960]]
    hits = total = 0
    for q, v in ok:
        if q % 20:
            continue
        want = sorted((-float(w @ v), i) for i, w in ok if i != q)[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and all(abs(m[2] - float(dict(ok)[m[1]] @ v)) < 1e-9 for m in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits, total = hits + len({i for _, i in want} & {i for _, i, _ in mine}), total + 20
    assert hits / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_graph_at_every_size(monkeypatch):
    """Shards of any size have a graph whose search finds what brute force finds; nothing is searched in full."""
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 9, 40, 300, 1500):
        x = rng.normal(size=(n, 6))
        g = ann.Graph.build(x)
        assert n < 2 or (g.degree > 0).all()
        looked = []
        monkeypatch.setattr(ann, "_d2", lambda x, norms, ids, q, f=ann._d2: looked.append(ids.size) or f(x, norms, ids, q))
        q = rng.normal(size=(30, 6)).astype(np.float32)
        found, _ = g.search(q, 32)
        monkeypatch.undo()
        assert n <= len(g.entries) or sum(looked) > 0  # the walk along the edges
        want = np.argsort(((x[None] - q[:, None]) ** 2).sum(2), 1, kind="stable")[:, :10]
        hits = np.mean([len(set(w) & set(f)) / len(w) for w, f in zip(want.tolist(), found.tolist(), strict=True)])
        assert hits >= 0.95, n


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_embeddings(spark, sf):
    from graftwork.session import load

    rows = [(r.vec_id, np.array(r.embedding, float)) for r in load(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = collections.defaultdict(set)
    for r in queries.op1_ann(spark, sf).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        want = ids[np.lexsort((ids, -score))[:20]]
        hits.append(len(set(want.tolist()) & got[int(ids[k])]) / len(want))
    assert np.mean(hits) >= 0.9


def test_ann_repeated_ids(spark):
    """Rows of one id are a candidate each; as queries, those with different vectors have a ranking each, equal ones one together."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    rows = [(i + 1, v.tolist()) for i, v in enumerate(x)] + [(20, x[0].tolist()), (20, x[1].tolist()), (20, x[1].tolist()), (7, x[2].tolist())]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.Counter((r.query_id, r["rank"]) for r in ann.nearest(df, F.col("vec_id") == 20, 5).collect())
    assert got == {(20, k): 3 for k in range(1, 6)}


# ---- archives --------------------------------------------------------------------------------------------------------


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 7)
    rows = [(i, f"http://a{i % 5}.x.com/p/{i % 9}?q", "same" * 40 if i % 4 == 0 else f"page {i} " * 30) for i in range(40)]
    rows += [(100, None, "y" * 200), (101, "null", "z\r\n\r\nq" * 40), (102, '"h\n://', "é" * 100), (103, "", None), (104, "http://A.b/", ""), (7, "http://a2.x.com/p/7?q", "dup" * 50)]
    rows += [(5, "http://r/", "same" * 40)] * 3  # exact repeats of a revisit
    rows += [(None, "http://n/", "same" * 40), (None, None, "none but nulls" * 20), (None, "http://n/2", "none but nulls" * 20), (-1, "http://n/", "t")]
    rows += [(200, "http://long/", "".join(map(chr, random.Random(1).choices(range(32, 900), k=2_000_000))))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    folder = scratch_path(spark, "w")
    warc.write_archives(df, folder)
    blocks = warc.build_index(spark, folder, scratch_path(spark, "i"))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.lookup(df, blocks).collect())
    first, want = {}, collections.Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 100 and p is not None:
            first[raw] = min(first.get(raw, 1 << 60), p)
    for p, _, h in rows:
        raw = (h or "").encode()
        r = first.get(raw, p)
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if r == p else "revisit", None if r == p else r] += 1
    assert got == want
    assert warc.fetch(spark, blocks, "http://a1.x.com/p/1?q") == [(1, ("page 1 " * 30).encode())]
    assert warc.fetch(spark, blocks, "http://none/") == []
    none = scratch_path(spark, "w")
    warc.write_archives(df.limit(0), none)
    assert warc.lookup(df.limit(0), warc.build_index(spark, none, scratch_path(spark, "i"))).count() == 0


def test_members_in_slices(monkeypatch):
    """Each member's place and content, whatever the slices; time grows with the file, not with its square."""
    import io

    contents = [b"", b"a", bytes(range(256)) * 90, b"", *[f"record {i} ".encode() * 50 for i in range(300)]]
    packed = [warc._gzip(c) for c in contents]
    raw, want, at = b"".join(packed), [], 0
    for c, z in zip(contents, packed, strict=True):
        want += [(at, len(z), c)] * bool(c)
        at += len(z)
    for size, step in ((1, 1), (7, 3), (4096, 100), (1 << 20, 1 << 12)):
        monkeypatch.setattr(warc, "SLICE", size)
        monkeypatch.setattr(warc, "STEP", step)
        assert list(warc.members(io.BytesIO(raw).read)) == want
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(raw[:-3]).read))


# ---- token files ------------------------------------------------------------------------------------------------------


def test_blocks():
    rng = np.random.default_rng(2)
    for bits in range(1, 33):
        v = rng.integers(0, 1 << bits, 300, np.uint64).astype(np.uint32)
        v[rng.random(300) < 0.03] = 4_000_000_000
        out, end = token_files.decode_block(b"__" + token_files.encode_block(v), 2)
        assert (out == v).all()
    assert (token_files.decode_block(token_files.encode_block(np.full(9, 7, np.uint32)))[0] == 7).all()


def test_file_numbers():
    """Numbers of five digits and of six."""
    names = [f"file:/x/part-{n:05d}-abc-c000.txt" for n in (99_999, 100_000, 7, 1_000_000)]
    assert sorted(names, key=token_files.file_number) == [names[i] for i in (2, 0, 1, 3)]


def test_token_files(spark, library):
    from pyspark.sql import functions as F

    df, rows = awkward(spark)
    out = scratch_path(spark, "tok")
    token_files.write_token_files(df, PATH, out)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, out).collect()]
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for _, t, *_ in rows}
    want, at = [], 0
    order = {r.t: r.h for r in df.select(F.col("text").alias("t"), F.xxhash64("text").alias("h")).collect()}
    for d, t in sorted(((d, t) for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, order[x[1]])):
        want.append((d, at, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())))
        at += len(ids[t])
    assert sorted(got, key=lambda r: r[1]) == want
    paths = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("path").collect()]
    files = [token_files.TokenFile(p) for p in sorted(paths, key=token_files.file_number)]
    whole = [np.concatenate([np.zeros(0, np.uint32), *f.blocks(0, len(f.starts))]) for f in files]
    assert np.concatenate(whole).tolist() == [i for d, t in sorted(((d, t) for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, order[x[1]])) for i in ids[t]]
    for f, w in zip(files, whole, strict=True):
        for first, n in ((0, 1), (5, 30), (len(w) // 2, 5000), (4095, 2), (max(0, len(w) - 3), 9)):
            assert (f.ids(first, n) == w[first : first + n]).all()
    none = scratch_path(spark, "none")
    token_files.write_token_files(empty(spark), PATH, none)
    assert token_files.read_token_files(spark, none).count() == 0


# ---- mixing -----------------------------------------------------------------------------------------------------------


def plain_targets(size, cap=2.0):
    """Source -> words wanted, from source -> words: shares by weight, the excess over the cap dealt out anew."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(size.values()), set(names)
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > cap * size[s]}:
        for s in over:
            target[s] = cap * size[s]
            left -= target[s]
        free -= over
    return target | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}


def plain_rates(sizes, target, cap=2.0):
    """Of all rates within 0 and the cap that give the target's words, those of least relative entropy to one: by bisection."""
    if target <= 0:
        return [0.0 if sum(sizes) else 1.0] * len(sizes)
    lo, hi = -800.0, 800.0

    def rate(x, s):
        return min(cap, np.exp(np.clip(x * s / max(sizes), -700, 700)))

    for _ in range(200):
        x = (lo + hi) / 2
        lo, hi = (x, hi) if sum(rate(x, s) * s for s in sizes) < target else (lo, x)
    return [rate(lo, s) for s in sizes]


def check_mix(rows, got):
    """rows: (id, text, source); got: rows of the mix, several with one id or none among them."""
    sizes = [(d, len(re.findall(r"[^\x20\x09-\x0d]+", t or "")), s) for d, t, s in rows]
    words, by = collections.Counter(), collections.defaultdict(list)
    for d, n, s in sizes:
        words[s] += n
        by[s].append((d, n))
    target = plain_targets(words)
    taken, seen = collections.Counter(), collections.defaultdict(list)
    for r in got:
        s = None if r.no_source else r.src
        assert 0 <= r.copies <= 2 and r.source_size == words[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r.copies * r.size
        seen[s].append((r.doc_id is not None, r.doc_id or 0, r.size, r.rate))
    for s, docs in by.items():
        rate = plain_rates([n for _, n in docs], target[s])
        want = sorted((d is not None, d or 0, n, x) for (d, n), x in zip(docs, rate, strict=True))
        assert [w[:3] for w in want] == [g[:3] for g in sorted(seen[s])]
        assert np.allclose([w[3] for w in want], [g[3] for g in sorted(seen[s])], rtol=1e-5, atol=1e-9), s
        # one document more or less is the most that rounding leaves
        assert abs(taken[s] - target[s]) <= max(n for _, n in docs) / 2 + 1, s


def test_mixing(spark):
    df, rows = awkward(spark)
    a, b = (collections.Counter((r.doc_id, r.size, r.src, r.copies, round(r.rate, 9)) for r in mixing.mix(df).collect()) for _ in range(2))
    assert a == b and a.total() == len(rows)
    check_mix([(d, t, s) for d, t, _, s, _ in rows], mixing.mix(df).collect())
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_solves_the_dual(spark):
    """Skewed sizes, sources at, above and below the cap, one without words, one of a single document."""
    r = random.Random(5)
    rows = [(i, " ".join("w" * int(r.paretovariate(0.8) * 3 % 700)) if i % 9 else None, ("hot", "hot", "big", "c", None)[i % 5]) for i in range(700)]
    rows += [(1000 + i, "", "blank") for i in range(5)] + [(2000, "one document alone", "single")]
    check_mix(rows, mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())


def test_copies_come_near_targets(spark):
    r = random.Random(9)
    df = spark.createDataFrame([(i, "w " * r.randint(1, 80), "hot" if i % 3 else f"s{i % 4}") for i in range(1500)], "doc_id long, text string, source string")
    by = collections.defaultdict(lambda: [0, 0.0])
    for x in mixing.mix(df).collect():
        by[x.src][0] += x.copies * x.size
        by[x.src][1] = x.target
    assert all(abs(t - g) <= max(3, 0.01 * t) for g, t in by.values())


# ---- urls -------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    r = random.Random(4)
    hosts = ["com", "a.com", "b.a.com", "a,b.com", "x.org", "", "foo bar.com", "A.Com"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/7", "/en/77", "/e?n/7", "/#x"]
    urls = [None, "nothing", "://", "http://"] + [f"{r.choice(('http', 'x'))}://{r.choice(hosts)}{r.choice(paths)}" for _ in range(200)]
    rules = [("com", "/en", "block"), ("a.com", "/en/7", "allow"), ("a.com", "/e", "block"), ("com", "", "allow"), ("org", "/", "block"), ("x.org", "/en/", "allow"), ("org", "/", "allow"), (None, "/", "block"), ("b/c", "/", "block")]
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls)], "page_id long, url string, rule string, verdict string")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if h is not None and "/" not in h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = (host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow")
        assert got[i] == want, u
    long = "http://a.com/en/7" + "x" * 1_000_000
    twice = spark.createDataFrame([(1, long), (1, long), (1, None), (None, "http://x.org/"), (None, "http://x.org/")], "page_id long, url string")
    got = collections.Counter((x.page_id, x.rule, x.verdict) for x in url_rules.filter_urls(twice, spark.createDataFrame(rules, "host string, path string, verdict string")).collect())
    assert got == {(1, "a.com/en/7", "allow"): 2, (1, None, "allow"): 1, (None, "org/", "block"): 2}
    assert url_rules.filter_urls(df.limit(0), spark.createDataFrame([], "host string, path string, verdict string")).count() == 0


# ---- fingerprints --------------------------------------------------------------------------------------------------------


def leaves_of(text):
    return [[merkle.split_sentences(p) for p in merkle.split_paragraphs(x)] for x in merkle.split_sections(text)]


def plain_likeness(a, b):
    """The Dice share of sentence bytes in common, without digests."""
    x, y = (collections.Counter(s for sec in leaves_of(t) for par in sec for s in par) for t in (a, b))
    size = {s: len(s.encode()) for s in x | y}
    total = sum(n * size[s] for c in (x, y) for s, n in c.items())
    return 2 * sum((x & y)[s] * size[s] for s in x & y) / total if total else 1.0


def plain_edits(a, b):
    """Sentences of a that aren't in the paragraph of b at the same place; whole equal sections and paragraphs have none."""
    x, y, n = leaves_of(a), leaves_of(b), 0
    for i, section in enumerate(x):
        for j, paragraph in enumerate(section):
            theirs = y[i][j] if i < len(y) and j < len(y[i]) else []
            n += sum(s not in theirs for s in paragraph)
    return n


def test_merkle(spark):
    df, rows = awkward(spark)
    from pyspark.sql import functions as F

    order = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    s = sorted(((d, t or "") for d, t, *_ in rows), key=lambda x: (x[0] is not None, x[0] or 0, order[x[1]]))
    want = collections.Counter()
    for (d, t), (_, n) in zip(s, s[1:] + s[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        want[d, len(t), hashlib.sha256(e.encode()).hexdigest(), merkle.Tree(t).root.hex(), merkle.Tree(e).root.hex(), round(plain_likeness(t, e), 9), round(plain_likeness(t, n), 9), plain_edits(t, e)] += 1
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9), r.edits) for r in merkle.fingerprints(df, 5).collect())
    assert got == want
    a, b = merkle.Tree("One. Two.\n\nThree. Four.\nFive."), merkle.Tree("One. Two.\n\nThree. Fuor.\nFive.")
    assert "".join(s for sec in leaves_of("a.  b\n\n c!\r\n\nd") for par in sec for s in par) == "a.  b\n\n c!\r\n\nd"
    assert merkle.differing(a, b) == [(1, 0, 1)] and merkle.differing(a, a) == [] and 0 < merkle.likeness(a, b) < 1
    assert merkle.fingerprints(empty(spark)).count() == 0


# ---- classifiers -----------------------------------------------------------------------------------------------------------


def rates(spark, name, label, folds, held):
    from graftwork.session import load

    rows = queries.QUERIES[name](spark, SF).join(load(spark, SF, "labels"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows)
    out = [r for r in rows if r.held_out]
    return [np.mean([r.predicted for r in out if r[label] == y]) for y in (0, 1)]


def test_held_out(spark):
    bad, good = rates(spark, "op7_quality", "quality", 5, 0)
    assert bad <= 0.2 and good >= 0.95
    clean, toxic = rates(spark, "op9_toxicity", "toxic", 4, 2)
    assert clean <= 0.05 and toxic >= 0.6


def test_mixing_tells_null_ids_apart(spark):
    """Thirty texts of equal size without ids: one and a half copies of each on average, not two of all."""
    import corpus_pipeline

    docs = spark.createDataFrame([(None, f"a b c {i}", "en", "s", 7) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()]
    assert len(got) == 45 and {got.count(t) for t in got} <= {1, 2}


def test_toxicity_of_few_labels(spark):
    """Nine toxic labels teach a lexicon; where labels teach none, the default one serves."""
    from graftwork.session import load

    small = "/root/testdata/sf0.001"
    m = toxicity.fit(load(spark, small, "documents"), load(spark, small, "labels"))
    assert {" trash ", " loser ", " scum ", " idiot "} <= set(m.entries)
    rows = queries.QUERIES["op9_toxicity"](spark, small).join(load(spark, small, "labels"), "doc_id").collect()
    clean, toxic = (np.mean([r.predicted for r in rows if r.toxic == y]) for y in (0, 1))
    assert clean <= 0.02 and toxic >= 0.6
    docs = spark.createDataFrame([(i, f"some text {i} {'you moron, moron' * (i == 9)}") for i in range(10)], "doc_id long, text string")
    none = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int"))
    assert none.entries == toxicity.DEFAULT_LEXICON
    assert {r.doc_id for r in toxicity.keep_clean(docs, none).collect()} == set(range(9))


def naive_hits(model, folded):
    """Entries at each place, the heaviest that counts; quiet where an exception phrase covers it."""
    quiet = [(i, i + len(e) - 1) for e in model.exceptions for i in range(len(folded)) if folded.startswith(e, i)]
    out = []
    for i in range(len(folded)):
        best = max(((w, i + len(e) - 1) for e, w in model.entries.items() if e not in model.exceptions and folded.startswith(e, i)), default=None)
        if best and not any(a <= i and best[1] <= b for a, b in quiet):
            out.append((i, best[1], best[0]))
    return out


def test_hits_against_naive_search():
    r = random.Random(6)
    vocabulary = ["scum", "pond", "vequ", "vequx", "a", "moron", "not", "the", "m0ron", "b4d"]
    m = toxicity.Model({" scum ": 3.0, " vequ": 2.0, " vequx ": 4.0, " moron ": 2.5, " mor": 1.0}, [" pond scum ", " not a moron ", " the vequ"])
    a = m.automaton()
    for _ in range(300):
        f = toxicity.fold(" ".join(r.choices(vocabulary, k=r.randint(0, 25))))
        got, want = m.hits(a, f), naive_hits(m, f)
        assert [(s, w) for s, _, w in got] == [(s, w) for s, _, w in want]
        total = sum(w for *_, w in want)
        x = m.features(a, f)
        assert x[2] == len(want) and abs(x[0] - np.log1p(total)) < 1e-9 and abs(x[1] - total / np.sqrt(1 + f.count(" "))) < 1e-9
        z = x[0] * m.curve[0] + x[1] * m.curve[1] + m.curve[2]
        assert abs(m.score(np.array([x], float))[0] - 1 / (1 + np.exp(-z))) < 1e-12


def test_folding_time_follows_the_length():
    import time

    for unit in ("long", "l0ng", "a@", "1", "é", "@ "):
        start = time.process_time()
        toxicity.fold(unit * 300_000)
        assert time.process_time() - start < 5


def test_gam_score_by_its_tables():
    """Every row's score is the logistic of base, table entries and pair entries, looked up one by one."""
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(800, 4)), 1)
    m = gam.fit_arrays(x, (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(float), bins=12, rounds=15, pair_rounds=10)
    assert m.pairs
    for row, got in zip(x[:200], m.score(x[:200]), strict=True):
        z = m.base + sum(t[sum(v >= c for c in cuts)] for v, cuts, t in zip(row, m.cuts, m.tables, strict=True))
        z += sum(t[sum(row[a] >= c for c in ca)][sum(row[b] >= c for c in cb)] for a, b, ca, cb, t in m.pairs)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9


def test_features_of_text():
    """Some features counted anew, letter by letter."""
    for t in ("", "Ab 12!\n\nAb 12!\nc.", "x" * 10, "é ü \t Q|", "a a a b"):
        f = dict(zip(gam.FEATURES, gam.features(t), strict=True))
        raw = t.encode()
        words = raw.split()
        assert abs(f["log_bytes"] - np.log1p(len(raw))) < 1e-12 and abs(f["log_words"] - np.log1p(len(words))) < 1e-12
        for name, chars in (("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digits", b"0123456789"), ("spaces", b" \t\n\r\x0b\x0c")):
            assert abs(f[name] - sum(c in chars for c in raw) / max(1, len(raw))) < 1e-12
        assert abs(f["distinct_words"] - len(set(words)) / max(1, len(words))) < 1e-12 or not raw


def test_sample_is_bounded_by_ids(spark):
    """A labelled id on many rows gives one text; contradicting labels take the larger; nulls and odd labels don't count."""
    from graftwork.llm.common import labelled_sample

    docs = spark.createDataFrame([(1, "a"), *[(2, f"t{i % 3}") for i in range(300)], (3, None), (4, "d"), (None, "n"), (5, "e")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (2, 1), (3, 1), (4, 7), (None, 1), (5, None)], "doc_id long, toxic int")
    for rows in (10, 2):
        got = [(r.doc_id, r.text, r.y) for r in labelled_sample(docs, labels, "toxic", 1000, 999, rows).select("doc_id", "text", "y").collect()]
        assert len(got) == len({d for d, _, _ in got}) == min(rows, 3)
        assert {(d, y) for d, _, y in got} <= {(1, 0), (2, 1), (3, 1)} and all(t in {1: ["a"], 2: ["t0", "t1", "t2"], 3: [None]}[d] for d, t, _ in got)


def test_fold_and_exceptions():
    assert toxicity.fold("Ａ İdIoT! м0rоn st@pid 12") == " " + toxicity.fold("Ａ İdIoT! м0rоn st@pid 12").strip() + " "
    assert "moron" in toxicity.fold("you m0rоn") and "idiot" in toxicity.fold("1D10T")
    m = toxicity.Model({" scum ": 3.0, " vequ": 2.0, " vequx ": 4.0}, [" pond scum "])
    a = m.automaton()
    assert [w for *_, w in m.hits(a, toxicity.fold("scum, pond scum. scum scum"))] == [3.0, 3.0, 3.0]
    assert [w for *_, w in m.hits(a, toxicity.fold("vequx vequard aveq"))] == [4.0, 2.0]
    assert m.features(a, toxicity.fold(""))[2] == 0


def test_classifiers_on_awkward_rows(spark):
    df, rows = awkward(spark)
    labels = spark.createDataFrame([(r[0], i % 2, (i + 1) % 2) for i, r in enumerate(rows)] + [(None, 1, 1), (3, None, 7)], "doc_id long, quality int, toxic int")
    for m, score in ((gam.fit(df, labels), gam.score), (toxicity.fit(df, labels), toxicity.score), (gam.fit(df, labels.limit(0)), gam.score), (toxicity.fit(df, labels.limit(0)), toxicity.score)):
        s = score(df, m).collect()
        assert len(s) == len(rows) and all(0 <= r.score <= 1 for r in s)
        assert score(empty(spark), m).count() == 0
    assert gam.keep_good(df, gam.fit(df, labels.limit(0))).columns == df.columns


def test_gam_sample_leaves_no_file_a_task(spark):
    """op7 on check_h: the sample was written by each task of the scan, and each file had its executor fork."""
    from graftwork import session

    df = spark.createDataFrame([(i, f"ab cde {i} the. " * (1 + i % 3)) for i in range(120)], "doc_id long, text string").repartition(30)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    before = len(session._scratch.get("paths", []))
    m = gam.fit(df, labels)
    assert m.pairs or any(t.any() for t in m.tables)
    assert sum(len(spark.read.parquet(p).inputFiles()) for p in session._scratch["paths"][before:]) < 10


def test_gam_learns_interactions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit_arrays(x, y)
    assert (((m.score(x) > 0.5) == y).mean()) > 0.9
    one = gam.fit_arrays(x, np.ones(3000))
    assert (one.score(x) > 0.99).all()


# ---- near copies ------------------------------------------------------------------------------------------------------------


def sets(t):
    w = (t or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows):
    """Each row a node; the component is the least id that its row reaches. Rows without an id are alone."""
    s, parent = [sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return collections.Counter((d, len(s[i]), None if d is None else low[find(i)]) for i, (d, _) in enumerate(rows))


def jaccard_rows(df, **work):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, jaccard.Work(**work)).collect())


def test_jaccard(spark):
    df, rows = awkward(spark)
    assert jaccard_rows(df) == brute([(d, t) for d, t, *_ in rows])
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_pivots_follow_the_order():
    """Pieces of the rare-first order, as many as asked for, each with about as many shingles."""
    rng = np.random.default_rng(1)
    sketch = rng.choice([0, 1, 1, 1, 2, 3, 40, 900], 1 << 14).astype(np.uint16)
    s = np.sort(rng.integers(0, 1 << 63, 1 << 14, np.uint64) * np.uint64(2) + rng.integers(0, 2, 1 << 14, np.uint64))
    s = np.repeat(s, np.maximum(1, jaccard._counts(s, sketch)))  # a shingle as often as it is counted
    for k in (4, 16, 50):
        cut = jaccard.pivots(sketch, k)
        part = np.searchsorted(cut, jaccard._order(s, jaccard._counts(s, sketch)), "right")
        assert len(cut) == k - 1 and (np.bincount(part, minlength=k) > len(s) / k / 3).all()
        by_rank = np.argsort(jaccard._counts(s, sketch), kind="stable")
        assert (np.diff(part[by_rank]) >= 0).all()


def near_copies(r):
    base, shared = [f"w{i}" for i in range(80)], [f"b{i}" for i in range(40)]
    docs = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"e{r.random()}"
        docs.append(" ".join(w))
    docs += [" ".join([*shared, *[f"o{k}-{i}" for i in range(r.randint(8, 60))]]) for k in range(40)]
    drift = [f"d{i}" for i in range(100)]
    for k in range(12):
        docs.append(" ".join(drift[2 * k :] + [f"n{i}" for i in range(2 * k)]))
    return docs


@pytest.mark.parametrize("work", [{"short": 4}, {"short": 4, "cuts": 16, "hubs": (1, 2)}, {"cuts": 1, "long": 3, "salts": 5}, {"long": 2, "salts": 7, "hubs": (1,), "sketch": 1 << 10}])
def test_jaccard_near_copy_groups(spark, work):
    """Groups larger than the short lists, lists dealt out to salts, boilerplate that many share, a chain of slow drift."""
    rows = list(enumerate(near_copies(random.Random(11))))
    assert jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string"), **work) == brute(rows)


# ---- encoding -----------------------------------------------------------------------------------------------------------------


def test_encoder(library):
    enc, r = bpe.encoder(PATH), random.Random(0)
    chars = "ab cd'sé  \n\t\r\x0b\x1c\x85٣²中😀\u0301\u200b\u3000_-'tI'LL<|endoftext|>\ufeff\u00a0×÷ß"
    for _ in range(3000):
        t = "".join(r.choice(chars) for _ in range(r.randint(0, 25)))
        t += "<|endoftext|>" * r.randint(0, 1)
        ids = library.encode(t, add_special_tokens=False).ids
        assert enc.encode_batch([t])[0].tolist() == ids
        assert enc.decode(np.array(ids, np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_joins_are_repaired(library):
    enc, r = bpe.encoder(PATH), random.Random(1)
    for n in (0, 10, 400, 3000):
        for text in (words(r, n), "x" * n, "中" * n, " " * n, words(r, n // 2) + "y" * n + words(r, n // 2)):
            raw = text.encode()
            ends, parts = bpe.cuts(raw), bpe.chunks(raw)
            assert b"".join(parts) == raw
            ids = enc.encode_batch([p.decode() for p in parts])
            known = {i: v for i, v in enumerate(ids) if r.random() < 0.7}
            assert bpe.assemble(enc, raw, ends, known).tolist() == library.encode(text, add_special_tokens=False).ids


def test_encode_documents(spark, library):
    df, rows = awkward(spark)
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(df, PATH).collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    assert bpe.encode_documents(empty(spark), PATH).count() == 0
    full = {r.doc_id: list(r.ids) for r in bpe.encode_documents(df, PATH, full=True).collect()}
    assert full[0] == library.encode(rows[0][1], add_special_tokens=False).ids


def test_files_of_another_kind_go_whole(spark, tmp_path):
    """A BPE without pre-tokenizer merges across blanks: texts are long enough to be cut, and must not be."""
    from tokenizers import Tokenizer, models

    letters = ["a", "b", " ", "a ", "a b", "ba", "a ba"]
    t = Tokenizer(models.BPE(vocab={x: i for i, x in enumerate(letters)}, merges=[("a", " "), ("a ", "b"), ("b", "a"), ("a ", "ba")]))
    path = str(tmp_path / "plain.json")
    t.save(path)
    r = random.Random(3)
    base = "".join(r.choices("ab ", k=3000))
    rows = [(i, base + "".join(r.choices("ab ", k=r.randint(0, 500))) if i % 4 else None) for i in range(12)]
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[d] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_hot_chunks(spark, library):
    """A passage that most documents share is split off the join; results stay the library's."""
    r = random.Random(2)
    shared = words(r, 400)
    rows = [(i, words(r, r.randint(1, 60)) + "\n" + shared * r.randint(1, 2) + words(r, 5)) for i in range(60)]
    got = {x.doc_id: x.n_tokens for x in bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    assert got == {d: len(library.encode(t, add_special_tokens=False).ids) for d, t in rows}


# ---- the pipeline ----------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    from graftwork.session import load, written

    docs = load(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        if name == "near_copies":
            left = [(r.doc_id, r.text) for r in docs.collect()]
            assert all(c == d for d, _, c in brute(left)) and len(left) < before
    texts = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert max(texts.values()) <= 2
    out = collections.Counter((r.doc_id, r.n_tokens) for r in pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert out == collections.Counter({(d, len(library.encode(t, add_special_tokens=False).ids)): n for (d, t), n in texts.items()})


def test_pipeline_on_awkward_rows(spark, library):
    pipeline = pytest.importorskip("corpus_pipeline")
    from graftwork.session import load, written

    df, _ = awkward(spark)
    df, columns = written(df), pipeline.COLUMNS
    stages = dict(pipeline.STAGES)

    def rows(x):
        return collections.Counter(tuple(r[c] for c in columns) for r in x.select(*columns).collect())

    before = rows(df)
    for name, m, score in (("toxicity", toxicity, lambda v: v < 0.3), ("quality", gam, lambda v: v >= 0.3)):
        model = m.fit(df.select(*columns), load(spark, SF, "labels"))
        scored = m.score(df.select("doc_id", "text"), model)
        out = rows(stages[name](spark, df, SF))
        assert out.total() == sum(score(r.score) for r in scored.collect()) and not out - before
    # near copies: of each component the least id, of repeats one; rows without words or ids are never near copies
    distinct = {(d, t) for d, t, *_ in before}
    classes = collections.defaultdict(list)
    for d, t in distinct:
        if d is not None and sets(t):
            classes[next(iter(k for k in classes if 100 * len(sets(k) & sets(t)) >= 75 * len(sets(k) | sets(t))), t)].append((d, t))
    want = {(d, t) for d, t in distinct if d is None or not sets(t)} | {min(c, key=lambda x: x[0]) for c in classes.values()}
    kept = written(stages["near_copies"](spark, df, SF))
    assert collections.Counter((d, t) for (d, t, *_), n in rows(kept).items() for _ in range(n)) == collections.Counter(want)
    # mixing: whole rows come again, twice at most, and words come near the targets
    mixed = rows(stages["mixing"](spark, kept, SF))
    assert not [r for r, n in mixed.items() if n > 2 or r not in rows(kept)]
    size = {r: len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")) for r in rows(kept)}
    source, words_of, taken, largest = columns.index("source"), collections.Counter(), collections.Counter(), collections.Counter()
    for r, n in rows(kept).items():
        words_of[r[source]] += n * size[r]
        largest[r[source]] = max(largest[r[source]], size[r])
    for r, n in mixed.items():
        taken[r[source]] += n * size[r]
    target = plain_targets(words_of)
    assert all(abs(taken[x] - target[x]) <= largest[x] / 2 + 1 for x in words_of)
    out = collections.Counter((r.doc_id, r.n_tokens) for r in stages["bpe"](spark, df, SF).collect())
    assert out == collections.Counter((d, len(library.encode(t or "", add_special_tokens=False).ids)) for (d, t, *_), n in before.items() for _ in range(n))
    for stage in stages.values():
        assert stage(spark, empty(spark), SF).count() == 0


def test_repeated_ids_with_other_texts(spark):
    """Rows are told apart by id and text: a copy under an id that also stands on another text goes, the other text stays."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, c = " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    docs = spark.createDataFrame([(3, a, "en", "s", 1), (3, c, "en", "s", 1), (1, c, "en", "s", 1), (3, a, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, docs, SF).collect())
    assert got == [(1, c), (3, a)]
