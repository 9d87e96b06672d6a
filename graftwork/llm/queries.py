"""The queries op1 to op10 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graftwork.session import load

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.url_rules import filter_urls

    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, verdict)")
    out = filter_urls(load(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')),
a AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url,'://')=0 THEN '' ELSE substr(url, strpos(url,'://')+3) END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest,'^[^/?#]*'),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(regexp_extract(rest,'^[^/?#]*'))+1),'^[^?#]*') AS path FROM a),
m AS (SELECT b.page_id, arg_max(rhost||rpath, length(rhost||rpath)) AS rule, arg_max(rverdict, length(rhost||rpath)) AS v
      FROM b JOIN rules ON (host=rhost OR ends_with(host,'.'||rhost)) AND starts_with(path,rpath) GROUP BY b.page_id)
SELECT b.page_id, b.host, b.path, m.rule, coalesce(m.v,'allow') AS verdict FROM b LEFT JOIN m USING(page_id)
"""

def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.ann import nearest

    return nearest(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.warc import build_index, lookup, write_archives
    from graftwork.session import scratch_path

    pages = load(spark, sf_dir, "pages").select("page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    return lookup(pages.select("page_id", "url"), build_index(spark, folder, scratch_path(spark, "cdx")))


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html,'') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS f FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f = page_id THEN NULL ELSE f END AS refers_to FROM r
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.token_files import read_token_files, write_token_files
    from graftwork.session import scratch_path

    out = scratch_path(spark, "tokens")
    write_token_files(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), out)
    return read_token_files(spark, out)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.mixing import mix

    out = mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.merkle import fingerprints

    return fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm import gam
    from graftwork.llm.common import crc_mod

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, load(spark, sf_dir, "labels"), "quality", folds=5, held_out=0)
    return gam.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.jaccard import jaccard_components

    return jaccard_components(load(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm import toxicity
    from graftwork.llm.common import crc_mod

    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"), folds=4, held_out=2)
    return toxicity.score(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "hits")


def tokenizer_path() -> str:
    """The byte-level vocabulary's place; the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graftwork.llm.bpe import encode_documents

    return encode_documents(load(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_warc": op2_warc,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_url_filters": op5_url_filters,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
}
ORACLES: dict[str, str] = {"op2_warc": OP2_SQL, "op5_url_filters": OP5_SQL}
