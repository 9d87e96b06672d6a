"""From raw documents to encoded training data: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graftwork.llm import bpe, gam, jaccard, mixing, toxicity
from graftwork.llm.queries import tokenizer_path
from graftwork.session import load, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the threshold go."""
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, load(spark, sf_dir, "labels")), THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    docs = docs.select(*COLUMNS)
    return gam.keep_good(docs, gam.fit(docs, load(spark, sf_dir, "labels")), THRESHOLD)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links by n-gram Jaccard, the row with the smallest id stays; of exactly repeated rows, one.

    Rows are told apart by id and text. Rows without words or without an id link with nothing and stay.
    """
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row")
    stays = jaccard.near_copies(docs.select("doc_id", "text")).where("stays").select(row, "key").distinct()
    rows = docs.select(*COLUMNS, row, jaccard.text_key(F.col("text")).alias("key")).join(stays, ["row", "key"])
    again = F.row_number().over(W.partitionBy("row", "key").orderBy("lang", "source", "n_chars"))
    return rows.withColumn("again", again).where("again = 1").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows are told apart by id and text, and repeats by a number, so that null ids don't meet."""
    docs = docs.select(*COLUMNS).withColumn("h", F.xxhash64("text"))
    again = F.row_number().over(W.partitionBy("doc_id", "h").orderBy("source", "lang", "n_chars"))
    docs = docs.withColumn("key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("h"), again))
    copies = mixing.mix(docs.select(F.col("key").alias("doc_id"), "text", "source")).where("copies > 0")
    copies = written(copies.select(F.col("doc_id").alias("key"), "copies"), "mix")
    return docs.join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids by byte-level BPE, as counts and digests, with the digest of what they decode to."""
    return bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_copies", drop_near_copies), ("mixing", mix_sources), ("bpe", encode)]
#: The learned stages can't be put into SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
