"""The thin queries over the driver's tables: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import COLLAPSE_SQL, collapse_snapshots
from .decontamination import find_leaks
from .licenses import scan_licenses
from .media import media_digest
from .mixing import plan_mix
from .ngram_join import link_components
from .repeats import remove_repeats
from .sharding import plan_shards
from .token_output import token_index
from .toxicity import score_documents, train


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of links of 3-word-shingle similarity 0.9 or more; one row a document."""
    found = link_components(_table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return found.selectExpr("doc_id", "n_shingles", "component_id", "explode(sequence(1L, copies)) AS copy").drop("copy")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards by proportional stratified interleaving (law ``rows``)."""
    return plan_shards(_table(spark, sf_dir, "documents"), shards=16)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains, with their edit distance."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("th")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in wavelet-matrix shard files, read back."""
    import public_tokenizers

    return token_index(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as media, read back, sniffed and digested."""
    return media_digest(_table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a repeated string of 400 bytes covers."""
    return remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, rendered."""
    return collapse_snapshots(_table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document, in blocks of 32 words."""
    plan = plan_mix(_table(spark, sf_dir, "documents"), block=32)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["upto"] - p["from"])
    return plan.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, from a machine that learnt on the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, _table(spark, sf_dir, "labels")))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_token_output": op4_token_output,
    "op5_media_columns": op5_media_columns,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_mixing": op8_mixing,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op7_chat_formatting": COLLAPSE_SQL}
