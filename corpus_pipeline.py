"""The corpus pipeline: toxicity, n-gram Jaccard join, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and gives the columns of
``documents``; the last gives one row a written document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm.decontamination import drop_leaks
from strandflow.llm.mixing import mix_sources
from strandflow.llm.ngram_join import keep_one
from strandflow.llm.token_output import token_index
from strandflow.llm.toxicity import drop_toxic
from strandflow.llm.workspace import Workspace


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return keep_one(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights in blocks of 2048 words; a row for each document and pass."""
    return mix_sources(docs, block=2048)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token ids in wavelet-matrix shards, with each document's place and digest as read back."""
    return token_index(docs, public_tokenizers.path("word_bpe_49k.json"), end=1)


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The first stages are a trained model, a hash-seeded mix and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = ws.table(docs, name)
    return ws.finish(docs)
