"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Within each source, rows stand in the order of a seeded hash; row ``r`` of ``n`` gets the
fractional rank ``(2r + 1) / 2n``.  Ordering all rows by fractional rank interleaves the sources in
proportion, and cutting that order into equal runs gives shards that each hold the
corpus's mixture and whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import hash_bucket, running
from .workspace import Workspace

SEED = 20_260_217


def plan_shards(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) -> (doc_id, source, size, text_crc32, law, shard, slot, grown_shard).

    ``size`` is the UTF-8 length plus one, of a null text 1; ``text_crc32`` of a null text is that of the
    empty text.  The law is ``rows``: counts differ by one at most.  ``slot`` counts from 0 within the
    shard, in interleaved order.  ``grown_shard`` is null (only a law of keys has one).  A null source is a
    source of its own.  Rows alike in doc_id, source and text get neighbouring places in any
    order, which changes nothing in the result.  An empty table gives an empty result.  Other columns are
    ignored, whatever their names.  Only a few numbers of each row are shuffled, never the text.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("h"),
    ).withColumn("b", hash_bucket("h"))
    ws = Workspace(docs.sparkSession, "shards")
    rows = ws.table(rows, "rows")  # the texts are read once
    order = ["h", "doc_id", "size", "text_crc32"]
    ranked = running(rows, ["source"], "b", order, F.lit(1).cast("long"), "rank", totals=True)
    ranked = ranked.withColumn("f", (2 * F.col("rank") + 1) / (2 * F.col("rank_total"))).drop("b")
    ranked = ranked.withColumn("b", F.floor(F.col("f") * 4096))
    # Fractional ranks of equal sources tie; the hash of the row breaks ties alike in every run.
    placed = running(ranked, [], "b", ["f", *order, "source"], F.lit(1).cast("long"), "place", totals=True)
    shard = F.expr(f"place * {shards} div place_total")
    first = F.expr(f"(shard * place_total + {shards - 1}) div {shards}")
    out = placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return ws.finish(out)
