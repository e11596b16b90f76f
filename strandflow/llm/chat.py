"""Chat formatting with DataFrame functions only: cumulative-snapshot collapse.

Logs often hold a conversation again after every turn.  Each turn gets a rolling hash of all
turns up to it; a conversation whose last rolling hash is met inside a longer one is a
snapshot of it.  An anti-join drops snapshots, one of equal conversations stays, and
only the conversations that remain are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, bounded_broadcast


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, merged, rendered) of the maximal conversations.

    ``conversations`` has conv_id, turn, role and text.  Turns stand in order of turn, null first, equal turns in
    order of a hash of role and text; null roles and texts count as empty.  A conversation is
    dropped if it is a proper prefix, turn by turn in role and text, of another; of equal ones the least conv_id stays (null
    last).  ``merged`` counts the conversations equal to it, itself included.  All rows of null conv_id are one conversation.  Repeated
    rows are turns of their own.  An empty table gives an empty result.  Other columns are ignored.

    A turn's rolling hash is the exclusive or of 64-bit hashes of (place, role, text) of the turns up to it, twice with
    different seeds; texts are hashed before the shuffle, and prefixes are made distinct before they are joined,
    so one conversation logged very often, or a common first turn, is no hot key.
    """
    ws = Workspace(conversations.sparkSession, "chat")
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    turns = turns.withColumn("h", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(7), "text", "role"))
    here = Window.partitionBy("conv_id").orderBy("turn", "h", "h2")
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.select("conv_id", "turn", "h", "h2").withColumn("i", F.row_number().over(here))
    rolled = placed.select(
        "conv_id", "i",
        F.bit_xor(F.xxhash64("i", "h")).over(upto).alias("r"), F.bit_xor(F.xxhash64("h2", "i")).over(upto).alias("r2"),
        (F.lead("i").over(here).isNull()).alias("last"),
    )
    rolled = ws.table(rolled, "rolled")
    whole = rolled.where("last").groupBy("i", "r", "r2").agg(F.min(F.struct(F.col("conv_id").isNull(), "conv_id")).alias("least"), F.count("*").alias("merged"))
    inside = rolled.where("not last").select("i", "r", "r2").distinct()
    kept = whole.join(inside, ["i", "r", "r2"], "left_anti").select(F.col("least.conv_id").alias("kept_id"), F.col("i").alias("n_turns"), "merged")
    kept = ws.table(kept, "kept")
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n")).alias("line")
    said = turns.join(bounded_broadcast(kept.select("kept_id")), F.col("conv_id").eqNullSafe(F.col("kept_id"))).select("conv_id", "turn", "h", "h2", line)
    text = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "h", "h2", "line"))).alias("lines"))
    text = text.select("conv_id", F.array_join(F.col("lines.line"), "").alias("rendered"))
    out = text.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "merged", "rendered")


#: DuckDB, for conversations without repeated turns.
COLLAPSE_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS line FROM conversations
), whole AS (
  SELECT conv_id, list(line ORDER BY turn NULLS FIRST) AS lines FROM said GROUP BY conv_id
), inside AS (
  SELECT DISTINCT list_slice(lines, 1, n) AS lines FROM (SELECT lines, unnest(range(1, len(lines))) AS n FROM whole)
)
SELECT min(conv_id) AS conv_id, CAST(len(lines) AS BIGINT) AS n_turns, count(*) AS merged, array_to_string(lines, '') AS rendered
FROM whole WHERE lines NOT IN (SELECT lines FROM inside) GROUP BY lines
"""
