"""Mixing sources to target weights by token blocks, with DataFrame functions only.

A source's documents stand in the order of a seeded hash and their words are packed into
blocks of fixed length.  The mix is a number of output shards, each with the same number of
slots.  Every slot draws its source by a hash of its own number, in proportion to the slots
that the sources want, so a shard's counts are multinomial and a source's total strays from its target as such counts do.
A source's k-th slot takes block ``P(i)`` of its n blocks, with ``i = k mod n`` and ``P`` a
Feistel permutation of 0 to n-1, anew in each pass ``k div n``.  Slots and blocks meet by an equi-join on
(source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import hash_bucket, running
from .workspace import Workspace, bounded_broadcast, column_name

SEED = 20_260_217
#: A source stops at this many times its size.
MOST = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Half rounds of the permutation.
ROUNDS = 6
#: Draws are whole numbers of so many bits; so many of their top bits name a cell of the table of sources.
DRAW_BITS, CELL_BITS = 52, 12
#: Slots that one task draws or places.
TASK_SLOTS = 1 << 19
#: Steps of cycle walking.
WALK = 40


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in order of code points, null last, weigh 1, 2, 3, repeating, and share the sum of all
    sizes; a target stops at ``MOST`` times its source's size and the excess is shared again by weight.
    With sources in order of cap/weight, the capped ones are those before the first whose share
    of what is left fits under its cap.  The table has one row a source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.partitionBy(F.lit(0)).orderBy("r", F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    w = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", MOST * F.col("source_size"))
    w = w.withColumn("r", F.col("cap") / F.col("w")).withColumn("i", F.row_number().over(by_cap))
    w = w.withColumn("cap_before", F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    w = w.withColumn("w_left", F.sum("w").over(whole) - F.sum("w").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w"))
    w = w.withColumn("share", (F.sum("source_size").over(whole) - F.col("cap_before")) / F.col("w_left"))
    w = w.withColumn("level", F.min(F.when(F.col("share") <= F.col("r"), F.struct("i", "share"))).over(whole))
    level = F.col("level.share") * F.col("w")
    return w.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("i") < F.col("level.i")), F.col("cap").cast("double")).otherwise(level).alias("target"))


def plan_mix(docs: DataFrame, block: int = 2048, slots: int = 65_536, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) -> (doc_id, th, size, source, source_size, target, at, pieces).

    One row a document: ``th`` is its text's xxhash64, ``at`` the number of words before it in its source, ``pieces``
    an array of (pass, from, upto): the ranges of its words (from 0, end excluded) that
    the mix takes in each pass; a document of no words has none.  Null texts have no words; a null source
    is a source of its own, last in order.  Rows alike in doc_id, source and text are placed next to each other in any
    order.  An empty table gives an empty result.  Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("text").alias("th"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), text).alias("h"),
    ).withColumn("b", hash_bucket("h"))
    ws = Workspace(docs.sparkSession, "mixplan")
    rows = ws.table(rows, "sizes")  # the texts are read once; all that follows works on these few numbers a row
    placed = running(rows, ["source"], "b", ["h", "doc_id", "size", "th"], F.col("size"), "at")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))

    drawn, parts = _draw(targets, block, slots, seed, ws)
    taken = (
        drawn.repartition(parts, "source", "shard")  # a row becomes up to ``slots`` rows: spread them first, by a number that nothing coalesces
        .withColumn("k", F.explode(F.expr("sequence(first, first + count - 1)")))
        .where(f"k < {MOST} * blocks")
        .selectExpr("source", "blocks", "k div blocks AS pass", "k % blocks AS i", f"xxhash64(key, k div blocks, {seed}) AS round_key")
        .transform(lambda d: permuted(d, "i", "blocks", "round_key", "block"))
        .select("source", "pass", "block")
    )
    uses = taken.groupBy("source", "block").agg(F.sort_array(F.collect_list("pass")).alias("passes"))  # MOST entries at most

    spans = placed.where("size > 0").select("source", "doc_id", "th", "h", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    hit = spans.join(uses.withColumnRenamed("source", "s").withColumnRenamed("block", "u").hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("u")))
    piece = hit.select(
        "source", "h", "at",
        F.explode("passes").alias("pass"),
        F.expr(f"greatest(block * {block} - at, 0L)").alias("from"),
        F.expr(f"least((block + 1) * {block} - at, size)").alias("upto"),
    )
    pieces = piece.groupBy("source", "at").agg(F.sort_array(F.collect_list(F.struct("pass", "from", "upto"))).alias("pieces"))  # as long as the document
    pieces = pieces.select(F.col("source").alias("_s"), F.col("at").alias("_at"), "pieces")
    targets = targets.select(F.col("source").alias("_t"), "source_size", "target")
    out = placed.join(targets, F.col("source").eqNullSafe(F.col("_t")))
    # Documents without words share their place with the next one and take nothing.
    out = out.join(pieces.hint("merge"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
    none = F.array().cast("array<struct<pass:bigint,from:bigint,upto:bigint>>")
    return ws.finish(out.select("doc_id", "th", "size", "source", "source_size", "target", "at", F.coalesce("pieces", none).alias("pieces")))


def _draw(targets: DataFrame, block: int, slots: int, seed: int, ws: Workspace) -> tuple[DataFrame, int]:
    """(source, key, blocks, shard, count, first) of the slots of each source in each output shard, and the tasks that all slots are worth.

    A source owns a stretch of the whole numbers of ``DRAW_BITS`` bits, as long as its share of the slots; a slot's hash falls
    into one of them.  Stretches are looked up by the cells they touch: an equi-join with about one row a slot.
    """
    spark = targets.sparkSession
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    t = targets.where("source_size > 0").withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    # A block's mean length, so that sources with a short last block still meet their target.
    t = t.withColumn("want", F.col("target") * F.col("blocks") / F.col("source_size"))
    t = t.withColumn("upto", F.sum("want").over(by_name)).withColumn("all", F.max("upto").over(whole))
    edge = F.when(F.col("upto") >= F.col("all"), F.lit(1 << DRAW_BITS)).otherwise(F.floor(F.col("upto") / F.col("all") * (1 << DRAW_BITS))).cast("long")
    t = t.withColumn("edge", edge).withColumn("from", F.lag("edge", 1, 0).over(whole.orderBy(F.col("source").asc_nulls_last())))
    t = ws.table(t.select("source", F.xxhash64(F.lit(seed), "source").alias("key"), "blocks", "want", "from", "edge"), "stretches")
    total = int(-(-(t.agg(F.sum("want")).first()[0] or 0) // 1))
    parts = max(1, -(-total // TASK_SLOTS))
    cells = t.where("from < edge").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(from, {DRAW_BITS - CELL_BITS}), shiftright(edge - 1, {DRAW_BITS - CELL_BITS}))")))
    cells = bounded_broadcast(ws.table(cells.drop("want"), "cells"))
    slot = spark.range(0, total, 1, parts).select(F.expr(f"id div {slots}").alias("shard"), F.expr(f"pmod(xxhash64({seed}, 'slot', id), {1 << DRAW_BITS}L)").alias("u"))
    slot = slot.withColumn("at", F.shiftright("u", DRAW_BITS - CELL_BITS))
    hit = slot.join(cells, (F.col("at") == F.col("cell")) & (F.col("u") >= F.col("from")) & (F.col("u") < F.col("edge")))
    counts = ws.table(hit.groupBy("source", "key", "blocks", "shard").agg(F.count("*").alias("count")), "counts")
    by_shard = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("first", F.sum("count").over(by_shard) - F.col("count")), parts


def permuted(df: DataFrame, index: str, size: str, key: str, name: str) -> DataFrame:
    """Adds ``name``: the place of ``index`` (0 to ``size`` - 1) under a pseudorandom permutation that ``key`` names.

    A Feistel network on pairs of digits, of bases about the square root of the size; what falls beyond the size is permuted
    again (cycle walking).  The bases' product exceeds the size by less than a base, so a walk longer than ``WALK``
    steps is impossible for sizes up to the square of ``WALK``, and for larger ones of a chance below ``WALK ** -WALK``.
    """
    high, low = column_name(df, "high"), column_name(df, "low")
    df = df.withColumn(high, F.ceil(F.sqrt(size)).cast("long")).withColumn(low, F.expr(f"({size} + {high} - 1) div {high}"))
    k, h, w, n = F.col(key), F.col(high), F.col(low), F.col(size)
    top, bottom = column_name(df, "top"), column_name(df, "bottom")
    df = df.withColumn(top, F.expr(f"{index} div {low}")).withColumn(bottom, F.pmod(index, w))
    made = [top, bottom]
    for r in range(ROUNDS):  # a column a half round: each is computed once, in generated code
        made.append(column_name(df, f"r{r}"))
        df = df.withColumn(made[-1], _shifted(F.col(bottom), F.col(top), w, r, k) if r % 2 else _shifted(F.col(top), F.col(bottom), h, r, k))
        top, bottom = (top, made[-1]) if r % 2 else (made[-1], bottom)
    first = column_name(df, "first_place")
    df = df.withColumn(first, F.col(top) * w + F.col(bottom))

    def step(s: Column, r: Column) -> Column:
        even = F.struct(_shifted(s["t"], s["b"], h, r, k).alias("t"), s["b"].alias("b"))
        return F.when(r % 2 == 0, even).otherwise(F.struct(s["t"].alias("t"), _shifted(s["b"], s["t"], w, r, k).alias("b")))

    def once(y: Column) -> Column:
        start = F.struct(((y - F.pmod(y, w)) / w).cast("long").alias("t"), F.pmod(y, w).alias("b"))  # exact below 2**53
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: s["t"] * w + s["b"])

    again = F.aggregate(F.array(*map(F.lit, range(WALK))), F.col(first), lambda y, _: F.when(y < n, y).otherwise(once(y)))
    return df.withColumn(name, F.when(F.col(first) < n, F.col(first)).otherwise(again)).drop(high, low, first, *made)


def _shifted(digit: Column, by: Column, base: Column, r: int | Column, key: Column) -> Column:
    """A digit after a half round: moved by a hash of the other digit."""
    return F.pmod(digit + F.pmod(F.xxhash64(key, F.lit(r) if isinstance(r, int) else r, by), base), base)


def mix_sources(docs: DataFrame, block: int = 2048, slots: int = 65_536, seed: int = SEED) -> DataFrame:
    """The mixed documents, in the columns of ``docs``: one row for each document and pass that takes words of it.

    A document whose words are all taken in a pass comes with its whole text; otherwise the text is its
    taken words with the white space that follows them.  ``n_chars``, if there, is counted anew.  Null texts and texts without
    words are never taken; rows alike in doc_id and text have a place each; null doc_ids take part; an empty table gives
    an empty result.  Other columns come along, whatever their names.
    """
    plan = plan_mix(docs, block, slots, seed).where("size(pieces) > 0").select("doc_id", "th", "size", "at", "source", "pieces")
    mark, nth, p_id, p_th, p_nth, p_size, cuts = (column_name(docs, c) for c in ("mark", "nth", "p_id", "p_th", "p_nth", "p_size", "cuts"))
    left = docs.withColumn(mark, F.xxhash64("text"))
    if plan.groupBy("doc_id", "th").count().where("count > 1").isEmpty():
        left, plan = left.withColumn(nth, F.lit(1)), plan.withColumn("nth", F.lit(1))
    else:  # rows alike in doc_id and text have a row each in the plan: they meet by number
        left = left.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy("source")))
        plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("source", "at")))
    by_pass = plan.select(
        F.col("doc_id").alias(p_id), F.col("th").alias(p_th), F.col("nth").alias(p_nth), F.col("size").alias(p_size),
        F.explode(F.expr("transform(array_distinct(transform(pieces, p -> p.pass)), q -> filter(pieces, p -> p.pass = q))")).alias(cuts),
    )
    text = F.col("text").cast("string")
    joined = left.join(by_pass, left["doc_id"].cast("long").eqNullSafe(by_pass[p_id]) & (left[mark] == by_pass[p_th]) & (left[nth] == by_pass[p_nth]))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform(cuts, lambda p: F.slice(words, p["from"].cast("int") + 1, (p["upto"] - p["from"]).cast("int")))), "")
    covered = F.aggregate(cuts, F.lit(0).cast("long"), lambda s, p: s + p["upto"] - p["from"])
    out = joined.withColumn("text", F.when(covered == F.col(p_size), text).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
