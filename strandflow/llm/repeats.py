"""Suffix-array dedup: every byte that a repeated string of ``LENGTH`` bytes covers.

1. Windows of ``LENGTH`` bytes are owned by anchors: the least hash of the 64-byte strings inside a
   window (winnowing), so equal windows have the same anchor at the same place.  A run of up
   to ``RUN`` windows of one anchor shares a core that all of them contain; the core's hash is the run's
   key.  Only keys and places travel, in packed arrays that Spark sorts by stretches of the key space, and only keys that occur twice go on.
2. A run whose whole stretch occurs elsewhere is decided (key and stretch agree: 128 bits).  For the others, stretches of equal key
   meet and a depth-limited radix sort orders their windows: most-significant-digit passes over eight
   bytes at a time, through ``LENGTH`` bytes and no further; windows that stand alone leave after each pass, and
   the groups that are left are exactly the repeated windows.  A key of very many stretches is split first, into a key
   for each of its windows' contents: of these the sort has nothing left to order, so only numbers travel and are counted.
3. Texts that occur in several rows are repeats of each other as a whole; within steps 1 and 2 such a text counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, released
from .ngram_join import packed
from .shingles import BYTE, BYTE_2, mix, powers
from .workspace import Workspace, bounded_broadcast

LENGTH, GRAM, RUN = 400, 64, 128
#: Window starts of a text looked at together.
SEGMENT = 1 << 20
#: Runs folded at once by a reducer; stretches sorted at once.
FOLD, SORTBYTES = 1_000_000, 8_000_000
#: Bytes of text whose runs make one stretch of the key space: the fewer stretches, the larger the packed arrays.
STRETCHBYTES = 8_000_000
#: Runs that a task gathers before it deals them out.
FLUSH = 800_000
#: A key with more stretches is split by its windows' contents.
HOT = 2_000
_U64 = np.uint64


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from block-wise running minima of both directions."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, _U64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(text: bytes) -> np.ndarray:
    """Rows (key, stretch hash, first start, starts) as uint64, of all windows of a text."""
    out = []
    for at in range(0, len(text) - LENGTH + 1, SEGMENT):
        arr = np.frombuffer(text, np.uint8, min(SEGMENT + LENGTH - 1, len(text) - at), at)
        up, down = powers(len(arr) + 1)
        sums = np.concatenate((np.zeros(1, _U64), np.cumsum(BYTE[arr] * up[: len(arr)], dtype=_U64)))
        grams = len(arr) - GRAM + 1
        hashed = mix((sums[GRAM:] - sums[:grams]) * down[:grams])
        least = _sliding_least(hashed & ~_U64((1 << 22) - 1) | np.arange(grams, dtype=_U64), LENGTH - GRAM + 1)
        anchor = (least & _U64((1 << 22) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        first, last, anchor = new, np.concatenate((new[1:] - 1, [len(anchor) - 1])), anchor[new]
        low, high = (anchor - last) // RUN, (anchor - first) // RUN
        times = high - low + 1
        pick = np.repeat(np.arange(len(new)), times)
        j = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times) + low[pick]
        a = anchor[pick]
        lo = np.maximum(first[pick], a - j * RUN - RUN + 1)
        hi = np.minimum(last[pick], a - j * RUN)
        core = a - j * RUN
        key = mix((sums[core + LENGTH - RUN + 1] - sums[core]) * down[core] + mix(j.astype(_U64)))
        stretch = mix((sums[hi + LENGTH] - sums[lo]) * down[lo] + mix((a - lo).astype(_U64) << _U64(20) | (hi - lo).astype(_U64)))
        out.append(np.stack((key, stretch, (lo + at).astype(_U64), (hi - lo + 1).astype(_U64)), axis=1))
    return np.concatenate(out) if out else np.zeros((0, 4), _U64)


def _runs_pass(parts: int, stretches: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            part, stretch, blobs = zip(*packed(np.concatenate(held), parts, stretches), strict=True)
            held.clear()
            size = 0
            return pa.record_batch([pa.array(part, pa.int32()), pa.array(stretch, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "stretch", "runs"])

        for batch, texts in batches(it, "text"):
            seen = set()
            for th, text in zip(batch.column("th").to_pylist(), texts, strict=True):
                if len(text) >= LENGTH and th not in seen:
                    seen.add(th)
                    r = runs_of(text)
                    held.append(np.concatenate((r, np.full((len(r), 1), th, np.int64).view(_U64)), axis=1))
                    size += len(r)
            if size >= FLUSH:
                yield flush()
        if size:
            yield flush()

    return run


_FOUND = ["th", "first", "starts", "key", "whole", "decided"]


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs whose key occurs at two places; decided if their whole stretch does.

    Between folds four stretches a key are kept at most, so a key of any number of runs takes bounded memory; a later
    run of a key that was met always goes on, and a stretch that is not among the kept is left to the sort.  Rows come in
    order of their part and stretch of the key space, and what is kept is let go when the next begins.
    """
    kept = np.zeros((0, 6), _U64)
    fresh: list[np.ndarray] = []
    held, last = 0, None

    def fold() -> pa.RecordBatch:
        nonlocal kept, held
        new = np.concatenate(fresh)
        r = np.concatenate((kept, np.concatenate((new, np.zeros((len(new), 1), _U64)), axis=1)))
        fresh.clear()
        held = 0
        r = r[np.lexsort((~r[:, 5], r[:, 2], r[:, 4], r[:, 1], r[:, 0]))]  # key, stretch, text, place; known first
        same = np.zeros(len(r), bool)
        same[1:] = (r[1:, [0, 1, 2, 4]] == r[:-1, [0, 1, 2, 4]]).all(axis=1)
        r = r[~same]
        key_new = np.concatenate(([True], r[1:, 0] != r[:-1, 0]))
        str_new = key_new | np.concatenate(([True], r[1:, 1] != r[:-1, 1]))
        key_no, str_no = np.cumsum(key_new) - 1, np.cumsum(str_new) - 1
        level = np.where(np.bincount(str_no)[str_no] > 1, 2, np.where(np.bincount(key_no)[key_no] > 1, 1, 0)).astype(_U64)
        go = level > r[:, 5]
        r[:, 5] = np.maximum(level, r[:, 5])
        found = r[go]
        one = r[str_new]
        begin = np.flatnonzero(np.concatenate(([True], one[1:, 0] != one[:-1, 0])))
        rank = np.arange(len(one)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(one)]))))
        kept = one[rank < 4]
        signed = found[:, [4, 2, 3, 0, 1]].astype(_U64).view(np.int64)
        return pa.record_batch([*(pa.array(np.ascontiguousarray(signed[:, c])) for c in range(5)), pa.array(found[:, 5] == 2)], names=_FOUND)

    for batch in it:
        for part, stretch, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "stretch", "runs")), strict=True):
            if (part, stretch) != last:
                if held:
                    yield fold()
                kept, last = kept[:0], (part, stretch)
            fresh.append(np.frombuffer(blob, _U64).reshape(-1, 5))
            held += len(fresh[-1])
            if held >= FOLD:
                yield fold()
    if held:
        yield fold()


def repeated_windows(stretches: list[bytes], starts: list[int], keys: list[int] | None = None) -> list[np.ndarray]:
    """For each stretch a flag for each of its first ``starts`` windows: does an equal window stand at another place?

    Depth-limited most-significant-digit radix sort of all windows; with ``keys`` (ascending, one a stretch) windows of
    unequal key start in unequal groups.
    """
    buf = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    digit = np.zeros(len(buf) - 8 + 1, _U64)
    for i in range(8):
        digit = digit << _U64(8) | buf[i : i + len(digit)]
    counts = np.array(starts, np.int64)
    begin = np.concatenate(([0], np.cumsum([len(s) for s in stretches])))[:-1]
    place = np.repeat(begin, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at, group = place, np.repeat(np.zeros(len(counts), np.int64) if keys is None else np.array(keys, np.int64), counts)
    for depth in range(0, LENGTH, 8):
        if not len(at):
            break
        d = digit[at + depth]
        head = np.concatenate(([True], group[1:] != group[:-1]))
        number = np.cumsum(head) - 1
        differs = d != d[np.flatnonzero(head)][number]
        if not differs.any():
            continue
        split = np.zeros(number[-1] + 1, bool)
        split[number[differs]] = True
        moving = np.flatnonzero(split[number])  # only groups that this digit splits are sorted
        order = np.lexsort((d[moving], number[moving]))
        at, d = at.copy(), d.copy()
        at[moving], d[moving] = at[moving][order], d[moving][order]
        head = np.concatenate(([True], (number[1:] != number[:-1]) | (d[1:] != d[:-1])))
        group = np.cumsum(head) - 1
        many = np.bincount(group)[group] > 1
        at, group = at[many], group[many]
    left = np.zeros(len(digit), bool)
    left[at] = True
    return [left[b : b + n] for b, n in zip(begin.tolist(), starts, strict=True)]


def _sort_keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches in order of key, many whole keys to a sort; repeated rows of a text come once."""
    held: list[tuple] = []
    size = 0

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        flags = repeated_windows([r[4] for r in rows], [r[3] for r in rows], [r[0] for r in rows])
        out = []
        for (_, th, first, _, _), f in zip(rows, flags, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], f, [False])).astype(np.int8))).tolist()
            out += [(th, first + a, b - a) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=["th", "first", "starts"])

    for batch in it:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "th", "first", "starts", "stretch")), strict=True):
            if held and row[0] != held[-1][0] and size >= SORTBYTES:
                yield sort(held)
                held, size = [], 0
            if not held or row[:3] != held[-1][:3]:
                held.append(row)
                size += len(row[4])
    if held:
        yield sort(held)


def window_names(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each window of a text, of tables of their own."""
    arr = np.frombuffer(text, np.uint8)
    up, down = powers(len(arr) + 1)
    names = []
    for table in (BYTE, BYTE_2):
        sums = np.concatenate((np.zeros(1, _U64), np.cumsum(table[arr] * up[: len(arr)], dtype=_U64)))
        names.append(mix((sums[LENGTH:] - sums[:-LENGTH]) * down[: len(arr) - LENGTH + 1]).view(np.int64))
    return names[0], names[1]


def _cut_stretches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(th, first, starts, key, stretch) of the wanted runs; of hot ones a row for each window, with its two hashes instead."""
    for batch, texts in batches(it, "text"):
        rows, hot = [], []
        for th, text, runs in zip(batch.column("th").to_pylist(), texts, batch.column("runs").to_pylist(), strict=True):
            for r in runs:
                first, starts = r["first"], r["starts"]
                stretch = text[first : first + starts - 1 + LENGTH]
                if r["hot"]:
                    a, b = window_names(stretch)
                    hot.append(np.stack((np.full(starts, th), first + np.arange(starts), np.ones(starts, np.int64), a, b), axis=1))
                else:
                    rows.append((th, first, starts, r["key"], stretch))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.nulls(len(rows), pa.int64()), pa.array(cols[4], pa.binary())], names=_CUT)
        for at in range(0, len(hot), 500):
            some = np.concatenate(hot[at : at + 500])
            yield pa.record_batch([*(pa.array(np.ascontiguousarray(some[:, c])) for c in range(5)), pa.nulls(len(some), pa.binary())], names=_CUT)


_CUT = ["th", "first", "starts", "key", "key2", "stretch"]


def spans(n: int, whole: bool, runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal removed (from, upto) of a text of ``n`` bytes."""
    if n >= LENGTH and whole:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["first"], r["first"] + r["starts"] - 1 + LENGTH) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it, "text"):
        rows = []
        for text, whole, runs in zip(texts, batch.column("whole").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            cut = spans(len(text), whole, runs)
            kept, at = hashlib.sha256(), 0
            for a, b in [*cut, (len(text), len(text))]:
                kept.update(text[at:a])
                at = b
            rows.append((len(text), sum(b - a for a, b in cut), len(cut), kept.hexdigest(), [a for a, _ in cut], [b for _, b in cut]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_from", "span_upto"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept_sha256, span_from, span_upto).

    A byte of a text's UTF-8 is removed if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the same or
    another row; overlapping places count, and no string crosses rows.  Null and empty texts, and texts below ``LENGTH``
    bytes, lose nothing.  Repeated rows are repeats of each other.  One row for each row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))  # dealt by hash: of fewer, one task would get several
    ws = Workspace(spark, "repeats")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    other = F.xxhash64(F.lit(LENGTH), "text")
    long = text.where(F.octet_length("text") >= LENGTH)
    met = ws.table(long.withColumn("th2", other).groupBy("th").agg(F.count("*").alias("many"), F.min("th2").alias("a"), F.max("th2").alias("b")).where("many > 1"), "met")
    unlike = met.where("a <> b").select(F.col("th").alias("unlike"))
    if not unlike.isEmpty():  # different texts of one 64-bit hash: these few take another
        text = text.join(bounded_broadcast(unlike), F.col("th") == F.col("unlike"), "left").select("doc_id", "text", F.when(F.col("unlike").isNotNull(), other).otherwise(F.col("th")).alias("th"))
        long = text.where(F.octet_length("text") >= LENGTH)
        met = long.groupBy("th").agg(F.count("*").alias("many")).where("many > 1")
    twice = ws.table(met.select("th"), "twice")
    # A task makes a row for each stretch that it has runs of, so there are no more stretches than the texts are worth.
    size = long.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    stretches = max(1, -(-size // (parts * STRETCHBYTES)))
    runs = long.select("th", "text").mapInArrow(released(_runs_pass(parts, stretches)), "part int, stretch int, runs binary")
    dealt = runs.repartition(parts, "part").sortWithinPartitions("part", "stretch")
    found = ws.table(dealt.mapInArrow(released(_fold), "th long, first long, starts long, key long, whole long, decided boolean"), "found")
    found = found.groupBy("th", "first", "starts", "key", "whole").agg(F.max("decided").alias("decided"))
    found = ws.table(found, "runs")

    open_runs = found.where("not decided")
    # Decided runs of such a key may hold equal windows too; of equal stretches one stands for all.
    # They are picked before the join, combined map-side: a key may have very many decided runs.
    one = found.where("decided").groupBy("key", "whole").agg(F.min(F.struct("th", "first", "starts")).alias("one"))
    one = one.join(open_runs.select("key").distinct(), "key", "left_semi")
    needed = ws.table(open_runs.select("key", "th", "first", "starts").union(one.select("key", "one.*")).distinct(), "needed")
    # Counted map-side; at most one of HOT stretches has a key that is split, so these keys are few.
    hot = ws.table(needed.groupBy("key").count().where(f"count > {HOT}").select(F.col("key").alias("hot_key")), "hot")
    needed = needed.join(bounded_broadcast(hot), F.col("key") == F.col("hot_key"), "left").withColumn("hot", F.col("hot_key").isNotNull())
    wanted = needed.groupBy("th").agg(F.collect_list(F.struct("first", "starts", "key", "hot")).alias("runs"))  # as many as the text is long
    cut = long.select("th", "text").join(wanted.hint("merge"), "th").mapInArrow(released(_cut_stretches), "th long, first long, starts long, key long, key2 long, stretch binary")
    if hot.isEmpty():
        usual, windows = cut, None
    else:
        cut = ws.table(cut, "cut")
        usual, windows = cut.where("key2 is null"), cut.where("key2 is not null").select("th", "first", "starts", "key", "key2").distinct()
    usual = usual.drop("key2").repartition("key").sortWithinPartitions("key", "th", "first")
    sorted_out = usual.mapInArrow(released(_sort_keys), "th long, first long, starts long")
    decided = found.where("decided").select("th", "first", "starts").union(sorted_out)
    if windows is not None:  # each distinct place of a window: a content met at two of them is repeated
        many = windows.groupBy("key", "key2").count().where("count > 1").drop("count")
        decided = decided.union(windows.join(many, ["key", "key2"], "left_semi").select("th", "first", "starts"))
    decided = ws.table(decided.distinct(), "decided")

    whole = twice.select("th", F.lit(True).alias("whole"), F.lit(None).cast("struct<first:bigint,starts:bigint>").alias("run"))
    per = whole.union(decided.select("th", F.lit(False), F.struct("first", "starts"))).groupBy("th").agg(F.max("whole").alias("whole"), F.collect_list("run").alias("runs"))
    per = ws.table(per, "per")
    # Runs grow with the texts, so the two always meet by shuffle.
    joined = text.join(per.hint("merge"), "th", "left").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "runs")
    out = joined.mapInArrow(released(_judge), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_from array<long>, span_upto array<long>")
    return ws.finish(out)
