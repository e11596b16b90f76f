"""N-gram Jaccard join: all links of similarity ``num/den`` or more, through signature trees.

1. One Arrow pass hashes every whole text into its set of k-word shingles.  Equal sets form
   a class.  For the links between different sets, sizes are cut into slots; in a slot of
   largest size U two linked sets differ in at most d = 2U(den-num)/(den+num) shingles, so of
   d+1 ranges of the hash space at least one holds exactly the same shingles in both.  With more ranges
   than that a set keeps d+1: the prefix filter, as several must agree.  Ranges without a rare shingle are the first left
   out, so lines that very many texts repeat join few unlike sets; a bounded sample tells what is common.  Each
   range's content is hashed to a key.  Keys travel as packed arrays, one row a batch and
   stretch of the key space, and each partition's stretches are folded one after the other, in the order
   that Spark sorts (and spills) them: of a key one set is kept, so a key that a
   third of all sets have takes no more memory than any other.
2. Within a slot, sets that share a key, directly or through others, form a candidate group; every
   link lies inside a group of the slot of its larger set.  Keys of empty ranges would join most sets, so
   there are enough ranges that nearly every set fills more than d and needs none.
3. In each group a signature tree (``sigtree``) finds the links exactly.  Groups above a
   block's size are cut into blocks.  Each block is traversed together with the group's pivots, a few sets of
   every group that all of its blocks get; that joins nearly all of a group of near copies.  What is left outside
   the group's main component then meets all blocks, in a traversal of bitmaps alone, a few bytes a shingle, that skips what already hangs
   together; the pairs that it leaves are verified by their shingles.  So the shingles that travel grow with the
   group; the bitmaps grow with its square only if most of it stays apart.

A set is known by 128 bits wherever links are made; candidate groups use 64, which at worst adds candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import batches, released
from .components import components
from .shingles import mix, shingle_sets
from .sigtree import SignatureTree, bitmap, candidates
from .workspace import Workspace, bounded_broadcast, column_name, fewer

#: Bytes of texts that stand for all when common shingles are looked for, or this share of the texts if that is less.
SAMPLE, SHARE = 64_000_000, 0.125
#: A shingle of so many sampled sets is common; at most so many are remembered.
COMMON, REMEMBERED = 4, 200_000
#: Size slots grow by this factor.
SLOT = 1.2
#: Ranges beyond the d+1 that are needed, and their share of these, so that empty ranges need no key of their own.
SPARE, STRETCH = 3, 0.15
#: Keys folded at once by a reducer, and the stretches that each of its partitions is cut into.
FOLD, STRETCHES = 1_000_000, 64
#: Keys that a task gathers before it deals them out: the more, the larger the packed arrays.
FLUSH = 2_000_000
#: Bytes of text hashed at once, and of packed arrays handed on at once: an executor has several workers beside its JVM.
LOT, HANDED = 1 << 18, 1 << 22
#: Sets and shingles in one block of a candidate group.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 3_000_000
#: Pairs that one task verifies.
VERIFY = 2000
#: Pivots of a group of several blocks, on average.
PIVOTS = 64
_U64 = np.uint64


def _slots() -> np.ndarray:
    bounds, x = [1], 1.0
    while bounds[-1] < 2**40:
        x *= SLOT
        if int(x) > bounds[-1]:
            bounds.append(int(x))
    return np.array(bounds, np.int64)


class Common:
    """Shingles that many sets have, ascending, and how common they are: each level has twice the sets of the one before."""

    def __init__(self, shingles: np.ndarray, many: np.ndarray):
        order = np.argsort(shingles)
        self.shingles, self.level = shingles[order], np.log2(np.maximum(1, many[order])).astype(np.int8) + np.int8(1)
        self._maybe = np.zeros(1 << 22, bool)
        self._maybe[self.shingles >> _U64(42)] = True

    def levels(self, s: np.ndarray) -> np.ndarray:
        """The level of each shingle, 0 of those not known as common."""
        out = np.zeros(len(s), np.int8)
        some = np.flatnonzero(self._maybe[s >> _U64(42)])
        if len(some):
            at = np.minimum(np.searchsorted(self.shingles, s[some]), len(self.shingles) - 1)
            out[some] = np.where(self.shingles[at] == s[some], self.level[at], 0)
        return out


def range_keys(s: np.ndarray, slot: int, d: int, level: np.ndarray | None = None) -> np.ndarray:
    """Keys of the ranges of a sorted set, the slot in the low byte; equal content of a range gives equal keys.

    Two sets with at most ``d`` differences agree in ``m - d`` ranges, so in ``f - d`` full ones, ``f`` the larger number of
    full ranges of the two.  Each set may thus leave out its last ``f - d - 1`` in an order that depends on content alone: the
    first range that both share stays.  Ranges whose rarest shingle is common (``level`` of each shingle) go last, and of equally
    rare ones those of few shingles, as unlike sets agree in these most often.  A set of at most ``d`` full ranges gives all
    keys, those of empty ranges too.
    """
    m = d + 1 + SPARE + int(STRETCH * (d + 1))
    edges = ((np.arange(1, m, dtype=_U64) << _U64(32)) + _U64(m - 1)) // _U64(m) << _U64(32)
    at = np.concatenate(([0], np.searchsorted(s, edges), [len(s)]))
    sums = np.concatenate((np.zeros(1, _U64), np.cumsum(mix(s ^ _U64(0xA24BAED4963EE407)), dtype=_U64)))
    count = np.diff(at)
    keys = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(m, dtype=_U64) + _U64(slot << 40)))
    keys = keys & ~_U64(255) | _U64(slot)
    full = np.flatnonzero(count)
    if len(full) <= d:
        return keys
    rarest = np.minimum.reduceat(level, at[full]) if level is not None else np.zeros(len(full), np.int8)
    return keys[full[np.lexsort((keys[full], -count[full], rarest))[: d + 1]]]


def _sample_pass(k: int, parts: int):
    """Packed rows (shingle, text) of whole texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", LOT):
            sets = shingle_sets(texts, k)
            own = np.repeat(batch.column("th").to_numpy().view(_U64), [len(s) for s in sets])
            if len(own):
                part, _, blobs = zip(*packed(np.stack((np.concatenate(sets), own), axis=1), parts, 1), strict=True)
                yield pa.record_batch([pa.array(part, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "rows"])

    return released(run)


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, n) of the shingles that ``COMMON`` different texts have; a shingle lies in one partition."""
    found = [np.frombuffer(blob.as_buffer(), _U64).reshape(-1, 2).copy() for batch in it for blob in batch.column("rows")]
    if found:
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))  # equal texts count once
        s, n = np.unique(rows[new, 0], return_counts=True)
        yield pa.record_batch([pa.array(s[n >= COMMON].view(np.int64)), pa.array(n[n >= COMMON])], names=["shingle", "n"])


def _common(text: DataFrame, k: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that many sets of a bounded sample of the distinct texts have, and how many.

    They only order the ranges of a set, by the same rule for all sets: a sample that misses some makes more candidates and loses no link.
    """
    size = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(SHARE, SAMPLE / max(1, size))
    some = text.where(F.expr(f"pmod(xxhash64(th), 1073741824) < {share} * 1073741824D")).select("th", "text")
    counts = some.mapInArrow(_sample_pass(k, parts), "part int, rows binary").repartition(parts, "part").mapInArrow(released(_count), "shingle long, n long")
    top = counts.orderBy(F.desc("n"), "shingle").limit(REMEMBERED).toArrow()
    return top.column("shingle").to_numpy().view(_U64), top.column("n").to_numpy()


def packed(rows: np.ndarray, parts: int, stretches: int = STRETCHES) -> Iterator[tuple[int, int, bytes]]:
    """(part, stretch, rows' bytes) of rows of uint64, dealt by the first column over the parts' stretches."""
    part = ((rows[:, 0] >> _U64(32)) * _U64(parts * stretches) >> _U64(32)).astype(np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    edge = np.concatenate((np.flatnonzero(np.diff(part, prepend=part[0] + np.uint32(1))), [len(part)])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(part[a]) // stretches, int(part[a]) % stretches, rows[order[a:b]].tobytes()


def _hash_pass(k: int, num: int, den: int, parts: int, known: tuple[np.ndarray, np.ndarray]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Common(*known)
        bounds = _slots()
        spread = [2 * (int(b) - 1) * (den - num) // (den + num) for b in bounds[1:]]
        held: list[np.ndarray] = []
        size = 0

        def joined() -> np.ndarray:
            nonlocal size
            rows = np.concatenate(held)
            held.clear()
            size = 0
            return rows

        def handed(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            part, stretch, blobs = zip(*pieces, strict=True)
            nulls = pa.nulls(len(part), pa.int64())
            return pa.record_batch([pa.array(part, pa.int32()), pa.array(stretch, pa.int32()), nulls, nulls, nulls, nulls, nulls, pa.array(blobs, pa.binary())], names=_HASHED)

        def flush() -> Iterator[pa.RecordBatch]:
            pieces, full = [], 0
            for piece in packed(joined(), parts):
                pieces.append(piece)
                full += len(piece[2])
                if full >= HANDED:
                    yield handed(pieces)
                    pieces, full = [], 0
            if pieces:
                yield handed(pieces)

        for batch, texts in batches(it, "text", LOT):
            sets = shingle_sets(texts, k)
            n = np.fromiter((len(s) for s in sets), np.int64, len(sets))
            a = np.array([int(mix(s).sum(dtype=_U64)) for s in sets], _U64)
            b = mix(np.array([int(mix(s ^ _U64(0x5851F42D4C957F2D)).sum(dtype=_U64)) for s in sets], _U64) + n.astype(_U64))
            a = mix(a ^ n.astype(_U64))
            for row, (s, many) in enumerate(zip(sets, n.tolist(), strict=True)):
                if many:
                    level = common.levels(s)
                    low = int(np.searchsorted(bounds, many, "right")) - 1
                    high = int(np.searchsorted(bounds, many * den // num, "right")) - 1
                    for slot in range(low, high + 1):
                        if spread[slot]:
                            keys = range_keys(s, slot, spread[slot], level)
                            held.append(np.stack((keys, np.full(len(keys), a[row])), axis=1))
                            size += len(keys)
            rows = len(sets)
            signed = a.view(np.int64)
            yield pa.record_batch([pa.array((signed % parts).astype(np.int32)), pa.nulls(rows, pa.int32()), batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(signed), pa.array(b.view(np.int64)), pa.nulls(rows, pa.binary())], names=_HASHED)
            if size >= FLUSH:
                yield from flush()
        if size:
            yield from flush()

    return run


_HASHED = ["part", "stretch", "doc_id", "th", "n", "sig", "sig2", "keys"]


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents pass; of the keys come edges (a, b, slot) from each set to the first set seen with its key.

    Rows come in order of their stretch, and a key lies in one stretch: what is remembered is let go when the next begins.
    """
    seen_key, seen_set = np.zeros(0, _U64), np.zeros(0, np.int64)
    keys: list[np.ndarray] = []
    sets: list[np.ndarray] = []
    held, last = 0, None

    def fold() -> pa.RecordBatch:
        nonlocal seen_key, seen_set, held
        key, own = np.concatenate([seen_key, *keys]), np.concatenate([seen_set, *sets])
        keys.clear()
        sets.clear()
        held = 0
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        seen_key, seen_set = key[new], own[new]
        first = seen_set[np.cumsum(new) - 1] if len(key) else own
        off = own != first
        pairs = np.unique(np.stack((own[off], first[off], (key[off] & _U64(255)).astype(np.int64)), axis=1), axis=0)
        nulls = pa.nulls(len(pairs), pa.int64())
        return pa.record_batch([nulls, nulls, nulls, nulls, nulls, *map(pa.array, pairs.T.copy())], names=_FOLDED)

    for batch in it:
        whole = batch.filter(batch.column("n").is_valid())
        if whole.num_rows:
            nulls = pa.nulls(whole.num_rows, pa.int64())
            yield pa.record_batch([*(whole.column(c) for c in _HASHED[2:7]), nulls, nulls, nulls], names=_FOLDED)
        for stretch, blob in zip(batch.column("stretch").to_pylist(), batch.column("keys"), strict=True):
            if blob.is_valid:
                if stretch != last:
                    if held:
                        yield fold()
                    seen_key, seen_set, last = np.zeros(0, _U64), np.zeros(0, np.int64), stretch
                pair = np.frombuffer(blob.as_buffer(), _U64).reshape(-1, 2)
                keys.append(pair[:, 0].copy())
                sets.append(pair[:, 1].copy().view(np.int64))
                held += len(keys[-1])
                if held >= FOLD:
                    yield fold()
    if held:
        yield fold()


_FOLDED = ["doc_id", "th", "n", "sig", "sig2", "a", "b", "slot"]
_FOLDED_TYPE = ", ".join(f"{c} long" for c in _FOLDED)


def _shingle_pass(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", LOT):
            sets = pa.array([s.tobytes() for s in shingle_sets(texts, k)], pa.binary())
            yield pa.record_batch([batch.column("sig"), batch.column("sig2"), batch.column("units"), sets], names=["sig", "sig2", "units", "tokens"])

    return released(run)


_LINKED = ["a", "a2", "b", "b2", "sets", "tested", "pruned", "verified"]
_LINKED_TYPE = ", ".join(f"{c} long" for c in _LINKED)


def _link_unit(num: int, den: int, every: bool):
    """Links of one unit's sets, and a last row that counts its sets, tested and pruned pairs of nodes, and verified pairs of sets."""

    def run(table: pa.Table) -> pa.Table:
        name = np.stack([table.column(c).to_numpy() for c in ("sig", "sig2")], axis=1)
        label = np.stack([table.column(c).to_numpy() for c in ("label", "label2")], axis=1)
        block = table.column("block").to_numpy()
        _, once = np.unique(name, axis=0, return_index=True)  # a set may come as one of several kinds
        sets = [np.frombuffer(table.column("tokens")[int(i)].as_buffer(), _U64) for i in once]
        name, block = name[once], block[once]
        tree = SignatureTree(sets, num, den)
        if every:
            pairs = np.array(tree.pairs(block if len(set(block.tolist())) > 1 else None), np.int64).reshape(-1, 2)
        else:
            _, known = np.unique(label[once], axis=0, return_inverse=True)
            roots = np.array(tree.link(known=known.ravel()), np.int64)
            off = np.flatnonzero(roots != np.arange(len(roots)))
            off = off[(label[once][off] != label[once][roots[off]]).any(axis=1)]
            pairs = np.stack((off, roots[off]), axis=1)
        counts = [[0] * 4, [len(sets), tree.tested, tree.pruned, tree.verified]]
        none, few = np.zeros((len(pairs), 4), np.int64), np.array(counts[1:], np.int64)
        values = np.concatenate((np.concatenate((name[pairs[:, 0]], name[pairs[:, 1]], none), axis=1), np.concatenate((np.zeros((1, 4), np.int64), few), axis=1)))
        real = np.arange(len(values)) < len(pairs)
        return pa.table({c: pa.array(values[:, i], mask=~real if i < 4 else None) for i, c in enumerate(_LINKED)})

    return run


def _map_pass(k: int):
    """A row for each set and unit with the set's bitmap, of the width that the unit asks for."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, "text", LOT):
            rows = []
            for s, sig, sig2, units in zip(shingle_sets(texts, k), *(batch.column(c).to_pylist() for c in ("sig", "sig2", "units")), strict=True):
                maps: dict[int, bytes] = {}
                for u in units:
                    bits = u["block"]
                    if bits not in maps:
                        maps[bits] = bitmap(s, bits).tobytes()
                    rows.append((u["group"], u["lo"], u["hi"], sig, sig2, u["label"]["sig"], u["label"]["sig2"], len(s), maps[bits]))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_MAPPED)

    return released(run)


_MAPPED = ["group", "lo", "hi", "sig", "sig2", "label", "label2", "n", "map"]


def _maybe_unit(num: int, den: int):
    """Pairs of sets of a unit that its bitmaps leave, with their labels, and a last row of counts."""

    def run(table: pa.Table) -> pa.Table:
        name = np.stack([table.column(c).to_numpy() for c in ("sig", "sig2")], axis=1)
        label = np.stack([table.column(c).to_numpy() for c in ("label", "label2")], axis=1)
        _, once = np.unique(name, axis=0, return_index=True)
        name, label = name[once], label[once]
        maps = np.stack([np.frombuffer(table.column("map")[int(i)].as_buffer(), _U64) for i in once])
        _, known = np.unique(label, axis=0, return_inverse=True)
        pairs, tested, pruned = candidates(maps, table.column("n").to_numpy()[once], known.ravel(), num, den)
        i, j = pairs.T
        cols = np.concatenate((np.concatenate((name[i], label[i], name[j], label[j], np.zeros((len(i), 3), np.int64)), axis=1), np.array([[0] * 8 + [len(once), tested, pruned]])))
        real = np.arange(len(cols)) < len(i)
        group = pa.array(np.full(len(cols), table.column("group")[0].as_py()))
        return pa.table({"group": group} | {c: pa.array(cols[:, n], mask=~real if n < 8 else None) for n, c in enumerate(_MAYBE[1:])})

    return run


_MAYBE = ["group", "a", "a2", "la", "la2", "b", "b2", "lb", "lb2", "sets", "tested", "pruned"]


def link_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, partitions: int | None = None, links: bool = False, figures: dict[str, int] | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) -> (doc_id, th, n_shingles, component_id, component, copies), checkpointed.

    One row for each distinct (doc_id, text); ``copies`` counts the rows it stands for and ``th`` is the
    text's xxhash64.  Two texts link when ``den * |A & B| >= num * |A | B|`` for their sets of
    ``k``-word shingles; ``component_id`` is the least doc_id reachable by links, a row's own included.
    With ``links`` every pair that the bounds leave is verified and ``n_links`` is added: the number of other rows
    whose text links with the row's own, equal texts included (0 for an empty set); a group of near copies that all
    link then costs the square of its sets.
    ``component`` is the component's own key: components that share an id, or have none, differ in it.
    ``figures`` takes the trees' counts: units, sets, pairs of nodes tested and pruned, pairs of sets verified.

    Null or blank texts have an empty set and link with nothing (component_id is their own doc_id,
    component is null).
    Rows with a null doc_id take part; their component_id is the least id reachable, null if there is
    none.  Repeated rows and repeated ids are allowed.  An empty table gives an empty result.  Other
    columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ws = Workspace(spark, "ngram")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    hashed = text.mapInArrow(released(_hash_pass(k, num, den, parts, _common(text, k, parts))), "part int, stretch int, doc_id long, th long, n long, sig long, sig2 long, keys binary")
    dealt = hashed.repartition(parts, "part").sortWithinPartitions("stretch", "part")
    folded = ws.table(dealt.mapInArrow(released(_fold), _FOLDED_TYPE), "folded")
    rows = folded.where("n is not null")
    edges = folded.where("a is not null").select("a", "b", "slot")
    edges = fewer(edges.distinct(), edges.count()).checkpoint()
    pairs = _links(text, rows, edges, k, num, den, ws, links, figures) if not edges.isEmpty() else None
    most, joined = rows.count(), pairs.count() if pairs is not None else 0

    per = rows.groupBy("doc_id", "th").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sig2").alias("sig2"), F.count("*").alias("copies"))
    per = per.withColumn("class", F.when(F.col("n") > 0, F.struct("sig", "sig2")))
    if joined:
        per = per.join(bounded_broadcast(components(pairs, joined)), F.col("class") == F.col("node"), "left").drop("node")
    else:
        per = per.withColumn("root", F.lit(None).cast("struct<sig:bigint,sig2:bigint>"))
    per = per.withColumn("component", F.coalesce("root", "class"))
    per = ws.table(fewer(_with_links(per, pairs) if links else per, most), "rows")
    least = per.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").drop("many")
    out = per.join(least, "component", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "component", "copies", *[c for c in ["n_links"] if links])
    return ws.finish(fewer(out, most))


def _links(text: DataFrame, rows: DataFrame, edges: DataFrame, k: int, num: int, den: int, ws: Workspace, every: bool, figures: dict[str, int] | None) -> DataFrame:
    """(a, b), structs of (sig, sig2): all pairs of different sets that link if ``every``, else enough to connect them."""
    node = lambda c: F.xxhash64(c, "slot")
    ends = edges.select(F.col("a").alias("sig"), node("a").alias("node")).union(edges.select(F.col("b").alias("sig"), node("b").alias("node"))).distinct()
    most = 2 * (joined := edges.count())  # members
    group = components(edges.select(node("a").alias("a"), node("b").alias("b")), joined).withColumnRenamed("root", "group")
    inside = ws.table(fewer(ends.join(group, "node").select("sig", "group"), most), "groups")
    member = rows.where("n > 0").join(bounded_broadcast(inside), "sig").groupBy("sig", "sig2", "group").agg(F.min(F.struct("th", "doc_id")).alias("at"), F.first("n").alias("n"))
    member = ws.table(fewer(member, most), "members")
    weight = member.groupBy("group").agg(
        F.count("*").alias("many"), F.max("n").alias("largest"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    )
    weight = ws.table(fewer(weight, most), "weights")
    own = F.pmod(F.xxhash64("sig", "n"), F.col("blocks")).cast("int")
    placed = member.join(weight, "group").withColumn("own", own)

    def sets_of(units: DataFrame, name: str) -> tuple[DataFrame, str]:
        """(sig, sig2, units, text) of ``units``, which has a row for each set and unit: group, lo, hi, block, label, and the set's place in the texts."""
        # A set lies in few groups and units: its text is hashed once for all of them.
        here = units.groupBy("sig", "sig2", F.col("at.th").alias("mth"), F.col("at.doc_id").alias("mid")).agg(F.collect_list(F.struct("group", "lo", "hi", "block", "label")).alias("units"))
        here = ws.table(fewer(here, most), f"here-{name}")
        wanted = text.join(bounded_broadcast(here), (text.th == F.col("mth")) & text.doc_id.eqNullSafe(F.col("mid"))).dropDuplicates(["sig", "sig2"])
        return wanted.select("sig", "sig2", "units", "text"), here.schema["units"].dataType.simpleString()

    def linked(units: DataFrame, name: str) -> DataFrame:
        wanted, kind = sets_of(units, name)
        sets = wanted.mapInArrow(_shingle_pass(k), f"sig long, sig2 long, units {kind}, tokens binary").select("sig", "sig2", "tokens", F.inline("units"))
        sets = sets.select("group", "lo", "hi", "block", "sig", "sig2", F.col("label.sig").alias("label"), F.col("label.sig2").alias("label2"), "tokens")
        return ws.table(sets.groupBy("group", "lo", "hi").applyInArrow(_link_unit(num, den, every), _LINKED_TYPE), f"links-{name}")

    def left_by_maps(units: DataFrame) -> DataFrame:
        wanted, _ = sets_of(units, "maps")
        maps = wanted.mapInArrow(_map_pass(k), "group long, lo int, hi int, sig long, sig2 long, label long, label2 long, n long, map binary")
        return ws.table(maps.groupBy("group", "lo", "hi").applyInArrow(_maybe_unit(num, den), ", ".join(f"{c} long" for c in _MAYBE)), "maybe")

    alone = F.struct("sig", "sig2").alias("label")
    each = F.explode(F.expr("sequence(0, blocks - 1)"))
    if every:  # a block against itself or against another
        units = placed.withColumn("other", each).select("sig", "sig2", "at", "group", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("block"), alone)
        found = [linked(units, "all")]
    else:
        blocks = placed.select("sig", "sig2", "at", "group", F.col("own").alias("lo"), F.col("own").alias("hi"), F.col("own").alias("block"), alone)
        large = placed.where("blocks > 1")
        pivots = large.where(F.expr(f"pmod(xxhash64('pivot', sig, group), 1073741824) < {PIVOTS} * 1073741824D / many")).withColumn("lo", each)
        pivots = pivots.where("lo <> own").select("sig", "sig2", "at", "group", "lo", F.col("lo").alias("hi"), F.col("lo").alias("block"), alone)
        found = [linked(blocks.union(pivots), "own")]
        units = _apart(large, _pairs(found[0]), each, ws) if not weight.where("blocks > 1").isEmpty() else None
        if units is not None:
            maybe = left_by_maps(units)
            found.append(maybe.where("a is null").select(*[F.lit(None).cast("long").alias(c) for c in _LINKED[:4]], "sets", "tested", "pruned", F.lit(0).cast("long").alias("verified")))
            if not (pairs := maybe.where("a is not null")).isEmpty():
                found.append(linked(_verify_units(pairs, member, ws), "apart"))
    table = reduce(DataFrame.union, found)
    if figures is not None:
        counts = table.where("a is null").agg(F.count("*").alias("units"), F.count_if(F.col("sets") > 8).alias("large_units"), *[F.sum(c).alias(c) for c in _LINKED[4:]])
        figures.update(counts.first().asDict())
    return _pairs(table)


def _verify_units(maybe: DataFrame, member: DataFrame, ws: Workspace) -> DataFrame:
    """Units of about ``VERIFY`` pairs of a group, with both sets of each pair."""
    lots = maybe.groupBy("group").agg(F.ceil(F.count("*") / VERIFY).cast("int").alias("lots"))
    lot = F.pmod(F.xxhash64("a", "a2", "b", "b2"), F.col("lots")).cast("int").alias("lo")
    pairs = maybe.join(bounded_broadcast(ws.table(lots, "lots")), "group")
    side = lambda x: pairs.select("group", lot, F.col(x).alias("sig"), F.col(f"{x}2").alias("sig2"), F.struct(F.col(f"l{x}").alias("sig"), F.col(f"l{x}2").alias("sig2")).alias("label"))
    ends = side("a").union(side("b")).distinct()
    return ends.join(member.select("group", "sig", "sig2", "at"), ["group", "sig", "sig2"]).select("sig", "sig2", "at", "group", "lo", F.col("lo").alias("hi"), F.lit(0).alias("block"), "label")


def _pairs(links: DataFrame) -> DataFrame:
    return links.where("a is not null").select(F.struct(F.col("a").alias("sig"), F.col("a2").alias("sig2")).alias("a"), F.struct(F.col("b").alias("sig"), F.col("b2").alias("sig2")).alias("b"))


def _apart(large: DataFrame, pairs: DataFrame, each: Column, ws: Workspace) -> DataFrame | None:
    """Units in which the sets outside their group's main component meet all of its blocks; None if there are none.

    Sets carry the component they are known to be in, so pairs that hang together already are skipped.
    """
    if not (joined := pairs.count()):
        known = large.withColumn("label", F.struct("sig", "sig2"))
    else:
        roots = components(pairs, joined)
        known = large.join(bounded_broadcast(roots), F.struct("sig", "sig2") == F.col("node"), "left").withColumn("label", F.coalesce("root", F.struct("sig", "sig2"))).drop("node", "root")
    known = ws.table(known, "known")
    main = known.groupBy("group", "label").count().groupBy("group").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most"))
    main = main.where("all > most").select("group", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK_SETS).cast("int").alias("rests"))
    if (main := ws.table(main, "main")).isEmpty():
        return None
    known = known.join(bounded_broadcast(main), "group")
    part = F.pmod(F.xxhash64("sig", F.lit("rest")), F.col("rests")).cast("int")
    # Four bits a shingle of the group's largest set, a power of two: the bitmaps' width.
    bits = F.least(F.lit(16384), F.greatest(F.lit(256), F.pow(F.lit(2), F.ceil(F.log2(4 * F.col("largest"))))))
    out = ["sig", "sig2", "at", "group", "lo", "hi", bits.cast("int").alias("block"), "label"]
    rest = known.where("label <> main").withColumn("lo", part).withColumn("hi", each).select(*out)
    whole = known.withColumn("lo", F.explode(F.expr("sequence(0, rests - 1)"))).withColumn("hi", F.col("own")).select(*out)
    return whole.union(rest)


def _with_links(per: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """``per`` with ``n_links``: the other rows of a row's class and the rows of the classes that it links with."""
    own = per.where("n > 0").groupBy(F.col("class").alias("_class")).agg(F.sum("copies").alias("_own"))
    per = per.join(own, F.col("class") == F.col("_class"), "left").drop("_class")
    more = F.lit(0).cast("long")
    if pairs is not None:
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        far = both.join(own, F.col("b") == F.col("_class")).groupBy(F.col("a").alias("_a")).agg(F.sum("_own").alias("_far"))
        per = per.join(far, F.col("class") == F.col("_a"), "left").drop("_a")
        more = F.coalesce("_far", more)
    return per.withColumn("n_links", F.coalesce(F.col("_own") - 1, F.lit(0)) + more).drop("_own", "_far")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked texts: the one of least doc_id (null last).

    Of rows equal in doc_id and text one stays.  Null texts and texts without words are all kept.  All columns come back,
    whatever their names; an empty table comes back empty.
    """
    found = link_components(docs, k, num, den)
    best = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("best"))
    ws = Workspace(docs.sparkSession, "keep")
    judged = found.join(best, "component", "left")
    gone = (F.col("n_shingles") > 0) & ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th")))
    drop_id, drop_th, mark = (column_name(docs, c) for c in ("drop_id", "drop_th", "mark"))
    drop = judged.where(F.col("best").isNotNull() & gone).select(F.col("doc_id").alias(drop_id), F.col("th").alias(drop_th))
    drop = ws.finish(fewer(drop, found.count()))
    th = F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(bounded_broadcast(drop), docs["doc_id"].cast("long").eqNullSafe(F.col(drop_id)) & (th == F.col(drop_th)), "left_anti")
    again = found.where("copies > 1 and n_shingles > 0")
    if again.isEmpty():
        return kept
    return kept.withColumn(mark, F.when(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")), th)).transform(lambda d: _first_of(d, mark))


def _first_of(df: DataFrame, mark: str) -> DataFrame:
    """One of the rows that are equal in doc_id and text; rows without words all stay."""
    blank = df.where(F.col(mark).isNull())
    return df.where(F.col(mark).isNotNull()).dropDuplicates(["doc_id", mark]).union(blank).drop(mark)
