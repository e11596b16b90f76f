"""Benchmark decontamination: pigeonhole edit matching.

Texts and test items are compared as lower-cased words joined by single spaces.  An item may differ
by ``rate`` of its length in edits; cut into one piece more than that, an item with so few edits has a piece
that stands unchanged.  One Aho-Corasick pass over each whole text finds all pieces, and Myers'
bit-parallel algorithm gives the least edit distance of the item around each hit.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, decoded, released
from .workspace import Workspace, bounded_broadcast, column_name

WORD = re.compile(r"[^\W_]+")
#: Edits allowed for each character of an item.
RATE = 0.06
#: Characters of items in one automaton: the query set is applied in blocks of this size.
BLOCK_CHARS = 1_000_000


def normal(text: str) -> str:
    """Lower-cased words, each with a space before and after."""
    return " " + "".join(w + " " for w in WORD.findall(text.lower()))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(place, text) of ``edits + 1`` pieces of near equal length that make up the item."""
    cut = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


class Myers:
    """Bit-parallel edit distance of one pattern against substrings of a text."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(distance, end) of the closest substring; the first end if several are as close."""
        full, top = (1 << self.m) - 1, 1 << self.m - 1
        plus, minus, score = full, 0, self.m
        least, where, get = self.m, 0, self.masks.get
        for j, c in enumerate(text, 1):
            eq = get(c, 0)
            x = ((eq & plus) + plus ^ plus) | eq | minus
            up = minus | ~(x | plus) & full
            down = plus & x
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1 & full, down << 1 & full
            step = eq | minus
            plus, minus = (down | ~(step | up)) & full, up & step
            if score < least:
                least, where = score, j
        return least, where


class Matcher:
    """All items of a block against one text."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self.items = items
        self.edits = [int(rate * len(i)) for i in items]
        self.myers = [Myers(i) for i in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for n, (item, e) in enumerate(zip(items, self.edits, strict=True)):
            for at, p in pieces(item, e):
                places.setdefault(p, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for p, where in places.items():
            self.automaton.add_word(p, (len(p), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """Item number -> least distance, of the items that the normalised text contains."""
        found: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for item, at in where:
                if found.get(item) == 0:
                    continue
                start = end + 1 - n - at
                if start in tried.setdefault(item, set()):
                    continue
                tried[item].add(start)
                e, m = self.edits[item], len(self.items[item])
                if text.startswith(self.items[item], max(start, 0)):
                    found[item] = 0
                    continue
                # A match with this piece unshifted by more than e edits lies in this stretch.
                least, _ = self.myers[item].best(text[max(0, start - e) : start + m + e])
                if least <= e and least < found.get(item, m):
                    found[item] = least
        return found


_last: dict[str, Matcher] = {}


def matcher_of(name: str, items: list[str], rate: float) -> Matcher:
    """The matcher of a block, made once a worker; the block before it is let go."""
    if name not in _last:
        _last.clear()
        _last[name] = Matcher(items, rate)
    return _last[name]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, th, item_id, distance): the test items that each document's whole text contains.

    ``distance`` is the least edit distance of the normalised item to a stretch of the normalised text, at most
    ``rate`` of the item's length; ``th`` is the text's xxhash64.  Items equal after normalising all
    match; items without words match nothing, and so do null or empty texts and items.  Rows of null ids take part.
    Repeated documents and items give their rows each.  Empty tables give an empty result.  Other
    columns are ignored, whatever their names.  Malformed UTF-8 reads as U+FFFD, which is no word.  The items are a query set: the driver reads them in
    blocks of ``BLOCK_CHARS`` characters and applies one block after the other.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = None
    block: dict[str, list[int | None]] = {}
    held = 0
    for item_id, text in items.toLocalIterator():
        item = normal(text)
        if item == " ":
            continue
        held += 0 if item in block else len(item)
        block.setdefault(item, []).append(item_id)
        if held >= BLOCK_CHARS:
            part = _apply(rows, block, rate)
            found = part if found is None else found.union(part)
            block, held = {}, 0
    if block or found is None:
        part = _apply(rows, block, rate)
        found = part if found is None else found.union(part)
    return found


def _apply(rows: DataFrame, block: dict[str, list[int | None]], rate: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(list(block.items()))  # at most BLOCK_CHARS and one item
    name = uuid.uuid4().hex

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ids = [t for t, _ in shared.value], [i for _, i in shared.value]
        matcher = matcher_of(name, texts, rate) if texts else None
        for batch, docs in batches(it, "text"):
            out: list[tuple] = []
            if matcher:
                for doc, th, text in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), docs, strict=True):
                    out += [(doc, th, i, d) for n, d in matcher.find(normal(decoded(text))).items() for i in ids[n]]
            if out:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "th", "item_id", "distance"])

    return rows.mapInArrow(released(run), "doc_id long, th long, item_id long, distance long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``docs`` without the documents that contain a test item; all columns come back, whatever their names.

    Rows of equal id and text go or stay together, null ids among them; null and empty texts stay; an empty table of
    documents or items leaves the documents as they are.
    """
    ws = Workspace(docs.sparkSession, "leaks")
    bad_id, bad_th = column_name(docs, "bad_id"), column_name(docs, "bad_th")
    bad = ws.finish(find_leaks(docs, benchmark, rate).select(F.col("doc_id").alias(bad_id), F.col("th").alias(bad_th)).distinct())
    return docs.join(bounded_broadcast(bad), docs["doc_id"].cast("long").eqNullSafe(F.col(bad_id)) & (F.xxhash64(docs["text"].cast("string")) == F.col(bad_th)), "left_anti")
