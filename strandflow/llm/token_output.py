"""Token-ID output: whole texts to wavelet-matrix shard files, and back.

Documents are range-partitioned and sorted by id; each task encodes its range and writes
shard files of about ``shard_tokens`` ids into the shared folder under names of its own attempt.
The written manifest names the files of the attempts that ended well, so lost executors and
repeated tasks leave at most unused files.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, decoded, released
from .ranking import running
from .shingles import BYTE, BYTE_2, mix
from .wavelet import WaveletMatrix, write
from .workspace import Workspace

#: Words that the younger half of a worker's memo may hold: about 30 bytes each.
MEMO = 1_000_000
#: Bytes of texts whose chunks are numbered together.
LOT_BYTES = 4_000_000
#: Ids of one shard file: about 16 MB for 16-bit ids.
SHARD_TOKENS = 1 << 23
_TAIL = ".,!?;:"
_PLAIN = np.array([chr(c).isalnum() if c < 128 else False for c in range(256)])


class Memo:
    """Ids of words in packed arrays: two hashes of each word, ascending in the first, and where its ids stand."""

    def __init__(self, kind: type):
        self.keys, self.keys2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, kind)

    def look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the words are here, their places)."""
        order = np.argsort(a)  # neighbours are looked up one after the other
        at = np.empty(len(a), np.int64)
        at[order] = np.minimum(np.searchsorted(self.keys, a[order]), max(0, len(self.keys) - 1))
        known = (self.keys[at] == a) & (self.keys2[at] == b) if len(self.keys) else np.zeros(len(a), bool)
        return known, at[known]

    def add(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        start = len(self.ids) + np.cumsum(lengths) - lengths
        keys = np.concatenate((self.keys, a))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.keys2 = np.concatenate((self.keys2, b))[order]
        self.start = np.concatenate((self.start, start.astype(np.int32)))[order]
        self.length = np.concatenate((self.length, lengths.astype(np.int32)))[order]
        self.ids = np.concatenate((self.ids, ids))


def _hashes(parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word of a large string array."""
    at = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    place = np.arange(len(data)) - np.repeat(at[:-1], size)
    out = []
    for base, table in ((0x9E3779B97F4A7C15, BYTE), (0xD1342543DE82EF95, BYTE_2)):
        power = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max(initial=0)), base, np.uint64))))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * power[place], dtype=np.uint64)))
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64) * np.uint64(base)))
    return out[0], out[1]


class WordEncoder:
    """Encodes whole texts with a tokenizer whose pre-tokens never span white space.

    For such a tokenizer the ids of a text are those of its white-space-separated chunks in order, so each
    distinct chunk is encoded once by the library and remembered.  A run of punctuation after a letter or digit is a
    pre-token of its own, and case is folded by the tokenizer, so ``Word``, ``word`` and ``word,`` share one encoding.
    Many chunks go to the library as one text.  Those of plain letters are one word each, whose last id is known as such; others get
    a mark between them.
    Arrow splits the texts and numbers their distinct chunks, so a chunk is looked up once a lot of texts.  The memo has two
    halves of bounded size, of which the older is dropped; a word is known in it by 128 bits of hash.  Malformed UTF-8 reads as U+FFFD.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # A character whose one id ends a word, if there is any: between parts it tells where each begins.
        suffix = json.loads(self._tokenizer.to_str())["model"].get("end_of_word_suffix")
        self._mark = self._mark_id = None
        for mark in "\u00b6\u00a7\u00a4\u00ac|~" if suffix else "":
            ids = self._tokenizer.encode(mark, add_special_tokens=False).ids
            if len(ids) == 1 and self._tokenizer.id_to_token(ids[0]).endswith(suffix):
                self._mark, self._mark_id = mark.encode(), ids[0]
                break
        #: Which ids end a word, and a pattern of chunks that are one word: of letters that neither end one nor go.
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        self._letters = None
        if suffix:
            self._ends[[n for token, n in self._tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
            chars = [c for c in map(chr, range(0x61, 0x250)) if c.isalpha() and c.lower() == c]
            found = self._tokenizer.encode_batch_fast([f"{c}a{c}{c}" for c in chars], add_special_tokens=False)
            good = [c for c, e in zip(chars, found, strict=True) if e.ids and self._ends[e.ids].nonzero()[0].tolist() == [len(e.ids) - 1]]
            self._letters = f"^[{''.join(good)}]+$" if good else None
        #: 16 bits an id where all fit.
        self.kind = np.uint16 if self._tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self._new, self._old = Memo(self.kind), Memo(self.kind)

    def _encode(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, lengths, ids) of parts by the library, a thousand at once; those that hold the mark or a special token alone."""
        order, lengths, found = [], [], []

        def joined(which: np.ndarray, sep: bytes, last: np.ndarray, skip: int | None) -> np.ndarray:
            """Encodes the parts with ``sep`` after each; returns those of lots whose number of last ids is not that of their parts."""
            texts, left = parts.take(pa.array(which)).view(pa.large_binary()).to_pylist(), []
            for i in range(0, len(which), 50_000):
                lots = [slice(j, min(j + 1000, i + 50_000, len(which))) for j in range(i, min(i + 50_000, len(which)), 1000)]
                for lot, e in zip(lots, self._tokenizer.encode_batch_fast([decoded(sep.join(texts[lot]) + sep) for lot in lots], add_special_tokens=False), strict=True):
                    ids = np.array(e.ids, np.uint32)
                    ends = np.flatnonzero(last[ids])
                    if len(ends) != lot.stop - lot.start or ends[-1] != len(ids) - 1:
                        left.append(which[lot])
                        continue
                    order.append(which[lot])
                    lengths.append(np.diff(ends, prepend=-1) - (skip is not None))
                    found.append((ids if skip is None else ids[ids != skip]).astype(self.kind))
            return np.concatenate(left) if left else which[:0]

        rest = np.arange(len(parts))
        if self._letters:
            plain = pc.match_substring_regex(parts, self._letters).to_numpy(zero_copy_only=False)
            rest = np.concatenate((rest[~plain], joined(rest[plain], b" ", self._ends, None)))
        if self._mark is not None and len(rest):
            some = parts.take(pa.array(rest)).view(pa.large_binary())
            apart = pc.or_(pc.match_substring(some, self._mark), pc.match_substring(some, b"<|")).to_numpy(zero_copy_only=False)
            last = np.zeros(len(self._ends), bool)
            last[self._mark_id] = True
            rest = np.concatenate((rest[apart], joined(rest[~apart], b" %b " % self._mark, last, self._mark_id)))
        for n, e in zip(rest.tolist(), self._tokenizer.encode_batch_fast([decoded(t) for t in parts.take(pa.array(rest)).view(pa.large_binary()).to_pylist()], add_special_tokens=False), strict=True):
            order.append(np.array([n]))
            lengths.append(np.array([len(e.ids)]))
            found.append(np.array(e.ids, self.kind))
        none = np.zeros(0, np.int64)
        return np.concatenate(order or [none]), np.concatenate(lengths or [none]), np.concatenate(found or [none.astype(self.kind)])

    def _ids_of(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length): the ids of distinct parts one after the other and where each part's stand, from the memo or the library."""
        if len(self._new.keys) > MEMO:
            self._old, self._new = self._new, Memo(self.kind)
        a, b = _hashes(parts)
        start, length = np.full(len(parts), -1, np.int64), np.zeros(len(parts), np.int64)
        base, new = 0, self._new
        stores = [new.ids, self._old.ids]
        for memo in (new, self._old):
            lost = np.flatnonzero(start < 0)
            known, at = memo.look_up(a[lost], b[lost])
            start[lost[known]], length[lost[known]] = base + memo.start[at], memo.length[at]
            base += len(memo.ids)
        lost = np.flatnonzero(start < 0)
        if len(lost):
            order, lengths, ids = self._encode(parts.take(pa.array(lost)))
            lost = lost[order]
            start[lost], length[lost] = base + np.cumsum(lengths) - lengths, lengths
            new.add(a[lost], b[lost], lengths, ids)
            stores.append(ids)
        ends = np.cumsum(length)
        at = np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)
        return np.concatenate(stores)[at], ends - length, length

    @staticmethod
    def _split(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
        """The chunks without their punctuation at the end, and that; where it is no pre-token of its own, the whole chunk and nothing."""
        cut = pc.ascii_rtrim(chunks, characters=_TAIL)
        whole, short = pc.binary_length(chunks).to_numpy(), pc.binary_length(cut).to_numpy()
        begin = np.frombuffer(cut.buffers()[1], np.int64, len(cut) + 1, 8 * cut.offset)
        data = np.frombuffer(cut.buffers()[2] or b"", np.uint8)
        maybe = np.flatnonzero((short < whole) & (short > 0))
        last = data[begin[maybe + 1] - 1]
        plain = _PLAIN[last]
        for n in np.flatnonzero(last >= 0x80).tolist():
            char = decoded(cut[int(maybe[n])].as_buffer().to_pybytes())[-1]
            plain[n] = char < "\u0250" and unicodedata.category(char.lower()[-1])[0] in "LN"
        good = np.zeros(len(chunks), bool)
        good[maybe[plain]] = True
        good &= ~pc.match_substring(chunks, "<|").to_numpy(zero_copy_only=False)
        size = np.where(good, whole - short, 0)
        begin = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, 8 * chunks.offset)
        data = np.frombuffer(chunks.buffers()[2] or b"", np.uint8)
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        at = np.repeat(begin[1:] - ends[1:], size) + np.arange(ends[-1])
        tails = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at].tobytes()))
        return pc.if_else(pa.array(good), cut, chunks), tails

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, where each text's begin and the last one's end).

        The tokenizer folds case itself; folding A-Z first makes fewer distinct chunks.  It changes nothing unless a combining mark
        (lead bytes CC and CD) makes one character of a letter and itself, or a special token is spelt in the text.
        """
        folded = [t if b"\xcc" in t or b"\xcd" in t or b"<|" in t else t.lower() for t in texts]
        split = pc.ascii_split_whitespace(pa.array(folded, pa.large_binary()).view(pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        base, tail = self._split(numbered.dictionary)
        parts = pa.concat_arrays([base, tail]).dictionary_encode()
        ids, start, lengths = self._ids_of(parts.dictionary)
        two = parts.indices.to_numpy().reshape(2, -1)  # a chunk's parts
        which = two[:, numbered.indices.to_numpy()].T.ravel()
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths[which])))
        small = np.int32 if ends[-1] < 2**31 else np.int64  # half the memory unless one text is huge
        shift = start[which] - ends[:-1]
        at = np.repeat(shift.astype(small), lengths[which])
        at += np.arange(len(at), dtype=small)
        return ids[at], ends[2 * split.offsets.to_numpy()]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordEncoder(path)


def _write(path: str, folder: str, end: int, shard_tokens: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        kind = encoder(path).kind if end < 1 << 16 else np.uint32
        buffer = np.empty(0, kind)
        docs: list[int | None] = []
        lengths: list[int] = []
        made: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal held
            name = f"{root}/{part:06d}-{len(made):06d}-{uuid.uuid4().hex}.wvm"
            with store.open_output_stream(name) as out:
                write(out, buffer[:held], docs, np.array(lengths, np.int64))
            made.append((part, len(made), name, held, len(docs)))
            docs.clear()
            lengths.clear()
            held = 0

        for batch, texts in batches(it, "text", LOT_BYTES):
            ids, edges = encoder(path).encode(texts)
            for n, (doc, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                size = b - a + 1
                if held and held + size > shard_tokens:
                    flush()
                if held + size > len(buffer):
                    # As large as the rest of the lot makes it, a whole shard at most unless one document is longer.
                    rest = max(held + size, min(shard_tokens, 2 * (held + len(ids) - a + len(texts) - n)))
                    buffer = np.concatenate((buffer[:held], np.empty(rest - held, kind)))
                buffer[held : held + size - 1] = ids[a:b]
                buffer[held + size - 1] = end
                docs.append(doc)
                lengths.append(size)
                held += size
        if docs:
            flush()
        if made:
            yield pa.record_batch([pa.array(x) for x in zip(*made, strict=True)], names=["part", "seq", "path", "tokens", "docs"])

    return released(run)


def _read(folder: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                matrix = _open(folder, path)
                ids = matrix.decode()
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch([pa.array(matrix.doc_ids, pa.int64()), pa.array(starts + base), pa.array(matrix.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return released(run)


def _open(folder: str, path: str) -> WaveletMatrix:
    store, _ = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(path) as f:
        return WaveletMatrix(f.read())


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shard files; returns the lazy manifest (part, seq, path, tokens, docs).

    Texts are encoded whole (null: empty), each followed by the id ``end``; documents stand in ascending doc_id
    order over (part, seq), null ids first, rows of equal id in order of their text's hash.  ``folder`` is
    a URI that pyarrow can write and all executors share.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))  # so that very many rows of one id, or of none, are dealt out too
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    return ordered.mapInArrow(_write(tokenizer, folder, end, shard_tokens), "part long, seq long, path string, tokens long, docs long")


def _placed(manifest: DataFrame) -> DataFrame:
    """(path, base): each file with the number of ids before it; a partition a file."""
    based = running(manifest, [], "part", ["seq"], F.col("tokens"), "base")
    return based.select("path", "base").repartition(max(1, manifest.count()), "path")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files of a written manifest."""
    return _placed(manifest).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def find_tokens(manifest: DataFrame, folder: str, tokens: list[int], most: int = 10) -> DataFrame:
    """(token, path, n, places): each token's count in each shard file, and its first ``most`` places among all ids.

    Answered by rank and select on the compressed files, without decoding them; files without the token give no row.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                matrix = _open(folder, path)
                rows = [(t, path, n, [base + matrix.occurrence(t, k) for k in range(min(n, most))]) for t in dict.fromkeys(tokens) if (n := matrix.count(t))]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)], names=["token", "path", "n", "places"])

    return _placed(manifest).mapInArrow(released(run), "token long, path string, n long, places array<long>")


def tokens_at(manifest: DataFrame, folder: str, places: DataFrame) -> DataFrame:
    """(place, token) of a table ``place`` of places among all ids, by access on the compressed files; places beyond the end give no row."""
    files = running(manifest, [], "part", ["seq"], F.col("tokens"), "base").select("path", "base", "tokens")
    asked = places.select(F.col("place").cast("long").alias("place")).join(F.broadcast(files) if manifest.count() <= 100_000 else files, F.expr("place >= base and place < base + tokens"))

    def run(table: pa.Table) -> pa.Table:
        matrix = _open(folder, table.column("path")[0].as_py())
        at = table.column("place").to_pylist()
        return pa.table({"place": pa.array(at, pa.int64()), "token": pa.array([matrix.access(p - b) for p, b in zip(at, table.column("base").to_pylist(), strict=True)], pa.int64())})

    return asked.groupBy("path").applyInArrow(run, "place long, token long")


def token_index(docs: DataFrame, tokenizer: str, end: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes ``docs`` as shard files in the shared folder, reads them back, and returns what ``read_tokens`` finds.

    Null or empty texts have the one id ``end``; an empty table gives an empty result.  The files go once they were read:
    use ``write_tokens`` to keep them.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    folder = f"{ws.path}/shards"
    manifest = ws.table(write_tokens(docs, tokenizer, folder, end, shard_tokens), "manifest")
    return ws.finish(read_tokens(manifest, folder))
