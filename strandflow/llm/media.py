"""Media columns: signature sniffing.

An Aho-Corasick automaton finds magic bytes at any place of a blob; a validator of the
format then confirms structure and gives the true length.  What stands at the start decides the
blob's type and corrects a declared one; confirmed media further in are carved out, those inside documents and archives too.
End marks are looked up in lists made once a blob, so a blob full of magic bytes costs no more than its length.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import batches, released
from .workspace import Workspace

#: The magic bytes of each format.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n",),
    "image/jpeg": (b"\xff\xd8\xff",),
    "image/gif": (b"GIF87a", b"GIF89a"),
    "image/bmp": (b"BM",),
    "application/pdf": (b"%PDF-",),
    "application/zip": (b"PK\x03\x04",),
    "application/gzip": (b"\x1f\x8b\x08",),
    "audio/flac": (b"fLaC",),
    "riff": (b"RIFF",),
}
RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}


#: Kinds that hold other media as they are.
HOLDERS = {"application/pdf", "application/zip"}


class Blob:
    """A blob's bytes, with places found once and remembered."""

    def __init__(self, data: bytes):
        self.data = data
        self._places: dict[bytes, list[int]] = {}
        self._archives: dict[int, int] | None = None

    def places(self, mark: bytes) -> list[int]:
        if mark not in self._places:
            self._places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._places[mark]

    def first(self, mark: bytes, start: int, stop: int | None = None) -> int:
        """The first place of ``mark`` from ``start`` on and before ``stop``, or -1."""
        found = self.places(mark)
        n = bisect_left(found, start)
        return found[n] if n < len(found) and (stop is None or found[n] < stop) else -1

    def last(self, mark: bytes, start: int, stop: int) -> int:
        found = self.places(mark)
        n = bisect_left(found, stop) - 1
        return found[n] if n >= 0 and found[n] >= start else -1

    def archives(self) -> dict[int, int]:
        """Where each archive begins, by its own end record, and where it ends."""
        if self._archives is None:
            self._archives = {}
            for end in self.places(b"PK\x05\x06"):
                if end <= len(self.data) - 22:
                    size, offset, comment = struct.unpack_from("<IIH", self.data, end + 12)
                    if end + 22 + comment <= len(self.data):
                        self._archives.setdefault(end - size - offset, end + 22 + comment)
        return self._archives


def _png(b: Blob, at: int) -> int:
    d = b.data
    p = at + 8
    while p + 12 <= len(d):
        (n,) = struct.unpack_from(">I", d, p)
        kind = d[p + 4 : p + 8]
        if p + 12 + n > len(d) or (p == at + 8 and (kind != b"IHDR" or n != 13)):
            return 0
        if zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(b: Blob, at: int) -> int:
    d = b.data
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        marker = d[p + 1]
        (n,) = struct.unpack_from(">H", d, p + 2)
        if n < 2 or p + 2 + n > len(d):
            return 0
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data up to the end marker
            end = b.first(b"\xff\xd9", p)
            return end + 2 - at if end >= 0 else 0
    return 0


def _gif(b: Blob, at: int) -> int:
    d = b.data
    if at + 13 > len(d):
        return 0
    flags = d[at + 10]
    p = at + 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += d[p] + 1
        return p + 1

    seen = False
    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at if seen else 0
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            local = d[p + 9]
            p = blocks(p + 11 + (3 << (local & 7) + 1 if local & 0x80 else 0))
            seen = True
        else:
            return 0
    return 0


def _bmp(b: Blob, at: int) -> int:
    d = b.data
    if at + 54 > len(d):
        return 0
    size, reserved, offset, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", d, at + 2)
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    good = reserved == 0 and head >= 40 and offset >= 14 + head and planes == 1 and depth in (1, 4, 8, 16, 24, 32) and width > 0 and size >= offset + rows
    return size if good and at + size <= len(d) else 0


def _pdf(b: Blob, at: int) -> int:
    """Up to the last end mark before the next document: updates append further ones."""
    following = b.first(b"%PDF-", at + 5)
    stop = following if following >= 0 else len(b.data)
    end = b.last(b"%%EOF", at, stop)
    return end + 5 - at if end >= 0 and b.data[at + 5 : at + 6].isdigit() and b.first(b"startxref", at, end) >= 0 else 0


def _zip(b: Blob, at: int) -> int:
    return max(0, b.archives().get(at, 0) - at)


def _gzip(b: Blob, at: int) -> int:
    inflate = zlib.decompressobj(31)
    try:
        view = memoryview(b.data)[at:]
        for i in range(0, len(view), 65536):
            inflate.decompress(view[i : i + 65536])
            if inflate.eof:
                return min(len(view), i + 65536) - len(inflate.unused_data)
    except zlib.error:
        pass
    return 0


def _flac(b: Blob, at: int) -> int:
    """Through the metadata blocks to a frame; frames give no length, so they reach to the next stream or the end."""
    d, p, last = b.data, at + 4, False
    if d[p + 1 : p + 4] != b"\x00\x00\x22" or not p + 38 <= len(d) or d[p] & 0x7F:
        return 0
    while not last:
        if p + 4 > len(d) or d[p] & 0x7F == 0x7F:
            return 0
        last, p = bool(d[p] & 0x80), p + 4 + int.from_bytes(d[p + 1 : p + 4], "big")
    if p > len(d) or (p < len(d) and d[p : p + 2] not in (b"\xff\xf8", b"\xff\xf9")):
        return p - at if p <= len(d) else 0
    following = b.first(b"fLaC\x00\x00\x00\x22", p)
    return (following if following >= 0 else len(d)) - at


def _riff(b: Blob, at: int) -> int:
    d = b.data
    if at + 12 > len(d) or d[at + 8 : at + 12] not in RIFF_KINDS:
        return 0
    (size,) = struct.unpack_from("<I", d, at + 4)
    end = at + 8 + size
    if end > len(d):
        return 0
    p = at + 12
    while p + 8 <= end:  # chunks fill the file exactly
        (n,) = struct.unpack_from("<I", d, p + 4)
        p += 8 + n + (n & 1)
    return end - at if p == end else 0


VALIDATORS: dict[str, Callable[[Blob, int], int]] = {
    "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/flac": _flac, "riff": _riff,
}


@lru_cache(1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for m in magics:
            found.add_word(m.decode("latin-1"), (kind, len(m)))
    found.make_automaton()
    return found


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of all confirmed media, in order; those inside another only if it is a document or an archive.

    A stream of frames without a length ends where the next confirmed medium begins.
    """
    found, clear, open_end = [], 0, False
    blob = Blob(data)
    for end, (kind, n) in _automaton().iter(data.decode("latin-1")):
        at = end + 1 - n
        if (at >= clear or open_end) and (length := VALIDATORS[kind](blob, at)):
            if open_end and at < clear:
                found[-1] = (*found[-1][:2], at - found[-1][1])
            found.append((RIFF_KINDS[data[at + 8 : at + 12]] if kind == "riff" else kind, at, length))
            open_end = kind == "audio/flac"
            if kind not in HOLDERS:
                clear = at + length
    return found


def wav(samples: bytes, rate: int = 16_000) -> bytes:
    """8-bit mono PCM in a RIFF container; ``samples`` has an even length."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def wav_samples(data: bytes) -> bytes:
    """The samples of a container made by ``wav``, found through its chunks."""
    p = 12
    while data[p : p + 4] != b"data":
        p += 8 + struct.unpack_from("<I", data, p + 4)[0]
    return data[p + 8 : p + 8 + struct.unpack_from("<I", data, p + 4)[0]]


def sniff_column(df: DataFrame, key: str, blob: str, declared: str) -> DataFrame:
    """(key, type, corrected, length, carved) of a binary column with a column of declared types.

    ``type`` is what the start holds (``application/octet-stream`` if nothing is confirmed there),
    ``corrected`` tells that it differs from the declared type, ``carved`` lists (type, offset, bytes) of
    media further in.  A null blob counts as empty; a null declared type is corrected unless nothing was found.  Null and repeated
    keys keep their rows; an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, blobs in batches(it, "b", 16_000_000):
            found = [sniff(b) for b in blobs]
            kind = [f[0][0] if f and f[0][1] == 0 else "application/octet-stream" for f in found]
            length = [f[0][2] if f and f[0][1] == 0 else len(b) for f, b in zip(found, blobs, strict=True)]
            carved = [[{"type": t, "offset": o, "bytes": b[o : o + n]} for t, o, n in f if o] for f, b in zip(found, blobs, strict=True)]
            off = [k != d and not (d is None and k == "application/octet-stream") for k, d in zip(kind, batch.column("d").to_pylist(), strict=True)]
            yield pa.record_batch(
                [batch.column("k"), pa.array(kind), pa.array(off), pa.array(length, pa.int64()), pa.array(carved, pa.list_(pa.struct({"type": pa.string(), "offset": pa.int64(), "bytes": pa.binary()})))],
                names=["k", "type", "corrected", "length", "carved"],
            )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(blob).alias("b"), F.col(declared).cast("string").alias("d"))
    out = rows.mapInArrow(released(run), f"k {kind}, type string, corrected boolean, length long, carved array<struct<type:string,offset:long,bytes:binary>>")
    return out.withColumnRenamed("k", key)


def _store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in batches(it, "text", 8_000_000):
        media = [wav(t + bytes(-len(t) % 64 or (0 if t else 64))) for t in texts]
        yield pa.record_batch([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, blobs in batches(it, "media", 8_000_000):
        rows = []
        for data in blobs:
            found = sniff(data)
            kind, _, length = found[0]
            payload = wav_samples(data)
            levels = np.frombuffer(payload, np.uint8)
            rms = float(np.sqrt(np.mean(np.square(levels.astype(np.float32) - 128))))
            inside = ",".join(t for t, o, _ in [*found[1:], *((t, o, n) for t, o, n in sniff(payload))])
            rows.append((
                len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(),
                f"{kind};length={length};rms={rms:.3f};peak={int(levels.max())};carved={inside}",
            ))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", *_DIGEST])


_DIGEST = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_digest(docs: DataFrame) -> DataFrame:
    """Stores every whole text of ``docs`` (doc_id, text) as a media column, reads it back and sniffs it.

    The text's UTF-8 (null: empty) with zeros up to a positive multiple of 64 becomes the 8-bit samples of a WAV
    container, written as a binary column in the shared folder.  From the bytes read back come
    the sniffed type and length, the samples' digests, and a feature string; media whose magic
    bytes and structure lie inside the samples are listed in it.  One row for each row; equal texts give equal values.
    Columns of other names are ignored; an empty table gives an empty result.
    """
    ws = Workspace(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stored = ws.table(rows.mapInArrow(released(_store), "doc_id long, n_bytes long, media binary"), "media")
    return ws.finish(stored.mapInArrow(released(_features), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"))
