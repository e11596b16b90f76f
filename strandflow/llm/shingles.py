"""Word shingle sets of whole texts as sorted 64-bit hashes, vectorised over a batch.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D after A-Z were lower-cased.
Its hash is a polynomial over a fixed random byte table; prefix sums give the hashes of
all words of a buffer at once, and multiplying by an inverse power makes a word's hash
independent of its place.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20260217)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes' numbers for a second hash.
BYTE_2 = np.random.default_rng(400).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes hashed at once; longer buffers are cut between words.
SEGMENT = 1 << 18
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + (1 << 16), 2 * len(_powers[0]) if _powers else 0)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b % 2**64, np.uint64))))
            for b in (_BASE, pow(_BASE, -1, 2**64))
        ]
    return _powers[0][:n], _powers[1][:n]


def _words_of(arr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[arr]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(arr) and not space[0]:
        edge = np.concatenate(([0], edge))
    if len(arr) and not space[-1]:
        edge = np.concatenate((edge, [len(arr)]))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    up, down = powers(len(arr))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTE[arr] * up, dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts]), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more at the end)."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths)))
    arr = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    hashes, places, at = [], [], 0
    while at < len(arr):
        stop = min(len(arr), at + SEGMENT)
        while stop < len(arr) and not _SPACE[arr[stop - 1]]:  # cut after white space
            back = np.flatnonzero(_SPACE[arr[at:stop]])
            stop = at + int(back[-1]) + 1 if len(back) else min(len(arr), stop + SEGMENT)
        h, s = _words_of(arr[at:stop])
        hashes.append(h)
        places.append(s + at)
        at = stop
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    return words, np.searchsorted(place, begin)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    With fewer words than ``k`` the whole sequence is the one shingle; without words the set is empty.
    """
    words, at = word_hashes(texts)
    if len(words) >= k:
        rows = len(words) - k + 1
        joined = np.zeros(rows, np.uint64)
        for j in range(k):
            joined += words[j : j + rows] * _ODD[j]
        joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(joined[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            s = (words[a:b] * _ODD[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(s + _ODD[k - (b - a)]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
