"""Signature trees: exact set-similarity links by dual traversal.

Every set has a bitmap with one bit for each token hash; a node holds the OR of its
children's bitmaps, its range of set sizes, and the largest excess (set size minus bits
set, which is what collisions can hide).  For any two members of nodes A and B the
overlap is at most popcount(A & B) + min(excess); node pairs whose bound or size ranges
rule the threshold out are pruned together with everything below them.
Where only connectivity is wanted (``link``), pairs of nodes that already lie wholly in one component are
skipped as well: a clique of near copies costs about one verification a member.  ``pairs`` verifies
all that the bounds leave.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """A set's signature: a bit for each token hash."""
    out = np.zeros(bits // 64, np.uint64)
    bit = (s * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - (bits.bit_length() - 1))
    np.bitwise_or.at(out, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def levels(maps: np.ndarray, sizes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bitmaps, least size, largest size, largest excess) of the nodes of each level, leaves first."""
    out = [(maps, sizes, sizes, sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64))]
    while len(out[-1][0]) > 1:
        m, lo, hi, ex = out[-1]
        cut = np.arange(0, len(m), FANOUT)
        out.append((np.bitwise_or.reduceat(m, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))
    return out


def possible(level: tuple, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of a level's nodes may hold a link: by sizes, then by the largest overlap that the bitmaps allow."""
    maps, lo, hi, ex = level
    good = (den * hi[a] >= num * lo[b]) & (den * hi[b] >= num * lo[a])
    some, lot = np.flatnonzero(good), max(256, (1 << 20) // max(1, maps.shape[1]))
    for at in range(0, len(some), lot):
        n = some[at : at + lot]
        x, y = a[n], b[n]
        most = np.bitwise_count(maps[x] & maps[y]).sum(axis=1, dtype=np.int64) + np.minimum(ex[x], ex[y])
        good[n] = (num + den) * np.minimum(most, np.minimum(hi[x], hi[y])) >= num * (lo[x] + lo[y])
    return good


def candidates(maps: np.ndarray, sizes: np.ndarray, known: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int, int]:
    """(pairs, tested, pruned): the pairs of sets that hang together in no known component and that the tree's bounds leave.

    All pairs of nodes of a level are tested at once; nothing is merged on the way.
    """
    order = np.lexsort((sizes, known))  # members of a component become neighbours
    tree, label = levels(maps[order], sizes[order]), known[order]
    ones = [label]
    for _ in tree[1:]:
        cut = np.arange(0, len(ones[-1]), FANOUT)
        low, high = np.minimum.reduceat(ones[-1], cut), np.maximum.reduceat(ones[-1], cut)
        ones.append(np.where((low == high) & (low >= 0), low, -1))
    a, b, tested, pruned = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0
    for depth in range(len(tree) - 2, -1, -1):
        below, n = [], len(tree[depth][0])
        for at in range(0, len(a), 20_000):
            step = np.arange(FANOUT)
            x = np.repeat(a[at : at + 20_000, None] * FANOUT + step, FANOUT, axis=1).ravel()
            y = np.tile(b[at : at + 20_000, None] * FANOUT + step, (1, FANOUT)).ravel()
            real = (x < n) & (y < n) & ((x < y) if depth == 0 else (x <= y))
            x, y = x[real], y[real]
            apart = (ones[depth][x] != ones[depth][y]) | (ones[depth][x] < 0)
            x, y = x[apart], y[apart]
            keep = possible(tree[depth], x, y, num, den)
            tested, pruned = tested + len(keep), pruned + len(keep) - int(keep.sum())
            below.append(np.stack((x[keep], y[keep])))
        a, b = np.concatenate(below, axis=1)
    if len(tree) == 1:
        a = b = np.zeros(0, np.int64)
    return np.stack((order[a], order[b]), axis=1), tested, pruned


class SignatureTree:
    """Tree over distinct sorted uint64 sets; ``num``/``den`` is the Jaccard threshold."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        first = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        order = np.lexsort((sizes, first))  # near copies share their least token, so they become neighbours
        self.order, self.sets, self.num, self.den = order, [sets[i] for i in order], num, den
        bits = 256
        while bits < 16384 and bits < 4 * (np.median(sizes) if len(sizes) else 1):
            bits *= 2
        maps = np.stack([bitmap(s, bits) for s in self.sets]) if len(sets) else np.zeros((0, bits // 64), np.uint64)
        self.levels = levels(maps, sizes[order])
        self.parent = list(range(len(sets)))
        self.whole = [np.zeros(len(x[0]), bool) for x in self.levels]
        self.whole[0][:] = True
        self.verified = self.tested = self.pruned = 0

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def _children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))

    def _component(self, level: int, node: int) -> int:
        """The root that all members share, or -1."""
        if self.whole[level][node]:
            return self.find(node * FANOUT**level)
        roots = {self._component(level - 1, c) for c in self._children(level, node)}
        if len(roots) == 1 and -1 not in roots:
            self.whole[level][node] = True
            return roots.pop()
        return -1

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return possible(self.levels[level], a, b, self.num, self.den)

    def _linked(self, i: int, j: int) -> bool:
        self.verified += 1
        both = np.concatenate((self.sets[i], self.sets[j]))
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        return self.den * shared >= self.num * (len(both) - shared)

    def pairs(self, side: np.ndarray | None = None) -> list[tuple[int, int]]:
        """All linked pairs (indices into the given sets), each once; ``side`` as in ``link``."""
        found: list[tuple[int, int]] = []
        self.link(side, found)
        return [(int(self.order[i]), int(self.order[j])) for i, j in found]

    def link(self, side: np.ndarray | None = None, found: list[tuple[int, int]] | None = None, known: np.ndarray | None = None) -> list[int]:
        """Roots (indices into the given sets) of all sets; ``side`` restricts links to pairs of unequal side.

        With ``side`` the trees of two blocks are traversed against each other: pairs within a block are
        left to the block's own traversal.  With ``found`` no pair is skipped and linked places are added to it.
        Sets of equal ``known`` hang together from the start.
        """
        if known is not None:
            first: dict[int, int] = {}
            for place, label in enumerate(known[self.order].tolist()):
                self.parent[place] = first.setdefault(label, place)
        where = None if side is None else side[self.order]
        top = len(self.levels) - 1
        stack = [(top, 0, 0)] if self.sets else []
        while stack:
            level, i, j = stack.pop()
            if found is None:
                root = self._component(level, i)
                if root >= 0 and root == self._component(level, j) and (level or i != j):
                    continue
            if level == 0:
                if i != j and (where is None or where[i] != where[j]) and self._linked(i, j):
                    a, b = self.find(i), self.find(j)
                    self.parent[max(a, b)] = min(a, b)
                    if found is not None:
                        found.append((i, j))
                continue
            left, right = self._children(level, i), self._children(level, j)
            if i == j:
                pairs = [(x, y) for x in left for y in right if x < y or (x == y and level > 1)]
            else:
                pairs = [(x, y) for x in left for y in right]
            if not pairs:
                continue
            a, b = np.array(pairs).T
            keep = self._possible(level - 1, a, b)
            self.tested += len(keep)
            self.pruned += len(keep) - int(keep.sum())
            # Within a node first, and neighbours before distant nodes: what merges early prunes later.
            rest = sorted(((x, y) for (x, y), k in zip(pairs, keep.tolist(), strict=True) if k), key=lambda p: (p[0] != p[1], p[1] - p[0]), reverse=True)
            stack += [(level - 1, x, y) for x, y in rest]
        out = [0] * len(self.sets)
        for place, original in enumerate(self.order.tolist()):
            out[original] = int(self.order[self.find(place)])
        return out
