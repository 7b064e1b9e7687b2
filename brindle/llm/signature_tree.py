"""Signature trees over sets: nodes hold OR-combined bitmaps and size ranges, and a tree is traversed against itself.

A set of n tokens has a bitmap of W >= 4n bits, one bit set for each token (its hash modulo W). Two
sets share at most as many tokens as bits set in both bitmaps plus the tokens that one of them lost
to collisions, so for a pair of nodes

    overlap <= popcount(OR_a & OR_b) + min(most collisions in a, most collisions in b)

and a pair of nodes is pruned if that, or its size ranges, rule out that any pair below them is
similar enough. Sets of one group under a node need no comparison among themselves, so a pair of
nodes that lie in the same group is pruned too.
"""

from __future__ import annotations

import numpy as np

FANOUT, _WORK = 8, 1 << 22


class Groups:
    """Union-find over 0..n-1; the smallest member stands for a group."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def root(self, i: int) -> int:
        of = self.of
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.of[max(a, b)] = min(a, b)
        return True

    def flat(self) -> np.ndarray:
        while True:
            up = self.of[self.of]
            if (up == self.of).all():
                return self.of
            self.of = up


def width_of(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, 64 at least."""
    return max(64, 1 << (4 * max(1, n) - 1).bit_length())


def bitmap(tokens: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(width, bool)
    out[(tokens & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap brought down to fewer bits."""
    return np.bitwise_or.reduce(bits.reshape(-1, width // 64), axis=0)


def _levels(bits: np.ndarray, sizes: np.ndarray, lost: np.ndarray):
    """From the sets up: (bitmaps, least size, most size, most collisions) of each level's nodes."""
    out = [(bits, sizes, sizes, lost)]
    while len(out[-1][0]) > FANOUT:
        b, low, high, c = out[-1]
        at = np.arange(0, len(b), FANOUT)
        out.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(c, at)))
    return out


def _uniform(labels: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each level, the group that all sets under a node belong to, or -1."""
    out, low, high = [labels], labels, labels
    for _ in range(depth - 1):
        at = np.arange(0, len(low), FANOUT)
        low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        out.append(np.where(low == high, low, -1))
    return out


def _join_width(order: np.ndarray, bits: np.ndarray, sizes: np.ndarray, groups: Groups, verify, num: int, den: int) -> None:
    """Dual traversal over the sets ``order``, whose bitmaps have one width; similar ones are joined in groups.

    A similarity of num / den needs (num + den) * overlap >= num * (one size + the other).
    """
    n = len(order)
    lost = sizes - np.bitwise_count(bits).sum(1).astype(np.int64)
    levels = _levels(bits, sizes, lost)
    words = bits.shape[1]
    most = max(FANOUT * FANOUT, _WORK // max(1, words))

    def passes(level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, low, high, c = levels[level]
        keep = np.flatnonzero((den * high[a] >= num * low[b]) & (den * high[b] >= num * low[a]))
        out = np.zeros(len(a), bool)
        for i in range(0, len(keep), most):
            k = keep[i : i + most]
            x, y = a[k], b[k]
            shared = np.bitwise_count(m[x] & m[y]).sum(1).astype(np.int64) + np.minimum(c[x], c[y])
            shared = np.minimum(shared, np.minimum(high[x], high[y]))
            out[k] = (num + den) * shared >= num * (low[x] + low[y])
        return out

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of sets that may be similar, worked off by their first member; pairs already in one group are left out."""
        nonlocal uniform
        if not len(a):
            return
        changed = False
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        edges = np.flatnonzero(np.diff(a, prepend=-1))
        for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(a)], strict=True):
            i = int(order[a[s]])
            labels = groups.flat()
            others = order[b[s:e]]
            others = others[labels[others] != labels[i]]
            if len(others):
                for j in (others if verify is None else others[verify(i, others)]).tolist():
                    changed |= groups.join(i, j)
        if changed:
            uniform = _uniform(groups.flat()[order], len(levels))

    uniform = _uniform(groups.flat()[order], len(levels))
    if n > 2:  # neighbours and the first set first: large groups then form before the traversal
        for a, b in ((np.arange(n - 1), np.arange(1, n)), (np.zeros(n - 1, np.int64), np.arange(1, n))):
            ok = passes(0, a, b)
            settle(a[ok], b[ok])
    top = len(levels) - 1
    a, b = np.triu_indices(len(levels[top][0]))
    stack = [(top, a, b)]
    while stack:
        level, a, b = stack.pop()
        if len(a) > most:
            stack += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)][::-1]
            continue
        label = uniform[level]
        apart = (label[a] < 0) | (label[a] != label[b])
        if level == 0:
            apart &= a != b
        a, b = a[apart], b[apart]
        ok = passes(level, a, b)
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        if level == 0:
            settle(a, b)
            continue
        size = len(levels[level - 1][0])
        step = max(1, most // (FANOUT * FANOUT))
        parts = []
        for i in range(0, len(a), step):
            x = (a[i : i + step, None, None] * FANOUT + np.arange(FANOUT)[None, :, None]).repeat(FANOUT, 2).ravel()
            y = (b[i : i + step, None, None] * FANOUT + np.arange(FANOUT)[None, None, :]).repeat(FANOUT, 1).ravel()
            ok = (x <= y) & (y < size)
            parts.append((level - 1, x[ok], y[ok]))
        stack += parts[::-1]


def similar_groups(bitmaps: list[np.ndarray], sizes: np.ndarray, near: np.ndarray, groups: Groups, verify=None, num: int = 3, den: int = 4) -> Groups:
    """Joins in ``groups`` the sets whose Jaccard similarity is num / den or more.

    bitmaps are of width_of(size) bits; ``near`` is a value that similar sets often share, to lay
    them side by side in the tree. verify(i, others) says which others are really similar to i;
    without it, all pairs are joined that the bitmaps can't rule out.
    """
    widths = np.array([64 * len(x) for x in bitmaps], np.int64)
    for w in np.unique(widths):
        # Similar sets differ in size by less than half, so their widths are equal or one step apart.
        members = np.flatnonzero((widths == w) | (widths == 2 * w))
        if len(members) < 2:
            continue
        order = members[np.lexsort((sizes[members], near[members]))]
        bits = np.stack([folded(bitmaps[i], int(w)) for i in order])
        _join_width(order, bits, sizes[order], groups, verify, num, den)
    return groups
