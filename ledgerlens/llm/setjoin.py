"""Exact similarity joins of sets given as sorted 64-bit hashes: block keys.

Two sets whose Jaccard similarity reaches num/den differ in at most
``most_different`` elements. Cut the global order of elements (their hash
value) into ``most_different + 2`` position blocks: at least two blocks hold
exactly the same elements of both. A set's index keys are the digests of its
blocks; sets that agree on no whole block are never looked at, and a list is
skipped block by block, not element by element. If two sets agree on empty
blocks only, they agree on two of them, so pairs of empty blocks are keys too.

Block counts depend on a size class. Classes grow by a quarter, linked sizes
lie in the same or in neighbouring classes, and the smaller set also emits
keys for the next class if a linked partner could be there.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ledgerlens.llm.common import mix


class Threshold:
    """Jaccard similarity num/den and its size classes."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.tops = [0]

    def most_different(self, size: int) -> int:
        """Largest symmetric difference of a linked pair of sets of up to ``size``."""
        return 2 * size * (self.den - self.num) // (self.den + self.num)

    def extend(self, size: int) -> None:
        while self.tops[-1] < size:
            top = self.tops[-1]
            grown = top + 1
            # The first class holds the sizes at which only equal sets link.
            if not top:
                while not self.most_different(grown + 1):
                    grown += 1
            self.tops.append(max(grown, top + top // 4))

    def classes(self, sizes: np.ndarray) -> np.ndarray:
        self.extend(int(sizes.max(initial=1)) * 2)
        return np.searchsorted(np.array(self.tops), sizes)

    def linked(self, both: int, left: int, right: int) -> bool:
        return self.den * both >= self.num * (left + right - both)


@lru_cache(maxsize=8)
def threshold(num: int, den: int) -> Threshold:
    return Threshold(num, den)


def distinct_sorted(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each owner's distinct values in ascending order. owner: ascending."""
    if not len(values):
        return values, owner
    order = np.argsort(values)
    by = owner[order]
    # Owners of a chunk are few: a stable sort of 16-bit numbers takes linear time.
    order = order[np.argsort(by.astype(np.uint16) if owner[-1] < 1 << 16 else by, kind="stable")]
    values, owner = values[order], owner[order]
    first = np.ones(len(values), dtype=bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], owner[first]


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Wrapping sums of uint64 values over runs that begin at ``starts``."""
    return np.add.reduceat(values, starts) if len(starts) else np.empty(0, np.uint64)


def block_keys(values: np.ndarray, owner: np.ndarray, sizes: np.ndarray, limit: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owners): index keys of sets. values: distinct ascending uint64 per
    owner; owner: ascending set numbers; sizes: by set number."""
    level = limit.classes(sizes)
    tops = np.array(limit.tops, dtype=np.int64)
    below = tops[level] + 1  # the least size of the next class
    keys, owners = [], []
    for step in (0, 1):
        emits = sizes > 0
        if step:
            emits &= limit.den * sizes >= limit.num * below
        top = tops[np.minimum(level + step, len(tops) - 1)]
        blocks = 2 * top * (limit.den - limit.num) // (limit.den + limit.num) + 2
        emits &= blocks > 2  # with no difference allowed only equal sets link
        used = emits[owner]
        v, o = values[used], owner[used]
        if not len(v):
            continue
        m = blocks[o].astype(np.uint64)
        block = ((v >> np.uint64(32)) * m) >> np.uint64(32)
        edge = np.ones(len(v), dtype=bool)
        edge[1:] = (block[1:] != block[:-1]) | (o[1:] != o[:-1])
        starts = np.flatnonzero(edge)
        digest = sums(mix(v + np.uint64(0x51ED270B)), starts)
        b, w = block[starts], o[starts]
        salt = mix((level[w] + step).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b)
        keys.append(mix(digest ^ salt))
        owners.append(w)
        empty = blocks - np.bincount(w, minlength=len(sizes))
        for s in np.flatnonzero(emits & (empty > 1)):
            full = set(b[np.searchsorted(w, s):np.searchsorted(w, s, side="right")].tolist())
            gaps = [i for i in range(int(blocks[s])) if i not in full]
            pairs = [(i, j) for n, i in enumerate(gaps) for j in gaps[n + 1:]]
            codes = np.array([i << 24 | j for i, j in pairs], dtype=np.uint64) + np.uint64(int(level[s] + step) << 50)
            keys.append(mix(codes ^ np.uint64(0xA5A5A5A55A5A5A5A)))
            owners.append(np.full(len(pairs), s))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)
