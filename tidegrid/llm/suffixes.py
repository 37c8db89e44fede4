"""Sorting suffixes by comparing hashes.

A polynomial hash of every prefix of a buffer gives the hash of any substring by one subtraction,
so the longest common extension of two suffixes is found by a binary search over its length, and a
comparison takes a number of steps that is logarithmic in the suffixes' length. A mergesort uses
these comparisons; numpy makes those of one step at once.

Hashes can collide. After sorting, neighbours are compared byte by byte: if each common part is
truly equal and the byte behind it truly greater, the order is right. If not, another base of the
polynomial is tried, and at last the bytes themselves are sorted.
"""

from __future__ import annotations

import numpy as np

from tidegrid.llm.terms import by_eights, key_at

# fixed values: odd bases of the polynomial
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2^64; one table a worker."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, b, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        have = _POWERS[base] = (tables[0], tables[1])
    return have


class Suffixes:
    """Suffixes of a buffer, cut to given lengths, in groups that lie behind each other."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray):
        self.starts, self.lengths, self.groups = starts, lengths, groups
        self.most = int(lengths.max(initial=0))
        # room behind the end, so that a probe past it reads zeros
        self.raw = np.append(raw, np.zeros(2 * self.most + 16, dtype=np.uint8))

    def _prefix_hashes(self, base: int) -> None:
        powers, self.inverse = _powers(base, len(self.raw) + 1)
        self.sums = np.zeros(len(self.raw) + 1, dtype=np.uint64)
        np.cumsum((self.raw.astype(np.uint64) + np.uint64(1)) * powers[: len(self.raw)], out=self.sums[1:])

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The longest common extension of suffixes x and y, by binary search over hashes."""
        a, b = self.starts[x].copy(), self.starts[y].copy()
        left = np.minimum(self.lengths[x], self.lengths[y])
        total = np.zeros(len(x), dtype=np.int64)
        step = 1 << max(0, self.most.bit_length() - 1)
        while step:
            same = (step <= left) & (
                (self.sums[a + step] - self.sums[a]) * self.inverse[a] == (self.sums[b + step] - self.sums[b]) * self.inverse[b])
            gain = np.where(same, step, 0)
            a, b, left, total = a + gain, b + gain, left - gain, total + gain
            step >>= 1
        return total

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Below 0 where suffix x comes first, 0 where they are equal; a prefix comes before its extensions."""
        n = self.common(x, y)
        ended = n == np.minimum(self.lengths[x], self.lengths[y])
        byte = lambda i: self.raw[self.starts[i] + n].astype(np.int64)
        return np.where(ended, self.lengths[x] - self.lengths[y], byte(x) - byte(y))

    def _merge_sort(self) -> np.ndarray:
        n = len(self.starts)
        order = np.arange(n)
        heads = np.flatnonzero(np.append(True, self.groups[1:] != self.groups[:-1])[:n])
        sizes = np.diff(np.append(heads, n))
        first, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        width = 1
        while True:
            # runs of ``width`` are sorted; each item seeks its place in the run next to its own
            places = np.flatnonzero(size > width)
            if not len(places):
                return order
            item, begin = order[places], first[places]
            run = (places - begin) // width
            low = np.minimum(begin + (run ^ 1) * width, begin + size[places])
            a, b = low.copy(), np.minimum(low + width, begin + size[places])
            even = (run & 1) == 0
            open_ = np.flatnonzero(a < b)
            while len(open_):
                middle = (a[open_] + b[open_]) >> 1
                sign = self.compare(order[middle], item[open_])
                before = np.where(even[open_], sign < 0, sign <= 0)
                a[open_[before]] = middle[before] + 1
                b[open_[~before]] = middle[~before]
                open_ = open_[a[open_] < b[open_]]
            order[places - (run & 1) * width + a - low] = item
            width *= 2

    def _verified(self, order: np.ndarray, common: np.ndarray) -> bool:
        """Whether neighbours of a group are in order, by their bytes."""
        x, y, n = order[:-1], order[1:], common[1:]
        inner = n >= 0
        x, y, n = x[inner], y[inner], n[inner]
        eights = by_eights(self.raw)
        for depth in range(-(-int(n.max(initial=0)) // 8)):
            if (key_at(eights, self.starts[x], n, depth) != key_at(eights, self.starts[y], n, depth)).any():
                return False
        ended = n == np.minimum(self.lengths[x], self.lengths[y])
        shorter = self.lengths[x] <= self.lengths[y]
        return bool(np.where(ended, shorter, self.raw[self.starts[x] + n] < self.raw[self.starts[y] + n]).all())

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        cut = [self.raw[s : s + n].tobytes() for s, n in zip(self.starts.tolist(), self.lengths.tolist())]
        # groups lie behind each other: their numbers as they come keep them there
        number = np.cumsum(np.append(False, self.groups[1:] != self.groups[:-1])[: len(cut)])
        order = np.array(sorted(range(len(cut)), key=lambda i: (number[i], cut[i])), dtype=np.int64)
        common = np.full(len(order), -1, dtype=np.int64)
        for k in range(1, len(order)):
            x, y = cut[order[k - 1]], cut[order[k]]
            if number[order[k - 1]] == number[order[k]]:
                common[k] = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        return order, common

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """The order of the suffixes inside each group, and what each has in common with the one
        before it (-1 for the first of a group)."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for base in BASES:
            self._prefix_hashes(base)
            order = self._merge_sort()
            common = np.full(len(order), -1, dtype=np.int64)
            same = np.flatnonzero(self.groups[order[1:]] == self.groups[order[:-1]]) + 1
            common[same] = self.common(order[same - 1], order[same])
            if self._verified(order, common):
                return order, common
        return self._by_bytes()
