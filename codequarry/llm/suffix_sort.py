"""Suffix mergesort whose comparisons are binary searches over prefix hashes."""

from __future__ import annotations

import numpy as np

from codequarry.llm.hashing import BYTE_VALUES, Prefix


class Suffixes:
    """Suffixes of ``text`` (bytes), compared over at most ``depth`` bytes."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text = np.concatenate([text, np.zeros(depth, np.uint8)])
        self.depth = depth
        self.prefix = Prefix(BYTE_VALUES[self.text])
        self.words = np.zeros(max(0, len(self.text) - 7), np.uint64)  # the eight bytes from each place on
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | self.text[k : len(self.words) + k]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j: a binary search over hashes, for those that differ within ``depth`` bytes."""
        sums, inverse = self.prefix.sums, self.prefix.inverse
        a, b, u, v = sums[i], sums[j], inverse[i], inverse[j]
        out = np.full(len(i), self.depth, np.int64)
        w = np.flatnonzero((sums[i + self.depth] - a) * u != (sums[j + self.depth] - b) * v)
        if not len(w):
            return out
        a, b, u, v, i, j = a[w], b[w], u[w], v[w], i[w], j[w]
        have = np.zeros(len(w), np.int64)
        step = 1 << (self.depth.bit_length() - 1)
        while step:
            longer = np.minimum(have + step, self.depth)
            have = np.where((sums[i + longer] - a) * u == (sums[j + longer] - b) * v, longer, have)
            step >>= 1
        out[w] = have
        return out

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        return (n < self.depth) & (self.text[np.minimum(i + n, len(self.text) - 1)] < self.text[np.minimum(j + n, len(self.text) - 1)])

    def equal(self, i: np.ndarray, j: np.ndarray, block: int = 1 << 15) -> np.ndarray:
        """Whether suffixes agree over ``depth`` bytes, checked on the bytes (eight at a time) where the hashes say so."""
        out = self.prefix.span(i, i + self.depth) == self.prefix.span(j, j + self.depth)
        at, size = np.flatnonzero(out), 8 if self.depth >= 8 else 1
        where = self.words if size == 8 else self.text
        for k in range(0, len(at), block):
            part = at[k : k + block]
            a, b, same = i[part], j[part], np.ones(len(part), bool)
            for reach in (*range(0, self.depth - size, size), self.depth - size):
                same &= where[a + reach] == where[b + reach]
            out[part] = same
        return out

    def sort(self, positions: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order positions by group, then suffix; returns them and whether each starts a segment that differs in group or first 8 bytes.

        Segments of equal group and leading bytes are formed first; within
        them, sorted blocks are merged by rank, all pairs of blocks of a level
        at once. A comparison costs the logarithm of ``depth``.
        """
        lead = self.words[positions]
        order = np.argsort(lead, kind="stable")
        group = group.astype(np.uint16) if group.max(initial=0) < 65536 else group  # sorted by radix
        order = order[np.argsort(group[order], kind="stable")]
        pos, lead, group = positions[order], lead[order], group[order]
        new = np.r_[True, (lead[1:] != lead[:-1]) | (group[1:] != group[:-1])][: len(pos)]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(pos)])
        width = 1
        while (big := size > width).any():
            start = np.repeat(first[big], size[big])
            n = np.repeat(size[big], size[big])
            at = np.arange(len(start)) - np.repeat(np.cumsum(size[big]) - size[big], size[big])
            pair = at // (2 * width) * (2 * width)
            odd = at - pair >= width
            lo = start + np.minimum(np.where(odd, pair, pair + width), n)
            hi = start + np.minimum(np.where(odd, pair + width, pair + 2 * width), n)
            base, mine = lo.copy(), pos[start + at]
            while (open_ := lo < hi).any():
                w = np.flatnonzero(open_)
                mid = (lo[w] + hi[w]) >> 1
                other = pos[mid]
                o = odd[w]
                before = self.less(np.where(o, mine[w], other), np.where(o, other, mine[w]))  # a tie keeps the even block first
                right = np.where(o, ~before, before)
                lo[w] = np.where(right, mid + 1, lo[w])
                hi[w] = np.where(right, hi[w], mid)
            target = start + pair + (at - pair - np.where(odd, width, 0)) + (lo - base)
            pos[target] = mine
            width *= 2
        return pos, new
