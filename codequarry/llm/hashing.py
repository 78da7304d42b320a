"""Vectorised prefix polynomial hashes, word splitting and sliding minima."""

from __future__ import annotations

import hashlib

import numpy as np

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words with more bytes are hashed by BLAKE2: a polynomial modulo 2**64 lets texts of many hundred bytes be made that collide.
LONG_WORD = 64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True

_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64, for i below n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Prefix polynomial hashes of a sequence of unsigned 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = powers(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], dtype=np.uint64, out=self.sums[1:])

    def span(self, start, end) -> np.ndarray:
        """The unmixed hash of values[start:end], elementwise."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def every(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` values."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[: n - width + 1]) * self.inverse[: n - width + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours; by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, one space after each text, and where each text starts (and the end)."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buffer, starts


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs without ASCII white space.

    Returns the joined bytes, each word's start and end, and the index of the
    first word of each text (with one more entry for the end).
    """
    buffer, starts = join_texts(texts)
    space = IS_SPACE[buffer]
    before = np.empty(len(space), bool)
    before[0], before[1:] = True, space[:-1]
    begin = np.flatnonzero(before & ~space)
    end = np.flatnonzero(~before & space)
    return buffer, begin, end, np.searchsorted(begin, starts)


FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def digest(content: bytes) -> int:
    """64 bits that nobody can make collide but by trying."""
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little")


def word_hashes(texts: list[bytes], lower: bool = False, with_buffer: bool = False):
    """A 64-bit hash of each word of all texts, and where each text's words start; with_buffer: the joined bytes too.

    ``lower`` folds A-Z to a-z first.
    """
    buffer, begin, end, offsets = word_spans(texts)
    values = BYTE_VALUES
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    p = Prefix(values[buffer])
    out = mix(p.span(begin, end))
    for i in np.flatnonzero(end - begin > LONG_WORD).tolist():
        word = buffer[begin[i] : end[i]].tobytes()
        out[i] = digest(word.translate(FOLD) if lower else word)
    return (out, offsets, buffer) if with_buffer else (out, offsets)


def chunks(sizes, limit: int):
    """(from, to) of consecutive items whose sizes sum to about ``limit`` at most."""
    first, total = 0, 0
    for i, s in enumerate(sizes):
        if i > first and total + s > limit:
            yield first, i
            first, total = i, 0
        total += s
    if first < len(sizes):
        yield first, len(sizes)


def batches(column, limit: int = 1_000_000):
    """(first row, texts as bytes) of an Arrow binary column; null becomes empty."""
    texts = [b"" if t is None else t for t in column.to_pylist()]
    for a, b in chunks([len(t) for t in texts], limit):
        yield a, texts[a:b]
