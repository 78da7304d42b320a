"""A count-min sketch made in partitions, merged by shards, kept as one bitmap.

Only the question "twice or more?" is ever asked, so counters stop at two.
The bitmap has ``DEPTH * 2**BITS`` bits (32 MB), whatever the input: that is
the proven bound of what is broadcast. When a corpus overfills it, estimates
grow and the exact pass that follows groups more keys; none is lost.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.memory import frugal
from codequarry.llm.hashing import mix

BITS, DEPTH, SHARD_BITS = 27, 2, 6
SHARD_CELLS = (DEPTH << BITS) >> SHARD_BITS
SHARDS = 1 << SHARD_BITS


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The cell of each hash in each row; rows follow one another."""
    return [
        (hashes >> np.uint64(64 - BITS)).astype(np.int64),
        (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS),
    ]


def _counted(hash_batches, flush: int = 1 << 20):
    """Per shard: the cells met once, and those met twice or more, in this partition."""
    held: list[np.ndarray] = []
    size = 0

    def out():
        every = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        twice = np.diff(np.r_[first, len(every)]) > 1
        unique = every[first]
        bounds = np.searchsorted(unique, (np.arange(SHARDS + 1) * SHARD_CELLS).astype(np.uint32))
        rows = [(s, a, b) for s, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        pack = lambda x, s: zlib.compress(np.diff(x - np.uint32(s * SHARD_CELLS), prepend=np.uint32(0)).tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([s for s, _, _ in rows], pa.int32()),
                pa.array([pack(unique[a:b][~twice[a:b]], s) for s, a, b in rows], pa.binary()),
                pa.array([pack(unique[a:b][twice[a:b]], s) for s, a, b in rows], pa.binary()),
            ],
            ["shard", "once", "more"],
        )

    for h in hash_batches:
        held += [c.astype(np.uint32) for c in cells(h)]
        size += DEPTH * len(h)
        if size >= flush:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _merge(batches):
    """Sums cells of the shards of this partition; one row per shard."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, once, more in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if s not in sums:
                sums[s] = np.zeros(SHARD_CELLS, np.uint8)
            for packed, n in ((once, 1), (more, 2)):
                at = np.cumsum(np.frombuffer(zlib.decompress(packed), np.uint32).astype(np.int64))
                sums[s][at] = np.minimum(sums[s][at] + n, 2)
    for s, x in sums.items():
        bits = zlib.compress(np.packbits(x > 1).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits], pa.binary())], ["shard", "bits"])


class Repeated:
    """Says of hashes whether they may occur twice or more: never a wrong no."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for c in cells(hashes):
            out &= (self.bits[c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 == 1
        return out

    def __getstate__(self):
        return zlib.compress(self.bits.tobytes(), 1)

    def __setstate__(self, packed):
        self.bits = np.frombuffer(zlib.decompress(packed), np.uint8)


def repeated(df: DataFrame, hashes_of) -> Repeated:
    """Sketch of ``hashes_of(batch) -> arrays`` over all batches of ``df``."""

    def count(batches):
        return _counted(h for batch in batches for h in hashes_of(batch))

    rows = (
        df.mapInArrow(frugal(count), "shard int, once binary, more binary")
        .repartition(min(SHARDS, 16), F.col("shard"))
        .mapInArrow(frugal(_merge), "shard int, bits binary")
        .collect()  # one bit per cell: bounded by BITS
    )
    bits = np.zeros((DEPTH << BITS) // 8, np.uint8)
    step = SHARD_CELLS // 8
    for r in rows:
        bits[r.shard * step : (r.shard + 1) * step] = np.frombuffer(zlib.decompress(bytes(r.bits)), np.uint8)
    return Repeated(bits)


def held(df: DataFrame, hashes_of) -> Repeated:
    """Says of hashes whether they may be among ``hashes_of`` of ``df``'s batches: each of these counts twice."""
    return repeated(df, lambda batch: (h for hashes in hashes_of(batch) for h in (hashes, hashes)))
