"""Windows that repeat across a corpus: the work shared by substring and suffix dedup.

A window's *anchor* is the least gram hash inside it, so equal windows have
equal anchors and a handful of anchors stand for all windows. Consecutive
windows with one anchor form a *run*; runs with the same content (told by a
64-bit BLAKE2 digest of it beside the anchor) collapse before anything is
compared, so a passage copied a million times is looked at once. Windows are compared one by one only where different runs share an
anchor, which is where copies begin, end or were edited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.hashing import Prefix, batches, mix, sliding_min

KEY = ["doc_id", "row_key"]


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, a key of the whole row's text, and the text as bytes."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_key"), text.alias("text"))


class Runs:
    """Runs of windows over concatenated sequences ``values``, split by ``offsets``."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray, window: int, gram: int, longest: int):
        self.prefix = Prefix(values)
        n, self.window = len(values), window
        self.values = values
        empty = np.zeros(0, np.int64)
        self.start = self.count = self.doc = empty
        self.anchor, self.grams, self.least = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.windows = empty
        if n < window:
            return
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.grams = self.prefix.every(gram)
        self.least = sliding_min(self.grams, window - gram + 1)
        starts = np.arange(len(self.least))
        at = np.flatnonzero(starts + window <= offsets[doc[starts] + 1])
        if not len(at):
            return
        self.windows = at
        least, d = self.least[at], doc[at]
        new = np.r_[True, (least[1:] != least[:-1]) | (d[1:] != d[:-1])]
        first = np.flatnonzero(new)
        within = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        first = np.flatnonzero(within % longest == 0)
        self.start, self.anchor, self.doc = at[first], least[first], d[first]
        self.count = np.diff(np.r_[first, len(at)])

    def window_hashes(self) -> np.ndarray:
        """Of all windows of all runs, in order."""
        return mix(self.prefix.span(self.windows, self.windows + self.window))

    def anchors_by_document(self) -> np.ndarray:
        """Each anchor once per document that has it."""
        pair = np.unique(np.stack([self.anchor, self.doc.astype(np.uint64)]), axis=1) if len(self.anchor) else np.zeros((1, 0), np.uint64)
        return pair[0]

    def anchor_positions(self) -> np.ndarray:
        """The anchors' hash values, once for each place that is some window's anchor."""
        if not len(self.windows):
            return self.anchor
        span = self.window - (len(self.values) - len(self.grams) + 1) + 1  # grams in a window
        most = np.zeros(len(self.least), np.uint64)
        most[self.windows] = self.least[self.windows]
        reach = ~sliding_min(~np.r_[np.zeros(span - 1, np.uint64), most, np.zeros(span - 1, np.uint64)], span)
        return self.grams[self.grams == reach[: len(self.grams)]]

    def repeats_inside(self) -> np.ndarray:
        """Whether a run's anchor occurs at two places of the run, so that its windows may equal one another."""
        if not len(self.start):
            return np.zeros(0, bool)
        span = self.count + self.window - (len(self.values) - len(self.grams) + 1)
        owner = np.repeat(np.arange(len(span)), span)
        at = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(self.start, span)
        hits = self.grams[at] == self.anchor[owner]
        return np.bincount(owner[hits], minlength=len(span)) > 1


def long_lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def listed(column: str, *keys: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*keys))).alias(column)


def with_runs(documents: DataFrame, flagged: DataFrame) -> DataFrame:
    """Documents with their flagged runs, one array each (null: none).

    ``flagged`` has KEY, start, count and hit, the flagged windows of a run
    (null: all). A document has fewer runs than words or bytes, so the lists
    are bounded by the documents themselves.
    """
    per_document = flagged.groupBy(*KEY).agg(F.collect_list(F.struct("start", "count", "hit")).alias("runs"))
    same = [documents[k].eqNullSafe(per_document[k]) for k in KEY]
    return documents.join(per_document, same[0] & same[1], "left").select(documents["doc_id"], documents["text"], per_document["runs"])


def covered(length: int, runs, window: int) -> np.ndarray:
    """Which of ``length`` items lie in a flagged window."""
    step = np.zeros(length + 1, np.int64)
    for r in runs or ():
        start, hit = r["start"], r["hit"]
        if hit is None:
            step[start] += 1
            step[start + r["count"] + window - 1] -= 1
        else:
            at = start + np.asarray(hit, np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + window, -1)
    return np.cumsum(step[:-1]) > 0


def over_texts(batch, limit: int = 2_000_000):
    """(row slice, texts) of a batch of ``keyed`` documents, in pieces of bounded size."""
    column = batch.column(batch.schema.get_field_index("text"))
    for first, texts in batches(column, limit):
        yield slice(first, first + len(texts)), texts
