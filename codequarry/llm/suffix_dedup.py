"""Suffix-array dedup: bytes of 200-byte strings that occur anywhere else.

Suffixes are sorted sparsely. Only those starting a window whose anchor occurs
twice (by the merged count-min sketch) can have a partner; runs of such
windows with the same bytes collapse to one, with their count; and what is
left, the suffixes around the ends of copies, is dealt out by anchor and sorted
in each task by a mergesort that compares suffixes through prefix polynomial
hashes and binary search. Neighbours that agree over 200 bytes are verified
byte by byte. Runs are the same if their anchors and BLAKE2 digests are. An
anchor with very many different runs is not sorted in one task: its windows are
grouped by their BLAKE2 digests across the cluster, with partial sums.

Null is an empty text. Rows are documents of their own, repeated rows too:
the text of both is then removed. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import sketch
from codequarry.llm.hashing import BYTE_VALUES, digest
from codequarry.llm.repeats import KEY, Runs, covered, keyed, long_lists, over_texts, with_runs
from codequarry.llm.suffix_sort import Suffixes
from codequarry.runtime import materialize, ship

GRAM, LONGEST = 32, 256
#: Anchors with more different runs than this are grouped across the cluster.
SORTED_RUNS = 4096
#: Bytes of runs that one sort takes at a time.
SORT_BYTES = 250_000
#: Bytes of texts that are hashed at a time: their arrays stay in a processor's cache.
HASH_BYTES = 1 << 17


def _runs(batch, window):
    for rows, texts in over_texts(batch, HASH_BYTES):
        if not any(len(t) >= window for t in texts):
            continue
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
        yield rows, buffer, offsets, Runs(BYTE_VALUES[buffer], offsets, window, min(GRAM, window), LONGEST)


def _emit(repeated, window):
    def emit(batches):
        flags = repeated.value
        for batch in batches:
            for rows, buffer, offsets, r in _runs(batch, window):
                keep = flags(r.anchor) if len(r.anchor) else np.zeros(0, bool)
                if not keep.any():
                    continue
                start, count, doc = r.start[keep], r.count[keep], r.doc[keep]
                part = batch.slice(rows.start, rows.stop - rows.start)
                raw = buffer.tobytes()
                content = [raw[s : s + n + window - 1] for s, n in zip(start.tolist(), count.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(k)).take(pa.array(doc)) for k in KEY),
                        pa.array(r.anchor[keep].view(np.int64)),
                        pa.array(np.array([digest(c) for c in content], np.uint64).view(np.int64)),
                        pa.array((start - offsets[doc]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(r.repeats_inside()[keep]),
                        pa.array(content, pa.binary()),
                    ],
                    [*KEY, "anchor", "content", "start", "count", "inside", "bytes"],
                )

    return emit


def _sorted_flags(window):
    """Of runs sorted by anchor within the partition: which windows occur twice or more."""

    def flush(held):
        anchor, content, times, texts = (list(x) for x in zip(*held))
        length = np.array([len(t) for t in texts])
        first = np.cumsum(length) - length
        s = Suffixes(np.frombuffer(b"".join(texts), np.uint8), window)
        n = length - window + 1
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = np.unique(np.array(anchor), return_inverse=True)[1]
        position = np.repeat(first, n) + at
        back = np.zeros(len(s.text), np.int64)
        back[position] = np.arange(len(position))
        order, new = s.sort(position, group[owner])
        joined = ~new
        joined[1:][joined[1:]] = s.equal(order[:-1][joined[1:]], order[1:][joined[1:]])
        cls = np.cumsum(~joined) - 1
        weight = np.bincount(cls, np.array(times)[owner[back[order]]])
        flag = np.zeros(len(position), bool)
        flag[back[order]] = weight[cls] > 1
        per = np.bincount(owner[flag], minlength=len(n))
        some = np.flatnonzero(per)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(anchor)[some], pa.int64()),
                pa.array(np.array(content)[some], pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per[some])].astype(np.int32)), pa.array(at[flag].astype(np.int32))),
            ],
            ["anchor", "content", "found"],
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and size > SORT_BYTES and row[0] != held[-1][0]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held)

    return run


def _window_hashes(window):
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            length = np.array([len(t) for t in texts], np.int64)
            if not len(length):
                continue
            hashes = np.array([digest(t[i : i + window]) for t in texts for i in range(len(t) - window + 1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), long_lists(hashes, length - window + 1)], ["anchor", "content", "windows"])

    return run


def _finish(window):
    def finish(batches):
        for batch in batches:
            for rows, texts in over_texts(batch):
                part = batch.slice(rows.start, len(texts))
                runs = part.column(part.schema.get_field_index("runs")).to_pylist()
                gone, spans, kept = [], [], []
                for text, found in zip(texts, runs):
                    if not found:
                        gone.append(0), spans.append(0), kept.append(text)
                        continue
                    cover = covered(len(text), found, window)
                    gone.append(int(cover.sum()))
                    spans.append(int((cover[1:] & ~cover[:-1]).sum() + cover[0]))
                    kept.append(np.frombuffer(text, np.uint8)[~cover].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return finish


def flagged_windows(documents: DataFrame, window: int = 200) -> DataFrame:
    """Runs of windows that occur anywhere else: KEY, start, count, hit (null: all)."""
    spark = documents.sparkSession
    ship(spark)
    docs = keyed(documents)

    def anchors(batch):
        return (r.anchor_positions() for *_, r in _runs(batch, window))

    repeated = spark.sparkContext.broadcast(sketch.repeated(docs, anchors))
    runs = materialize(
        docs.mapInArrow(_emit(repeated, window), "doc_id long, row_key long, anchor long, content long, start int, count int, inside boolean, bytes binary"),
        "windows",
    )
    distinct = materialize(
        runs.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.first("inside").alias("inside"), F.first("bytes").alias("bytes")), "runs"
    )
    met = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.max("inside").alias("again"))
    mixed = distinct.join(met.filter("n > 1 or again"), "anchor").filter("n > 1 or inside")
    mixed = materialize(mixed.select("anchor", "content", F.least("times", F.lit(2)).cast("int").alias("times"), "bytes", "n"), "mixed")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_sort = (
        mixed.filter(F.col("n") <= SORTED_RUNS)
        .select("anchor", "content", "times", "bytes")
        .repartition(parts, "anchor")
        .sortWithinPartitions("anchor")
        .mapInArrow(_sorted_flags(window), "anchor long, content long, found array<int>")
    )
    hot = materialize(
        mixed.filter(F.col("n") > SORTED_RUNS)
        .select("anchor", "content", "bytes")
        .mapInArrow(_window_hashes(window), "anchor long, content long, windows array<long>")
        .join(mixed.filter(F.col("n") > SORTED_RUNS).select("anchor", "content", "times"), ["anchor", "content"])
        .select("anchor", "content", "times", F.posexplode("windows").alias("at", "hash")),
        "hot",
    )
    twice = hot.groupBy("anchor", "hash").agg(F.sum("times").alias("times")).filter("times > 1").drop("times")
    by_group = hot.join(twice, ["anchor", "hash"]).groupBy("anchor", "content").agg(F.collect_list("at").alias("found"))
    alone = distinct.filter("times > 1").select("anchor", "content", F.lit(True).alias("all"))
    verdict = alone.join(by_sort.unionByName(by_group), ["anchor", "content"], "full")
    return (
        runs.drop("bytes", "inside")
        .join(verdict, ["anchor", "content"])
        .withColumn("hit", F.when(F.col("all").isNull(), F.col("found")))
        .select(*KEY, "start", "count", "hit")
    )


def remove_repeated(documents: DataFrame, window: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes that stay."""
    return with_runs(keyed(documents), flagged_windows(documents, window)).mapInArrow(
        _finish(window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows, window: int = 200) -> dict:
    """{doc_id: (bytes, removed, spans, sha256)} of (doc_id, text) rows with distinct ids."""
    from collections import Counter

    texts = {d: (t or "").encode() for d, t in rows}
    met: Counter = Counter()
    for t in texts.values():
        met.update(t[i : i + window] for i in range(len(t) - window + 1))
    out = {}
    for d, t in texts.items():
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if met[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
