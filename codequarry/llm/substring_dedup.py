"""Substring dedup: 50-word passages that an earlier document already has.

A count-min sketch, built in partitions and merged, overestimates how often
each window occurs (through its anchor: equal windows share one). A second
pass groups exactly only the windows whose estimate is two or more: whole runs
of them by their anchor and a digest of their words, and where runs differ, by
anchor and window hash, of together 128 bits; an overestimate costs work and never a window.

Null and empty texts have no words. Documents with one doc_id are one
document: they never count as earlier than one another. A null doc_id is
later than no document and earlier than none, so it neither removes nor loses
words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm import sketch
from codequarry.llm.hashing import digest, word_hashes
from codequarry.llm.repeats import KEY, Runs, covered, keyed, long_lists, over_texts, with_runs
from codequarry.runtime import materialize, ship

GRAM, LONGEST = 8, 64


def _runs(batch, window):
    for rows, texts in over_texts(batch):
        values, offsets = word_hashes(texts)
        yield rows, texts, offsets, Runs(values, offsets, window, min(GRAM, window), LONGEST)


def _emit(repeated, window):
    def emit(batches):
        flags = repeated.value
        for batch in batches:
            for rows, texts, offsets, r in _runs(batch, window):
                keep = flags(r.anchor) if len(r.anchor) else np.zeros(0, bool)
                if not keep.any():
                    continue
                hashes = r.window_hashes()[np.repeat(keep, r.count)]
                count, doc, start = r.count[keep], r.doc[keep], r.start[keep] - offsets[r.doc[keep]]
                content, words, of = [], [], -1
                for d, a, n in zip(doc.tolist(), start.tolist(), count.tolist()):
                    if d != of:
                        words, of = texts[d].split(), d
                    content.append(digest(b" ".join(words[a : a + n + window - 1])))
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(part.schema.get_field_index(k)).take(pa.array(doc)) for k in KEY),
                        pa.array(r.anchor[keep].view(np.int64)),
                        pa.array(np.array(content, np.uint64).view(np.int64)),
                        pa.array(start.astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        long_lists(hashes, count),
                    ],
                    [*KEY, "anchor", "content", "start", "count", "windows"],
                )

    return emit


def _finish(window):
    def finish(batches):
        for batch in batches:
            for rows, texts in over_texts(batch):
                part = batch.slice(rows.start, len(texts))
                runs = part.column(part.schema.get_field_index("runs")).to_pylist()
                total, gone, kept = [], [], []
                for text, found in zip(texts, runs):
                    words = text.split()
                    total.append(len(words))
                    if found:
                        cover = covered(len(words), found, window)
                        words = [w for w, c in zip(words, cover.tolist()) if not c]
                    gone.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    return finish


def flagged_windows(documents: DataFrame, window: int = 50) -> DataFrame:
    """Runs of windows that start in a document with a smaller doc_id: KEY, start, count, hit."""
    spark = documents.sparkSession
    ship(spark)
    docs = keyed(documents).filter("doc_id is not null")

    def anchors(batch):
        return (r.anchors_by_document() for *_, r in _runs(batch, window))

    repeated = spark.sparkContext.broadcast(sketch.repeated(docs, anchors))
    runs = materialize(
        docs.mapInArrow(_emit(repeated, window), "doc_id long, row_key long, anchor long, content long, start int, count int, windows array<long>"), "windows"
    )
    distinct = materialize(
        runs.groupBy("anchor", "content").agg(F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"), F.first("windows").alias("windows")), "runs"
    )
    anchors_met = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.min("earliest").alias("lo"), F.max("latest").alias("hi")).filter("lo < hi")
    mixed = (
        distinct.join(anchors_met.filter("n > 1").select("anchor"), "anchor", "left_semi")
        .select("anchor", "content", "earliest", "latest", F.posexplode("windows").alias("at", "hash"))
    )
    mixed = materialize(mixed, "mixed")
    first_of = mixed.groupBy("anchor", "hash").agg(F.min("earliest").alias("first"), F.max("latest").alias("last")).filter("first < last")
    firsts = (
        mixed.join(first_of, ["anchor", "hash"])
        .filter("first < latest")
        .groupBy("anchor", "content")
        .agg(F.collect_list(F.struct("at", "first")).alias("firsts"))
    )
    alone = distinct.filter("earliest < latest").select("anchor", "content", "earliest")
    verdict = alone.join(firsts, ["anchor", "content"], "full")
    return (
        runs.drop("windows")
        .join(verdict, ["anchor", "content"])
        .withColumn("all", F.coalesce(F.col("earliest") < F.col("doc_id"), F.lit(False)))
        .withColumn("hit", F.when(~F.col("all"), F.transform(F.filter("firsts", lambda x: x["first"] < F.col("doc_id")), lambda x: x["at"])))
        .filter(F.col("all") | (F.size("hit") > 0))
        .select(*KEY, "start", "count", "hit")
    )


def remove_repeated(documents: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept: the bytes of the words that stay, joined by one space."""
    return with_runs(keyed(documents), flagged_windows(documents, window)).mapInArrow(_finish(window), "doc_id long, n_words long, n_removed long, kept binary")


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = remove_repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows, window: int = 50) -> dict:
    """{doc_id: (words, removed, sha256)} of (doc_id, text) rows with distinct ids, by a dictionary of windows."""
    words = {d: (t or "").encode().split() for d, t in rows}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
