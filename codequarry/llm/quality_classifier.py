"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, SGD.

Every word gives one hashed word feature and its hashed character n-grams, and
every two neighbours one hashed word bigram (a word met twice in a row gives
one bigram of its own, whatever the word). A document is the mean of its features' vectors; a softmax layer turns that
into class probabilities. Vectors and layer are learnt together by stochastic
gradient descent in numpy, in one task, from a bounded sample of labelled
rows: at most ``Settings.train_rows`` documents, the first in the order of a
hash of doc_id, and at most ``Settings.buckets`` numbers for each. Only the
learnt numbers reach the driver.

Scoring is one pass over all whole texts without a shuffle. What is broadcast
is one number per bucket (1 MB), whatever the corpus.

Null and empty texts have no features: they get the score of the bias alone.
Rows without a label, or labelled null, teach nothing; without any usable
label of both classes all scores are 0.5. Repeated rows get equal scores. Of
rows that share a labelled doc_id the one with the least text teaches; a
doc_id labelled both ways counts as good.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from codequarry.llm.memory import frugal
from codequarry.llm.hashing import Prefix, chunks, mix
from codequarry.runtime import ship


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    size: int = 8
    shortest: int = 3
    longest: int = 5
    train_rows: int = 3000
    epochs: int = 10
    rate: float = 20.0
    cache_words: int = 300_000
    cache_bytes: int = 32_000_000
    seed: int = 7


def word_features(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct words: their hashes, and the buckets of each ``<word>`` and its character n-grams, with the word's index."""
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = (b"<" + b"> <".join(words) + b">").decode("utf-8", "replace")
    codes = np.frombuffer(marked.encode("utf-32-le", "replace"), np.uint32)
    gap = codes == 0x20
    owner = np.cumsum(gap)
    prefix = Prefix(mix(codes.astype(np.uint64) + np.uint64(1)))
    breaks = np.flatnonzero(gap)
    hashes = mix(prefix.span(np.r_[0, breaks + 1], np.r_[breaks, len(codes)]) ^ np.uint64(0x5851F42D4C957F2D))
    buckets, owners = [hashes], [np.arange(len(words))]
    for k in range(s.shortest, s.longest + 1):
        grams = prefix.every(k)
        n = len(grams)
        inside = np.flatnonzero(~gap[:n] & (owner[:n] == owner[k - 1 : k - 1 + n]))
        buckets.append(grams[inside])
        owners.append(owner[inside])
    every = np.concatenate(buckets)
    return hashes, ((every >> np.uint64(33)) % np.uint64(s.buckets)).astype(np.int64), np.concatenate(owners)


def bigrams(hashes: np.ndarray, s: Settings) -> np.ndarray:
    """Buckets of neighbouring words, given the words' hashes; equal neighbours share bucket 0."""
    a, b = hashes[:-1], hashes[1:]
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b) * np.uint64(0xBF58476D1CE4E5B9)
    return np.where(a == b, 0, (mixed >> np.uint64(40)).astype(np.int64) % s.buckets)


def _texts(column):
    texts = [b"" if t is None else t for t in column.to_pylist()]
    for a, b in chunks([len(t) for t in texts], 1_000_000):
        yield a, texts[a:b]


def _pieces(words: list[bytes], limit: int = 400_000):
    """(first, words) of consecutive words of together about ``limit`` bytes, which bounds the arrays made of them."""
    for a, b in chunks([len(w) + 3 for w in words], limit):
        yield a, words[a:b]


def _featurize(s: Settings):
    def run(batches):
        for batch in batches:
            rows = []
            for _, texts in _texts(batch.column(1)):
                for t in texts:
                    words = t.split()
                    met = {w: i for i, w in enumerate(dict.fromkeys(words))}
                    order = np.array([met[w] for w in words], np.int64)
                    total = np.zeros(s.buckets)
                    hashes = np.zeros(len(met), np.uint64)
                    times = np.bincount(order, minlength=len(met))
                    for first, some in _pieces(list(met)):
                        here = slice(first, first + len(some))
                        hashes[here], at, owner = word_features(some, s)
                        total += np.bincount(at, weights=times[here][owner], minlength=s.buckets)
                    total += np.bincount(bigrams(hashes[order], s), minlength=s.buckets)
                    at = np.flatnonzero(total)
                    rows.append((at.astype(np.int32).tobytes(), (total[at] / max(total.sum(), 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "at", "weight"]
            )

    return run


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """One number per bucket and a bias: the difference of the two softmax inputs."""
    labels = np.array([y for *_, y in examples])
    if len(set(labels.tolist())) < 2:
        return np.zeros(s.buckets), 0.0
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.size, 1 / s.size, (s.buckets, s.size))
    layer, bias = np.zeros((s.size, 2)), np.zeros(2)
    steps, done = s.epochs * len(examples), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(examples)):
            at, weight, y = examples[i]
            weight = weight.astype(float)
            rate = s.rate * (1 - done / steps)
            done += 1
            hidden = weight @ vectors[at]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = layer @ p
            layer -= rate / 10 * np.outer(hidden, p)
            bias -= rate / 100 * p
            vectors[at] -= rate * np.outer(weight, back)
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def _learn(s: Settings):
    def run(batches):
        examples = []
        for batch in batches:
            for label, at, weight in zip(*(batch.column(k).to_pylist() for k in range(3))):
                examples.append((np.frombuffer(at, np.int32), np.frombuffer(weight, np.float32), label))
        value, bias = train(examples, s)
        yield pa.RecordBatch.from_arrays([pa.array([value.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["value", "bias"])

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(documents: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    ship(documents.sparkSession)
    ids = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.train_rows)
    )
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    learnt = (
        texts.join(F.broadcast(ids), "doc_id")  # train_rows ids
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("label").alias("label"))
        .select("label", "text")
        .mapInArrow(frugal(_featurize(s)), "label int, at binary, weight binary")
        .repartition(1)  # train_rows rows of at most ``buckets`` numbers
        .sortWithinPartitions("at", "weight", "label")
        .mapInArrow(frugal(_learn(s)), "value binary, bias double")
        .first()
    )
    return (np.frombuffer(bytes(learnt["value"]), "<f8"), learnt["bias"]) if learnt else (np.zeros(s.buckets), 0.0)


class _Scorer:
    """Scores texts; sums of words met before are kept, ``cache_words`` or ``cache_bytes`` at most beside those of the texts at hand."""

    def __init__(self, model, s: Settings):
        self.value, self.bias, self.s = np.asarray(model[0], float), model[1], s
        self.start()

    def start(self):
        self.index: dict[bytes, int] = {}
        self.bytes = 0
        self.table = np.zeros((2, 1 << 16))
        self.hashes = np.zeros(1 << 16, np.uint64)

    def learn(self, words: list[bytes]) -> None:
        for _, some in _pieces(words):
            first, last = len(self.index), len(self.index) + len(some)
            self.bytes += sum(map(len, some))
            self.index.update(zip(some, range(first, last)))
            while last > len(self.hashes):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            hashes, at, owner = word_features(some, self.s)
            self.table[0, first:last] = np.bincount(owner, weights=self.value[at], minlength=len(some))
            self.table[1, first:last] = np.bincount(owner, minlength=len(some))
            self.hashes[first:last] = hashes

    def __call__(self, texts: list[bytes]) -> list[float]:
        if len(self.index) > self.s.cache_words or self.bytes > self.s.cache_bytes:
            self.start()
        split = [t.split() for t in texts]
        index = self.index
        self.learn([w for w in dict.fromkeys(w for words in split for w in words) if w not in index])
        out = []
        for words in split:
            if not words:
                out.append(self.bias)
                continue
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            pairs = bigrams(self.hashes[at], self.s)
            out.append((self.table[0, at].sum() + self.value[pairs].sum()) / (self.table[1, at].sum() + len(pairs)) + self.bias)
        return (1 / (1 + np.exp(-np.clip(np.array(out), -500, 500)))).tolist()


def _score(model, s: Settings, keep: tuple[str, ...]):
    def run(batches):
        value, bias = model.value
        scorer = _Scorer((value, bias), s)
        for batch in batches:
            out = []
            for _, texts in _texts(batch.column("text").cast(pa.binary())):
                out += scorer(texts)
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(out, pa.float64())], [*keep, "score"])

    return run


def score(documents: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and a score from 0 to 1 of each row's whole text."""
    ship(documents.sparkSession)
    model = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*dict.fromkeys([*keep, "text"]))  # a text that is kept is sent to the task once
    schema = StructType([rows.schema[c] for c in keep] + [StructField("score", DoubleType())])
    return rows.mapInArrow(frugal(_score(model, s, keep)), schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score(documents, fit(documents, labels))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
