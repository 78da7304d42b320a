"""Language-model scores by a probabilistic suffix tree.

Contexts are up to ``Settings.depth`` words before a token. The tree grows
level by level: a gram of two words or more is counted only if its context
and its suffix are frequent (``least`` times or more in the training texts,
however many these are; a caller may ask for a ``share`` of their tokens as
well, as suffix trees ask for a least probability), and of
the frequent ones a context is kept if its distribution diverges from that of its longest
kept suffix by more than ``bits`` over all its occurrences, each symbol being
discounted by its own occurrence. The next symbol of a kept context has
(c - discount) / n, and what discounts and rare symbols leave goes to the
kept suffix's distribution; the root has (c + 0.5) / (N + 0.5 * (V + 1)). A
token is scored in the longest kept context before it.

Texts are coded once, as chunks of word numbers with the chunk's own
vocabulary. Grams of a chunk are sent as arrays of distinct keys by ranges of
these, so a common gram costs a number for each chunk; ranges add up what
all chunks sent and tell each chunk which of its keys are frequent, a mark for
each, their counts and their places among the range's frequent ones: a chunk finds the
keys again by itself. Words are asked about by their hashes; then the chunks are written anew without
hashes, with a word's count and number and one word for all rare ones of a count, and the first ones are emptied. Place and range make a
frequent gram's number, and a longer gram's key is the number of its context and that of its last word, of
as many bits as these need, so sorted keys have small differences. Answers are written once, in the chunks'
buckets, and later passes read them there. One of the chunks that hold a
frequent gram makes a row of it, with the counts of its context and suffix, and tests are
windows and joins of those rows. A chunk gets back marks of the kept contexts that it
holds and counts of what they leave to their suffixes, and makes the probabilities. Nothing is broadcast,
and what is counted grows with the corpus.

Null is an empty text, whose only token is the end. A null doc_id is not held
out. Rows that share a doc_id are scored one by one. Words are told apart by 64
bits of hash. Without training texts every token has probability 1. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.hashing import batches, chunks, word_hashes
from codequarry.runtime import materialize, shared_folder, ship, shuffles_freed

END = np.uint64(0x9D39247E33776D41)
_ODD = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Bits of a gram's number where a caller does not know how many there are.
_WIDE = 32


@dataclass(frozen=True)
class Settings:
    depth: int = 2
    least: int = 16
    share: float = 0.0
    discount: float = 0.75
    bits: float = 24.0
    #: Tokens of a chunk, and keys that a range of hashes holds, about.
    chunk_tokens: int = 3 << 18
    range_keys: int = 1 << 21

    def frequent(self, total: int) -> int:
        """How often a frequent gram occurs in ``total`` training tokens."""
        return max(self.least, math.ceil(self.share * total))

    def __post_init__(self):
        if self.least < 2 or not 0 < self.discount < 1:
            raise ValueError("the test discounts a symbol's own occurrence: least must be 2 or more, discount between 0 and 1")


def pack(x: np.ndarray, low: int = 0) -> bytes:
    """Numbers as compressed planes of their bytes, but for so many low bits of each, which are random and stored as they are."""
    high = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray((x >> x.dtype.type(low)).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())
    bits = np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize), axis=1, bitorder="little")[:, :low] if low else np.zeros(0, np.uint8)
    return bytes([low]) + len(high).to_bytes(4, "little") + high + np.packbits(bits, bitorder="little").tobytes()


def unpack(content: bytes, kind) -> np.ndarray:
    low, end = content[0], 5 + int.from_bytes(content[1:5], "little")
    plain = np.frombuffer(zstandard.ZstdDecompressor().decompress(content[5:end]), np.uint8)
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(plain.reshape(size, -1).T).view(kind).ravel()
    if low:
        some = np.packbits(np.unpackbits(np.frombuffer(content, np.uint8, offset=end), count=low * len(x), bitorder="little").reshape(-1, low), axis=1, bitorder="little")
        padded = np.zeros((len(x), size), np.uint8)
        padded[:, : some.shape[1]] = some
        x = x << x.dtype.type(low) | padded.view(kind).ravel()
    return x


def pack_sorted(x: np.ndarray) -> bytes:
    """Numbers that mostly ascend as their differences."""
    steps = np.diff(x, prepend=x.dtype.type(0))
    return pack(steps, max(0, int(np.median(steps)).bit_length() - 1) if len(steps) else 0)


def unpack_sorted(content: bytes, kind) -> np.ndarray:
    return np.cumsum(unpack(content, kind), dtype=kind)


def scramble(x: np.ndarray, bits: int) -> np.ndarray:
    """A permutation of the numbers of so many bits, so that ranges of them get equal shares."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for odd in _ODD:
        x = (x * odd) & mask
        x = x ^ (x >> half)
    return x


def _coded(s: Settings):
    """Chunks: per document its id, number of tokens and whether it trains; the vocabulary, commonest first, and each token's place in it."""

    def run(found):
        ids, held, tokens, lengths, trains, size = [], [], [], [], [], 0

        def out():
            words = np.concatenate(tokens)
            vocabulary, at, n = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            return pa.RecordBatch.from_pydict(
                {"doc_ids": pa.array([ids], pa.list_(pa.int64())), "held": [pack(np.array(held, np.uint8))], "lengths": [pack(np.concatenate(lengths).astype(np.int64))], "vocabulary": [pack_sorted(vocabulary[order])], "tokens": [pack(place[at])], "n": pa.array([len(words)], pa.int64()), "n_trains": pa.array([int(sum(x.sum() for x in trains))], pa.int64())}
            )

        for batch in found:
            for first, texts in batches(batch.column(2)):
                for a, b in chunks([len(t) for t in texts], 4 * s.chunk_tokens):
                    h, offsets = word_hashes(texts[a:b], lower=True)
                    tokens.append(np.insert(h, offsets[1:], END))
                    lengths.append(np.diff(offsets) + 1)
                    ids += batch.column(0)[first + a : first + b].to_pylist()
                    some = batch.column(1)[first + a : first + b].to_pylist()
                    held += some
                    trains.append(lengths[-1][~np.array(some, bool)])
                    size += len(tokens[-1])
                    if size >= s.chunk_tokens:
                        yield out()
                        ids, held, tokens, lengths, trains, size = [], [], [], [], [], 0
        if size:
            yield out()

    return run


_CODED = "doc_ids array<long>, held binary, lengths binary, vocabulary binary, tokens binary, n long, n_trains long"


class Chunk:
    """A chunk's tokens, with the numbers and counts of the frequent grams that end at them."""

    def __init__(self, row: dict, ranges: int, bits: tuple[int, ...] = ()):
        self.doc_ids = row["doc_ids"]
        self.held, self.lengths = unpack(row["held"], np.uint8).astype(bool), unpack(row["lengths"], np.int64)
        self.tokens, self.vocabulary = unpack(row["tokens"], np.int32), None
        if "vocabulary" in row:
            self.vocabulary = unpack_sorted(row["vocabulary"], np.uint64)
            self.sorted = np.argsort(self.vocabulary)  # the order in which words are asked about
        else:
            self.words = unpack(row["counts"], np.int64), unpack_sorted(row["ids"], np.int64)
        starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(self.tokens)) - np.repeat(starts, self.lengths)
        self.trains = np.repeat(~self.held, self.lengths)
        self.ranges, self.bits = ranges, bits
        # per level: whether the gram that ends at a token is frequent, its count and number, what a kept one leaves to its suffix (else nan), and a token where each gram ends that this chunk owns
        self.have, self.n, self.ids, self.rest, self.own = [], [], [], [], []

    def key_bits(self, d: int) -> int:
        """Bits of the keys of level d."""
        context, word = (self.bits[k] if k < len(self.bits) else _WIDE for k in (d - 1, 0))
        if context + word > 64:
            raise OverflowError("more frequent grams than 64 bits can number with a word")
        return context + word

    def candidates(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens where the grams of level d end whose context and suffix are frequent, their sorted distinct keys, and the place of each among these."""
        both = self.have[d - 1].copy()
        both[1:] &= self.have[d - 1][:-1]
        both &= self.place >= d
        at, bits = np.flatnonzero(both), self.key_bits(d)
        word = np.uint64(self.bits[0] if self.bits else _WIDE)
        keys = self.ids[d - 1][at - 1].astype(np.uint64) << word | self.ids[0][at].astype(np.uint64)
        return at, *np.unique(scramble(keys, bits), return_inverse=True)

    def hear_words(self, answers: list[dict], least: int):
        """Takes the answers about words: of each word its count and, if it is frequent, its number."""
        rows = sorted((r for r in answers if r["level"] == 0), key=lambda r: r["range"])
        counts, ids = np.zeros(len(self.vocabulary), np.int64), np.zeros(len(self.vocabulary), np.int64)
        counts[self.sorted] = np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"], np.int64) for r in rows)])
        ids[self.sorted[counts[self.sorted] >= least]] = self._numbers(rows)
        self.words = counts, ids

    def _numbers(self, rows: list[dict]) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(unpack_sorted(r["places"], np.int64) * self.ranges + r["range"] for r in rows)])

    def hear(self, answers: list[dict], depth: int, least: int, discount: float = 0.0):
        """Takes the answers about levels 0 to ``depth``, in this order; about words only if it has their hashes."""
        answers = sorted(answers, key=lambda r: r["range"])
        size = len(self.tokens)
        if self.vocabulary is not None:
            self.hear_words(answers, least)
        for d in range(depth + 1):
            rows, kept = [r for r in answers if r["level"] == d], {r["range"]: r for r in answers if r["level"] == -1 - d}
            one = lambda name, kind: np.concatenate([np.zeros(0, kind), *(unpack(r[name], kind) for r in rows)])  # noqa: B023, E731
            if d == 0:
                at, of, (counts, ids) = np.arange(size), self.tokens, self.words
                often, owned = counts >= least, np.zeros(0, bool)
            else:
                at, keys, of = self.candidates(d)
                often, owned = one("often", np.uint8).astype(bool), one("owned", np.uint8).astype(bool)
                counts, ids = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
                counts[often], ids[often] = one("counts", np.int64), self._numbers(rows)
            for found, kind, values in ((self.have, bool, often), (self.n, np.int64, counts), (self.ids, np.int64, ids)):
                found.append(np.zeros(size, kind))
                found[d][at] = values[of]
            where = np.zeros(len(counts), np.int64)
            where[of] = at
            self.own.append(where[often][owned] if d else owned)
            self.rest.append(None)
            if kept:
                place, of_range = np.divmod(ids[often], self.ranges)
                order = np.flatnonzero(often)[np.lexsort((place, of_range))]
                marks = [unpack(kept[r]["often"], np.uint8) if r in kept else np.zeros(n, np.uint8) for r, n in enumerate(np.bincount(of_range).tolist()) if n]
                which = order[np.concatenate(marks).astype(bool)]
                free, number = (np.concatenate([unpack(r[name], np.int64) for r in kept.values()]) for name in ("counts", "places"))
                rest = np.full(len(counts), np.nan)
                rest[which] = (free + discount * number) / counts[which]
                self.rest[d] = np.full(size, np.nan)
                self.rest[d][at] = rest[of]


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands among sorted ones, and whether it does."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


_ASK = "chunk long, range int, keys binary, counts binary"


def _asks(chunk: int, keys: np.ndarray, counts: np.ndarray, ranges: int, bits: int = 64) -> pa.RecordBatch:
    """Sorted distinct keys of so many bits with their counts, cut by ranges."""
    top = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    of = (top * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(of, np.arange(ranges + 1))
    some = [(r, a, b) for r, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
    data = {"chunk": pa.array([chunk] * len(some), pa.int64()), "range": pa.array([r for r, _, _ in some], pa.int32())}
    data |= {"keys": pa.array([pack_sorted(keys[a:b]) for _, a, b in some], pa.binary()), "counts": pa.array([pack(counts[a:b].astype(np.int32)) for _, a, b in some], pa.binary())}
    return pa.RecordBatch.from_pydict(data)


def _ask_words(ranges: int):
    def run(found):
        for batch in found:
            for row in batch.to_pylist():
                c = Chunk(row, ranges)
                counts = np.bincount(c.tokens[c.trains], minlength=len(c.vocabulary))
                yield _asks(row["chunk"], c.vocabulary[c.sorted], counts[c.sorted], ranges)

    return run


_ANSWER = "chunk long, range int, counts binary, often binary, owned binary, places binary, total long, different long, size long"
_ANSWER_KINDS = {"chunk": pa.int64(), "range": pa.int32(), **dict.fromkeys(["counts", "often", "owned", "places"], pa.binary()), **dict.fromkeys(["total", "different", "size"], pa.int64())}


def _added(words: bool, least: int):
    """Sums of a range's keys, sent back to each chunk: a mark for each asked key, the frequent ones' sums and places among the range's; of words all sums in the order asked.

    ``owned`` marks a frequent key for one of the chunks that have it. ``total``, ``different`` and ``size``, the number of frequent keys, are the range's, once.
    """

    def run(found: pa.Table) -> pa.Table:
        rows = []
        if asked := sorted(found.to_pylist(), key=lambda r: r["chunk"]):
            parts = [unpack_sorted(r["keys"], np.uint64) for r in asked]
            keys, first, at = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
            sums = np.bincount(at, weights=np.concatenate([unpack(r["counts"], np.int32) for r in asked]).astype(np.float64), minlength=len(keys)).astype(np.int64)
            often = sums >= least
            place = np.cumsum(often) - 1
            owned, end = np.zeros(len(at), np.uint8), 0
            owned[first] = 1
            for r, part in zip(asked, parts):
                here, own, end = at[end : end + len(part)], owned[end : end + len(part)], end + len(part)
                some = often[here]
                row = {"chunk": r["chunk"], "range": r["range"], "places": pack(np.diff(place[here[some]], prepend=0)), "counts": pack(sums[here if words else here[some]])}
                rows.append(row | ({} if words else {"often": pack(some.astype(np.uint8)), "owned": pack(own[some])}))
            rows[0] |= {"total": int(sums.sum()), "different": int((sums > 0).sum()), "size": int(often.sum())}
        return pa.table({k: pa.array([r.get(k) for r in rows], t) for k, t in _ANSWER_KINDS.items()})

    return run


def _grow(d: int, s: Settings, ranges: int, least: int, bits: tuple[int, ...] = ()):
    """From the answers about all levels below d: what is asked at level d."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for row in coded.to_pylist():  # one
            c = Chunk(row, ranges, bits)
            c.hear(answers.to_pylist(), d - 1, least)
            at, keys, of = c.candidates(d)
            out.append(_asks(row["chunk"], keys, np.bincount(of, weights=c.trains[at], minlength=len(keys)), ranges, c.key_bits(d)))
        return pa.Table.from_batches(out or [_asks(0, np.zeros(0, np.uint64), np.zeros(0), ranges)])

    return run


_CHUNK = "chunk long, doc_ids array<long>, held binary, lengths binary, tokens binary, counts binary, ids binary"
_CHUNK_KINDS = {"chunk": pa.int64(), "doc_ids": pa.list_(pa.int64()), **dict.fromkeys(["held", "lengths", "tokens", "counts", "ids"], pa.binary())}


def _recoded(ranges: int, least: int):
    """Chunks whose words have counts and numbers in place of hashes, one word for all rare ones of a count."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for row in coded.to_pylist():  # one
            c = Chunk(row, ranges)
            c.hear_words(answers.to_pylist(), least)
            counts, ids = c.words
            _, first, of = np.unique(np.where(counts < least, -1 - counts, np.arange(len(counts))), return_index=True, return_inverse=True)
            tokens = of[c.tokens]
            order = np.lexsort((ids[first], -np.bincount(tokens, minlength=len(first))))  # words that are as common ascend by number
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            rows.append({k: row[k] for k in ("chunk", "doc_ids", "held", "lengths")} | {"tokens": pack(place[tokens]), "counts": pack(counts[first[order]]), "ids": pack_sorted(ids[first[order]])})
        return pa.table({k: pa.array([r[k] for r in rows], t) for k, t in _CHUNK_KINDS.items()})

    return run


_ENTRY = "level int, key long, ctx long, suffix long, c long, n long, m long"


def _entries(s: Settings, ranges: int, least: int, bits: tuple[int, ...]):
    """Rows of the frequent grams of two words and more that a chunk owns: numbers of it, its context and its suffix, and the three's counts."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [pa.table({n: pa.array([], pa.int32() if n == "level" else pa.int64()) for n in ("level", "key", "ctx", "suffix", "c", "n", "m")})]
        for row in coded.to_pylist():  # one
            c = Chunk(row, ranges, bits)
            c.hear(answers.to_pylist(), s.depth, least)
            for d in range(1, s.depth + 1):
                own, ids, n = c.own[d], c.ids, c.n
                parts.append(pa.table({"level": np.full(len(own), d, np.int32), "key": ids[d][own], "ctx": ids[d - 1][own - 1], "suffix": ids[d - 1][own], "c": n[d][own], "n": n[d - 1][own - 1], "m": n[d - 1][own]}))
        return pa.concat_tables(parts)

    return run


def _scored(s: Settings, total: int, different: int, ranges: int, least: int, bits: tuple[int, ...]):
    def run(coded: pa.Table, known: pa.Table) -> pa.Table:
        parts = []
        for row in coded.to_pylist():  # one
            c = Chunk(row, ranges, bits)
            c.hear(known.to_pylist(), s.depth, least, s.discount)
            # of frequent grams: the probability in the longest kept context before the last word
            p = (c.n[0] + 0.5) / (total + 0.5 * (different + 1))
            base = np.log10(p)
            score = base.copy()
            for d in range(1, s.depth + 1):
                if c.rest[d - 1] is None:
                    continue
                inside = np.flatnonzero(c.place >= d)
                left = c.rest[d - 1][inside - 1]
                have = ~np.isnan(left)
                inside, left = inside[have], left[have]
                score[inside] += np.log10(left)
                entry = c.have[d][inside]
                inside, left = inside[entry], left[entry]
                p[inside] = (c.n[d][inside] - s.discount) / c.n[d - 1][inside - 1] + left * p[inside]
                score[inside] = np.log10(p[inside])
            starts = np.cumsum(c.lengths) - c.lengths
            add = lambda x: np.add.reduceat(x, starts)
            parts.append(pa.table({"doc_id": pa.array(c.doc_ids, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.lengths), "n_known": pa.array(add((c.n[0] > 0).astype(np.int64))), "base_score": pa.array(add(base)), "score": pa.array(add(score))}))
        if not parts:
            return pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})
        return pa.concat_tables(parts)

    return run


_KEPT = "level int, chunk long, range int, often binary, counts binary, places binary"


def _kept_part(holds: pa.Table, model: pa.Table) -> pa.Table:
    """For each chunk and level, marks of the kept contexts among the frequent grams that it holds in a range; as ``counts`` their occurrences before no frequent gram's last word, as ``places`` the number of such grams."""
    out: list[tuple] = []
    levels = model["level"].to_numpy()
    for d in np.unique(levels).tolist():
        one = model.filter(pa.array(levels == d))
        order = np.argsort(places := one["place"].to_numpy())
        places, free, number = places[order], one["free"].to_numpy()[order], one["number"].to_numpy()[order]
        for r in holds.to_pylist():
            if r["level"] == d:
                at, have = _found(places, unpack_sorted(r["places"], np.int64))
                if have.any():
                    out.append((-1 - d, r["chunk"], r["range"], pack(have.astype(np.uint8)), pack(free[at[have]]), pack(number[at[have]])))
    kinds = (("level", pa.int32()), ("chunk", pa.int64()), ("range", pa.int32()), ("often", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()))
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate(kinds)})


def _model(entries: list[DataFrame], total: int, different: int, s: Settings) -> DataFrame:
    """Rows level, key, free, number: of a kept context its occurrences before no frequent gram's last word, and the number of such grams."""
    lower, parts, of = None, [], Window.partitionBy("ctx")
    for entry in entries:
        if lower is None:
            rows = entry.withColumn("parent", (F.col("m") + 0.5) / (total + 0.5 * (different + 1)))
        else:
            rows = entry.join(lower.select(F.col("key").alias("suffix"), F.col("p").alias("parent")), "suffix")
        rows = rows.select("key", "ctx", "c", "n", "parent").withColumns({"free": F.col("n") - F.sum("c").over(of), "number": F.count("c").over(of)})
        rows = rows.withColumn("rest", (F.col("free") + s.discount * F.col("number")) / F.col("n"))
        own = lambda less: (F.col("c") - less) / F.col("n") + F.col("rest") * F.col("parent")
        gain = F.sum(F.col("c") * F.log2(own(s.discount + 1) / F.col("parent"))).over(of) + F.col("free") * F.log2("rest")
        rows = rows.withColumn("kept", gain > s.bits)
        # of a gram: its probability in the longest kept context before its last word
        lower = rows.select("key", F.when(F.col("kept"), own(s.discount)).otherwise(F.col("parent")).alias("p"), "ctx", "free", "number", "kept")
        if len(parts) + 1 < len(entries):
            lower = materialize(lower, "tree-level")
        parts.append(lower.filter("kept").groupBy(F.lit(len(parts)).alias("level"), F.col("ctx").alias("key")).agg(F.first("free").alias("free"), F.first("number").alias("number")))
    return reduce(DataFrame.unionByName, parts)


def scores(documents: DataFrame, held_out: Column, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text; trained on those not held out."""
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Buckets(spark, n_parts)
    with shuffles_freed(spark):
        try:
            coded = rows.mapInArrow(_coded(s), _CODED).withColumn("chunk", F.monotonically_increasing_id())
            return _over_chunks(tables.put("coded", coded), tables, n_parts, s)
        finally:
            for table in ("coded", "chunks", "told"):
                tables.drop(table)


class _Buckets:
    """Tables in buckets of chunks, in the shared folder: no later pass over them shuffles them."""

    def __init__(self, spark, n_parts: int):
        self.spark, self.n_parts, self.name, self.paths = spark, n_parts, f"codequarry_{uuid.uuid4().hex}", {}

    def put(self, table: str, rows: DataFrame) -> DataFrame:
        self.paths[table] = f"{shared_folder(self.spark)}/codequarry/{self.name}-{table}"
        rows.write.format("parquet").bucketBy(self.n_parts, "chunk").mode("append").option("path", self.paths[table]).saveAsTable(f"{self.name}_{table}")
        return self.spark.table(f"{self.name}_{table}")

    def tell(self, answers: DataFrame) -> DataFrame:
        """All answers so far."""
        columns = [F.col(c) if c in answers.columns else F.lit(None).cast(kind).alias(c) for c, kind in (x.split() for x in _ANSWER.split(", "))]
        return self.put("told", answers.select("level", *columns).repartition(self.n_parts, "chunk"))

    def drop(self, table: str):
        """The table's files are overwritten by none."""
        if path := self.paths.pop(table, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")
            self.spark.createDataFrame([], "chunk long").write.mode("overwrite").parquet(path)


def _over_chunks(coded: DataFrame, tables: _Buckets, n_parts: int, s: Settings) -> DataFrame:
    counted = coded.agg(F.sum("n").alias("n"), F.sum("n_trains").alias("n_trains")).first()
    tokens, least = counted["n"] or 0, s.frequent(counted["n_trains"] or 0)
    ranges = max(n_parts, -(-tokens // s.range_keys))
    bits: tuple[int, ...] = ()

    def answered(d: int, asked: DataFrame):
        """The answers about the levels up to d, and the sums of that level's ranges."""
        told = tables.tell(asked.groupBy("range").applyInArrow(_added(d == 0, least), _ANSWER).withColumn("level", F.lit(d)))
        sums = told.filter(F.col("level") == d).agg(F.sum("total").alias("total"), F.sum("different").alias("different"), F.max("size").alias("size")).first()
        return told, sums, (*bits, max(1, (ranges * (sums["size"] or 0) - 1).bit_length()))

    def heard(by, schema: str) -> DataFrame:
        """Of each chunk and what it was told about grams; about words it knows."""
        return chunks.groupBy("chunk").cogroup(told.filter("level <> 0").groupBy("chunk")).applyInArrow(by, schema)

    told, sums, bits = answered(0, coded.mapInArrow(_ask_words(ranges), _ASK))
    total, different = sums["total"] or 0, sums["different"] or 0
    chunks = tables.put("chunks", coded.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_recoded(ranges, least), _CHUNK))
    tables.drop("coded")
    for d in range(1, s.depth + 1):
        told, _, bits = answered(d, heard(_grow(d, s, ranges, least, bits), _ASK))
    grams = materialize(heard(_entries(s, ranges, least, bits), _ENTRY), "tree-grams")
    model = _model([grams.filter(F.col("level") == d).drop("level") for d in range(1, s.depth + 1)], total, different, s)
    model = model.select("level", (F.col("key") % ranges).cast("int").alias("range"), F.expr(f"key div {ranges}").alias("place"), "free", "number")
    # contexts are grams of all levels but the last
    holds = told.filter(F.col("level") < s.depth).select("level", "range", "chunk", "places")
    told = tables.tell(holds.groupBy("range").cogroup(model.groupBy("range")).applyInArrow(_kept_part, _KEPT))
    out = heard(_scored(s, total, different, ranges, least, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    out = materialize(out, "tree-scores")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op11_suffix_tree_lm(spark, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out)


def brute_force(rows, s: Settings = Settings()) -> list[tuple]:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text) rows, by plain counting."""
    import zlib
    from collections import Counter

    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    texts = [((*(t or "").encode().translate(fold).split(), None), d is not None and zlib.crc32(str(d).encode()) % 5 == 1, d) for d, t in rows]
    grams = [Counter(w[i : i + d + 1] for w, held, _ in texts if not held for i in range(len(w) - d)) for d in range(s.depth + 1)]
    total, different = sum(grams[0].values()), len(grams[0])
    kept: dict[tuple, tuple[dict, float]] = {}

    def p(context, word):
        while context and context not in kept:
            context = context[1:]
        if not context:
            return (grams[0][word,] + 0.5) / (total + 0.5 * (different + 1))
        entries, rest = kept[context]
        return entries.get(word, 0.0) + rest * p(context[1:], word)

    for d in range(1, s.depth + 1):
        of: dict = {}
        for g, c in grams[d].items():
            if c >= s.frequent(total):
                of.setdefault(g[:-1], {})[g[-1]] = c
        level = {}
        for context, found in of.items():
            n = grams[d - 1][context]
            rest = 1 - sum(c - s.discount for c in found.values()) / n
            gain = (n - sum(found.values())) * math.log2(rest)
            for word, c in found.items():
                parent = p(context[1:], word)
                gain += c * math.log2(((c - 1 - s.discount) / n + rest * parent) / parent)
            if gain > s.bits:
                level[context] = ({w: (c - s.discount) / n for w, c in found.items()}, rest)
        kept |= level
    out = []
    for w, held, d in texts:
        known = sum(grams[0][x,] > 0 for x in w)
        base = sum(math.log10(p((), x)) for x in w)
        out.append((d, held, len(w), known, total, base, sum(math.log10(p(w[max(0, i - s.depth) : i], x)) for i, x in enumerate(w))))
    return out
