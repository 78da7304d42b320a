"""N-gram Jaccard join: components of documents whose shingle sets overlap enough.

Tokens (shingle hashes) are hashed into groups. Documents meet where a whole
group is equal: with more groups than two linked sets can have differences,
some group must be (the number of groups follows the sets' sizes). Every group's
content goes once, packed, to the task of its range, which keeps those that two
sets have; this grows with the input and with nothing else. Texts are read again
for the sets that met only. Documents that met are points of
group counts in an R-tree; the sum of coordinate minima bounds the overlap from
above, for boxes and for points, and the pairs that survive are verified on the
sets themselves.

Equal sets collapse to one representative before anything is paired. Of
representatives that may all be linked with one another, each is paired with
one pivot p only (the one of highest rank). Two of them that are linked, but not both with p,
must share many elements of their differences from p: if they did not, their
distance would be the sum of their distances from p, and both would be near p.
Elements that no second document holds cannot be shared, so each member meets
the others again under a short prefix of the rest, those that p lacks (the
rarer ones) first. Links found so far make components, and only members of different
ones are paired again: a pivot whose members are all in one component has no
keys, a key without a second component is not followed, and keys that a sketch tells to be of one
member alone are never written out. Pivots' ranks fall from round to round, so the rounds end by themselves;
what is paired stays linear for any group of near copies.

Null texts and texts without words have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle. Repeated rows
are equal sets. Rows that share a doc_id are one document with all their links.
Rows with a null doc_id are left out. Extra columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.memory import frugal
from codequarry.llm import sketch
from codequarry.llm.components import components
from codequarry.llm.hashing import Prefix, batches, mix, word_hashes
from codequarry.runtime import materialize, shared_folder, ship, shuffles_freed

#: Coordinates of a count vector.
DIMENSIONS = 128
#: Representatives of one key that one tree takes, where keys are groups of tokens (which many sets share in many ways) and where they are
#: differences from a pivot; more are paired with the key's pivot.
DIRECT, DIRECT_APART = 64, 4096
#: Members that may all be linked and are paired with one another nevertheless, not with a pivot only; for either kind of key.
FEW, FEW_APART = 8, 64
#: Pairs that a task remembers, so as to name them once.
SEEN = 200_000
#: Names of groups that a task gathers before it sends them, and that a task compares, about.
SENT, COMPARED = 1 << 20, 1 << 21
SEEDS = 4
#: The bits of a mark, and of it those of the least number of shared names.
MARK, LEAST = 0x7FF, 0xFF


@dataclass(frozen=True)
class Similarity:
    """Linked if 100 * intersection >= percent * union; shingles of ``words`` words."""

    words: int = 5
    percent: int = 80

    def linked(self, both: int, a: int, b: int) -> bool:
        return 100 * both >= self.percent * (a + b - both)

    def needed(self, total):
        """The overlap that sets of together ``total`` elements need."""
        return -(-self.percent * total // (100 + self.percent))

    def shared_differences(self, n: int, pivot: int, apart: int) -> tuple[int, int]:
        """Of the differences from a pivot of ``pivot`` elements: how many a set of ``n``, ``apart`` from it, shares at least with a linked set.

        First if that set is not linked with the pivot, then whatever it is. Linked sets differ by (100 - percent) / (100 + percent)
        of their summed sizes at most, sets that are not linked by more, and two sets by apart + other - 2 * shared.
        """
        c = 100 + self.percent
        return max(1, (c * apart + (100 - self.percent) * (pivot - n)) // (2 * c) + 1), max(1, apart - (100 - self.percent) * n // self.percent)

    def size_class(self, n: int) -> int:
        """Linked sets have the same class or neighbouring ones."""
        c = int(math.log(n) / math.log(100 / self.percent))
        while self.low(c + 1) <= n:
            c += 1
        while self.low(c) > n:
            c -= 1
        return c

    def low(self, c: int) -> float:
        return (100 / self.percent) ** c

    def differences(self, c: int) -> int:
        """The most elements that two linked sets differ by, if the smaller one is of class c."""
        return int(self.low(c + 1) * (100 - self.percent) / self.percent * (1 + 1e-9))

    def groups(self, c: int) -> int:
        """How many groups sets of class c are hashed into: more than they can differ by, and as many again as will be empty."""
        least = self.differences(c) + 1
        empty = least * math.exp(-self.low(c) / least)
        return least + math.ceil(1.5 * empty + 2 * math.sqrt(empty))


def shingles(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    values, offsets = word_hashes(texts, lower=True)
    prefix = Prefix(values)
    grams = prefix.every(words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            out.append(mix(prefix.span(np.array([a]), np.array([b]))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(tokens: np.ndarray, s: Similarity):
    """Numbers for the groups' contents, in the set's own size class and the one below: (numbers, mark) for each class and hash.

    Empty groups would be equal everywhere and give no signature. A set with
    more groups in use than linked sets can differ by shares as many as it has more with
    every partner that is grouped by that hash; one with fewer is grouped again by another hash. Under each
    hash it still shows its groups in use, for partners that stop there. The
    last hash keeps the empty ones too. The mark tells a set's classes and hashes apart and holds how many numbers any partner shares, at least.
    """
    c = s.size_class(len(tokens))
    for k in (c, c - 1):
        if k < 0:
            continue
        n = s.groups(k)
        for seed in range(SEEDS):
            label = np.uint64((k * SEEDS + seed + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            mixed = mix(tokens ^ label)
            group = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, group, mix(mixed))
            used = np.bincount(group, minlength=n) > 0
            named = mix(sums ^ mix(np.arange(n, dtype=np.uint64) + label))
            more = int(used.sum()) - s.differences(k)
            yield named if seed == SEEDS - 1 and more < 1 else named[used], (k & 1) << 10 | seed << 8 | min(max(more, 1), LEAST)
            if more > 0:
                break


def signatures(tokens: np.ndarray, s: Similarity) -> np.ndarray:
    return np.concatenate([names for names, _ in signed(tokens, s)])


def count_vector(tokens: np.ndarray) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(57)).astype(np.int64), minlength=DIMENSIONS).astype(np.uint16 if len(tokens) < 65536 else np.uint32)


def _describe(s: Similarity):
    def run(found):
        for batch in found:
            for first, texts in batches(batch.column(1)):
                rows = [(len(t), *(set_name(t) if len(t) else (0, 0))) for t in shingles(texts, s.words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], ["doc_id", "n", "set_a", "set_b"])

    return run


def set_name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the set."""
    a, b = (int(np.add.reduce(mix(tokens ^ np.uint64(x))).view(np.int64)) for x in (0x1234567, 0xABCDEF01234567))
    return a, b


def packed(counts: np.ndarray) -> bytes:
    return counts.astype("u1" if counts.max(initial=0) < 256 else "<u4").tobytes()


def unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(counts, "u1" if len(counts) == DIMENSIONS else "<u4")


def _among(docs: DataFrame):
    """Says of doc_ids whether they may be among those of ``docs``, in a bitmap of fixed size: never a wrong no."""

    def ids(batch):
        yield mix(batch.column(0).to_numpy().view(np.uint64))

    return docs.sparkSession.sparkContext.broadcast(sketch.held(docs, ids))


def _of(docs: DataFrame, among) -> DataFrame:
    """Rows (doc_id, text) of documents that may be among those."""

    def run(found):
        for batch in found:
            yield batch.filter(pa.array(among.value(mix(batch.column(0).to_numpy().view(np.uint64)))))

    return docs.mapInArrow(frugal(run), "doc_id long, text binary")


def _sent(s: Similarity, parts: int):
    """Of texts (doc_id, text): rows (part, names, reps) of packed group names, marks in their last bits, and the sets that have them; a part is a range of names."""

    def packed(names, reps):
        part = ((names >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(bounds))
        offsets = pa.py_buffer((bounds[np.r_[used, parts]] * 8).astype(np.int32).tobytes())
        column = lambda x: pa.Array.from_buffers(pa.binary(), len(used), [None, offsets, pa.py_buffer(x[order].tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), column(names), column(reps)], ["part", "names", "reps"])

    def run(found):
        names, reps, size = [], [], 0
        for batch in found:
            for _, texts in batches(batch.column(1)):
                for t in shingles(texts, s.words):
                    if len(t):
                        mine = np.concatenate([(x | np.uint64(MARK)) ^ np.uint64(MARK ^ mark) for x, mark in signed(t, s)])
                        names.append(mine)
                        reps.append(np.full(len(mine), set_name(t)[0]))
                        size += len(mine)
                    if size >= SENT:
                        yield packed(np.concatenate(names), np.concatenate(reps))
                        names, reps, size = [], [], 0
        if size:
            yield packed(np.concatenate(names), np.concatenate(reps))

    return run


def _shared_names(found):
    """Of a part's packed names and sets: rows (key, rep, mark), once each, of names that two sets or more have."""
    rows = [(np.frombuffer(n, np.uint64), np.frombuffer(r, np.int64)) for batch in found for n, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
    if not rows:
        return
    name, rep = (np.concatenate(x) for x in zip(*rows))
    del rows
    mark_of = np.uint64(MARK)

    def met(key):
        same = key[1:] == key[:-1]
        return np.r_[same, False] | np.r_[False, same]

    order = np.argsort(name)
    name, rep = name[order], rep[order]
    more = met(name | mark_of)
    name, rep = name[more], rep[more]
    order = np.lexsort((rep, name | mark_of))
    name, rep = name[order], rep[order]
    key = name | mark_of
    once = np.r_[True, (key[1:] != key[:-1]) | (rep[1:] != rep[:-1])][: len(key)]
    name, rep, key = name[once], rep[once], key[once]
    if len(key):
        more = met(key)
        yield pa.RecordBatch.from_arrays([pa.array(key[more].view(np.int64)), pa.array(rep[more]), pa.array((name & mark_of)[more].astype(np.int32))], ["key", "rep", "mark"])


def _met(docs: DataFrame, reps: DataFrame, s: Similarity) -> DataFrame:
    """key, rep and weight (how many keys the set has) of the group names that two of the sets ``reps`` (n, set_a, set_b, doc) or more have."""
    total = reps.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total * (100 - s.percent) // s.percent // COMPARED)
    sent = _of(docs, _among(reps.select("doc"))).mapInArrow(frugal(_sent(s, parts)), "part int, names binary, reps binary")
    met = sent.repartitionById(parts, F.col("part")).mapInArrow(frugal(_shared_names), "key long, rep long, mark int")
    # a set shares as many names of a class and hash as its mark says with any partner, or it has none there
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("rep", "mark"))).filter(f"n >= (mark & {LEAST})")
    return met.select("key", "rep", F.count("*").over(Window.partitionBy("rep")).alias("weight"))


def _tokens(s: Similarity):
    """Of rows (rep, doc, weight, text): those whose text is the set that ``rep`` names, with tokens and counts."""

    def run(found):
        for batch in found:
            at = 0
            for _, texts in batches(batch.column(3)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                sets = shingles(texts, s.words)
                mine = [i for i, (rep, t) in enumerate(zip(part.column(0).to_pylist(), sets)) if len(t) and set_name(t)[0] == rep]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(k).take(pa.array(mine, pa.int64())) for k in range(3)),
                        pa.array([sets[i].tobytes() for i in mine], pa.binary()),
                        pa.array([packed(count_vector(sets[i])) for i in mine], pa.binary()),
                    ],
                    ["rep", "doc", "weight", "tokens", "counts"],
                )

    return run


class CountTree:
    """An R-tree over count vectors, bulk-loaded by halving along the widest coordinate."""

    LEAF = 32

    def __init__(self, points: np.ndarray):
        self.points, self.totals = points, points.sum(axis=1, dtype=np.int64)
        self.depth = 0
        self.root = self._node(np.arange(len(points)), 1)

    def _node(self, rows, depth):
        self.depth = max(self.depth, depth)
        box, least = self.points[rows].max(axis=0), self.totals[rows].min()
        if len(rows) <= self.LEAF:
            return box, least, rows, ()
        spread = np.ptp(self.points[rows], axis=0)
        rows = rows[np.argsort(self.points[rows, np.argmax(spread)], kind="stable")]
        half = len(rows) // 2
        return box, least, rows, (self._node(rows[:half], depth + 1), self._node(rows[half:], depth + 1))

    def pairs(self, s: Similarity) -> np.ndarray:
        """Which pairs of points have coordinate minima that reach, in sum, the overlap a link needs: boxes against boxes, then points."""
        out = np.zeros((len(self.points), len(self.points)), bool)
        todo = [(self.root, self.root)]
        while todo:
            x, y = todo.pop()
            if np.minimum(x[0], y[0]).sum(dtype=np.int64) < s.needed(x[1] + y[1]):
                continue
            if x[3] or y[3]:
                wide, narrow = (x, y) if len(x[2]) >= len(y[2]) and x[3] else (y, x)
                if x is y:
                    todo += [(x[3][0], x[3][0]), (x[3][0], x[3][1]), (x[3][1], x[3][1])]
                else:
                    todo += [(c, narrow) for c in wide[3]]
            else:
                both = np.minimum(self.points[x[2]][:, None, :], self.points[y[2]][None, :, :]).sum(axis=2, dtype=np.int64)
                fine = both >= s.needed(self.totals[x[2]][:, None] + self.totals[y[2]][None, :])
                out[np.ix_(x[2], y[2])] = fine
                out[np.ix_(y[2], x[2])] = fine.T
        return out


def pivot_pairs(near: np.ndarray, rank: list, few: int, wanted: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """Of members and which of them may be linked: (member, pivot, True) for those near a pivot, and all other pairs of near ones.

    Pivots are taken by falling rank; each takes its neighbours that no pivot has yet. What two members near one pivot
    have to do with each other is left to the keys of their differences from it. Of near pairs only ``wanted`` ones matter
    (all, if not given): they decide whether a pivot is needed, but not which members it takes, or two large groups that
    are apart would be paired each with each.
    """
    n, out = len(near), []
    wanted = near if wanted is None else wanted
    pivot = np.full(n, -1)
    for p in sorted(range(n), key=rank.__getitem__, reverse=True):
        if pivot[p] < 0:
            mine = np.flatnonzero(near[p] & (pivot < 0))
            pivot[mine] = pivot[p] = p
            some = np.union1d(mine, p)
            i, k = np.nonzero(np.triu(wanted[np.ix_(some, some)], 1))
            if len(mine) >= few and 2 * len(i) >= (few - 1) * len(mine):
                out += [(i, p, True) for i in mine.tolist() if i != p]
            else:
                out += [(a, b, False) for a, b in zip(some[i].tolist(), some[k].tolist())]
    i, k = np.nonzero(np.triu(wanted, 1) & (pivot[:, None] != pivot[None, :]))
    return out + [(a, b, False) for a, b in zip(i.tolist(), k.tolist())]


def _tree_pairs(s: Similarity, few: int):
    """Of rows (cell, rep, weight, joined, component, counts) sorted by cell: pairs of representatives to verify, and whether others depend on them.

    A pair is named the same way in every cell, the lower rank first, so that it is verified once; cells that have most
    members in common come one after another, and what was named lately is not named again. Only pairs of different
    components are wanted, and where some are joined with a pivot, of those a joined one with another.
    """

    def flush(rows):
        near = CountTree(np.stack([unpacked(r[5]) for r in rows])).pairs(s)
        joined, component = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        wanted = near & (component[:, None] != component[None, :])
        if joined.any():
            wanted &= joined[:, None] ^ joined[None, :]
        rank = [(r[2], r[1]) for r in rows]
        pairs = [(*sorted((i, k), key=rank.__getitem__), wide) for i, k, wide in pivot_pairs(near, rank, few, wanted)]
        return [(rows[i][1], rows[k][1], wide) for i, k, wide in pairs]

    def batch_of(pairs):
        types = (pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate(types)], ["a", "b", "wide"])

    def run(found):
        held, out, seen = [], [], set()

        def fresh(rows):
            if len(seen) > SEEN:
                seen.clear()
            pairs = [p for p in flush(rows) if p not in seen]
            seen.update(pairs)
            return pairs

        for batch in found:
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if held and row[0] != held[0][0]:
                    out += fresh(held)
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if held:
            out += fresh(held)
        if out:
            yield batch_of(out)

    return run


def keys_of(x: np.ndarray, y: np.ndarray, both: int, linked: bool, pivot: int, shared, s: Similarity) -> np.ndarray:
    """The keys under which x meets others that the pivot y does not join it with.

    Of the differences, only those that x may have in common with another set count, and of these a prefix that must hold
    a shared one. Two sets that are both not linked with the pivot meet under even keys, two of which one is linked under odd ones.
    """
    new = x[~np.isin(x, y, assume_unique=True)]
    differ = np.concatenate([new[shared(new)], y[~np.isin(y, x, assume_unique=True)]])
    apart, other = s.shared_differences(len(x), len(y), len(x) + len(y) - 2 * both)
    label = mix(np.array([pivot], np.int64).view(np.uint64))
    part = lambda least, kind: mix(differ[: max(0, len(differ) - least + 1)] ^ label) & ~np.uint64(1) | np.uint64(kind)
    return part(apart, 1) if linked else np.concatenate([part(apart, 0), part(other, 1)])


def _verify(s: Similarity, shared):
    """Of pairs with both sets: whether they are linked, and the keys under which a meets others near its pivot b."""

    def run(found):
        common = shared.value
        for batch in found:
            rows = []
            for a, b, wide, doc_a, doc_b, weight, x, y in zip(*(batch.column(k).to_pylist() for k in range(8))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked = s.linked(both, len(x), len(y))
                keys = keys_of(x, y, both, linked, b, common, s).view(np.int64).tolist() if wide else []
                rows.append((a, doc_a, doc_b, weight, linked, keys))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["rep", "a", "b", "weight", "linked", "keys"])

    return run


def _followed(wide: DataFrame) -> DataFrame:
    """Rows key, rep, weight, joined, component of rows (rep, weight, linked, component, keys), but for keys that no second row has (by a merged sketch).

    Nobody is met under those, and they are most of the keys.
    """

    def keys(batch):
        yield batch.column(4).flatten().to_numpy().view(np.uint64)

    again = wide.sparkSession.sparkContext.broadcast(sketch.repeated(wide, keys))

    def run(found):
        for batch in found:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                held = part.column(4).flatten()
                keep = pa.array(np.flatnonzero(again.value(held.to_numpy().view(np.uint64))))
                of = pc.list_parent_indices(part.column(4)).take(keep)
                yield pa.RecordBatch.from_arrays([held.take(keep), *(part.column(k).take(of) for k in range(4))], ["key", "rep", "weight", "joined", "component"])

    return wide.mapInArrow(frugal(run), "key long, rep long, weight long, joined boolean, component long")


def _bucketed(rows: DataFrame, column: str) -> str:
    """The name of a table with these rows, bucketed by a column, in the shared folder: every round joins it without a shuffle of its own."""
    spark, name = rows.sparkSession, f"codequarry_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    written = rows.repartition(n, column).write.format("parquet").bucketBy(n, column).sortBy(column)
    written.option("path", f"{shared_folder(spark)}/codequarry/{name}").saveAsTable(name)
    return name


def _links(met: DataFrame, sets: DataFrame, s: Similarity, shared) -> DataFrame | None:
    """(node, component) of the documents with links; ``met`` has key, rep and weight, ``sets`` rep, doc, weight, tokens and counts.

    ``joined`` marks members of a key that are linked with the key's pivot; ``component`` is that of the links found so far.
    """
    found, first = None, True
    met = met.withColumn("joined", F.lit(False)).withColumn("component", F.col("rep"))
    while True:
        keys = met.groupBy("key").agg(
            F.count("*").alias("n"), F.max(F.struct("weight", "rep")).alias("top"), F.bool_and("joined").alias("all"), F.bool_or("joined").alias("some"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        keys = keys.filter("low < high" if first else "low < high and not all and (some or key % 2 = 0)")
        here = materialize(met.join(keys.select("key", "n", F.col("top.rep").alias("pivot")), "key").select("key", "rep", "joined", "component", "n", "pivot"), "met")
        if here.isEmpty():
            return found
        direct = DIRECT if first else DIRECT_APART
        lists = here.filter(F.col("n") <= direct).groupBy("key", "pivot").agg(F.sort_array(F.collect_set(F.struct("rep", "joined", "component"))).alias("reps")).select("pivot", "reps").distinct()
        cells = lists.select("pivot", F.xxhash64("reps").alias("cell"), F.explode("reps").alias("x")).select("pivot", "cell", "x.*")
        near = (
            cells.join(sets.select("rep", "weight", "counts"), "rep")
            .repartitionByRange(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pivot", "cell")
            .sortWithinPartitions("pivot", "cell")
            .select("cell", "rep", "weight", "joined", "component", "counts")
            .mapInArrow(frugal(_tree_pairs(s, FEW if first else FEW_APART)), "a long, b long, wide boolean")
        )
        stars = here.filter((F.col("n") > direct) & (F.col("rep") != F.col("pivot"))).select(F.col("rep").alias("a"), F.col("pivot").alias("b"), F.lit(True).alias("wide"))
        pairs = near.unionByName(stars).groupBy("a", "b").agg(F.max("wide").alias("wide"))
        side = lambda c, doc, tokens: sets.select(F.col("rep").alias(c), F.col("doc").alias(doc), F.col("tokens").alias(tokens), *(["weight"] if c == "a" else []))
        checked = materialize(
            pairs.join(side("a", "doc_a", "x"), "a")
            .join(side("b", "doc_b", "y"), "b")
            .select("a", "b", "wide", "doc_a", "doc_b", "weight", "x", "y")
            .mapInArrow(frugal(_verify(s, shared)), "rep long, a long, b long, weight long, linked boolean, keys array<long>"),
            "links",
        )
        links = checked.filter("linked").select("a", "b")
        found = components(links if found is None else links.unionByName(found.toDF("a", "b")))
        wide = checked.filter(F.size("keys") > 0).join(found.withColumnRenamed("node", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
        # keys are told apart by their pivot b: where its members are one component already, nobody is left to meet
        several = wide.groupBy("b").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("b")
        wide = materialize(wide.join(several, "b", "left_semi").select("rep", "weight", "linked", "component", "keys"), "wide")
        if wide.isEmpty():
            return found
        met = materialize(_followed(wide), "followed").groupBy("key", "rep", "weight", "component").agg(F.bool_and("joined").alias("joined"))
        first = False


def classes(documents: DataFrame, s: Similarity = Similarity()) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable by links; one row per row with a doc_id."""
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).filter("doc_id is not null")

    def tokens(batch):
        yield np.concatenate([np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()])

    by_set = ["n", "set_a", "set_b"]
    with shuffles_freed(spark):
        described = materialize(docs.mapInArrow(frugal(_describe(s)), "doc_id long, n long, set_a long, set_b long"), "shingles")
        reps = materialize(described.filter("n > 0").groupBy(*by_set).agg(F.min("doc_id").alias("doc")), "sets")
        met = materialize(_met(docs, reps, s), "keys")
        wanted = met.groupBy("rep").agg(F.first("weight").alias("weight"))
        wanted = materialize(reps.select(F.col("set_a").alias("rep"), "doc").join(wanted, "rep").select("doc", "rep", "weight"), "wanted")
        sets = _of(docs, _among(wanted.select("doc"))).join(wanted, F.col("doc_id") == F.col("doc")).select("rep", "doc", "weight", "text")
        table = _bucketed(sets.mapInArrow(frugal(_tokens(s)), "rep long, doc long, weight long, tokens binary, counts binary").dropDuplicates(["rep"]), "rep")
        shared = spark.sparkContext.broadcast(sketch.repeated(spark.table(table).select("tokens"), tokens))
        of = _links(met, spark.table(table), s, shared)
    spark.sql(f"DROP TABLE {table}")  # its files stay in the shared folder
    out = described.select("doc_id", F.col("n").alias("n_shingles"), *[F.col(k).alias(f"of_{k}") for k in by_set])
    same = [F.col(f"of_{k}") == F.col(k) for k in by_set]
    out = out.join(reps.select(*by_set, "doc"), same[0] & same[1] & same[2], "left")
    if of is not None:
        out = out.join(of.withColumnRenamed("node", "doc"), "doc", "left")
    else:
        out = out.withColumn("component", F.lit(None).cast("long"))
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc", "doc_id").alias("component_id"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), Similarity(3, 90))


def brute_force(rows, s: Similarity) -> dict:
    """{doc_id: (shingles, component)} of (doc_id, text) rows with distinct ids, by comparing all pairs."""
    sets = {}
    fold = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    for d, t in rows:
        w = (t or "").encode().translate(fold).split()
        sets[d] = {tuple(w[i : i + s.words]) for i in range(len(w) - s.words + 1)} if len(w) >= s.words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            na, nb = len(sets[a]), len(sets[b])
            if na and nb and 100 * min(na, nb) >= s.percent * max(na, nb) and s.linked(len(sets[a] & sets[b]), na, nb):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}
