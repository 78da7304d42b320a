"""Hard negatives by dual-tree search over anchors and candidates.

Rows are dealt into blocks by a tree of median splits, learned from a bounded
sample (``Settings.sample_rows``, the first in the order of a hash of vec_id);
a leaf of it with more rows than a block is dealt on by a hash, so that equal
vectors, however many, fill no block. Blocks are the roots: two summaries
(centre, radius, labels, what the anchors ask for) bound all inner products
between two blocks, and a pair that cannot hold what any of its anchors asks
for is never shipped. Within a pair of blocks both sides have a tree of balls;
an anchor node meets lists of candidate nodes, intervals of inner products
prune them for its whole group at once, and what is left at the leaves is
scored exactly, best bounds first.

A search has two rounds: each anchor block meets the candidate blocks of its
own leaf, and what that finds is the floor with which all others are pruned.
There are two searches: positives (same label, the best), then negatives
(another label, the best inside the band that each positive sets). Nothing is
left out but by a bound, so results are exact.

Components are floored after scaling by ``SCALE`` and scores are integers. Rows
with a null label, vec_id or vector, a null or non-finite component, another
length than most, or a scaled component beyond ``LARGEST`` (scores might not
fit 64 bits) take no part. A vec_id that occurs more than once counts each time.
Equal scores go to the smaller vec_id. A positive that does not score above
zero has no negatives but at score zero. Empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.runtime import materialize, ship

SCALE, LARGEST = 256, 2**24
NONE = -(2**62)  # below every score


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 3
    anchor_block: int = 512
    candidate_block: int = 4096
    leaf: int = 48
    sample_rows: int = 8192
    #: Levels of the tree that deals rows into blocks, at most.
    deepest: int = 9


def usable(rows: DataFrame, label: Column) -> DataFrame:
    """row, vec_id, label and v (scaled and floored) of the rows that take part."""
    v = F.col("embedding")
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < LARGEST))
    good = rows.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(scaled, lambda x: x.cast("int")).alias("v"))
    usual = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return good.filter(F.size("v") == (usual.n if usual else 0)).withColumn("row", F.monotonically_increasing_id())


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _splits(x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and threshold of the inner nodes of a tree of median splits, in heap order."""
    dims, cuts = np.zeros(2**depth, np.int64), np.zeros(2**depth)

    def split(node, rows):
        if node >= 2**depth:
            return
        if len(rows):
            d = int(np.argmax(x[rows].var(axis=0)))
            dims[node], cuts[node] = d, np.median(x[rows, d])
        left = x[rows, dims[node]] <= cuts[node]
        split(2 * node, rows[left])
        split(2 * node + 1, rows[~left])

    split(1, np.arange(len(x)))
    return dims, cuts


def _leaf_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    for _ in range(len(dims).bit_length() - 1):
        node = 2 * node + (x[np.arange(len(x)), dims[node]] > cuts[node])
    return node - len(dims)


class Balls:
    """A binary tree of balls over the rows of ``x``; nodes are numbered, children -1 at leaves."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.begin, self.end, self.left, self.right = [], [], [], []
        self._grow(x, 0, len(x), leaf)
        self.x, labels = x[self.order], labels[self.order]
        self.begin, self.end, self.left, self.right = (np.array(a, np.int64) for a in (self.begin, self.end, self.left, self.right))
        spans = list(zip(self.begin.tolist(), self.end.tolist()))
        self.center = np.array([self.x[a:b].mean(axis=0) for a, b in spans])
        self.radius = np.array([np.sqrt(((self.x[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(spans, self.center)])
        self.norm = np.sqrt((self.center**2).sum(axis=1))
        bits = np.left_shift(np.uint64(1), (labels % 64).astype(np.uint64))
        self.bits = np.array([np.bitwise_or.reduce(bits[a:b]) for a, b in spans], np.uint64)
        self.one = np.array([labels[a] if (labels[a:b] == labels[a]).all() else -(2**62) for a, b in spans], np.int64)

    def _grow(self, x, a, b, leaf) -> int:
        node = len(self.begin)
        self.begin.append(a), self.end.append(b), self.left.append(-1), self.right.append(-1)
        if b - a > leaf:
            rows = self.order[a:b]
            part = x[rows]
            d = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            if part[:, d].max() > part[:, d].min():  # equal rows stay one leaf
                m = a + (b - a) // 2
                self.order[a:b] = rows[np.argpartition(part[:, d], m - a)]
                self.left[node] = self._grow(x, a, m, leaf)
                self.right[node] = self._grow(x, m, b, leaf)
        return node


def interval(a_center, a_radius, c_center, c_radius) -> tuple[np.ndarray, np.ndarray]:
    """What inner products of members of balls may be, with room for rounding; the second side may hold many balls."""
    middle = c_center @ a_center
    a_norm, c_norm = np.sqrt(a_center @ a_center), np.sqrt((c_center**2).sum(axis=1))
    spread = a_norm * c_radius + a_radius * (c_norm + c_radius)
    spread = spread * (1 + 1e-9) + 1e-9 * np.abs(middle) + 1
    return middle - spread, middle + spread


class Best:
    """The k best (score, vec_id, row) of each slot of each anchor, and the scores that still count."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.held = [[(np.zeros(0, np.int64),) * 3 for _ in row] for row in low]

    def offer(self, i: int, scores, ids, rows) -> None:
        for j in range(len(self.low[i])):
            at = np.flatnonzero((scores >= self.low[i, j]) & (scores <= self.high[i, j]))
            if len(at):
                s, v, r = (np.concatenate([old, new]) for old, new in zip(self.held[i][j], (scores[at], ids[at], rows[at])))
                order = np.lexsort((r, v, -s))[: self.k]
                self.held[i][j] = s[order], v[order], r[order]
                if len(order) == self.k:
                    self.low[i, j] = max(self.low[i, j], s[order[-1]])


def _dual(anchors: Balls, a_rows, a_labels, candidates: Balls, c_ids, c_rows, c_labels, best: Best, same: bool) -> None:
    """Offers ``best`` every candidate that an anchor may ask for."""
    a, c = anchors, candidates
    exact = float(np.abs(a.x).max(initial=0)) * float(np.abs(c.x).max(initial=0)) * a.x.shape[1] < 2**53
    ax, cx = (a.x.astype(np.float64), c.x.astype(np.float64)) if exact else (a.x, c.x)

    def open_nodes(node, nodes):
        """The candidate nodes that may hold something for the anchor node, best bound first, with the bounds."""
        members = slice(a.begin[node], a.end[node])
        low, high = best.low[members].min(initial=2**62), best.high[members].max(initial=NONE)
        least, most = interval(a.center[node], a.radius[node], c.center[nodes], c.radius[nodes])
        keep = (most >= low) & (least <= high)
        keep &= (c.bits[nodes] & a.bits[node]) != 0 if same else ~((c.one[nodes] == a.one[node]) & (a.one[node] != -(2**62)))
        order = np.argsort(-most[keep], kind="stable")
        return nodes[keep][order], most[keep][order]

    def children(nodes):
        inner = c.left[nodes] >= 0
        return np.concatenate([nodes[~inner], c.left[nodes[inner]], c.right[nodes[inner]]])

    def score(node, nodes):
        cols = np.concatenate([np.arange(c.begin[n], c.end[n]) for n in nodes.tolist()])
        found = (ax[a.begin[node] : a.end[node]] @ cx[cols].T).astype(np.int64)
        for k, i in enumerate(range(a.begin[node], a.end[node])):
            fit = (c_labels[cols] == a_labels[i]) == same
            fit &= c_rows[cols] != a_rows[i]
            fit &= (found[k] >= best.low[i].min(initial=2**62)) & (found[k] <= best.high[i].max(initial=NONE))
            if fit.any():
                best.offer(i, found[k][fit], c_ids[cols][fit], c_rows[cols][fit])

    def visit(node, nodes):
        nodes, _ = open_nodes(node, nodes)
        if not len(nodes):
            return
        if a.left[node] >= 0:
            nodes = children(nodes)
            visit(a.left[node], nodes)
            visit(a.right[node], nodes)
            return
        while (c.left[nodes] >= 0).any():
            nodes, _ = open_nodes(node, children(nodes))
        step = 4
        while len(nodes):
            score(node, nodes[:step])
            nodes, _ = open_nodes(node, nodes[step:])
            step = min(64, step * 2)

    visit(0, np.zeros(1, np.int64))


_FOUND = "row long, slot int, c_row long, c_vec_id long, score long"


def _met(k: int, same: bool, leaf: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if anchors.num_rows and candidates.num_rows:
            ax, al = matrix(anchors["v"]), anchors["label"].to_numpy()
            cx, cl = matrix(candidates["v"]), candidates["label"].to_numpy()
            a, c = Balls(ax, al, leaf), Balls(cx, cl, leaf)
            rows, ids, c_rows = anchors["row"].to_numpy()[a.order], candidates["vec_id"].to_numpy()[c.order], candidates["row"].to_numpy()[c.order]
            slots = max(len(x) for x in anchors["low"].to_pylist())
            ask = lambda name, none: np.array([x + [none] * (slots - len(x)) for x in anchors[name].to_pylist()], np.int64).reshape(len(ax), slots)[a.order]
            best = Best(ask("low", 2**62), ask("high", NONE), k)
            _dual(a, rows, al[a.order], c, ids, c_rows, cl[c.order], best, same)
            for i, row in enumerate(rows.tolist()):
                for j, (s, v, r) in enumerate(best.held[i]):
                    for column, x in zip(out, ([row] * len(s), [j] * len(s), r.tolist(), v.tolist(), s.tolist())):
                        column += x
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["row", "slot", "c_row", "c_vec_id", "score"])

    return run


def _summed(asks: bool):
    """Per block: centre, radius, labels; for anchors also the least and greatest score that one asks for."""

    def run(block: pa.Table) -> pa.Table:
        x, labels = matrix(block["v"]), block["label"].to_numpy()
        b = Balls(x, labels, len(x))
        flat = lambda name: block[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        low, high = (int(flat("low").min(initial=2**62)), int(flat("high").max(initial=NONE))) if asks else (0, 0)
        return pa.table({"block": block["block"][:1], "center": pa.array([b.center[0].tolist()], pa.list_(pa.float64())), "radius": [float(b.radius[0])], "bits": pa.array(b.bits[:1].view(np.int64)), "one": pa.array(b.one[:1]), "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64())})

    return run


_SUMMARY = "block long, center array<double>, radius double, bits long, one long, low long, high long"
#: Summaries that meet in one task.
_TILE = 512


def _pairs(anchors: DataFrame, candidates: DataFrame, same: bool) -> DataFrame:
    """(a, c) of blocks that may hold something an anchor asks for, of two tables of summaries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_a, out_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            center = np.array(right["center"].to_pylist())
            radius, bits, one, ids = (right[n].to_numpy() for n in ("radius", "bits", "one", "block"))
            for x in left.to_pylist():
                least, most = interval(np.array(x["center"]), x["radius"], center, radius)
                keep = (most >= x["low"]) & (least <= x["high"])
                keep &= (bits & np.int64(x["bits"])) != 0 if same else ~((one == x["one"]) & (x["one"] != -(2**62)))
                out_c.append(ids[keep])
                out_a.append(np.full(keep.sum(), x["block"]))
        return pa.table({"a": pa.array(np.concatenate(out_a)), "c": pa.array(np.concatenate(out_c))})

    tiles = lambda df: max(1, -(-df.count() // _TILE))
    n_a, n_c = tiles(anchors), tiles(candidates)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tile = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = anchors.withColumn("ta", tile(n_a)).withColumn("tc", every(n_c))
    right = candidates.withColumn("tc", tile(n_c)).withColumn("ta", every(n_a))
    return left.groupBy("ta", "tc").cogroup(right.groupBy("ta", "tc")).applyInArrow(run, "a long, c long")


def _asked(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, k: int, same: bool, s: Settings) -> DataFrame:
    """What the anchors find in the candidates of these pairs of blocks."""
    left = anchors.withColumnRenamed("block", "a").join(pairs, "a").select("a", "c", "row", "label", "v", "low", "high")
    right = candidates.withColumnRenamed("block", "c").join(pairs, "c").select("a", "c", "row", "vec_id", "label", "v")
    return left.groupBy("a", "c").cogroup(right.groupBy("a", "c")).applyInArrow(_met(k, same, s.leaf), _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "c_vec_id", "c_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, candidates: DataFrame, k: int, same: bool, s: Settings) -> DataFrame:
    """The first k of what each slot of each anchor asks for: row, slot, c_row, c_vec_id, score, rank.

    ``anchors`` has row, label, v, block, leaf, and arrays low and high, an entry for each slot.
    """
    summaries = materialize(candidates.groupBy("block").applyInArrow(_summed(False), _SUMMARY), "negatives-blocks")
    home = anchors.select(F.col("block").alias("a"), "leaf").distinct().join(candidates.select(F.col("block").alias("c"), "leaf").distinct(), "leaf").select("a", "c")
    home = materialize(home, "negatives-home")
    near = materialize(_first(_asked(anchors, candidates, home, k, same, s), k), "negatives-near")
    floors = near.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("floor"))
    raised = F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at(F.col("floor"), i), x)))
    anchors = materialize(anchors.join(floors, "row", "left").withColumn("low", raised).drop("floor"), "negatives-anchors")
    pairs = _pairs(materialize(anchors.groupBy("block").applyInArrow(_summed(True), _SUMMARY), "negatives-asking"), summaries, same)
    rest = materialize(pairs.join(home, ["a", "c"], "left_anti"), "negatives-pairs")
    return _first(near.drop("rank").unionByName(_asked(anchors, candidates, rest, k, same, s)), k)


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """Adds block: a leaf's rows, dealt by a hash into as many blocks as they fill."""
    counts = rows.groupBy("leaf").count()  # at most 2**deepest rows
    found = {r["leaf"]: -(-r["count"] // size) for r in counts.collect()}
    parts = F.create_map(*[F.lit(x) for leaf, n in sorted(found.items()) for x in (leaf, n)]) if found else F.lit(None).cast("map<int,int>")
    return rows.withColumn("block", F.col("leaf").cast("long") * (1 << 32) + F.pmod(F.xxhash64("row"), parts[F.col("leaf")]))


def mine(rows: DataFrame, anchor: Column, label: Column, low: Column, high: Column, s: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``low`` and ``high`` are the bounds of a negative's score, made of positive_score.
    """
    spark = rows.sparkSession
    ship(spark)
    good = materialize(usable(rows, label), "negatives-rows")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(s.sample_rows).select("v").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    depth = min(s.deepest, max(0, int(np.ceil(np.log2(max(1, good.count() / s.candidate_block))))))
    dims, cuts = _splits(matrix(sample["v"]).astype(np.float64), depth)

    def placed(batches):
        for b in batches:
            x = matrix(b.column("v")) if b.num_rows else np.zeros((0, 1), np.int64)
            yield b.append_column("leaf", pa.array(_leaf_of(x, dims, cuts), pa.int32()))

    placed_rows = materialize(good.mapInArrow(placed, "vec_id long, label long, v array<int>, row long, leaf int"), "negatives-placed")
    candidates = materialize(_dealt(placed_rows, s.candidate_block), "negatives-candidates")
    asking = materialize(_dealt(placed_rows.filter(anchor), s.anchor_block), "negatives-asked")
    whole = asking.select("row", "label", "v", "block", "leaf", F.array(F.lit(NONE)).alias("low"), F.array(F.lit(-NONE)).alias("high"))
    positives = materialize(search(whole, candidates, s.positives, True, s).withColumn("positive_score", F.col("score")), "negatives-positives")
    bands = positives.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("at"), low.alias("low"), high.alias("high")))).alias("b"))
    banded = asking.join(bands, "row").select("row", "label", "v", "block", "leaf", F.transform("b", lambda x: x["low"]).alias("low"), F.transform("b", lambda x: x["high"]).alias("high"))
    found = search(materialize(banded, "negatives-banded"), candidates, s.negatives, False, s)
    found = found.select("row", (F.col("slot") + 1).alias("at"), F.col("rank").cast("int").alias("rank"), F.col("c_vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = positives.select("row", F.col("rank").alias("at"), F.col("c_vec_id").alias("positive_id"), "positive_score")
    named = asking.select("row", F.col("vec_id").alias("anchor_id"))
    return found.join(known, ["row", "at"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def band() -> tuple[Column, Column]:
    """Bounds of a negative's score: half of positive_score, rounded up, and 95 hundredths of it, rounded down; in integers."""
    return F.expr("positive_score - (positive_score - pmod(positive_score, 2)) div 2"), F.expr("positive_score + (-positive_score - pmod(-positive_score, 20)) div 20")


def op12_hard_negatives(spark, sf_dir: str, s: Settings = Settings()) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label, *band(), s)


SQL = """WITH good AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v, rowid_ FROM (SELECT *, row_number() OVER () AS rowid_ FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.rowid_ AS a, a.vec_id AS anchor_id, c.rowid_ AS c, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score FROM good a JOIN good c ON a.rowid_ <> c.rowid_ WHERE a.vec_id % 50 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= 5),
negatives AS (SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.c ORDER BY n.score DESC, n.vec_id) AS INT) AS rank, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM negatives WHERE rank <= 3"""


def brute_force(rows, positives: int = 5, negatives: int = 3) -> list[tuple]:
    """The query's rows, sorted, of (vec_id, vector, label) rows, by comparing each anchor with every row."""
    import math

    good = [(i, v, label, k) for k, (i, v, label) in enumerate(rows) if i is not None and v and label is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i % 7 == 0 else label, k) for i, v, label, k in good]
    out = []
    for i, v, label, k in good:
        if i % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, m == label) for j, w, m, n in good if n != k)
            for p, pid, _ in [x for x in scored if x[2]][:positives]:
                band = [x for x in scored if not x[2] and 50 * -p <= 100 * -x[0] <= 95 * -p][:negatives]
                out += [(i, pid, r + 1, nid, -p, -n) for r, (n, nid, _) in enumerate(band)]
    return sorted(out)
