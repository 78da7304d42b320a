"""Approximate nearest neighbours by additive quantisation.

A vector is the sum of one code from each of several full-dimensional
codebooks. The codebooks start as residual k-means and are then fitted
together by least squares, on a bounded sample (``Settings.sample_rows``, the
first in the order of a hash of vec_id). All vectors are encoded by beam
search; their codes' squared norms are stored beside the codes. A query scores
all codes of a block through its lookup table (for distances, with the stored
norms), and the best of a block are ranked again on the original vectors. A
vector's distance from its code, stored too, bounds what its score may be;
those that may still be among the k best are ranked again as well, so that
none of a block is lost where many codes nearly tie.

Queries and vectors meet in blocks: every query block meets every block of
vectors in one task of bounded size, so no side is broadcast.

Vectors that are null, zero, of another length than most, or have null or
non-finite components take no part. Equal scores go to the smaller vec_id. A
vec_id that occurs more than once counts each time: each of its rows is a query
with neighbours of its own, and only the row itself is left out of them. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.runtime import materialize, ship


@dataclass(frozen=True)
class Settings:
    books: int = 16
    codes: int = 256
    beam: int = 4
    sample_rows: int = 8192
    fits: int = 1
    rerank: int = 600
    query_block: int = 1024
    vector_block: int = 16384
    metric: str = "inner"  # or "l2"
    seed: int = 11


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v of the vectors that take part."""
    v = F.col(column)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first()
    return rows.filter(F.size("v") == (usual.n if usual else 0))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.float32)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book * book).sum(1) - 2 * (x @ book.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng, turns: int = 8) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(turns):
        near = _nearest(x, book)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), x.dtype)]), np.minimum(np.r_[0, np.cumsum(n)[:-1]], len(x)))
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of each row by beam search: of all continuations of a row's beams, the best ones go on."""
    n, d = x.shape
    codes = np.zeros((n, 1, 0), np.uint8)
    rest = x[:, None, :]
    for book in books:
        norms = (book * book).sum(1)
        cost = (rest * rest).sum(2)[:, :, None] + norms - 2 * (rest.reshape(-1, d) @ book.T).reshape(n, rest.shape[1], -1)
        width = min(beam, cost.shape[1] * cost.shape[2])
        best = np.argpartition(cost.reshape(n, -1), width - 1, axis=1)[:, :width]
        source, code = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        codes = np.concatenate([codes[rows, source], code[:, :, None].astype(np.uint8)], axis=2)
        rest = rest[rows, source] - book[code]
    return codes[np.arange(n), np.argmin((rest * rest).sum(2), axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(book[codes[:, m]] for m, book in enumerate(books))


def train(x: np.ndarray, s: Settings) -> np.ndarray:
    rng = np.random.default_rng(s.seed)
    books, rest = [], x.copy()
    for _ in range(s.books):
        book = _kmeans(rest, s.codes, rng)
        books.append(book)
        rest = rest - book[_nearest(rest, book)]
    books = np.stack(books)
    for _ in range(s.fits):  # all codebooks at once: ridge regression of the vectors on their codes
        codes = encode(x, books, s.beam).astype(np.int64) + np.arange(s.books) * s.codes
        size = s.books * s.codes
        gram = np.bincount((codes[:, :, None] * size + codes[:, None, :]).ravel(), minlength=size * size).reshape(size, size).astype(np.float64)
        right = np.zeros((size, x.shape[1]))
        np.add.at(right, codes.ravel(), np.repeat(x, s.books, axis=0))
        books = np.linalg.solve(gram + np.eye(size) * 0.1, right + 0.1 * books.reshape(size, -1)).reshape(books.shape).astype(np.float32)
    return books


def _encode_rows(books, s: Settings):
    def run(found):
        for batch in found:
            exact = matrix(batch.column(1))
            if not len(exact):
                continue
            x = exact.astype(np.float32)
            codes = np.concatenate([encode(x[i : i + 2048], books.value, s.beam) for i in range(0, len(x), 2048)])
            close = decode(codes, books.value)
            gap = np.sqrt(((exact.astype(np.float64) - close) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((close * close).sum(1), pa.float32()), pa.array(gap, pa.float64())],
                ["vec_id", "v", "codes", "norm", "gap"],
            )

    return run


def _search(books, s: Settings, k: int):
    def nearest(queries: pa.Table, base: pa.Table) -> pa.Table:
        out: list[tuple] = [([], [], [], [])]
        if queries.num_rows and base.num_rows:
            out = []
            ids, own = base["vec_id"].to_numpy(), base["row"].to_numpy()
            order = np.lexsort((own, ids))
            ids, own = ids[order], own[order]
            x = matrix(base["v"])[order]
            codes = np.frombuffer(b"".join(base["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            norm, gap = base["norm"].to_numpy()[order], base["gap"].to_numpy()[order]
            q_ids, q_own, q = queries["vec_id"].to_numpy(), queries["row"].to_numpy(), matrix(queries["v"])
            tables = np.einsum("qd,mkd->mqk", q.astype(np.float32), books.value, optimize=True)
            for i in range(len(q)):
                scores = sum(tables[m, i][codes[:, m]] for m in range(len(tables)))
                if s.metric == "l2":
                    scores = 2 * scores - norm
                scores = np.where(own == q_own[i], -np.inf, scores)
                keep = min(s.rerank, len(ids))
                floor = np.partition(scores, len(ids) - keep)[len(ids) - keep]
                at = np.flatnonzero(scores >= floor)
                at = at[np.lexsort((ids[at], -scores[at]))][:keep]
                at = at[own[at] != q_own[i]]
                exact = _measure(q[i].astype(np.float64), x[at].astype(np.float64), s.metric)
                if keep < len(ids):
                    most = _at_most(scores, float(np.sqrt((q[i].astype(np.float64) ** 2).sum())), norm, gap, s.metric)
                    most[at] = -np.inf
                    more = np.flatnonzero((most >= (np.partition(exact, -k)[-k] if len(exact) >= k else -np.inf)) & (own != q_own[i]) & (most > -np.inf))
                    at = np.r_[at, more]
                    exact = np.r_[exact, _measure(q[i].astype(np.float64), x[more].astype(np.float64), s.metric)]
                best = np.lexsort((ids[at], -exact))[:k]
                out.append((np.full(len(best), q_ids[i]), np.full(len(best), q_own[i]), ids[at][best], exact[best]))
        return pa.table([pa.array(np.concatenate([o[j] for o in out]), t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "row", "vec_id", "score"])

    return nearest


def _at_most(scores: np.ndarray, length: float, norm: np.ndarray, gap: np.ndarray, metric: str) -> np.ndarray:
    """No vector's score is above this: its code's, and the part of its distance from the code that lies along the query; with room for rounding."""
    scores, close = scores.astype(np.float64), np.sqrt(norm.astype(np.float64))
    slack = 1e-5 * (length + close + gap) ** 2
    if metric == "inner":
        return scores + length * gap + slack
    far = np.sqrt(np.maximum(length * length - scores - slack, 0))
    return -(np.maximum(far - gap, 0) ** 2) + slack


def _measure(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """In double precision, by rows, so that equal vectors have equal scores."""
    return (x * q).sum(axis=1) if metric == "inner" else -((x - q) ** 2).sum(axis=1)


def search(vectors: DataFrame, queries: Column, k: int = 20, s: Settings = Settings()) -> DataFrame:
    """The k nearest vectors of each row for which ``queries`` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(s.sample_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(train(matrix(sample["v"]).astype(np.float32), s))
    kind = rows.schema["v"].dataType.simpleString()
    coded = rows.mapInArrow(_encode_rows(books, s), f"vec_id long, v {kind}, codes binary, norm float, gap double")
    coded = materialize(coded.withColumn("row", F.monotonically_increasing_id()), "codes")  # a repeated vector is a row of its own
    asked = coded.filter(queries)
    sizes = coded.agg(F.count("*").alias("n"), F.count_if(queries).alias("q")).first()
    n_blocks, q_blocks = max(1, -(-sizes.n // s.vector_block)), max(1, -(-sizes.q // s.query_block))
    block = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "row", "v", block(q_blocks).alias("q"), every(n_blocks).alias("b"))
    right = coded.select("vec_id", "row", "v", "codes", "norm", "gap", block(n_blocks).alias("b"), every(q_blocks).alias("q"))
    found = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(_search(books, s, k), "query_id long, row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def brute_force(rows, k: int = 20) -> dict:
    """{query_id: [vec_id, ...]} for ids divisible by 20, of (vec_id, vector) rows that take part."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = (x * x[i]).sum(axis=1)
        order = np.lexsort((ids, -score))
        out[int(ids[i])] = [int(ids[j]) for j in order if j != i][:k]
    return out
