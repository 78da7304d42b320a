"""Hard negatives against brute force and SQL."""

import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from codequarry.llm import hard_negatives as H

SF = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SMALL = H.Settings(anchor_block=4, candidate_block=16, leaf=3, sample_rows=40)


@pytest.mark.parametrize("n", [0, 1, 60, 400])
def test_edges(spark, tmp_path, n):
    """Nulls in every column and component, other lengths, equal vectors, repeated ids, a column of a clashing name, many blocks."""
    pick = random.Random(n)
    vector = lambda: [pick.choice([0.0, 0.25, 0.5, -0.25])] * 2 + [pick.random(), pick.random()]
    same = vector()
    odd = [None, [1.0, None, 2.0, 1.0], [float("nan")] * 4, [float("inf")] * 4, [1.0], []]
    rows = [(pick.choice([None, i, i, 50 * i, 50]), pick.choice([same, same, vector(), vector(), pick.choice(odd)]) if i else same, pick.choice([None, 1, 2, 3])) for i in range(n)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("row", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in H.op12_hard_negatives(spark, str(tmp_path), SMALL).select(*NAMES).collect())
    assert got == H.brute_force([r for r in rows if r[1] is None or len(r[1]) == 4])


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in H.op12_hard_negatives(spark, SF).select(*NAMES).collect())
    assert got and got == H.brute_force(rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert Counter(con.execute(f"SELECT {', '.join(NAMES)} FROM ({H.SQL})").fetchall()) == Counter(got)


def test_intervals_hold_all_products():
    rng = np.random.default_rng(5)
    for _ in range(50):
        x, y = rng.integers(-300, 300, (2, 20, 8))
        a, c = H.Balls(x, np.zeros(20, np.int64), 4), H.Balls(y, np.zeros(20, np.int64), 4)
        for node in range(len(a.begin)):
            least, most = H.interval(a.center[node], a.radius[node], c.center, c.radius)
            for k in range(len(c.begin)):
                products = a.x[a.begin[node] : a.end[node]] @ c.x[c.begin[k] : c.end[k]].T
                assert least[k] <= products.min() and products.max() <= most[k]


def test_distant_groups_are_pruned():
    """Of candidates in far apart clusters, an anchor group scores only a few."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16)) * 1000
    c = H.Balls((centers[np.repeat(np.arange(40), 50)] + rng.normal(size=(2000, 16)) * 5).astype(np.int64), np.arange(2000) % 3, 25)
    a = H.Balls((centers[[0] * 30] + rng.normal(size=(30, 16)) * 5).astype(np.int64), np.zeros(30, np.int64), 8)
    best = H.Best(np.full((30, 1), H.NONE), np.full((30, 1), -H.NONE), 5)
    offered = []
    offer = best.offer
    best.offer = lambda i, s, v, r: (offered.append(len(s)), offer(i, s, v, r))
    ids = np.arange(2000)
    H._dual(a, np.full(30, -1), np.zeros(30, np.int64), c, ids[c.order], ids[c.order], (ids % 3)[c.order], best, False)
    assert sum(offered) < 30 * 2000 / 10
    want = np.sort(np.where((ids % 3)[c.order] != 0, a.x @ c.x.T, H.NONE), axis=1)[:, ::-1][:, :5]
    assert (np.array([b[0][0] for b in best.held]) == want).all()
