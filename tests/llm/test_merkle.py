"""The Merkle manifest against brute force and SQL."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from codequarry.llm import merkle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def _written(spark, folder, rows):
    spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return [tuple(r) for r in merkle.op13_merkle_manifest(spark, str(folder)).select(*NAMES).collect()]


@pytest.mark.parametrize("n", [0, 1, 2, 64, 65, 300])
def test_edges(spark, tmp_path, n):
    """Nulls in every column, repeated doc_ids and rows, empty and long texts, the largest n_chars, a column of a clashing name."""
    pick = random.Random(n)
    rows = [(pick.choice([None, 1, i, i]), pick.choice(["a", None]), pick.choice(["en", "en", "de", None, "", "é"]), pick.choice([None, 5, 2**63 - 1]), pick.choice(["", "x" * 100_000, None, "é ü"])) for i in range(n)]
    assert Counter(_written(spark, tmp_path, rows)) == Counter(merkle.brute_force(rows))


def test_one_large_group_of_equal_rows(spark, tmp_path):
    rows = [(7, "a", "en", 3, "abc")] * 3000 + [(i, "a", "de", 3, "abc") for i in range(70)]
    got = _written(spark, tmp_path, rows)
    assert Counter(got) == Counter(merkle.brute_force(rows))


def test_many_groups(spark, tmp_path):
    rows = [(i, None, f"l{i}", i, "t") for i in range(150)]
    assert Counter(_written(spark, tmp_path, rows)) == Counter(merkle.brute_force(rows))


def test_query_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = Counter(merkle.brute_force(rows))
    got = merkle.op13_merkle_manifest(spark, SF)
    assert Counter(tuple(r) for r in got.select(*NAMES).collect()) == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert Counter(con.execute(f"SELECT {', '.join(NAMES)} FROM ({merkle.SQL})").fetchall()) == want


def test_a_changed_row_does_not_verify(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}", "") for i in range(20)], SCHEMA)
    rows = merkle.documents_manifest(docs)
    again = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    bad = rows.select("doc_id", (again == F.col("root")).alias("ok"), F.col("tampered").isNotNull().alias("hit")).collect()
    assert any(r.hit for r in bad) and all(r.ok != r.hit for r in bad)
