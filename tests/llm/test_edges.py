"""Texts and rows made to trip the operators: colliding words, repeated rows and ids, clashing columns, empty tables."""

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import bpe, jaccard_join, mixing, nearest_neighbours, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, suffix_sort

SCHEMA = "doc_id long, text string, source string, n_chars long, `kept id` string, `a.b` string, candidates string, spans string"


def thue_morse(n: int, one: str, other: str) -> str:
    """Two of these, one with the letters swapped, have equal polynomial hashes modulo 2**64 for any odd base."""
    return "".join(one if bin(i).count("1") % 2 == 0 else other for i in range(n))


def rows_of(spark, rows):
    return spark.createDataFrame([(d, t, "s", len(t or ""), "k", "ab", "c", "p") for d, t in rows], SCHEMA)


def test_words_that_collide_modulo_powers_of_two(spark):
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    words = [f"w{i}" for i in range(55)]
    rows = [(1, " ".join([*words, x])), (2, " ".join([*words, y])), (3, x), (4, y)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeated(rows_of(spark, rows)).collect()}
    assert got == {d: v[:2] for d, v in substring_dedup.brute_force(rows).items()} and got[2] == (56, 55)
    s = jaccard_join.Similarity(3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows_of(spark, rows), s).collect()} == jaccard_join.brute_force(rows, s)


def test_rows_that_share_a_doc_id_keep_all_links(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (None, a), (4, "")]
    got = jaccard_join.classes(rows_of(spark, rows), jaccard_join.Similarity(3, 90)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("n", [1, 2, 5, 9, 20, 60, 330, 1000])
def test_sets_that_differ_as_much_as_links_can_share_a_signature(percent, n):
    s, rng = jaccard_join.Similarity(5, percent), np.random.default_rng(n)
    for _ in range(20):
        apart = n * (100 - percent) // percent
        x = np.unique(rng.integers(0, 2**64, n + apart, dtype=np.uint64))
        rng.shuffle(x)
        cut = n + int(rng.integers(0, apart + 1))
        a, b = np.sort(x[:cut]), np.sort(np.r_[x[:n], x[cut:]])
        assert s.linked(n, len(a), len(b))
        assert len(np.intersect1d(jaccard_join.signatures(a, s), jaccard_join.signatures(b, s)))


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("n", [1, 2, 5, 9, 20, 60, 330, 1000])
def test_linked_sets_share_as_many_signatures_as_their_marks_say(percent, n):
    s, rng = jaccard_join.Similarity(5, percent), np.random.default_rng(n)
    for _ in range(20):
        apart = n * (100 - percent) // percent
        x = np.unique(rng.integers(0, 2**64, n + apart, dtype=np.uint64))
        rng.shuffle(x)
        cut = n + int(rng.integers(0, apart + 1))
        a, b = ({mark & ~jaccard_join.LEAST: (names, mark & jaccard_join.LEAST) for names, mark in jaccard_join.signed(np.sort(y), s)} for y in (x[:cut], np.r_[x[:n], x[cut:]]))
        assert any(len(np.intersect1d(a[k][0], b[k][0])) >= max(a[k][1], b[k][1]) for k in set(a) & set(b))


@pytest.mark.parametrize("s", [jaccard_join.Similarity(3, 90), jaccard_join.Similarity(5, 80)])
def test_sketches_that_are_full_write_no_more(spark, monkeypatch, s):
    """A bitmap of fixed size says yes to everything once the input is large; what is written must not follow it."""
    written, write, held = [], jaccard_join.materialize, jaccard_join.sketch.repeated
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: written.append(write(df, label)) or written[-1])
    monkeypatch.setattr(jaccard_join.sketch, "repeated", lambda df, hashes_of: jaccard_join.sketch.Repeated(np.full_like(held(df, hashes_of).bits, 255)))
    rng = np.random.default_rng(11)
    rows = [(d, " ".join(f"{x:x}" for x in rng.integers(0, 2**32, 2000))) for d in range(100)]
    rows += [(100, rows[3][1] + " more"), (101, rows[4][1])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows_of(spark, rows), s).collect()}
    assert got == jaccard_join.brute_force(rows, s)
    size = sum(os.path.getsize(f.removeprefix("file:")) for df in written for f in df.inputFiles())
    assert size < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("s", [jaccard_join.Similarity(3, 90), jaccard_join.Similarity()])
def test_box_join_finds_all_pairs_that_the_bound_leaves(s):
    rng = np.random.default_rng(1)
    points = rng.integers(0, 4, (500, 32)).astype("u1")
    points[250:] = np.clip(points[:250].astype(int) + (rng.random((250, 32)) < 0.05), 0, 9)
    tree = jaccard_join.CountTree(points)
    both = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=int)
    total = points.sum(axis=1, dtype=int)
    assert tree.depth > 3 and (tree.pairs(s) == (both >= s.needed(total[:, None] + total[None]))).all()


def test_pivots_leave_no_neighbours_unpaired():
    rng = np.random.default_rng(2)
    near = rng.random((60, 60)) < 0.2
    near |= near.T
    np.fill_diagonal(near, True)
    pairs = jaccard_join.pivot_pairs(near, list(range(60)), 5)
    pivot_of = {i: p for i, p, wide in pairs if wide}
    direct = {frozenset(x[:2]) for x in pairs}
    for i, k in zip(*np.nonzero(np.triu(near, 1))):
        assert frozenset((i, k)) in direct or (i in pivot_of and pivot_of[i] == pivot_of.get(k))


def test_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(1000):
        words = [f"v{i}" for i in range(90)]
        for at in rng.integers(0, 90, d % 7):
            words[at] = f"x{rng.integers(0, 6 if d % 3 else 10**6)}"
        rows.append((d, " ".join(words)))
    s = jaccard_join.Similarity(5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows_of(spark, rows), s).collect()}
    assert got == jaccard_join.brute_force(rows, s)


@pytest.mark.parametrize("depth", [1, 5, 8, 13, 20])
def test_suffixes_in_order_and_equal_by_their_bytes(depth):
    rng = np.random.default_rng(depth)
    text = np.frombuffer(bytes(rng.choice([0, 97, 98], 400).astype("u1")) * 2, np.uint8)
    s = suffix_sort.Suffixes(text, depth)
    at, group = np.arange(len(text) - 8), np.arange(len(text) - 8) // 300
    order, _ = s.sort(at, group)
    raw = text.tobytes() + bytes(depth)
    most = max(depth, 8)  # the sort forms its segments by eight bytes
    key = [(int(group[i]), raw[i : i + most]) for i in order]
    assert sorted(order) == at.tolist() and key == sorted(key)
    i, j = rng.integers(0, len(text) - depth, (2, 3000))
    want = np.array([raw[x : x + depth] == raw[y : y + depth] for x, y in zip(i, j)])
    assert want.any() and (s.equal(i, j, 100) == want).all()


def test_suffix_dedup_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "SORT_BYTES", 300)
    line = "".join(f"<{i}>" for i in range(120))
    rows = [(i, f"head {i % 7} " * (i % 40) + line[i % 11 :] + f" tail {i * i}") for i in range(60)] + [(60, None), (61, "x" * 900), (62, "")]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == {d: tuple(v[:4]) for d, v in suffix_dedup.brute_force(rows).items()}


def test_only_keys_that_others_may_have_are_followed(spark, monkeypatch):
    """Differences from a pivot that one member alone has make no rows; the components stay those of all pairs."""
    made = {}
    write = jaccard_join.materialize
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: made.setdefault(label, []).append(write(df, label)) or made[label][-1])
    rng = np.random.default_rng(7)
    rows = []
    for d in range(300):
        words = [f"v{i}" for i in range(90)]
        for at in rng.integers(0, 90, d % 7):
            words[at] = f"x{rng.integers(0, 6 if d % 3 else 10**6)}"
        rows.append((d, " ".join(words)))
    s = jaccard_join.Similarity(5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows_of(spark, rows), s).collect()}
    assert got == jaccard_join.brute_force(rows, s)
    keys = made["links"][0].select(F.explode("keys").alias("key")).groupBy("key").count()
    followed = made["followed"][0].groupBy("key").count()
    wanted = keys.filter("count > 1")
    assert 0 < followed.count() == wanted.join(followed, ["key", "count"]).count() < keys.count()


def test_pairs_of_near_copies_are_named_once_and_not_within_a_component(spark, monkeypatch):
    """Near copies meet in many cells: what leaves the cells stays near the number of pairs, over all rounds."""
    made, named = {}, spark.sparkContext.accumulator(0)
    write, tree_pairs = jaccard_join.materialize, jaccard_join._tree_pairs
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, label: made.setdefault(label, []).append(write(df, label)) or made[label][-1])

    def counting(s, few):
        inner = tree_pairs(s, few)

        def run(found):
            for batch in inner(found):
                named.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(jaccard_join, "_tree_pairs", counting)
    rng = np.random.default_rng(7)
    rows = []
    for d in range(300):
        words = [f"w{d % 3}v{i}" for i in range(90)]
        for at in rng.integers(0, 90, d % 6):
            words[at] = f"x{rng.integers(0, 10**6)}"
        rows.append((d, " ".join(words)))
    s = jaccard_join.Similarity(5, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(rows_of(spark, rows), s).collect()}
    assert got == jaccard_join.brute_force(rows, s)
    verified = sum(t.count() for t in made["links"])
    assert 0 < named.value <= 2 * verified


def test_two_components_near_one_another_are_not_paired_each_with_each():
    n = 200
    near, of = np.ones((n, n), bool), np.arange(n) % 2
    pairs = jaccard_join.pivot_pairs(near, list(range(n)), 8, near & (of[:, None] != of[None, :]))
    assert sorted(pairs) == [(i, n - 1, True) for i in range(n - 1)]
    assert jaccard_join.pivot_pairs(near, list(range(n)), 8, np.zeros((n, n), bool)) == []


def test_repeated_query_has_its_neighbours_once(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0, 0.1]), (2, [0.0, 0.0]), (3, None), (20, [1e-9, 1.0]), (4, [float("nan"), 1.0])]
    found = nearest_neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 0), (0, 1, 0), (0, 2, 1), (0, 2, 1), (0, 3, 20), (0, 3, 20), (20, 1, 0), (20, 2, 0), (20, 3, 1)]
    assert {r.score for r in found if r.vec_id == 20} == {1e-9 + 2.0}
    assert nearest_neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)).count() == 0


def test_nearest_recall_where_a_tenth_is_ranked_again(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = nearest_neighbours.brute_force([(r.vec_id, r.embedding) for r in vectors.collect()])
    got = {}
    for r in nearest_neighbours.search(vectors, F.col("vec_id") % 20 == 0, 20, nearest_neighbours.Settings(rerank=150)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


def test_bpe_of_code_points_that_unicode_versions_treat_differently():
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    t.no_padding(), t.no_truncation()
    with open(file, encoding="utf-8") as f:
        own = bpe.BytePairs(f.read(), bpe.unicode_of(file))
    for c in [*range(1, 0x3000, 3), *range(0xA600, 0xB000, 5), *range(0x10000, 0x20000, 37), 0x1C89, 0xA7CB, 0x10940, 0x208F]:
        for text in (f"a{chr(c)}b", f"!{chr(c)}?", chr(c)):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, hex(c)


def test_bpe_of_marks_next_to_each_other():
    """Which marks compose, and in which order they stand, is a matter of the library's version of Unicode."""
    import random
    import unicodedata

    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    with open(file, encoding="utf-8") as f:
        own = bpe.BytePairs(f.read(), bpe.unicode_of(file))
    newer = [0x7FD, 0xC3C, 0xD3B, 0x10EFD, *range(0x898, 0x8A0), *range(0x8CA, 0x8D4), *range(0x1ABF, 0x1ACF), *range(0x1DF6, 0x1DFB), *range(0x10D24, 0x10D28)]
    marks = [*newer, *(c for c in range(0x300, 0x20000) if unicodedata.combining(chr(c)))]
    pick = random.Random(9)
    for i in range(20_000):
        text = pick.choice("aeo\u00c9\u03b1\u0438x") + chr(newer[i % len(newer)]) + "".join(chr(pick.choice(marks)) for _ in range(2)) + pick.choice(["", " b"])
        assert np.frombuffer(own.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_bpe_refuses_a_file_that_asks_for_something_else():
    import json

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    with pytest.raises(ValueError):
        bpe.BytePairs(json.dumps(spec | {"normalizer": {"type": "NFKC"}}))


def test_mixing_of_equal_rows(spark, tmp_path):
    """A source of equal rows, one with some of them, and rows without a doc_id come near their targets, alike in each run."""
    rows = [(1, "one two three four five six seven eight", "a")] * 500 + [(2, "x y", "b")] * 300 + [(i, "x y z", "b") for i in range(3, 200)] + [(None, "k", "c")] * 90
    got = []
    for n in (2, 5):
        spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(n).write.parquet(f"{tmp_path}/{n}/documents.parquet")
        got.append(mixing.op10_mixing(spark, f"{tmp_path}/{n}").collect())
        per = {}
        for r in got[-1]:
            assert r.taken in (0, r.size, 2 * r.size)
            per[r.target] = per.get(r.target, 0) + r.taken
        assert len(got[-1]) == len(rows) and len(per) == 3
        assert all(abs(taken - target) <= 4 + 1e-6 for target, taken in per.items())
    assert sorted(map(str, got[0])) == sorted(map(str, got[1]))
    docs = spark.read.parquet(f"{tmp_path}/2/documents.parquet")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.taken // r.size for r in got[0])


def test_a_long_text_of_looser_spans(spark):
    """Thousands of spans that overlap nothing, and some that do: linear work, the first of overlapping ones stays."""
    text = "Dr. John Smith wrote token = abcd1234efgh5678ijkl and " * 4000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    assert spans[2] == [] and len(spans[1]) >= 4000
    assert all(a.end <= b.start for a, b in zip(spans[1], spans[1][1:]))


def test_secrets_are_added_and_strict_spans_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = [(r.text or "", r.spans) for r in docs.join(pii.op5_pii(spark, "/root/testdata/sf0.01").select("doc_id", "spans"), "doc_id").select("text", "spans").collect()]
    assert any("secret:" in spans for _, spans in found)
    for text, spans in found:
        assert ("secret:" in spans) == ("token = " in text)


def test_redact_of_many_spans_and_clashing_columns(spark):
    docs = rows_of(spark, [(1, "x.y@z.org " * 3000), (2, None), (3, "")])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "[EMAIL] " * 3000 and got[2].text is None and got[3].text == ""
    assert (got[1].candidates, got[1].spans, got[1]["kept id"], got[1]["a.b"]) == ("c", "p", "k", "ab")


def test_stages_keep_clashing_columns_and_empty_tables(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = rows_of(spark, [(1, words), (2, words), (3, None), (3, "other"), (None, "lost")])
    none = rows_of(spark, []).limit(0)
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.personal_data, corpus_pipeline.source_mix):
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
        assert stage(spark, none, "/root/testdata/sf0.001").count() == 0
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "lost"), (1, words), (3, "")]
    assert all(r["a.b"] == "ab" for r in kept)
    assert corpus_pipeline.token_ids(spark, none, "").count() == 0


@pytest.mark.parametrize("stage", [corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.token_ids])
def test_stages_send_whole_texts_to_workers_in_small_batches(spark, stage):
    """Held by executor and worker at once; batches of 10,000 rows, or 64 MB, took the pipeline's executors beyond their memory."""
    docs = spark.range(0, 100, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.expr("repeat('a b ', 50000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        spark.conf.unset(limit)
        stage(spark, docs, "/root/testdata/sf0.001")
        got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    finally:
        spark.conf.unset(limit)
    assert sum(got) > 19_000_000 and max(got) < 6_000_000


def test_classifier_of_shared_ids_and_column_names_is_the_same_each_time(spark):
    docs = rows_of(spark, [(d, f"good words {d}" if d % 2 else f"$$$ spam {d}") for d in range(40)] + [(1, "$$$ other")])
    labels = spark.createDataFrame([(d, d % 2) for d in range(40)], "doc_id long, quality int")
    s = quality_classifier.Settings(buckets=1 << 10, epochs=3)
    first, again = (quality_classifier.fit(docs.repartition(n), labels, s) for n in (3, 7))
    assert (first[0] == again[0]).all() and first[1] == again[1]
    assert quality_classifier.score(docs, first, s, keep=("doc_id", "kept id")).columns == ["doc_id", "kept id", "score"]


def test_rules_sql_and_spark_agree(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    names = ["doc_id", *quality_rules.COUNTS, "base_failed", "kept"]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(names)} FROM ({quality_rules.SQL})").fetchall()
    assert sorted(map(tuple, quality_rules.op2_quality_rules(spark, sf).select(*names).collect())) == sorted(want)


def test_mix_of_null_sources_and_equal_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None), (1, "a b c", None), (2, "d", None), (3, None, "x")], "doc_id long, text string, source string")
    taken = {(r.doc_id, r.text): 0 for r in docs.collect()}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id, r.text] += 1
    assert taken[3, None] == 0 and max(taken.values()) <= 4
    assert abs(3 * taken[1, "a b c"] + taken[2, "d"] - 10.5) <= 1.5  # the target of the null source, within half a document
