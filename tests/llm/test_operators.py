"""Operators against brute force, libraries and edge cases."""

import hashlib
import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codequarry.llm import bpe, jaccard_join, mixing, nearest_neighbours, pii, quality_classifier, quality_rules, substring_dedup, suffix_dedup, token_counts
from codequarry.llm import queries as registered

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(120)]
PASSAGE = " ".join(WORDS[:70])
ROWS = [
    (1, PASSAGE, "a", "x"), (2, "before " + PASSAGE + " after", "a", "x"), (3, None, None, None), (4, "", "b", "x"), (5, " ".join(WORDS), "b", None),
    (6, " ".join(WORDS[:-1]), "b", "x"), (7, "one", "c", "x"), (8, "mail a.b@c.org or +44 20 7946 0958, 10.1.2.3, 4111 1111 1111 1111", "c", "x"), (9, "word " * 3000, "c", "x"),
]
SCHEMA = "doc_id long, text string, source string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _plain():
    return [(d, t) for d, t, *_ in ROWS]


def test_substring_dedup(docs, none):
    want = substring_dedup.brute_force(_plain())
    got = {r.doc_id: tuple(r[1:4]) for r in substring_dedup.remove_repeated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()}
    assert got == {d: tuple(v[:3]) for d, v in want.items()}
    assert got[2][1] == 70
    assert substring_dedup.remove_repeated(none).count() == 0


def test_suffix_dedup(docs, none):
    want = suffix_dedup.brute_force(_plain())
    got = {r.doc_id: tuple(r[1:5]) for r in suffix_dedup.remove_repeated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()}
    assert got == {d: tuple(v[:4]) for d, v in want.items()}
    assert suffix_dedup.remove_repeated(none).count() == 0


def test_suffix_dedup_of_hot_anchors(spark, monkeypatch):
    """Every anchor by the way of those with too many runs to sort."""
    monkeypatch.setattr(suffix_dedup, "SORTED_RUNS", 0)
    line = "".join(f"<{i}>" for i in range(120))
    rows = [*_plain(), *((100 + i, f"head {i} " + line + f" tail {i * i}") for i in range(40)), *((200 + i, line[: 150 + i] + f"!{i}") for i in range(100))]
    want = suffix_dedup.brute_force(rows)
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == {d: tuple(v[:4]) for d, v in want.items()}


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_jaccard(docs, none, words, percent):
    s = jaccard_join.Similarity(words, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(docs, s).collect()}
    assert got == jaccard_join.brute_force(_plain(), s)
    assert got[6][1] == 5
    assert jaccard_join.classes(none, s).count() == 0


def test_jaccard_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows = []
    for d in range(150):
        words = [f"v{i}" for i in range(90)]
        for at in rng.integers(0, 90, d % 5):
            words[at] = f"x{rng.integers(0, 6)}"
        rows.append((d, " ".join(words)))
    s = jaccard_join.Similarity(3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string"), s).collect()}
    want = jaccard_join.brute_force(rows, s)
    assert got == want and len({c for _, c in want.values()}) > 2


@pytest.mark.parametrize("s", [jaccard_join.Similarity(3, 90), jaccard_join.Similarity()])
def test_linked_sets_share_the_differences_that_the_bound_names(s):
    rng = np.random.default_rng(5)
    linked = lambda x, y: s.linked(len(x & y), len(x), len(y))
    edited = lambda x, k: x ^ set(rng.integers(0, 60, k).tolist())
    seen = 0
    for _ in range(5000):
        pivot = set(range(int(rng.integers(20, 50))))
        base = edited(pivot, int(rng.integers(0, 12)))
        a, b = (edited(base, int(rng.integers(0, 4))) for _ in range(2))
        if linked(a, b) and not (linked(a, pivot) and linked(b, pivot)):
            seen += 1
            both = len((a ^ pivot) & (b ^ pivot))
            for x, y in ((a, b), (b, a)):
                apart, other = s.shared_differences(len(x), len(pivot), len(x ^ pivot))
                assert both >= (apart if not linked(y, pivot) else other)
    assert seen > 200


def test_pii(docs, none, spark):
    got = pii.found(docs)
    by_id = {r.doc_id: [x for x in r.candidates if x.strict] for r in got.collect()}
    assert [pii.KINDS[x.kind] for x in by_id[8]] == ["email", "phone", "ip", "card"]
    assert not by_id[3] and not by_id[4]
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[8] == "mail [EMAIL] or [PHONE], [IP], [CARD]" and clean[3] is None and clean[1] == PASSAGE
    assert pii.redact(none).columns == docs.columns and pii.found(none).count() == 0


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    for r in bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).collect():
        ids = t.encode(dict(_plain())[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert bytes(r.decoded).decode() == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_token_counts(docs):
    """The library's unigram model, over the same pieces."""
    from tokenizers import models

    vocabulary = [("<unk>", 0.0), *[(c, -5.0) for c in "▁abcdeforw"], ("▁word", -6.0), ("or", -7.0), ("▁w", -7.0), ("rd", -7.0), ("ab", -10.0)]
    model = models.Unigram(vocabulary, 0, False)
    counter = token_counts.UnigramCounter(vocabulary, byte_fallback=False)
    for word in ("word", "ab", "abab", "forab", "wordword", "a"):
        assert counter.word(word.encode())[1] == len(model.tokenize("▁" + word)), word
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert (rows[3].n_words, rows[3].n_tokens, rows[9].n_words) == (0, 0, 3000)


def test_mixing(docs, none):
    sizes, plan = mixing.planned(docs)
    assert sizes.count() == len(ROWS)
    taken = {r.source_key + str(r.source_null): r for r in plan.collect()}
    assert all(r.target <= 2 * r.source_size for r in taken.values())
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none).count() == 0


def test_quality_rules(docs, none):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(rows) == len(ROWS) and rows[3].base_failed and rows[9].base_failed and not rows[5].base_failed
    assert quality_rules.judge(none).count() == 0


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = registered.queries()["op4_quality_classifier"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] >= 0.95


def test_nearest_recall(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = nearest_neighbours.brute_force(rows)
    got = {}
    for r in registered.queries()["op8_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & set(w)) / len(w) for q, w in want.items()]) >= 0.9


@pytest.mark.parametrize("metric", ["inner", "l2"])
def test_nearest_in_a_dense_group(metric):
    """Many near but unequal vectors, of which few are ranked again by their codes alone."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x[:1500] = x[0] + rng.normal(size=(1500, 16)) * 0.03
    s = nearest_neighbours.Settings(books=4, codes=32, sample_rows=3000, rerank=40, metric=metric)
    books = types.SimpleNamespace(value=nearest_neighbours.train(x, s))
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.array(x.tolist(), pa.list_(pa.float32()))], ["vec_id", "v"])
    base = pa.Table.from_batches(list(nearest_neighbours._encode_rows(books, s)([rows]))).append_column("row", pa.array(np.arange(len(x))))
    asked = base.take(pa.array(range(0, 3000, 60)))
    got = {}
    for r in nearest_neighbours._search(books, s, 20)(asked, base).to_pylist():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(0, 3000, 60):
        exact = nearest_neighbours._measure(x[i].astype(np.float64), x.astype(np.float64), metric)
        assert got[i] == [j for j in np.lexsort((np.arange(len(x)), -exact)).tolist() if j != i][:20]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, SF)
    bad = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0")
    assert good.columns == docs.columns and good.join(bad, "doc_id").count() <= 1
    one = corpus_pipeline.near_duplicates(spark, docs, SF)
    classes = jaccard_join.brute_force([(r.doc_id, r.text) for r in docs.collect()], corpus_pipeline.NEAR)
    assert sorted(r.doc_id for r in one.collect()) == sorted(d for d, (_, c) in classes.items() if d == c)
    last = corpus_pipeline.token_ids(spark, docs, SF).filter("doc_id = 0").first()
    assert last.ids_sha256 == hashlib.sha256(bytes(last.ids)).hexdigest()


def _targets(sizes: dict, share: float = 1.5, most: float = 2.0) -> dict:
    """Targets by source (None last): the level that spends the budget, found by bisection."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    weight = {n: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, n in enumerate(names)}
    at = lambda level: {n: min(weight[n] * level, most * sizes[n]) for n in names}
    low, high = 0.0, most * sum(sizes.values()) + 1
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle).values()) < share * sum(sizes.values()) else (low, middle)
    return at(high)


def _holds_mix(rows, taken):
    """``rows``: (doc_id, source, text, place), each doc_id once; ``taken``: {doc_id: times}."""
    size = {d: len((t or "").split()) for d, _, t, _ in rows}
    by_source = {}
    for d, source, _, place in rows:
        by_source.setdefault(source, []).append((place, d))
    want = _targets({n: sum(size[d] for _, d in v) for n, v in by_source.items()})
    for source, found in by_source.items():
        total = sum(size[d] for _, d in found)
        copies = int(want[source] // total + 1e-9) if total else 0
        more = [taken.get(d, 0) - copies for _, d in sorted(found) if size[d]]
        assert more == sorted(more, reverse=True) and set(more) <= {0, 1}  # one more of those with the least hashes
        words = sum(size[d] * taken.get(d, 0) for _, d in found)
        assert abs(words - want[source]) <= max(size[d] for _, d in found) / 2 + 1e-6
    assert all(not taken.get(d, 0) for d in size if not size[d])


def test_mixing_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("place", mixing.place(F.col("doc_id"), F.col("text")))
    rows = [(r.doc_id, r.source, r.text, r.place) for r in docs.select("doc_id", "source", "text", "place").collect()]
    size = {d: len((t or "").split()) for d, _, t, _ in rows}
    per = {}
    for d, source, *_ in rows:
        per[source] = per.get(source, 0) + size[d]
    want, source_of = _targets(per), {d: source for d, source, *_ in rows}
    got = registered.queries()["op10_mixing"](spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.size, r.source_size) == (size[r.doc_id], per[source_of[r.doc_id]])
        assert r.target == pytest.approx(want[source_of[r.doc_id]])
    _holds_mix(rows, {r.doc_id: r.taken // r.size if r.size else 0 for r in got})


def test_pii_against_brute_force(spark):
    want = pii.brute_force([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = registered.queries()["op5_pii"](spark, SF).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert {r.doc_id: tuple(r[1:]) for r in got} == want


def test_pipeline_run(spark, monkeypatch):
    from tokenizers import Tokenizer

    kept, real = {}, corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, label: kept.setdefault(label.removeprefix("pipeline-"), real(df, label)))
    last = corpus_pipeline.run(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id: r.text for r in kept["quality_classifier"].collect()}
    assert all(docs[d] == t for d, t in good.items())
    assert sum(d not in good for d in docs if quality.get(d) == 1) <= 1 and sum(d in good for d in docs if quality.get(d) == 0) <= 1
    classes = jaccard_join.brute_force(list(good.items()), corpus_pipeline.NEAR)
    single = {r.doc_id: r.text for r in kept["jaccard_join"].collect()}
    assert single == {d: good[d] for d, (_, c) in classes.items() if c == d}
    clean = {r.doc_id: r.text for r in kept["pii"].collect()}
    hits = pii.brute_force(list(single.items()))
    assert clean.keys() == single.keys() and sum(v[0] for v in pii.brute_force(list(clean.items())).values()) == 0
    assert all(("[EMAIL]" in clean[d]) >= (hits[d][0] > 0) for d in clean)
    mixed = kept["mixing"].collect()
    rows = kept["pii"].select("doc_id", "source", "text", mixing.place(F.col("doc_id"), F.col("text")).alias("place")).collect()
    times = {}
    for r in mixed:
        assert r.text == clean[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    _holds_mix([tuple(r) for r in rows], times)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding(), t.no_truncation()
    assert sorted(r.doc_id for r in last) == sorted(r.doc_id for r in mixed)
    for r in last:
        assert np.frombuffer(r.ids, "<u4").tolist() == t.encode(clean[r.doc_id] or "", add_special_tokens=False).ids
