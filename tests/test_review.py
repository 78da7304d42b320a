"""The store of verdicts, reviews, contexts and text reports."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators import issue_filters, review
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.verdict_store import VerdictStore, key_of, normalized_key

ROWS = [("src/a.ts", 2, "security", "high", "medium", "security", "m1", "b"), ("src/a.ts", 2, "security", "high", "medium", "security", "m2", "b"), ("src/a.ts", 9, "fake-url", "low", None, "x", "m3", ""), ("none.ts", 1, "fake-url", "low", "low", "x", "m4", "z")]


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(ROWS, "path string, line int, rule string, severity string, confidence string, category string, message string, snippet string").select(*ISSUE)


def at(text):
    return F.lit(text).cast("timestamp")


def test_store(spark, tmp_path):
    store = VerdictStore(spark, f"file://{tmp_path}/verdicts", ttl=100)
    rows = lambda *r: spark.createDataFrame(r, "key string, value string")
    assert store.read().count() == 0 and store.segments() == []
    store.compact()
    store.put(rows(("a", "1"), ("b", "1"), (None, "x"), ("n", None)), at("2024-01-01 00:00:00"))
    store.put(rows(("b", "2"), ("b", "3"), ("c", "1")), at("2024-01-01 00:01:00"))
    live = lambda when: {r.key: r.value for r in store.read(at(when)).collect()}
    assert live("2024-01-01 00:01:00") == {"a": "1", "b": "3", "c": "1", "n": None}
    assert live("2024-01-01 00:01:50") == {"b": "3", "c": "1"}
    (tmp_path / "verdicts" / ".segment-half").mkdir()  # a run that died while writing
    assert live("2024-01-01 00:01:50") == {"b": "3", "c": "1"}
    store.compact(at("2024-01-01 00:01:50"))
    assert len(store.segments()) == 1 and live("2024-01-01 00:01:00") == {"b": "3", "c": "1"}
    found = store.looked_up(spark.createDataFrame([("b", 1), ("z", 2), (None, 3)], "key string, hit_id int"), at("2024-01-01 00:01:10")).collect()
    assert {(r.hit_id, r.cached, r.hit) for r in found} == {(1, "3", True), (2, None, False), (3, None, False)}
    store.clear()
    assert store.read().count() == 0


def test_keys(spark):
    rows = spark.createDataFrame([(" a \n b ", "x"), ("a b", "x"), ("a", "b x"), (None, "x")], "p string, q string")
    keys = [r.k for r in rows.select(key_of(F.col("p"), F.col("q")).alias("k")).collect()]
    assert keys[0] == keys[1] and len(set(keys)) == 3 and all(len(k) == 16 for k in keys)
    assert rows.select(normalized_key(F.col("p")).alias("p")).first().p == "a b"


def test_two_issues_of_one_line_have_verdicts_of_their_own(spark, issues):
    verdicts = spark.createDataFrame([("src/a.ts", 2, "security", "m1", "false_positive", None, None), ("src/a.ts", 2, "security", "m2", "enhanced", "new", "critical")], "path string, line int, rule string, message string, verdict string, new_message string, new_severity string")
    got = {(r.message, r.severity, r.verdict) for r in review.judged(issues, verdicts).collect()}
    assert got == {("new", "critical", "enhanced"), ("m3", "low", None), ("m4", "low", None)}
    s = review.review_statistics(issues, verdicts).first()
    assert (s.reviewed, s.removed, s.enhanced, s.removed_percent) == (2, 1, 1, 50)


def test_stored_verdicts_meet_their_issues(spark, issues, tmp_path):
    store = VerdictStore(spark, f"file://{tmp_path}/v")
    store.put(review.verdict_key(issues.filter("message = 'm1'")).select("key", F.lit("confirmed").alias("value")))
    got = {(r.message, r.cached, r.hit) for r in review.already_judged(issues, store).collect()}
    assert got == {("m1", "confirmed", True), ("m2", None, False), ("m3", None, False), ("m4", None, False)}


def test_context_and_reports(spark, issues):
    files = spark.createDataFrame([("src/a.ts", "\n".join(f"l{i}" for i in range(1, 11)))], "path string, source string")
    got = {(r.message): r.context for r in review.with_context(issues, files).collect()}
    assert got["m4"] is None and ">>> 2| l2" in got["m1"] and ">>> 9| l9" in got["m3"] and got["m3"].endswith("10| l10")
    assert {r.text for r in review.report_lines(issues).collect()} >= {"src/a.ts:2  [HIGH]  m1"}
    detailed = {r.text for r in review.detailed_lines(issues).collect()}
    assert "src/a.ts:9 [LOW] [CONF:MEDIUM] m3" in detailed and "src/a.ts:2 [HIGH] [CONF:MEDIUM] m1\n      2 | b" in detailed
    assert review.fails(issues) and not review.fails(issues.limit(0))


def test_registry_knows_packages_by_language(spark):
    rows = [("a.py", 1, "package-hallucination", "high", "high", "x", "m", "import acme"), ("a.ts", 1, "package-hallucination", "high", "high", "x", "m", "import acme"), ("a.py", 2, "security", "high", "high", "x", "m", "acme")]
    issues = spark.createDataFrame(rows, "path string, line int, rule string, severity string, confidence string, category string, message string, snippet string")
    known = spark.createDataFrame([("acme", "python")], "name string, language string")
    assert {(r.path, r.line) for r in issue_filters.confirmed_by_registry(issues, known).collect()} == {("a.ts", 1), ("a.py", 2)}
    assert {(r.path, r.line) for r in issue_filters.confirmed_by_registry(issues, known.drop("language")).collect()} == {("a.py", 2)}
