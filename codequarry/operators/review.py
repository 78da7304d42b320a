"""Which issues a reviewer looks at, in what portions, with which lines around them, and what the verdicts change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.sources.verdict_store import VerdictStore, key_of

from codequarry.operators.issue_filters import CONFIDENCES, SEVERITIES, rank

# The severities and confidences of each rule that are reviewed; rules not listed never are.
REVIEWED = {
    "api-hallucination": (SEVERITIES, CONFIDENCES),
    "package-hallucination": (SEVERITIES, CONFIDENCES),
    "stub-function": (("critical", "high", "medium"), CONFIDENCES),
    "empty-impl": (("critical", "high", "medium"), CONFIDENCES),
    "fake-url": (("critical", "high", "medium"), CONFIDENCES),
    "security": (("critical", "high", "medium"), CONFIDENCES),
    "unused-declaration": (("critical", "high"), ("high",)),
    "weak-validation": (("critical", "high"), ("high", "medium")),
    "unhandled-promise": (("critical", "high", "medium"), ("high",)),
    "swallowed-error": (("critical", "high"), ("high",)),
    "hardcoded-value": (("critical", "high"), ("high",)),
    "resource-leak": (("critical", "high"), ("high",)),
}
# Lines shown before and after an issue, by rule, else by severity.
AROUND_RULE = {"package-hallucination": 1, "api-hallucination": 2, "stub-function": 2, "empty-impl": 2, "fake-url": 1, "hardcoded-value": 1}
AROUND_SEVERITY = {"critical": 5, "high": 5, "medium": 3}
AROUND = 2
#: Issues of one portion.
PORTION = 10


def eligible(issues: DataFrame, rules: tuple[str, ...] | None = None) -> DataFrame:
    """Issues that are reviewed: those of ``rules`` if given, else by rule, severity and confidence (null: medium)."""
    if rules is not None:
        return issues.filter(F.col("rule").isin(*rules))
    confidence = F.coalesce("confidence", F.lit("medium"))
    wanted = [(F.col("rule") == r) & F.col("severity").isin(*s) & confidence.isin(*c) for r, (s, c) in REVIEWED.items()]
    return issues.filter(reduce(Column.__or__, wanted))


def portions(issues: DataFrame, size: int = PORTION) -> DataFrame:
    """Issues with ``portion``, from 0 in each file, worst and first ones first; equal issues may change places."""
    worst = rank("severity", SEVERITIES)
    order = Window.partitionBy("path").orderBy(F.when(worst > 0, worst).otherwise(99), "line", "rule", "message", "snippet")
    return issues.withColumn("portion", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def portion_rules(issues: DataFrame, size: int = PORTION) -> DataFrame:
    """path, portion, n and the sorted rules of each portion."""
    return portions(issues, size).groupBy("path", "portion").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("rule")), ",").alias("rules"))


def with_context(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Issues with ``context``: numbered lines around each, its own marked; null where the file or its source is missing.

    ``files`` has one row per path. One equi-join; lines are cut out of the
    source as an array slice, not joined one by one.
    """
    by_rule = F.try_element_at(F.create_map(*[F.lit(x) for pair in AROUND_RULE.items() for x in pair]), F.col("rule"))
    by_severity = F.try_element_at(F.create_map(*[F.lit(x) for pair in AROUND_SEVERITY.items() for x in pair]), F.col("severity"))
    k = F.coalesce(by_rule, by_severity, F.lit(AROUND))
    text = F.split("source", "\n", -1)
    first = F.greatest(F.col("line") - k, F.lit(1))
    last = F.least(F.col("line") + k, F.size(text))
    numbered = F.transform(
        F.slice(text, first, F.greatest(last - first + 1, F.lit(0))),
        lambda x, i: F.concat(F.when(first + i == F.col("line"), ">>> ").otherwise("    "), (first + i).cast("string"), F.lit("| "), x),
    )
    joined = issues.join(files.select("path", "source"), "path", "left")
    return joined.select(*[F.col(f"`{c}`") for c in issues.columns], F.when(F.col("source").isNotNull(), F.array_join(numbered, "\n")).alias("context"))


def judged(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Issues after review, with ``verdict``: false positives go, enhanced ones take the new message and severity where given.

    ``verdicts`` has path, line, rule, verdict, new_message and new_severity, one row per issue at most; an issue without one stays as it is.
    Where two issues of a rule share a line, verdicts also need the issue's ``message``.
    """
    at = ["path", "line", "rule", *(["message"] if "message" in verdicts.columns else [])]
    joined = issues.join(verdicts.select(*at, "verdict", "new_message", "new_severity"), at, "left").filter("verdict is null or verdict <> 'false_positive'")
    better = lambda c: F.when(F.col("verdict") == "enhanced", F.coalesce(F.col(f"new_{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return joined.select(*[better(c) if c in ("message", "severity") else F.col(f"`{c}`") for c in issues.columns], "verdict")


def review_statistics(issues: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: issues reviewed, removed and enhanced, and the share removed in whole per cent."""
    at = ["path", "line", "rule", *(["message"] if "message" in verdicts.columns else [])]
    rows = eligible(issues).join(verdicts.select(*at, "verdict"), at, "left")
    counts = rows.agg(F.count("*").alias("reviewed"), F.count_if(F.col("verdict") == "false_positive").alias("removed"), F.count_if(F.col("verdict") == "enhanced").alias("enhanced"))
    share = F.when(F.col("reviewed") > 0, F.round(F.col("removed") * 100 / F.col("reviewed"))).otherwise(0)
    return counts.withColumn("removed_percent", share.cast("long"))


def report_lines(issues: DataFrame) -> DataFrame:
    """path, line and ``text``: the place, the severity and the message of each issue."""
    return issues.select("path", "line", F.format_string("%s:%d  [%s]  %s", "path", "line", F.upper("severity"), "message").alias("text"))


def detailed_lines(issues: DataFrame) -> DataFrame:
    """path, line and ``text``: as ``report_lines``, with the confidence (null: medium) and, below, the snippet and its line's number."""
    head = F.format_string("%s:%d [%s] [CONF:%s] %s", "path", "line", F.upper("severity"), F.upper(F.coalesce("confidence", F.lit("medium"))), "message")
    numbered = F.when(F.length("snippet") > 0, F.concat(F.lit("   "), F.lpad(F.col("line").cast("string"), 4, " "), F.lit(" | "), F.col("snippet")))
    return issues.select("path", "line", F.concat_ws("\n", head, numbered).alias("text"))


def fails(issues: DataFrame) -> bool:
    """Whether a build that checks for issues fails: there is one at least."""
    return not issues.isEmpty()


def verdict_key(issues: DataFrame) -> DataFrame:
    """Issues with ``key``, under which a verdict on them is stored: their rule, message, snippet and path."""
    return issues.withColumn("key", key_of(F.col("rule"), F.col("message"), F.col("snippet"), F.col("path")))


def already_judged(issues: DataFrame, store: VerdictStore, now: Column | None = None) -> DataFrame:
    """Issues with ``cached``, the stored verdict, and ``hit``; those without one are still to be reviewed."""
    return store.looked_up(verdict_key(issues), now).drop("key")
