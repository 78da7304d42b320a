"""Filters, confirmation, order, statistics and reports of issues."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.sources.source_files import language_of

SEVERITIES = ("critical", "high", "medium", "low", "info")
CONFIDENCES = ("high", "medium", "low")


def rank(column: str, values: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, values)), F.col(column))


def ignore_rules(issues: DataFrame, rules: list[str]) -> DataFrame:
    return issues.filter(~F.col("rule").isin(rules)) if rules else issues


def ignore_paths(issues: DataFrame, patterns: list[str]) -> DataFrame:
    """A path goes if it holds a pattern, or is matched whole by one with stars."""
    for p in patterns:
        whole = "^" + ".*".join(re.escape(x) for x in p.split("*")) + "$"
        issues = issues.filter(~(F.col("path").contains(p) | F.col("path").rlike(whole)))
    return issues


def ignore_issues(issues: DataFrame, listed: DataFrame) -> DataFrame:
    """``listed`` has rule, path and line; a null line stands for any."""
    i, x = issues.alias("i"), listed.alias("x")
    return i.join(x, (F.col("i.rule") == F.col("x.rule")) & (F.col("i.path") == F.col("x.path")) & (F.col("x.line").isNull() | (F.col("x.line") == F.col("i.line"))), "left_anti")


def min_confidence(issues: DataFrame, least: str = "medium") -> DataFrame:
    return issues.filter(rank("confidence", CONFIDENCES) <= CONFIDENCES.index(least) + 1)


def strict(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("severity").isin("critical", "high", "medium"))


def reduce_false_positives(issues: DataFrame) -> DataFrame:
    return issues.filter(~((F.col("severity") == "info") | ((F.col("severity") == "low") & (F.coalesce("confidence", F.lit("low")) == "low"))))


def confirmed_by_registry(issues: DataFrame, known: DataFrame) -> DataFrame:
    """Package issues go whose package a registry knows, if ``known`` (name, language) has it in the file's language; others stay.

    A ``known`` without languages counts for all. An issue's package is the last word of its snippet.
    """
    named = issues.withColumn("package", F.regexp_extract("snippet", r"([\w.-]+)\W*$", 1)).withColumn("of", language_of(F.col("path")))
    k = known.select(F.col("name").alias("package"), F.lit("package-hallucination").alias("rule"), *([F.col("language").alias("of")] if "language" in known.columns else [])).distinct()
    return named.join(k, [c for c in ("package", "rule", "of") if c in k.columns], "left_anti").select(*issues.columns)


def ordered(issues: DataFrame) -> DataFrame:
    return issues.orderBy(rank("severity", SEVERITIES), "path", "line", "rule", "message")


def statistics(issues: DataFrame) -> DataFrame:
    """Counts by severity, confidence, category and in all, in one pass."""
    kinds = ("severity", "confidence", "category")
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds], F.struct(F.lit("total").alias("kind"), F.lit("").alias("value")))
    return issues.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def by_file(issues: DataFrame) -> DataFrame:
    return issues.groupBy("path").agg(F.count("*").alias("n"), F.min(rank("severity", SEVERITIES)).cast("int").alias("worst"), F.min("line").alias("first_line"))


def as_json(issues: DataFrame) -> DataFrame:
    return issues.select(F.to_json(F.struct(*issues.columns)).alias("json"))
