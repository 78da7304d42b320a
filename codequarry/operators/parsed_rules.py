"""All rules over blocks, statements and Python's tree: one pass of each parser for all of them, whatever rules are on.

Each rule gives an array of issues of one file's row; they are joined and become
rows at once, so a file is read and parsed once for them, and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import block_rules, flow_rules, promise_rules, python_tree, syntax
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import is_test_file

BY_SCOPES = {"stub-function", "empty-impl", "unreachable-code", "unhandled-promise"}
BY_TREE = {"stub-function", "empty-impl", "swallowed-error"}


def _rows(parsed: DataFrame, found: list) -> DataFrame:
    rows = parsed.select("path", F.split("source", "\n", -1).alias("shown"), F.inline(F.concat(*found)))
    snippet = F.regexp_replace(F.get("shown", F.col("line") - 1), r"^\s+|\s+$", "").alias("snippet")
    return rows.select(*[snippet if n == "snippet" else F.col(n) for n in ISSUE])


def issues(files: DataFrame, rules: set[str]) -> list[DataFrame]:
    """Issues of the rules asked for, in two parts at most: of scopes in eight languages, of Python's tree."""
    live = files.filter(~is_test_file(F.col("path")))
    out = []
    if rules & BY_SCOPES:
        rows = syntax.parsed(live).withColumn("rows", F.split("code", "\n", -1))
        out.append(_rows(rows, [*block_rules.findings(rules), *flow_rules.findings(rules), *promise_rules.findings(rules)]))
    if rules & BY_TREE:
        out.append(_rows(python_tree.parsed(live), python_tree.findings(rules)))
    return out
