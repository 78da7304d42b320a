"""Handlers that swallow errors, and code behind a return: patterns over code without comments, and the scopes around it.

Patterns are expressions over one file's row; Python's handlers come from its
syntax tree (see ``python_tree``). A null source has no
issues; equal files give equal issues each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import is_test_file

_JS = r"\bcatch\s*(?:\(\s*\w+[^(){}]*\)\s*)?\{\s*(?:console\.log\s*\([^{}\n]*\)\s*;?\s*|console\.\w+\s*\(\s*\w+\s*\)\s*;?\s*)?\}"
#: language: a handler from its keyword on, with a body that does nothing or only tells of the error.
SWALLOWED = {
    "javascript": _JS,
    "typescript": _JS,
    "java": r"\bcatch\s*\([^()]*\)\s*\{\s*(?:(?:\w+\.printStackTrace\s*\(\s*\)|(?:System\.(?:out|err)\.print\w*|log(?:ger)?\.\w+)\s*\([^;{}]*\))\s*;\s*)*\}",
    "go": r"\bif\s+err\s*!=\s*nil\s*\{\s*(?:(?:log|fmt)\.\w+\([^\n]*\)\s*){0,2}\}",
    "php": r"\bcatch\s*\([^()]*\)\s*\{\s*(?:(?:echo|print|var_dump|error_log)\b[^;{}]*;\s*)*\}",
    "ruby": r"(?m)^[ \t]*rescue\b[^\n]*\n\s*(?:nil\s+|retry\s+|(?:puts|p|warn|(?:Rails\.)?logger\.\w+)\b[^\n]*\n\s*)?(?:end|ensure|else)\b",
}
#: What may stand behind a return: declarations that hold anywhere, labels of a switch, and one more way out.
HOISTED = r"^(?:function|class|method) \{\}$|^(?:case|default|when)\b|^(?:return|throw|raise|break|continue|goto)\b|^(?:export|import|type|interface|end)\b"


def _feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _found(files: DataFrame, pattern: str) -> DataFrame:
    """path, line and snippet of each match in the code; a match begins where its first visible character is."""
    kind = "struct<line:int,out:array<int>>"

    def step(acc, x):
        lead = F.regexp_extract(x["m"], r"^(\s*)", 1)
        at = acc["line"] + _feeds(x["b"])
        return F.struct((at + _feeds(x["m"])).alias("line"), F.array_append(acc["out"], at + _feeds(lead)).alias("out")).cast(kind)

    pairs = F.arrays_zip(F.split("code", pattern, -1).alias("b"), F.regexp_extract_all("code", F.lit(pattern), F.lit(0)).alias("m"))
    at = F.aggregate(F.filter(pairs, lambda x: x["m"].isNotNull()), F.struct(F.lit(1).alias("line"), F.array().cast("array<int>").alias("out")).cast(kind), step)["out"]
    rows = files.filter(F.col("code").rlike(pattern)).select("path", F.split("source", "\n", -1).alias("rows"), at.alias("at"))
    hits = rows.select("path", F.explode(F.transform("at", lambda n: F.struct(n.alias("line"), F.get("rows", n - 1).alias("text")))).alias("x"))
    return hits.select("path", "x.line", F.regexp_replace("x.text", r"^\s+|\s+$", "").alias("snippet"))


def _issues(rows: DataFrame, rule: str, category: str, severity: str, confidence: Column, message: str) -> DataFrame:
    fixed = [F.lit(x).alias(n) for n, x in (("rule", rule), ("severity", severity), ("category", category), ("message", message))]
    return rows.select("path", "line", *fixed, confidence.alias("confidence"), "snippet").select(*ISSUE)


def swallowed_errors(files: DataFrame) -> DataFrame:
    """Handlers of six languages whose body is empty or only prints or logs."""
    live = files.filter(~is_test_file(F.col("path")) & F.col("language").isin(*SWALLOWED))
    live = live.select("path", "language", "source", code(F.col("source"), F.col("language")).alias("code"))
    out = None
    for pattern in sorted(set(SWALLOWED.values())):
        part = _found(live.filter(F.col("language").isin(*[k for k, v in SWALLOWED.items() if v == pattern])), pattern)
        out = part if out is None else out.unionByName(part)
    return _issues(out, "swallowed-error", "ai-code", "high", F.lit("medium"), "error is caught and not handled")


def findings(rules: set[str]) -> list[Column]:
    """Of one file's statements (see ``syntax.parsed``): the first one of each block behind one that leaves it, as an array of issues without path and snippet.

    What leaves a block is a return, throw or the like, or branches that all end so. Of low confidence where no other
    statement of the block follows.
    """
    if "unreachable-code" not in rules:
        return []
    dead = F.filter("statements", lambda x: ~x["reached"] & ~x["text"].rlike(HOISTED))

    def first(spans):
        same = lambda x: F.filter(spans, lambda y: y["node"] == x["node"])
        alone = lambda x: F.size(same(x)) == 1
        heads = F.filter(spans, lambda x: x["seq"] == F.array_min(F.transform(same(x), lambda y: y["seq"])))
        fixed = [F.lit(v).alias(n) for n, v in (("rule", "unreachable-code"), ("severity", "low"))]
        rest = [F.lit(v).alias(n) for n, v in (("category", "correctness"), ("message", "code behind a return is never reached"))]
        return F.transform(heads, lambda x: F.struct(x["line"].alias("line"), *fixed, F.when(alone(x), "low").otherwise("medium").alias("confidence"), *rest))

    return [F.element_at(F.transform(F.array(dead), first), 1)]  # ``dead`` computed once
