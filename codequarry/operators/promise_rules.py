"""Promises and awaits without a handler: statements and the blocks around them.

Everything is judged from the row of one file (its statements and blocks, found
in one pass of the scope parser), so the rule needs no shuffle. A chain of
``then`` is one statement however many lines it takes; an await is guarded by a
handled ``try`` around it, by a function whose body is one, or by a ``try``
right behind it that begins a transaction.

A null source has no issues; equal files give equal issues each. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators import syntax

# Words of operations that may fail.
CRITICAL_WORDS = [
    "fetch", "axios", "http", "request", "get", "post", "put", "delete", "patch", "head", "db", "database", "mongo", "redis", "sql", "query", "execute", "insert", "update", "remove",
    "writeFile", "readFile", "write", "save", "create", "unlink", "mkdir", "rmdir",
]
# Calls after which an unhandled rejection does little harm.
HARMLESS_CALLS = ["showError", "showSuccess", "showWarning", "showInfo", "alert", "toast", "notification", "notify"]
HARMLESS_OBJECTS = [r"navigator\.clipboard", "console", "classList"]
# Names of variables that hold a transaction.
TRANSACTIONS = ["transaction", "tx", "txn", "sess", "session"]
CRITICAL = rf"(?i)\bawait\b.*\b(?:{'|'.join(CRITICAL_WORDS)})\b"
HARMLESS = rf"\b(?:{'|'.join(HARMLESS_CALLS)})\s*\(|\b(?:{'|'.join(HARMLESS_OBJECTS)})\.\w+\s*\("
FUNCTIONS = ("function", "method")


def _within(x: Column, blocks: Column) -> Column:
    return F.exists(blocks, lambda b: x["line"].between(b["line"], b["end"]))


def _text(x: Column) -> Column:
    """All lines of a statement, blocks inside it included."""
    return F.array_join(F.slice(F.col("rows"), x["line"], x["last"] - x["line"] + 1), "\n")


def findings(rules: set[str]) -> list[Column]:
    """Of one file (see ``syntax.parsed``, and ``rows``, its code's lines): an array of issues without path and snippet."""
    if "unhandled-promise" not in rules:
        return []
    statements, nodes, language = F.col("statements"), F.col("nodes"), F.col("language")
    tries = F.filter(nodes, lambda n: (n["kind"] == "try") & (n["name"] == "handled"))
    whole = F.filter(nodes, lambda n: n["kind"].isin(*FUNCTIONS) & (n["lead"] == "try {}"))  # functions of which the body is a try
    script = language.isin("javascript", "typescript")

    def hit(x: Column, message: str, confidence: str) -> Column:
        fixed = [F.lit(v).alias(n) for n, v in (("rule", "unhandled-promise"), ("severity", "medium"), ("confidence", confidence), ("category", "ai-code"), ("message", message))]
        return F.struct(x["line"].alias("line"), *fixed)

    chains = F.filter(statements, lambda x: script & x["text"].rlike(r"\.then\s*\(") & ~x["text"].rlike(r"\.catch\s*\(") & ~_text(x).rlike(HARMLESS) & ~_text(x).rlike(r"\.catch\s*\("))
    follows = lambda x: F.exists(statements, lambda y: (y["node"] == x["node"]) & (y["seq"] == x["seq"] + 1) & (y["text"] == "try {}"))
    begins = lambda x: x["text"].rlike(rf"\b(?:{'|'.join(TRANSACTIONS)})\s*=")
    awaits = F.filter(statements, lambda x: ((script & x["text"].rlike(CRITICAL)) | ((language == "python") & x["text"].startswith("await ") & x["text"].rlike(CRITICAL))))
    bare = F.filter(awaits, lambda x: ~_within(x, F.concat(tries, whole)) & ~(begins(x) & follows(x)))
    futures = F.filter(statements, lambda x: (language == "java") & x["text"].rlike(r"\.get\s*\(\s*\)") & x["text"].rlike("[Ff]uture") & ~_within(x, tries))
    found = F.concat(
        F.transform(chains, lambda x: hit(x, "chain of then() without catch()", "high")),
        F.transform(bare, lambda x: hit(x, "await of an operation that may fail outside try", "low")),
        F.transform(futures, lambda x: hit(x, "Future.get() outside try", "medium")),
    )
    return [found]


def awaits_outside_try(files: DataFrame) -> DataFrame:
    """path and line of every statement that awaits and lies in no handled ``try``: an interval anti join over all files."""
    awaits = syntax.statements(files).filter(F.col("text").rlike(r"\bawait\b")).select("path", "line")
    tries = syntax.ast_nodes(files).filter("kind = 'try' and name = 'handled'").select("path", "line", "end")
    return syntax.inside(awaits, tries, "left_anti")
