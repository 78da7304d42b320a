"""Rules over whole functions, and comments with the code below them.

Functions and methods come from the scope parser (Python's from its own syntax
tree, see ``python_tree``). Nothing is shuffled.

A null source has no functions or comments; equal files give equal
issues each. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import is_test_file

_VALUE = r"(?:null|undefined|true|false|0|''|\"\"|\[\s*\]|\{\s*\})"
#: language: what the only statement of a body that does nothing may be.
EMPTY = {"javascript": "return", "typescript": "return", "java": "return(?: null)?", "go": "return(?: (?:nil|0|false|\"\"))?", "rust": r"return(?: \(\))?", "php": "return"}
#: language: the only statement of a body that gives a fixed value.
STUB = {
    "javascript": f"return {_VALUE}",
    "typescript": f"return {_VALUE}",
    "java": 'return (?:true|false|0|"")',
    "go": "return true",
    "rust": r"(?:return )?(?:None|true|false|0|todo!\(\)|unimplemented!\(\))",
    "php": r"return (?:null|true|false|0|''|\"\"|\[\])",
    "ruby": r"(?:return )?(?:nil|true|false|0|''|\"\"|\[\]|\{\})",
}
BOOLEAN_NAME = r"^(?:is|has|can|should)[A-Z_]"
FACTORY_NAME = r"^(?:create|make|build|default|noop|empty|new)"
FIXED_NAMES = ["constructor", "init", "main", "new", "default"]
_CHECKED = r"\{(?:[^{}]++|\{[^{}]*+\})*+\}"
_HEAD_JS = r"(?:function\s+(\w+)\s*\([^(){}]*\)[^{}();=]*|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^(){}]*\)[^{}();=]*=>\s*)"
WEAK = r"if\s*\(\s*!\s*\w+\s*\)\s*\{?\s*(?:return|throw)\b"
STRONG = r"(?i)typeof|instanceof|\.test\(|\.match\(|\.length\b|Number\.is|isNaN|Array\.isArray|\b(?:joi|zod|yup|ajv)\b"
NARRATIVE = r"(?i)^(?:now |then |here )?(?:we |let's |let us )?(?:create|get|set|call|loop|iterate|check|add|initiali[sz]e|define|increment|update|calculate|import)\b"
REASONED = r"(?i)\b(?:todo|fixme|hack|note|because|since|why|must|avoid|ensure|otherwise|unless|see|lint|noqa|https?)\b|@"


def _matches(files: DataFrame, pattern: str, names: int = 1) -> DataFrame:
    """path, language, line, found and name of each match of ``pattern`` in each source; the name is the first group that took part."""
    p = F.lit(pattern)
    feeds = lambda parts: F.transform(parts, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    groups = [F.regexp_extract_all("source", p, F.lit(k + 1)) for k in range(names)]
    rows = files.select("path", "language", F.split("source", "\n", -1).alias("rows"), F.regexp_extract_all("source", p, F.lit(0)).alias("found"), feeds(F.split("source", pattern, -1)).alias("between"), *[g.alias(f"name_{k}") for k, g in enumerate(groups)])
    rows = rows.filter(F.size("found") > 0).withColumn("within", feeds(F.col("found")))
    total = lambda a, n: F.aggregate(F.slice(a, 1, n), F.lit(0), lambda s, x: s + x)
    line = F.lit(1) + total("between", F.col("at") + 1) + total("within", F.col("at"))
    rows = rows.select("*", F.posexplode("found").alias("at", "text"))
    lead = F.regexp_extract("text", r"^(\s*)", 1)  # a match may begin with blank lines
    name = F.coalesce(*[F.nullif(F.get(f"name_{k}", F.col("at")), F.lit("")) for k in range(names)])
    at_line = (line + F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit("")))).cast("int")
    hits = rows.select("path", "language", "rows", at_line.alias("line"), "text", name.alias("name"))
    return hits.select("path", "language", "line", F.trim(F.get("rows", F.col("line") - 1)).alias("snippet"), "text", "name")


def _issues(rows: DataFrame, rule: str, category: str, severity: Column, confidence: str, message: str) -> DataFrame:
    fixed = [F.lit(x).alias(n) for n, x in (("rule", rule), ("confidence", confidence), ("category", category), ("message", message))]
    return rows.select("path", "line", *fixed, severity.alias("severity"), "snippet").select(*ISSUE)


def _live(files: DataFrame, *languages: str) -> DataFrame:
    return files.filter(~is_test_file(F.col("path")) & F.col("language").isin(*languages)).select("path", "language", "source")


def _named(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("name").isin(FIXED_NAMES) & ~F.col("name").rlike(f"{FACTORY_NAME}|^__|^test_"))


def _such(only: dict[str, str], none: bool):
    """Functions and methods whose one statement is as ``only`` says for their language, or (``none``) that have none."""
    pattern = F.try_element_at(F.create_map(*[F.lit(x) for k, v in only.items() for x in (k, f"^(?:{v})$")]), F.col("language"))
    none = F.lit(none) & F.col("language").isin(*only)

    def test(x):
        body = (none & (x["size"] == 0)) | ((x["size"] == 1) & F.coalesce(F.regexp_like(x["only"], pattern), F.lit(False)))
        named = (x["name"] != "") & ~x["name"].isin(FIXED_NAMES) & ~x["name"].rlike(f"{FACTORY_NAME}|^__|^test_")
        return x["kind"].isin("function", "method") & named & body

    return test


def findings(rules: set[str]) -> list[Column]:
    """Of one file's blocks (see ``syntax.parsed``): functions that do nothing or only give a fixed value, as arrays of issues without path and snippet."""

    def issue(x, rule, severity, message):
        return F.struct(x["line"].alias("line"), F.lit(rule).alias("rule"), severity.alias("severity"), F.lit("high").alias("confidence"), F.lit("ai-code").alias("category"), F.lit(message).alias("message"))

    out = []
    if "stub-function" in rules:
        asks = lambda x: F.when(x["name"].rlike(BOOLEAN_NAME), "low").otherwise("high")
        out.append(F.transform(F.filter("nodes", _such(STUB, False)), lambda x: issue(x, "stub-function", asks(x), "function only returns a fixed value")))
    if "empty-impl" in rules:
        out.append(F.transform(F.filter("nodes", _such(EMPTY, True)), lambda x: issue(x, "empty-impl", F.lit("high"), "function does nothing")))
    return out


def weak_validation(files: DataFrame) -> DataFrame:
    """Script functions with untyped parameters that ask only whether a value is there; bodies of up to two levels of braces."""
    head = F.regexp_extract("text", r"\(([^(){}]*)\)", 1)
    rows = _named(_matches(_live(files, "javascript", "typescript"), _HEAD_JS + _CHECKED, 2)).filter(F.col("text").rlike(WEAK) & ~F.col("text").rlike(STRONG) & (head != "") & ~head.contains(":"))
    return _issues(rows, "weak-validation", "ai-code", F.lit("medium"), "medium", "only presence is checked")


def narrative_comments(files: DataFrame) -> DataFrame:
    """Comments on their own line that retell the next line: a narrating verb, no reason, and a word of that line."""
    own = F.split("source", "\n", -1)
    pairs = F.arrays_zip(own.alias("text"), F.slice(own, 2, F.size(own)).alias("below"))
    rows = files.filter(~is_test_file(F.col("path"))).select("path", "language", F.posexplode(pairs).alias("at", "x")).select("path", "language", (F.col("at") + 1).alias("line"), F.col("x.text").alias("text"), F.col("x.below").alias("below"))
    mark = F.when(F.col("language").isin("python", "ruby"), F.regexp_extract("text", r"^\s*#\s*(.*)$", 1)).otherwise(F.regexp_extract("text", r"^\s*//\s*(.*)$", 1))
    rows = rows.withColumn("said", F.trim(mark)).filter(F.length("said") >= 8).filter(F.col("said").rlike(NARRATIVE) & ~F.col("said").rlike(REASONED))
    tokens = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))
    rows = rows.filter(F.arrays_overlap(tokens("said"), tokens("below"))).withColumn("snippet", F.trim("text"))
    return _issues(rows, "narrative-comments", "ai-code", F.lit("low"), "low", "comment retells the code")
