"""Rules that relate lines of a file, or files of a project: equi-joins, anti-joins and aggregates."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.operators import packages
from codequarry.operators.catalogs import NODE_BUILTINS, PYTHON_COMMON_PACKAGES, PYTHON_STDLIB, RUBY_STDLIB
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import extension, is_test_file, lines

#: language: how a resource is opened into a variable, how a call on it closes it.
OPENED = {
    "python": r"^\s*(\w+)\s*=\s*(?:open|sqlite3\.connect|psycopg2\.connect|pymysql\.connect|redis\.Redis|MongoClient)\s*\(",
    "javascript": r"(?:const|let|var)\s+(\w+)\s*=\s*(?:fs\.)?(?:createReadStream|createWriteStream|net\.createConnection|mysql\.createConnection)\s*\(",
    "typescript": r"(?:const|let|var)\s+(\w+)\s*=\s*(?:fs\.)?(?:createReadStream|createWriteStream|net\.createConnection|mysql\.createConnection)\s*\(",
    "java": r"(\w+)\s*=\s*new\s+(?:FileInputStream|FileOutputStream|FileReader|FileWriter|Socket)\s*\(",
    "go": r"(\w+)\s*,\s*\w+\s*:?=\s*(?:os\.(?:Open|Create|OpenFile)|net\.(?:Dial|Listen)|sql\.Open)\s*\(",
    "rust": r"let\s+(?:mut\s+)?(\w+)\s*=\s*BufWriter::new\s*\(",
    "php": r"(\$\w+)\s*=\s*(?:fopen|curl_init)\s*\(",
    "ruby": r"(\w+)\s*=\s*(?:File\.open|Mysql2::Client\.new|PG\.connect)\s*\(",
}
CLOSED = r"(\$?\w+)\.(?:close|Close|end|destroy|quit|disconnect|flush|pipe)\b|(?:fclose|curl_close|drop)\s*\(\s*(\$?\w+)"
PASSED_ON = r"^\s*(?:return|yield)\s+(\$?\w+)\s*;?\s*$"
#: language: what each import of a line names; Python's ``import`` holds a list, see ``imports``.
IMPORTED = {
    "javascript": r"""(?:\bfrom\s*|\brequire\s*\(\s*)['"`]([^'"`\s]+)['"`]""",
    "typescript": r"""(?:\bfrom\s*|\brequire\s*\(\s*)['"`]([^'"`\s]+)['"`]""",
    "ruby": r"""\brequire\s+['"]([^'"]+)['"]""",
}
PYTHON_FROM = r"^\s*from\s+([A-Za-z_][\w.]*)\s+import\b"
PYTHON_IMPORT = r"^\s*import\s+([A-Za-z_][^#;]*)"
PYTHON_ITEM = r"^\s*([A-Za-z_]\w*(?:\.\w+)*)(?:\s+as\s+\w+)?[\s\\]*$"
#: Modules of examples, in Python and scripts.
PLACEHOLDER = r"(?i)^(?:\.{3}|[xyz]{2,}|todo|fixme|placeholder|example|foobar?|dummy)$"
# Popular packages beyond the catalogs.
POPULAR = {"javascript": "react vue express lodash axios next".split(), "typescript": "react vue express lodash axios next".split(), "ruby": "rails rspec sinatra".split()}


def _by_language(pattern: dict[str, str]):
    out = F.lit("")
    for language, p in pattern.items():
        out = F.when(F.col("language") == language, F.regexp_extract("text", p, 1)).otherwise(out)
    return out


def _issue(rows: DataFrame, rule: str, category: str, severity: str, confidence: str, message: str, snippet: str = "text") -> DataFrame:
    fixed = [F.lit(x).alias(n) for n, x in (("rule", rule), ("severity", severity), ("confidence", confidence), ("category", category), ("message", message))]
    return rows.select("path", "line", *fixed, F.trim(snippet).alias("snippet")).select(*ISSUE)


def resource_leaks(files: DataFrame) -> DataFrame:
    """Lines that open a resource into a variable which no later line of the file closes or passes on."""
    rows = lines(files.filter(~is_test_file(F.col("path"))))
    opened = rows.withColumn("name", _by_language(OPENED)).filter("name <> '' and not text rlike '(^|[^A-Za-z_])(with|using|try) *[(]'")
    ended = rows.select("path", F.col("line").alias("end_line"), F.explode(F.array(F.regexp_extract("text", CLOSED, 1), F.regexp_extract("text", CLOSED, 2), F.regexp_extract("text", PASSED_ON, 1))).alias("name"))
    last = ended.filter("name <> ''").groupBy("path", "name").agg(F.max("end_line").alias("end_line"))
    left = opened.join(last, (opened.path == last.path) & (opened.name == last.name) & (last.end_line > opened.line), "left_anti")
    return _issue(left, "resource-leak", "ai-code", "medium", "medium", "resource is never closed")


def imports(files: DataFrame) -> DataFrame:
    """path, language, line, text, module and name, its top-level package: one row per import; relative ones have none."""
    rows = lines(files.filter(~is_test_file(F.col("path"))).filter(F.col("language").isin("python", *IMPORTED)))
    # the first of a list may be followed by anything, the others only by what makes them an item
    listed = F.transform(F.split(F.regexp_extract("text", PYTHON_IMPORT, 1), ","), lambda x, i: F.when(i == 0, F.regexp_extract(x, r"^([\w.]*)", 1)).otherwise(F.regexp_extract(x, PYTHON_ITEM, 1)))
    named = F.when(F.col("language") == "python", F.concat(listed, F.array(F.regexp_extract("text", PYTHON_FROM, 1))))
    for language, p in IMPORTED.items():
        named = named.when(F.col("language") == language, F.regexp_extract_all("text", F.lit(p), F.lit(1)))
    rows = rows.select("*", F.explode(named).alias("module")).filter("module <> '' and not module rlike '^[./]'")
    rows = rows.withColumn("module", F.when(F.col("language").isin("javascript", "typescript"), F.regexp_replace("module", "^node:", "")).otherwise(F.col("module")))
    top = F.when(F.col("language") == "python", F.regexp_extract("module", r"^(\w+)", 1)).otherwise(F.regexp_extract("module", r"^(@[^/]+/[^/]+|[^/]+)", 1))
    return rows.withColumn("name", top)


def trusted(spark) -> DataFrame:
    """Modules (language, module) of the runtimes and popular Python packages: the catalogs and this Python's own modules."""
    rows = [("python", n) for n in PYTHON_STDLIB | PYTHON_COMMON_PACKAGES | sys.stdlib_module_names] + [("ruby", n) for n in RUBY_STDLIB]
    rows += [(language, n.removeprefix("node:")) for language in ("javascript", "typescript") for n in NODE_BUILTINS]
    return spark.createDataFrame(sorted(set(rows)), "language string, module string")


def unknown_packages(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Imports of packages that no catalog, project module or declaration (path, language, name) knows, in all languages."""
    spark = files.sparkSession
    popular = spark.createDataFrame([(language, n) for language, names in POPULAR.items() for n in names], "language string, name string")
    used = imports(files).filter(~(F.col("module").rlike(PLACEHOLDER) & (F.col("language") != "ruby")))
    # Python's catalog holds packages, the others whole modules: fs is known, fs/madeup is not
    used = used.withColumn("module", F.when(F.col("language") == "python", F.col("name")).otherwise(F.col("module")))
    used = used.join(F.broadcast(trusted(spark)), ["language", "module"], "left_anti").join(F.broadcast(popular), ["language", "name"], "left_anti")
    own = files.select("language", F.explode(F.split(F.regexp_replace("path", r"\.[^./]+$", ""), "/")).alias("name")).distinct()
    left = used.join(own, ["language", "name"], "left_anti")
    if declared is not None:
        near = packages.nearest_manifests(left, declared)
        entries = declared.select("language", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), "name").distinct()
        known = left.select("path", "language", "name").distinct().join(near, ["path", "language"]).join(entries, ["language", "folder", "name"], "left_semi").select("path", "language", "name")
        left = left.join(known, ["path", "language", "name"], "left_anti")
    return packages.unknown_packages(files, declared).unionByName(_issue(left, "package-hallucination", "hallucination", "high", "high", "package is not known"))


def unused_imports(files: DataFrame) -> DataFrame:
    """Python imports whose name occurs once in the whole file."""
    used = imports(files).filter("language = 'python' and text rlike '^ *import [A-Za-z_0-9]+ *$'")
    words = lines(files).select("path", F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0))).alias("name"))
    counts = words.groupBy("path", "name").count().filter("count > 1").select("path", "name")
    return _issue(used.join(counts, ["path", "name"], "left_anti"), "unused-declaration", "quality", "low", "medium", "import is not used")


def structure(paths: DataFrame) -> DataFrame:
    """Project gaps, from a table of paths: one aggregate, then one row per gap."""
    name, ext = F.regexp_extract("path", r"([^/]+)$", 1), extension(F.col("path"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    seen = paths.agg(
        *[has(name == n).alias(n.strip(".").replace(".", "_")) for n in ("package.json", "tsconfig.json", "go.mod", "Cargo.toml", ".gitignore")],
        has(name.isin("requirements.txt", "pyproject.toml", "setup.py")).alias("python_manifest"),
        *[has(ext == e).alias(f"any{e[1:]}") for e in (".ts", ".py", ".go", ".rs")],
    )
    gap = lambda ok, severity, message, path: F.when(ok, F.struct(F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(path).alias("path")))
    gaps = F.array(
        gap(F.expr("package_json and anyts and not tsconfig_json"), "medium", "tsconfig.json is missing", "tsconfig.json"),
        gap(F.expr("anypy and not package_json and not python_manifest"), "medium", "no list of dependencies", "requirements.txt"),
        gap(F.expr("anygo and not package_json and not go_mod"), "high", "go.mod is missing", "go.mod"),
        gap(F.expr("anyrs and not package_json and not Cargo_toml"), "high", "Cargo.toml is missing", "Cargo.toml"),
        gap(F.expr("not gitignore"), "low", ".gitignore is missing", ".gitignore"),
    )
    rows = seen.select(F.explode(F.array_compact(gaps)).alias("x"))
    fixed = {"rule": F.lit("structure"), "confidence": F.lit("medium"), "category": F.lit("correctness"), "line": F.lit(1), "snippet": F.lit("")}
    return rows.select(*[fixed[n].alias(n) if n in fixed else F.col(f"x.{n}").alias(n) for n in ISSUE])
