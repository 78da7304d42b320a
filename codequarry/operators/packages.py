"""Packages of nine more languages that no catalog, manifest or file of the project knows.

A name such as ``a.b.c`` is known if any of its beginnings is: all beginnings
are exploded and meet the known names by an equi-join, so nothing is compared
by LIKE. What a manifest declares counts below its folder only: each file's
folders meet the folders of manifests, and the longest one is the file's own.
Only the catalogs, of a fixed size, are broadcast.

A null source has no imports; a file imported twice is reported twice. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.operators import symbols
from codequarry.operators.catalogs import STANDARD
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import is_test_file

#: language: what a line of code imports.
IMPORTED = {
    "java": r"^import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;",
    "rust": r"^(?:pub\s+)?use\s+(?:::)?([\w:]*\w)",
    "php": r"^use\s+(?:function\s+|const\s+)?\\?([A-Za-z_][\w\\]*)",
    "c": r"^\s*#\s*include\s*<([^>\s]+)>",
    "cpp": r"^\s*#\s*include\s*<([^>\s]+)>",
    "kotlin": r"^import\s+([\w.]+?)(?:\.\*)?(?:\s++as\s++\w++)?\s*+(?:;\s*+)?$",
    "swift": r"^(?:@\w+\s+)?import\s+(?:(?:struct|class|enum|protocol|func|typealias)\s+)?(\w+)",
    "csharp": r"^(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;",
}
#: A line of Go that holds a path; no white space is given back, as a blanked comment is a line of it, of any length.
QUOTED = r'^\s*+(?:import\s++)?+(?:\(\s*+)?+(?:[\w.]++\s++)?+"([^"]++)"\s*+(?:\)\s*+)?+$'
RELATIVE = r"""^\s*(?:require|include)(?:_once)?\s*\(?\s*['"](\.{0,2}/[^'"]+)['"]"""
#: What separates the parts of a name.
SEPARATOR = {"go": "/", "java": ".", "rust": "::", "php": "\\", "c": "/", "cpp": "/", "kotlin": ".", "swift": ".", "csharp": "."}


def package_imports(files: DataFrame) -> DataFrame:
    """path, language, line, module of each import in nine languages; relative ones are left out."""
    rows = files.filter(F.col("language").isin(*IMPORTED)).select("path", "language", F.posexplode(F.split(code(F.col("source"), F.col("language")), "\n", -1)).alias("at", "text"))
    module = F.lit("")
    for language, pattern in IMPORTED.items():
        module = F.when(F.col("language") == language, F.regexp_extract("text", pattern, 1)).otherwise(module)
    rows = rows.select("path", "language", (F.col("at") + 1).alias("line"), module.alias("module")).filter("module <> ''")
    go = files.filter("language = 'go'")
    lines = go.select("path", F.posexplode(F.split(code(F.col("source"), F.col("language")), "\n", -1)).alias("at", "text"))
    # an import's statement may have many lines: each path stands on a line of its own
    paths = symbols.imports(go).select("path", F.col("line").alias("first"), F.col("source").alias("module")).distinct()
    quoted = lines.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("text", QUOTED, 1).alias("module")).filter("module <> ''")
    found = paths.join(quoted, ["path", "module"]).filter("line >= first").groupBy("path", "module", "first").agg(F.min("line").alias("line"))
    return rows.unionByName(found.select("path", F.lit("go").alias("language"), "line", "module").distinct())


def _beginnings(module: Column, separator: str) -> Column:
    parts = F.split(module, "\\Q" + separator + "\\E", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))


def beginnings(module: Column, language: Column) -> Column:
    """All beginnings of a name by its language's separator, the whole name included."""
    out = F.array(module)
    for separator in sorted(set(SEPARATOR.values())):
        names = [k for k, v in SEPARATOR.items() if v == separator]
        out = F.when(language.isin(*names), _beginnings(module, separator)).otherwise(out)
    return out


def standard(spark) -> DataFrame:
    """language and name of the catalogs, and whether names below it are known too."""
    return spark.createDataFrame([(language, n, separator != "") for language, (names, separator) in STANDARD.items() for n in sorted(names)], "language string, name string, nests boolean")


def nearest_manifests(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, language and folder: the nearest folder above each path with a manifest of its language (manifests: path, language)."""
    folders = manifests.select("language", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")).distinct()
    parts = F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    rows = paths.select("path", "language").distinct().select("path", "language", F.explode(F.array_distinct(above)).alias("folder"))
    return rows.join(folders, ["language", "folder"]).groupBy("path", "language").agg(F.max_by("folder", F.length("folder")).alias("folder"))


def own_modules(files: DataFrame) -> DataFrame:
    """language and name under which a project's own files are imported: Java and Kotlin by package, Rust by crate module, PHP and C# by first folder."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    dotted = F.replace(F.regexp_replace(stem, r"^(?:.*/)?(?:src/main/(?:java|kotlin)|src)/", ""), F.lit("/"), F.lit("."))
    rust = F.regexp_extract("path", r"(?:^|/)src/(\w+)(?:\.rs|/mod\.rs)$", 1)
    names = F.when(F.col("language").isin("java", "kotlin"), F.array(dotted)).when(F.col("language") == "rust", F.array(rust)).when(F.col("language").isin("c", "cpp"), F.array("path", F.substring_index("path", "/", -1)))
    return files.select("language", F.explode(names).alias("name")).filter("name <> ''").distinct()


def unknown_modules(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """path, language, line, module of imports that nothing knows; ``declared`` has path, language and name of manifests' entries."""
    spark = files.sparkSession
    used = package_imports(files.filter(~is_test_file(F.col("path"))))
    key = ["path", "language", "line", "module"]
    begun = used.select(*key, F.explode(beginnings(F.col("module"), F.col("language"))).alias("name"))
    # a whole name, or a beginning where names nest
    known = begun.join(F.broadcast(standard(spark)), ["language", "name"]).filter("nests or name = module").select(*key)
    known = known.unionByName(begun.join(own_modules(files), ["language", "name"], "left_semi").select(*key))
    if declared is not None:
        near = nearest_manifests(used, declared)
        entries = declared.select("language", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.when(F.col("language") == "rust", F.replace("name", F.lit("-"), F.lit("_"))).otherwise(F.col("name")).alias("name")).distinct()
        known = known.unionByName(begun.join(near, ["path", "language"]).join(entries, ["language", "folder", "name"], "left_semi").select(*key))
    return used.join(known.distinct(), key, "left_anti")


def missing_files(files: DataFrame) -> DataFrame:
    """path, line, module: what PHP requires by a relative path and the project does not have."""
    rows = files.filter((F.col("language") == "php") & ~is_test_file(F.col("path"))).select("path", F.posexplode(F.split(code(F.col("source"), F.col("language")), "\n", -1)).alias("at", "text"))
    rows = rows.select("path", (F.col("at") + 1).alias("line"), F.regexp_extract("text", RELATIVE, 1).alias("module")).filter("module <> ''")
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    target = symbols.normalized(F.when(F.col("module").startswith("/"), F.col("module")).otherwise(F.concat_ws("/", folder, F.col("module"))))
    return rows.withColumn("target", target).join(files.select(F.col("path").alias("target")).distinct(), "target", "left_anti").select("path", "line", "module")


def unknown_packages(files: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Issues of ``unknown_modules`` and ``missing_files``."""
    rows = unknown_modules(files, declared).select("path", "line", F.when(F.col("language") == "go", "high").otherwise("medium").alias("severity"), F.lit("package is not known").alias("message"))
    rows = rows.unionByName(missing_files(files).select("path", "line", F.lit("high").alias("severity"), F.lit("required file does not exist").alias("message")))
    rows = rows.join(files.select("path", F.split("source", "\n", -1).alias("rows")), "path").withColumn("snippet", F.regexp_replace(F.get("rows", F.col("line") - 1), r"^\s+|\s+$", ""))
    fixed = {"rule": F.lit("package-hallucination"), "confidence": F.lit("high"), "category": F.lit("hallucination")}
    return rows.select(*[fixed[n].alias(n) if n in fixed else F.col(n) for n in ISSUE])
