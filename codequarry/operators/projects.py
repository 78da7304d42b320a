"""Gaps of whole projects: files that should be there, entries and dependencies of package.json that are not.

The input lists every file: project, path (below the project's root) and source
(needed of package.json and of scripts below src; null elsewhere). Flags are one
aggregate for each project; what package.json names meets the paths and folders
of its own project by equi-joins, so equal paths of two projects never mix.

A null project is one of its own, the nameless. A package.json that is no JSON
names nothing and lacks a type. Repeated rows add nothing; an empty table has no
projects. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators.line_rules import ISSUE
from codequarry.operators.symbols import normalized
from codequarry.sources.source_files import extension, in_ignored_folder

PYTHON_MANIFESTS = ["requirements.txt", "pyproject.toml", "setup.py"]
MANIFEST = "struct<main:string,module:string,bin:string,type:string,dependencies:map<string,string>,devDependencies:map<string,string>>"


def listed(files: DataFrame) -> DataFrame:
    """project, path, source of a table that may lack a project or sources."""
    project = F.coalesce("project", F.lit("")) if "project" in files.columns else F.lit("")
    source = F.col("source") if "source" in files.columns else F.lit(None).cast("string")
    return files.select(project.alias("project"), "path", source.alias("source"))


def manifests(files: DataFrame) -> DataFrame:
    """project and package.json as a struct; ``bin`` stays text, as it may be a path or a table of paths."""
    rows = files.filter("path = 'package.json'").groupBy("project").agg(F.max("source").alias("source"))
    return rows.select("project", F.from_json("source", MANIFEST).alias("of"))


def flags(files: DataFrame) -> DataFrame:
    """One row for each project: which files its root has, which kinds of code it holds, whether scripts import."""
    name, ext = F.col("path"), extension(F.col("path"))
    own = ~in_ignored_folder(F.col("path"))
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    roots = {"package_json": ["package.json"], "tsconfig": ["tsconfig.json"], "go_mod": ["go.mod"], "cargo": ["Cargo.toml"], "gitignore": [".gitignore"], "python_manifest": PYTHON_MANIFESTS}
    esm = name.startswith("src/") & (ext == ".js") & own & F.coalesce(F.col("source"), F.lit("")).rlike(r"(?m)^\s*import\s")
    return files.groupBy("project").agg(
        *[has(name.isin(names)).alias(k) for k, names in roots.items()],
        has((ext == ".ts") & ~name.endswith(".d.ts") & own).alias("ts"),
        *[has((ext == e) & own).alias(e[1:]) for e in (".py", ".go", ".rs")],
        has(esm).alias("imports"),
        has(name.startswith("node_modules/")).alias("installed"),
    )


def _gap(ok: Column, severity: str, message: str, path: str) -> Column:
    return F.when(ok, F.struct(F.lit(path).alias("path"), F.lit(severity).alias("severity"), F.lit(message).alias("message")))


def missing_settings(files: DataFrame) -> DataFrame:
    """project, path, severity, message of settings files that are missing, or do not say what the code needs."""
    of = flags(files).join(manifests(files), "project", "left")
    module = F.coalesce(F.col("of.type") == "module", F.lit(False))
    gaps = F.array(
        _gap(F.expr("package_json and ts and not tsconfig"), "medium", "tsconfig.json is missing", "tsconfig.json"),
        _gap(F.expr("package_json and imports") & ~module, "medium", 'package.json does not say "type": "module", but scripts import', "package.json"),
        _gap(F.expr("py and not package_json and not python_manifest"), "medium", "no list of dependencies", "requirements.txt"),
        _gap(F.expr("go and not package_json and not go_mod"), "high", "go.mod is missing", "go.mod"),
        _gap(F.expr("rs and not package_json and not cargo"), "high", "Cargo.toml is missing", "Cargo.toml"),
        _gap(F.expr("not gitignore"), "low", ".gitignore is missing", ".gitignore"),
    )
    return of.select("project", F.inline(F.array_compact(gaps)))


def _existing(files: DataFrame) -> DataFrame:
    """project and place: every file and every folder that holds one."""
    parts = F.split("path", "/")
    return files.select("project", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("place")).distinct()


def missing_entries(files: DataFrame) -> DataFrame:
    """project, path, severity, message of ``main``, ``module`` and ``bin`` that name a file which does not exist."""
    table = F.from_json("of.bin", "map<string,string>")
    bins = F.when(F.col("of.bin").startswith("{"), F.map_values(table)).when(F.col("of.bin").isNotNull(), F.array("of.bin"))
    entry = lambda kind, severity, names: F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), x.alias("named")))
    one = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.array(c))
    rows = manifests(files).select("project", F.inline(F.concat(entry("main", "high", one("of.main")), entry("module", "medium", one("of.module")), entry("bin", "high", bins))))
    rows = rows.withColumn("place", normalized(F.col("named"))).filter("place <> ''")
    left = rows.join(_existing(files), ["project", "place"], "left_anti")
    return left.select("project", F.lit("package.json").alias("path"), "severity", F.concat(F.lit("package.json names "), "named", F.lit(" as "), "kind", F.lit(", which does not exist")).alias("message"))


def missing_dependencies(files: DataFrame) -> DataFrame:
    """project, path, severity, message of dependencies that are not installed, in projects where some are."""
    names = lambda c: F.coalesce(F.map_keys(c), F.array().cast("array<string>"))
    rows = manifests(files).join(flags(files).filter("installed").select("project"), "project", "left_semi")
    rows = rows.select("project", F.explode(F.array_union(names("of.dependencies"), names("of.devDependencies"))).alias("name")).withColumn("place", F.concat(F.lit("node_modules/"), "name"))
    left = rows.join(_existing(files.filter(F.col("path").startswith("node_modules/"))), ["project", "place"], "left_anti")
    return left.select("project", F.lit("package.json").alias("path"), F.lit("medium").alias("severity"), F.concat(F.lit("dependency "), "name", F.lit(" is declared and not installed")).alias("message"))


def gaps(files: DataFrame) -> DataFrame:
    """project, path, severity, message of all of these."""
    rows = listed(files)
    return missing_settings(rows).unionByName(missing_entries(rows)).unionByName(missing_dependencies(rows))


def structure(files: DataFrame) -> DataFrame:
    """The gaps as issues; of several projects, paths begin with the project's name."""
    path = F.concat_ws("/", F.nullif("project", F.lit("")), "path")
    fixed = {"path": path, "rule": F.lit("structure"), "confidence": F.lit("medium"), "category": F.lit("correctness"), "line": F.lit(1), "snippet": F.lit("")}
    return gaps(files).select(*[fixed[n].alias(n) if n in fixed else F.col(n) for n in ISSUE])
