"""Declared dependencies, read from a table of manifest files (path, source): one pass, no shuffle before the last distinct.

The file's name tells its format; other files declare nothing. Null sources and
files that are no valid JSON declare nothing, repeated rows add nothing. A lock
file's package is named by the first ``name`` of its own block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File names of each format.
REQUIREMENTS = ["requirements.txt", "requirements-dev.txt", "dev-requirements.txt"]
LOCKS = ["poetry.lock", "pdm.lock"]
SCRIPT_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
#: How a package is named at the start of a line.
BARE = r"^([a-zA-Z0-9_-]+)\s*="
QUOTED = r"""^["']([a-zA-Z0-9_-]+)["']"""
QUOTED_WITH_VERSION = r"""^["']([a-zA-Z0-9_-]+)[^"']*["']"""
QUOTED_ITEM = r"""^["']([a-zA-Z0-9_-]+)["']\s*[=<>!~\[,]"""
ANYWHERE = r"""["']([a-zA-Z0-9_-]+)["']\s*[=<>!~]"""
#: A section goes from its header to the next one.
NEXT_HEADER = r"\n(?=[ \t]*\[[^\]\n]+\])"
HEADER = r"^\s*\[([^\]]+)\]"


def _named(rows: DataFrame, language: str, names: Column) -> DataFrame:
    """Nameless entries go."""
    return rows.select("path", F.lit(language).alias("language"), F.explode(names).alias("name")).filter("name <> ''")


def _lines(column: str) -> Column:
    return F.transform(F.split(column, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def _requirements(files: DataFrame) -> DataFrame:
    said = F.filter(_lines("source"), lambda x: ~x.rlike("^[#-]"))
    return _named(files.filter(F.col("file").isin(REQUIREMENTS)), "python", F.transform(said, lambda x: F.lower(F.regexp_extract(x, r"^([^=<>!~\s\[]+)", 1))))


def _sections(files: DataFrame) -> DataFrame:
    """Python's manifests with sections: each section's lines are read by the section's own pattern."""
    parts = files.filter(F.col("file").isin("pyproject.toml", "Pipfile", *LOCKS)).select("path", "file", F.explode(F.split("source", NEXT_HEADER, -1)).alias("part"))
    parts = parts.select("path", "file", F.regexp_extract("part", HEADER, 1).alias("section"), _lines("part").alias("said"))
    section, dependencies = F.col("section"), F.col("section").contains("dependencies")
    of = lambda pattern: F.transform("said", lambda x: F.lower(F.regexp_extract(x, pattern, 1)))
    project = F.col("file") == "pyproject.toml"
    poetry = project & section.startswith("tool.poetry.") & dependencies
    names = (
        F.when(F.col("file").isin(LOCKS), F.when(section == "[package", F.slice(F.filter(of(r'^name\s*=\s*"([^"]+)"'), lambda x: x != ""), 1, 1)))
        .when(F.col("file") == "Pipfile", F.when(section.isin("packages", "dev-packages"), of(BARE)))
        .when(project & section.isin("project.dependencies", "project.optional-dependencies.*"), of(QUOTED))
        .when(poetry, of(BARE))
        .when(project & section.startswith("tool.pdm.") & dependencies, of(QUOTED_WITH_VERSION))
        .otherwise(of(QUOTED_ITEM))
    )
    not_itself = F.filter(names, lambda x: ~((x == "python") & (poetry | F.col("file").isin(LOCKS))))
    return _named(parts, "python", not_itself)


def _setup(files: DataFrame) -> DataFrame:
    return _named(files.filter("file = 'setup.py'"), "python", F.transform(F.regexp_extract_all("source", F.lit(ANYWHERE), F.lit(1)), F.lower))


def _scripts(files: DataFrame) -> DataFrame:
    """Every key of the four sections, for both script languages."""
    read = F.from_json("source", ", ".join(f"{s} map<string, string>" for s in SCRIPT_SECTIONS))
    rows = files.filter("file = 'package.json'").select("path", read.alias("of"))
    names = F.flatten(F.array(*[F.coalesce(F.map_keys(f"of.{s}"), F.array().cast("array<string>")) for s in SCRIPT_SECTIONS]))
    found = _named(rows, "javascript", names)
    return found.unionByName(found.withColumn("language", F.lit("typescript")))


def _go(files: DataFrame) -> DataFrame:
    """The module itself, and each line of a path and its version."""
    rows = files.filter("file = 'go.mod'")
    names = F.array_union(F.regexp_extract_all("source", F.lit(r"(?m)^module\s+(\S+)"), F.lit(1)), F.regexp_extract_all("source", F.lit(r"(?m)^\s*(\S+)\s+v[\d.]+"), F.lit(1)))
    return _named(rows, "go", names)


def _cargo(files: DataFrame) -> DataFrame:
    """Keys of the sections of dependencies, and packages named by the section itself; of a workspace too."""
    parts = files.filter("file = 'Cargo.toml'").select("path", F.explode(F.split("source", NEXT_HEADER, -1)).alias("part"))
    parts = parts.select("path", F.regexp_extract("part", HEADER, 1).alias("section"), _lines("part").alias("said"))
    listed = F.when(F.col("section").rlike(r"(?:^|[.])(?:dev-|build-)?dependencies$"), F.transform(F.slice("said", 2, F.size("said")), lambda x: F.regexp_extract(x, BARE, 1)))
    own = F.array(F.regexp_extract("section", r"(?:^|[.])(?:dev-|build-)?dependencies[.]([\w-]+)$", 1))
    return _named(parts, "rust", F.concat(F.coalesce(listed, F.array().cast("array<string>")), own))


def _gems(files: DataFrame) -> DataFrame:
    return _named(files.filter("file = 'Gemfile'"), "ruby", F.transform(_lines("source"), lambda x: F.regexp_extract(x, r"""^gem\s*\(?\s*["']([^"']+)["']""", 1)))


def declared(files: DataFrame) -> DataFrame:
    """path, language and name of each declared dependency, once a file."""
    files = files.filter("source is not null").select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "source")
    out = _requirements(files)
    for part in (_sections, _setup, _scripts, _go, _cargo, _gems):
        out = out.unionByName(part(files))
    return out.distinct()


#: Manifests of eight formats, spliced from ``orders``.
DERIVED_MANIFESTS = r"""
SELECT concat('p', CAST(o_orderkey AS STRING), '/', CASE o_orderkey % 8 WHEN 0 THEN 'requirements.txt' WHEN 1 THEN 'pyproject.toml' WHEN 2 THEN 'poetry.lock' WHEN 3 THEN 'Pipfile'
    WHEN 4 THEN 'setup.py' WHEN 5 THEN 'package.json' WHEN 6 THEN 'go.mod' ELSE 'notes.txt' END) AS path,
  CASE o_orderkey % 8
    WHEN 0 THEN concat('# of order', chr(10), 'Pkg', CAST(o_custkey AS STRING), '>=1.', CAST(o_orderkey AS STRING), chr(10), '-r more.txt', chr(10), '  extra[fast] == 2', chr(10), chr(10), 'bare')
    WHEN 1 THEN concat('[project]', chr(10), 'dependencies = [', chr(10), '  "listed",', chr(10), '  "versioned>=1",', chr(10), ']', chr(10), '[project.dependencies]', chr(10), '"Own', CAST(o_custkey AS STRING), '"', chr(10),
      '[tool.poetry.group.dev.dependencies]', chr(10), 'python = "3"', chr(10), 'poem', CAST(o_custkey AS STRING), ' = { version = "1" }', chr(10), '# no = 1', chr(10), '[tool.pdm.dev-dependencies]', chr(10), '"test', CAST(o_custkey AS STRING), '>=7"', chr(10), '[tool.black]', chr(10), 'line = 1')
    WHEN 2 THEN concat('[[package]]', chr(10), 'name = "Lock', CAST(o_custkey AS STRING), '"', chr(10), 'version = "1"', chr(10), '[package.extras]', chr(10), 'name = "inner"', chr(10), '[[package]]', chr(10), 'name = "python"')
    WHEN 3 THEN concat('[packages]', chr(10), 'pip', CAST(o_custkey AS STRING), ' = "*"', chr(10), '[requires]', chr(10), 'python_version = "3"')
    WHEN 4 THEN concat('setup(install_requires=["a', CAST(o_custkey AS STRING), '", "Weird" >= 1, ''odd'' == 2])')
    WHEN 5 THEN CASE WHEN o_custkey % 5 = 0 THEN '{ not json' ELSE concat('{"name": "x", "dependencies": {"left', CAST(o_custkey AS STRING), '": "1", "@s/p": "2"}, "devDependencies": {"vite": "3"}}') END
    WHEN 6 THEN concat('module example.org/m', CAST(o_custkey AS STRING), chr(10), 'require (', chr(10), chr(9), 'example.org/dep', CAST(o_custkey AS STRING), ' v1.2.3', chr(10), ')')
    ELSE concat('none', chr(10), '"a" == 1') END AS source
FROM documents
"""
