"""The symbol graph of a project: what files import, define and export, and which definitions imports refer to.

Imports and definitions come from the statements and blocks of the scope parser,
so lists over several lines count and text in strings does not. A relative
import's candidate paths are exploded with their priority and meet the table of
paths by an equi-join; the first that exists wins. Absolute modules are looked
up in an index of module names. References are imports joined with definitions
on (path, name).

A null source has no symbols. A symbol defined twice in a file is one, at its
first line. Equal paths are one file. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.operators import syntax
from codequarry.operators.line_rules import ISSUE
from codequarry.sources.source_files import is_test_file

# Endings that a relative import may stand for, in order, and those of a folder's index.
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".java", ".rs", ".rb", ".php"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]
#: Folders that hold sources and are not part of a module's name.
ROOTS = ("src", "lib", "source")
SCRIPTS = ("javascript", "typescript")
_NAME = r"^[A-Za-z_$][\w$]*$"
_ROW = "array<struct<source:string,name:string,local:string>>"


def _statements(files: DataFrame) -> DataFrame:
    """path, language, line, node, text: each statement with its strings."""
    rows = syntax.parsed(files).select("path", "language", F.split(code(F.col("source"), F.col("language")), "\n", -1).alias("plain"), F.inline("statements"))
    text = F.trim(F.regexp_replace(F.array_join(F.slice("plain", F.col("line"), F.col("last") - F.col("line") + 1), "\n"), r"^\s*<\?php\b|\s+|;\s*$", " "))
    return rows.select("path", "language", "line", "node", F.col("text").alias("masked"), text.alias("text"))


def _pairs(listed: Column, source: Column, separator: str) -> Column:
    """One (source, name, local) for each item of a list, ``name as local`` or ``name``."""

    def one(x):
        parts = F.split(F.trim(x), separator)
        return F.struct(source.alias("source"), F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0)))).alias("local"))

    return F.transform(F.split(listed, ","), one).cast(_ROW)


def _one(source: Column, name: Column, local: Column) -> Column:
    return F.array(F.struct(source.alias("source"), name.alias("name"), local.alias("local"))).cast(_ROW)


def _named(text: Column, language: Column) -> Column:
    """All imports of a statement as (source, name, local); ``*`` is a whole module, ``default`` what a script exports so."""
    part = lambda p, n=1: F.regexp_extract(text, p, n)
    empty = F.array().cast(_ROW)
    quoted = r"""['"]([^'"]+)['"]"""
    script_from = rf"\bfrom {quoted}"
    clause = part(rf"^import (?:type )?(.+?) from {quoted}")
    braced = F.regexp_extract(clause, r"\{(.*)\}", 1)
    before = F.regexp_extract(clause, r"^([A-Za-z_$][\w$]*)", 1)
    script = F.when(
        clause != "",
        F.concat(
            F.when(braced != "", _pairs(F.regexp_replace(braced, r"\btype ", ""), part(script_from), r" as ")).otherwise(empty),
            F.when(before != "", _one(part(script_from), F.lit("default"), before)).otherwise(empty),
            F.when(clause.rlike(r"\* as "), _one(part(script_from), F.lit("*"), F.regexp_extract(clause, r"\* as ([\w$]+)", 1))).otherwise(empty),
        ),
    )
    script = script.when(text.rlike(rf"^export .*{script_from}"), F.when(text.rlike(r"^export \*"), _one(part(script_from), F.lit("*"), F.lit(""))).otherwise(_pairs(part(r"\{(.*)\}"), part(script_from), r" as ")))
    required = rf"= ?require\( ?{quoted} ?\)"
    script = script.when(text.rlike(rf"\{{.*\}} {required}"), _pairs(part(r"\{(.*?)\}"), part(required), r": ?")).when(text.rlike(required), _one(part(required), F.lit("*"), part(r"(?:const|let|var) ([\w$]+)")))
    script = script.when(text.rlike(rf"^import {quoted}"), _one(part(rf"^import {quoted}"), F.lit("*"), F.lit("")))
    module = part(r"^from (\S+) import ")
    python = F.when(module != "", _pairs(F.regexp_replace(part(r" import (.*)$"), r"[()]", ""), module, r" as "))
    python = python.when(text.rlike(r"^import "), F.transform(_pairs(part(r"^import (.*)$"), F.lit(""), r" as "), lambda x: F.struct(x["name"].alias("source"), F.lit("*").alias("name"), x["local"].alias("local"))).cast(_ROW))
    go_items = F.regexp_extract_all(text, F.lit(r'([\w.]* ?"[^"]+")'), F.lit(1))
    go = F.when(text.rlike(r"^import\b"), F.transform(go_items, lambda x: _go(x)).cast(_ROW))
    dotted = part(r"^import (?:static )?([\w.]+)")
    java = F.when(dotted != "", _one(dotted, F.substring_index(dotted, ".", -1), F.substring_index(dotted, ".", -1)))
    used = part(r"^(?:pub(?:\([^)]*\))? )?use (.*)$")
    group = F.regexp_extract(used, r"\{(.*)\}", 1)
    rust = F.when(group != "", _pairs(F.regexp_replace(group, r"[{}]", ""), F.regexp_extract(used, r"^([\w:]+?)(?:::)?\{", 1), r" as ")).when(used != "", F.transform(_pairs(used, F.lit(""), r" as "), lambda x: _rust(x)).cast(_ROW))
    required = part(rf"^require(?:_relative)? ?\(? ?{quoted}")
    ruby = F.when(required != "", _one(F.when(text.startswith("require_relative"), F.concat(F.lit("./"), required)).otherwise(required), F.lit("*"), F.substring_index(required, "/", -1)))
    space = part(r"^use (?:function |const )?\\?([\w\\]+)")
    alias = part(r" as (\w+)$")
    php = F.when(space != "", _one(space, F.substring_index(space, "\\", -1), F.when(alias != "", alias).otherwise(F.substring_index(space, "\\", -1))))
    out = F.when(language == "python", python).when(language.isin(*SCRIPTS), script).when(language == "go", go).when(language == "java", java)
    return F.coalesce(out.when(language == "rust", rust).when(language == "ruby", ruby).when(language == "php", php), empty)


def _go(item: Column) -> Column:
    path, alias = F.regexp_extract(item, r'"([^"]+)"', 1), F.regexp_extract(item, r"^(\w+)", 1)
    return F.struct(path.alias("source"), F.lit("*").alias("name"), F.when(alias != "", alias).otherwise(F.substring_index(path, "/", -1)).alias("local"))


def _rust(x: Column) -> Column:
    last = F.substring_index(x["name"], "::", -1)
    return F.struct(F.regexp_replace(x["name"], r"(?:::)?\w+$", "").alias("source"), last.alias("name"), F.when(x["local"] == x["name"], last).otherwise(x["local"]).alias("local"))


def imports(files: DataFrame) -> DataFrame:
    """path, language, line, source, name, local: one row for each name that a file imports."""
    rows = _statements(files).filter(F.col("masked").rlike(r"\b(?:import|from|use|require|require_relative)\b"))
    rows = rows.select("path", "language", "line", F.inline(_named(F.col("text"), F.col("language"))))
    return rows.filter(F.col("name").rlike(_NAME) | (F.col("name") == "*"))


def symbols(files: DataFrame) -> DataFrame:
    """path, language, name, line, exported: what a file defines for others, by its language's rules."""
    rows = syntax.parsed(files).select("path", "language", F.split(code(F.col("source"), F.col("language")), "\n", -1).alias("plain"), "nodes", "statements")
    at = lambda x: F.get(F.col("plain"), x["line"] - 1)
    language = F.col("language")

    def block(x):
        line = at(x)
        out = F.when(language == "python", x["depth"] == 1).when(language.isin(*SCRIPTS), (x["depth"] == 1) & line.rlike(r"^\s*export\b")).when(language == "go", x["name"].rlike("^[A-Z]"))
        out = out.when(language == "java", line.rlike(r"\bpublic\b") | (line.rlike(r"\bprotected\b") & (x["kind"] == "class"))).when(language == "rust", line.rlike(r"^\s*pub\b") & ~line.rlike(r"^\s*impl\b"))
        return F.struct(x["name"].alias("name"), x["line"].alias("line"), F.coalesce(out, language == "ruby").alias("exported"))

    named = F.filter("nodes", lambda x: x["kind"].isin("function", "method", "class") & x["name"].rlike(_NAME) & ((x["depth"] == 1) | language.isin("go", "java", "rust", "ruby")))
    kind = "array<struct<name:string,line:int,exported:boolean>>"

    def said(x):
        """Names of a plain statement: constants, and a script's list of exports."""
        t, line = x["text"], x["line"]
        row = lambda name, exported: F.struct(name.alias("name"), line.alias("line"), exported.alias("exported"))
        script = F.when(t.rlike(r"^export \{") & ~t.rlike(r"\bfrom\b"), F.transform(F.split(F.regexp_extract(t, r"\{(.*)\}", 1), ","), lambda i: row(F.regexp_extract(i, r"^\s*(?:type )?([\w$]+)", 1), F.lit(True))))
        script = script.when(t.rlike(r"^(?:export )?(?:declare )?(?:const|let|var|type)\b"), F.array(row(F.regexp_extract(t, r"\b(?:const|let|var|type) ([\w$]+)", 1), t.startswith("export"))))
        script = script.when(t.rlike(r"^export (?:default )?(?:interface|class|function|abstract|enum)\b"), F.array(row(F.regexp_extract(t, r"\b(?:interface|class|function|enum) ([\w$]+)", 1), F.lit(True))))
        python = F.when(t.rlike(r"^[A-Za-z_]\w*\s*(?::[^=]+)?=[^=]"), F.array(row(F.regexp_extract(t, r"^(\w+)", 1), t.rlike(r"^[A-Z][A-Z_0-9]+\s*(?::|=)"))))
        python = python.when(t.rlike(r"^(?:async )?(?:def|class) "), F.array(row(F.regexp_extract(t, r"^(?:async )?(?:def|class) (\w+)", 1), F.lit(True))))
        rust = F.when(t.rlike(r"^pub (?:struct|enum|fn|const|static) "), F.array(row(F.regexp_extract(t, r"^pub \w+ (\w+)", 1), F.lit(True))))
        go = F.when(t.rlike(r"^(?:var|const|type) \w+"), F.array(row(F.regexp_extract(t, r"^\w+ (\w+)", 1), t.rlike(r"^\w+ [A-Z]"))))
        return F.coalesce(F.when(language.isin(*SCRIPTS), script).when(language == "python", python).when(language == "rust", rust).when(language == "go", go).cast(kind), F.array().cast(kind))

    top = F.filter("statements", lambda x: x["node"] == 0)
    rows = rows.select("path", "language", F.inline(F.concat(F.transform(named, block).cast(kind), F.flatten(F.transform(top, said)))))
    rows = rows.filter(F.col("name").rlike(_NAME))
    return rows.groupBy("path", "language", "name").agg(F.min("line").alias("line"), F.max("exported").alias("exported"))


def normalized(path: Column) -> Column:
    """A path without ``.``, ``..`` and empty parts: a fold over its parts."""
    none = F.array().cast("array<string>")
    step = lambda out, x: F.when(x.isin("", "."), out).when(x == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, x))
    return F.array_join(F.aggregate(F.split(path, "/"), none, step), "/")


def module_index(files: DataFrame) -> DataFrame:
    """module and path: the names under which a file may be imported (its own, with its folders, a package's folder, without a source root)."""
    path = F.col("path")
    folder, base = F.regexp_replace(path, r"/?[^/]*$", ""), F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    dotted = F.replace(folder, F.lit("/"), F.lit("."))
    package = (F.col("language") == "python") & (base == "__init__")
    bare = F.regexp_replace(dotted, rf"^(?:{'|'.join(ROOTS)})\.", "")
    names = F.array(base, F.when(folder != "", F.concat(dotted, F.lit("."), base)), F.when(package & (dotted != ""), dotted), F.when(package & (bare != dotted), bare))
    return files.select("path", F.explode(F.array_compact(names)).alias("module")).select("module", "path").distinct()


def _candidates(path: Column, language: Column, source: Column, name: Column) -> Column:
    """Paths without their ending that a relative import may mean, the likeliest first."""
    folder = F.regexp_replace(path, r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract(source, r"^(\.+)", 1))
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    module = F.replace(F.regexp_replace(source, r"^\.+", ""), F.lit("."), F.lit("/"))
    python = F.array(F.concat_ws("/", folder, F.concat(up, module, F.lit("/"), name)), F.concat_ws("/", folder, F.concat(up, module)))
    plain = F.when(source.startswith("/"), source).otherwise(F.concat_ws("/", folder, source))
    return F.transform(F.when(language == "python", python).otherwise(F.array(plain)), normalized)


def resolved_imports(files: DataFrame) -> DataFrame:
    """path, line, source, name, local, target (null where no file of the project is meant) and whole, whether the import names the file itself."""
    found = imports(files)
    rows = found.filter(F.col("source").rlike(r"^[./]"))
    stems = rows.select("*", F.posexplode(_candidates(F.col("path"), F.col("language"), F.col("source"), F.col("name"))).alias("stem_at", "stem"))
    endings = F.array(F.lit(""), *map(F.lit, [*ENDINGS, *INDEXES]))
    tried = stems.select("*", F.posexplode(endings).alias("ending_at", "ending")).withColumn("target", F.concat("stem", "ending"))
    paths = files.select(F.col("path").alias("target")).distinct()
    key = ["path", "line", "source", "name", "local"]
    met = tried.join(paths, "target").filter(F.col("target") != F.col("path"))
    # a Python name may be a file of the package itself
    submodule = (F.col("language") == "python") & (F.col("stem_at") == 0)
    hit = met.groupBy(*key).agg(F.min_by(F.struct("target", (submodule | (F.col("name") == "*")).alias("whole")), F.struct("stem_at", "ending_at")).alias("x")).select(*key, "x.*")
    modules = module_index(files).groupBy("module").agg(F.min("path").alias("target"))
    absolute = found.filter("language = 'python' and not source like '.%'").join(modules.withColumnRenamed("module", "source"), "source").filter(F.col("target") != F.col("path")).select(*key, "target", (F.col("name") == "*").alias("whole"))
    hits = hit.unionByName(absolute)
    return found.select(*key).distinct().join(hits, key, "left").select(*key, "target", F.coalesce("whole", F.lit(False)).alias("whole"))


def symbol_references(files: DataFrame) -> DataFrame:
    """name, path and line of a definition, with from_path and from_line of each import that names it."""
    refs = resolved_imports(files).filter("target is not null and not whole").select(F.col("target").alias("path"), F.when(F.col("name") == "default", F.col("local")).otherwise(F.col("name")).alias("name"), F.col("path").alias("from_path"), F.col("line").alias("from_line"))
    return symbols(files).join(refs, ["path", "name"]).select("name", "path", "line", "from_path", "from_line").distinct()


def reference_counts(files: DataFrame) -> DataFrame:
    """path, name, line, exported, n (imports that name it) and from_paths, sorted."""
    refs = symbol_references(files).groupBy("path", "name").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("from_path")).alias("from_paths"))
    rows = symbols(files).join(refs, ["path", "name"], "left")
    return rows.select("path", "name", "line", "exported", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("from_paths", F.array().cast("array<string>")).alias("from_paths"))


def referenced_names(files: DataFrame) -> DataFrame:
    """name: what any file imports, whether it is found in the project or not."""
    rows = imports(files)
    return rows.select(F.explode(F.array(F.when(~F.col("name").isin("*", "default"), F.col("name")), F.when(F.col("local") != "", F.col("local")))).alias("name")).filter("name is not null").distinct()


def dead_code(files: DataFrame) -> DataFrame:
    """Exported names that nothing uses: no import names them, no file takes their whole module, and, where code names things without importing them (Go, Java, Rust, Ruby), no other file holds the word; and its own file does not say it again."""
    exported = symbols(files).filter(F.col("exported") & ~is_test_file(F.col("path")) & ~F.col("name").rlike("^__.*__$") & ~F.col("name").isin("main", "new", "initialize", "default"))
    # what imports use: a name of a file, a whole file, or a name of no known file
    row = lambda ok, path, name: F.when(ok, F.struct(path.alias("of"), name.alias("use")))
    found, meant = F.col("target").isNotNull(), F.when(F.col("name") == "default", F.col("local")).otherwise(F.col("name"))
    used = F.array(row(found & ~F.col("whole"), F.col("target"), meant), row(found & F.col("whole"), F.col("target"), F.lit("*")), row(~found, F.lit(""), F.col("name")), row(~found, F.lit(""), F.col("local")))
    used = resolved_imports(files).select(F.inline(F.array_compact(used))).distinct()
    asked = F.array(F.struct(F.col("path").alias("of"), F.col("name").alias("use")), F.struct(F.col("path").alias("of"), F.lit("*").alias("use")), F.struct(F.lit("").alias("of"), F.col("name").alias("use")))
    hit = exported.select("path", "name", F.inline(asked)).join(used, ["of", "use"], "left_semi").select("path", "name").distinct()
    left = exported.join(hit, ["path", "name"], "left_anti")
    by_word = F.col("language").isin("go", "java", "rust", "ruby")
    words = files.filter(by_word).select("path", F.explode(F.array_distinct(F.regexp_extract_all(code(F.col("source"), F.col("language"), True), F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("name"))
    shared = words.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit(True).alias("shared"))
    left = left.join(shared, "name", "left").filter(~by_word | F.col("shared").isNull())
    lines = files.select("path", F.split("source", "\n", -1).alias("rows"), code(F.col("source"), F.col("language"), True).alias("bare"))
    fixed = {"rule": F.lit("dead-code"), "severity": F.lit("low"), "confidence": F.lit("medium"), "category": F.lit("quality"), "message": F.lit("exported name is never used")}
    again = F.regexp_count("bare", F.concat(F.lit(r"(?<![\w$])\Q"), "name", F.lit(r"\E(?![\w$])"))) > 1
    rows = left.join(lines, "path").filter(~again).withColumn("snippet", F.regexp_replace(F.get("rows", F.col("line") - 1), r"^\s+|\s+$", ""))
    return rows.select(*[fixed[n].alias(n) if n in fixed else F.col(n) for n in ISSUE])
