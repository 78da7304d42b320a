"""Declarations that their file never uses: imports, variables and functions, held against the words of the code.

Local names come from the statements of the scope parser, imports from the symbol
graph or by pattern.

Comments and strings do not count as uses, except strings that may hold
expressions. A null source declares nothing; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.operators import symbols, syntax
from codequarry.operators.block_rules import _live, _matches
from codequarry.operators.line_rules import ISSUE

LANGUAGES = ("python", "javascript", "typescript", "go", "java", "rust")
JS = ("javascript", "typescript")
PYTHON_IMPORT = r"(?m)^[ \t]*import[ \t]+(\w[^#;\n]*)"
PYTHON_FROM = r"(?m)^from[ \t]+(?!__future__\b)[\w.]+[ \t]+import[ \t]+(\([^)]*\)|[^#;\n]+)"
JS_IMPORT = r"\bimport\b(?!\s+type\s+(?!from\b))\s*([\w$\s{},*]+?)\s*\bfrom\s*['\"][^'\"\n]+['\"]"
GO_BLOCK = r"(?:\bimport\s*\(|\G(?!\A))[^\")]*?(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\""
GO_SINGLE = r"(?m)^[ \t]*import[ \t]+(?:([\w.]+)[ \t]+)?\"([^\"\n]+)\""
PYTHON_VARIABLE, PYTHON_DEF = r"(?m)^(\w+)[ \t]*=(?!=)", r"(?m)^def[ \t]+(\w+)[ \t]*\("
# Words that no declaration names.
PYTHON_WORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split()
JAVA_KEYWORDS = ["return", "throw", "new", "else", "case", "package", "import", "assert", "goto", "yield"]
JAVA_WORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
# Names of examples.
EXAMPLE_NAMES = ["todo", "fixme", "placeholder", "example", "foo", "foob", "fooba", "foobar"]
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"
_TRIPLE = r'"""(?:\\.|[^\\])*?"""|' + r"'''(?:\\.|[^\\])*?'''"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*+\*/|//[^\n]*"
#: language: what is kept as code (group 1, strings with expressions in them), and what is left out.
HIDDEN = {
    "python": rf"(\b(?:[fF][rR]?|[rR][fF])(?:{_TRIPLE}|{_DOUBLE}|{_SINGLE}))|{_TRIPLE}|{_DOUBLE}|{_SINGLE}|#[^\n]*",
    "javascript": rf"(`(?:\\.|[^`\\])*+`)|{_DOUBLE}|{_SINGLE}|{_BLOCK}",
    "go": rf"(?!)()|`[^`]*`|{_DOUBLE}|'(?:\\.|[^'\\\n])'|{_BLOCK}",
    "java": rf"(?!)()|{_DOUBLE}|'(?:\\.|[^'\\\n])'|{_BLOCK}",
    "rust": r'("(?:\\.|[^"\\{])*\{(?:\\.|[^"\\])*")|' + rf'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'|{_BLOCK}',
}
HIDDEN["typescript"] = HIDDEN["javascript"]
SALTS = 32


def code_words(files: DataFrame) -> DataFrame:
    """path, name and n of the words of each file's code."""
    code = F.col("source")
    for language, p in HIDDEN.items():
        code = F.when(F.col("language") == language, F.regexp_replace("source", p, "$1 ")).otherwise(code)
    words = files.select("path", F.explode(F.regexp_extract_all(code, F.lit(r"[\w$]+"), F.lit(0))).alias("name"))
    return words.groupBy("path", "name").agg(F.count("*").alias("n"))


def _listed(rows: DataFrame, items: Column, drop: str = "(?!)") -> DataFrame:
    """One row per item of a list of imports; ``a as b`` binds b, and brings in a."""
    rows = rows.select("*", F.explode(items).alias("item")).withColumn("item", F.trim(F.regexp_replace("item", r"\s+", " "))).filter(~F.col("item").rlike(drop))
    first = F.regexp_extract("item", r"^([\w$]+)", 1)
    last = F.regexp_extract("item", r"\bas ([\w$]+)$", 1)
    return rows.withColumn("name", F.when(last != "", last).otherwise(first)).withColumn("original", first)


def _from_imports(files: DataFrame) -> DataFrame:
    rows = _matches(files, PYTHON_FROM)
    return _listed(rows, F.split(F.regexp_replace("name", r"#[^\n]*|[()\\]", " "), ","))


def _bound(text: Column, language: Column) -> Column:
    """Names that a plain statement declares, told by its words: a script's or Rust's keyword, Go's left side, Java's type before the name."""
    words = F.split(text, r"[\s(]+")
    word = lambda n: F.coalesce(F.get(words, F.lit(n)), F.lit(""))
    bare = lambda x: F.regexp_extract(x, r"^([A-Za-z_$][\w$]*)", 1)
    assigned = text.rlike(r"[^=!<>]=[^=>]|[^=!<>]=$")
    script = F.when(word(0).isin("const", "let", "var") & assigned, F.array(bare(word(1))))
    left = F.substring_index(text, ":=", 1)
    names = F.transform(F.split(F.element_at(F.split(F.trim(left), r"^(?:if|for|switch)\s+"), -1), ","), lambda x: F.trim(x))
    go = F.when(text.contains(":="), names).when(word(0) == "var", F.array(bare(word(1))))
    before = F.filter(F.split(F.regexp_replace(F.regexp_replace(F.substring_index(text, "=", 1), r"<[^=]*>|\[\s*\]", " "), r"@\w+", " "), r"\s+"), lambda x: (x != "") & ~x.isin("final", "public", "private", "protected", "static", "volatile", "transient"))
    typed = (F.size(before) == 2) & ~F.get(before, F.lit(0)).isin(JAVA_KEYWORDS) & F.get(before, F.lit(0)).rlike(r"^[\w.]+$")
    java = F.when(assigned & typed, F.array(bare(F.get(before, F.lit(1)))))
    rust = F.when((word(0) == "let") & assigned, F.array(bare(F.when(word(1) == "mut", word(2)).otherwise(word(1)))))
    return F.coalesce(F.when(language.isin(*JS), script).when(language == "go", go).when(language == "java", java).when(language == "rust", rust), F.array().cast("array<string>"))


def _locals(files: DataFrame) -> DataFrame:
    """path, language, line, snippet and name of what statements declare in scripts, Go, Java and Rust, and of Java's and Rust's imports."""
    live = _live(files, *JS, "go", "java", "rust")
    said = syntax.parsed(live).select("path", "language", F.split("source", "\n", -1).alias("rows"), F.inline("statements"))
    bound = said.select("path", "language", "line", "rows", F.explode(_bound(F.col("text"), F.col("language"))).alias("name")).select("path", "language", "line", F.get("rows", F.col("line") - 1).alias("snippet"), "name")
    brought = symbols.imports(_live(files, "java", "rust")).filter("name <> '*'").select("path", "language", "line", F.col("local").alias("name"))
    rows = live.select("path", F.split("source", "\n", -1).alias("rows"))
    brought = brought.join(rows, "path").select("path", "language", "line", F.get("rows", F.col("line") - 1).alias("snippet"), "name")
    return bound.unionByName(brought).filter("name <> '' and name not in ('self', 'super', 'crate')").withColumn("snippet", F.trim("snippet"))


def declarations(files: DataFrame) -> DataFrame:
    """path, line, snippet, name, kind and own: how often the declaration itself names it in code."""
    live = {language: _live(files, language) for language in LANGUAGES}
    scripts = _live(files, *JS)
    found = [
        (_listed(_matches(live["python"], PYTHON_IMPORT), F.split("name", ",")), "import", 1),
        (_from_imports(live["python"]), "import", 1),
        (_listed(_matches(scripts, JS_IMPORT), F.split("name", "[{},]"), "^type [^ ]|^$"), "import", 1),
    ]
    for p in (GO_BLOCK, GO_SINGLE):  # without an alias, by the last part of the path, which is a string
        rows = _matches(live["go"], p, 2)
        alias = F.regexp_extract("text", r"([\w.]+)[ \t]+\"[^\"]+\"$", 1)
        path = F.regexp_replace(F.regexp_extract("text", r"\"([^\"]+)\"$", 1), r"[/.]v[0-9]+$", "")
        # a match of a block starts where the last one ended; the entry is on its last line
        rows = rows.withColumn("alias", alias).withColumn("name", F.when(alias != "", alias).otherwise(F.regexp_extract(path, r"([^/]+)$", 1)))
        rows = rows.withColumn("snippet", F.trim(F.regexp_extract("text", r"([^\n]*)$", 1)))
        body = F.regexp_replace("text", r"^\s+", "")
        rows = rows.withColumn("line", F.col("line") + F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))))
        found += [(rows.filter("alias <> ''"), "import", 1), (rows.filter("alias = ''"), "import", 0)]
    listed = F.regexp_extract("source", r"__all__\s*=\s*[\[(]([^\])]*)[\])]", 1)
    public = live["python"].select("path", F.explode(F.regexp_extract_all(listed, F.lit(r"['\"](\w+)['\"]"), F.lit(1))).alias("name"))
    for p, kind in ((PYTHON_VARIABLE, "variable"), (PYTHON_DEF, "function")):
        rows = _matches(live["python"], p).filter(~F.col("name").isin(PYTHON_WORDS))
        if kind == "variable":
            rows = rows.filter(~F.col("name").rlike("^[A-Z][A-Z_0-9]+$"))
        found.append((rows.join(public, ["path", "name"], "left_anti"), kind, 1))
    found.append((_locals(files).filter(~F.col("name").isin(JAVA_WORDS) | (F.col("language") != "java")), "local", 1))
    out = None
    for rows, kind, own in found:
        rows = rows.select("path", "language", F.col("line").cast("int").alias("line"), "snippet", "name", F.lit(kind).alias("kind"), F.lit(own).alias("own"))
        out = rows if out is None else out.unionByName(rows)
    lower = F.lower("name")
    example = lower.isin(EXAMPLE_NAMES) | ((F.length("name") > 1) & (F.translate(lower, "xyz", "") == ""))
    fine = F.col("name").rlike(r"^[A-Za-z$][\w$]*$") & ~example
    alembic = (F.col("language") == "python") & F.col("path").rlike(r"alembic[\\/]versions[\\/]")
    return out.filter(fine & ~alembic).dropDuplicates(["path", "name", "line"])


def unused_declarations(files: DataFrame) -> DataFrame:
    """Declarations whose name the code of their file holds only there; of Python's variables and functions, those that no file imports."""
    declared = declarations(files)
    counts = code_words(_live(files, *LANGUAGES))
    left = declared.join(counts, ["path", "name"], "left").filter(F.coalesce("n", F.lit(0)) == F.col("own"))
    brought = _from_imports(files.filter("language = 'python'").select("path", "language", "source")).select(F.col("original").alias("name")).distinct()
    # a name may be declared in very many files, so both sides are salted
    brought = brought.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("kind", F.explode(F.array(F.lit("variable"), F.lit("function"))))
    left = left.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int")).join(brought, ["name", "salt", "kind"], "left_anti")
    fixed = [F.lit(x).alias(n) for n, x in (("rule", "unused-declaration"), ("severity", "low"), ("category", "quality"), ("message", "declaration is not used"))]
    confidence = F.when(F.col("kind") == "function", "low").otherwise("medium").alias("confidence")
    return left.select("path", "line", *fixed, confidence, "snippet").select(*ISSUE)
