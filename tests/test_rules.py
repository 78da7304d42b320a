"""Small cases: each rule's hits and what it leaves alone."""

import pytest

from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.operators import issue_filters, known_false
from codequarry.plans.scan import Options, issues
from codequarry.sources import source_files

SCHEMA = "path string, language string, source string"

CASES = [
    ("typescript", 'const key = "sk-abcdefghijklmnopqrstuvwxyz0123456"', "security", True),
    ("typescript", 'const key = "sk-your-api-key-here"', "security", False),
    ("python", "eval(userInput)", "security", True),
    ("python", "model.eval(userInput)", "security", False),
    ("typescript", "Object.map(obj, fn)", "api-hallucination", True),
    ("typescript", "Object.keys(obj)", "api-hallucination", False),
    ("typescript", "arr.unique()", "api-hallucination", True),
    ("typescript", "const MAX_RETRIES = 3", "hardcoded-value", False),
    ("python", 'h = "10.1.2.3"', "hardcoded-value", True),
    ("python", 'h = "127.0.0.1"', "hardcoded-value", False),
    ("python", "f = open(p)\nreturn f", "resource-leak", False),
    ("python", "f = open(p)\nf.read()", "resource-leak", True),
    ("python", "with open(p) as f:\n  f.read()", "resource-leak", False),
    ("python", "import json\nimport nowhere_to_be", "package-hallucination", True),
    ("python", "import json", "package-hallucination", False),
    ("python", "import matplotlib\nfrom seaborn import heatmap\nimport crypt", "package-hallucination", False),
    ("python", "from .m import x\nfrom . import y\nimport xyz", "package-hallucination", False),
    ("python", "import os, nowhere_to_be", "package-hallucination", True),
    ("python", "import numpy as np, os.path as p  # and nowhere", "package-hallucination", False),
    ("typescript", "import { x } from './m'\nimport y from '../lib'\nconst z = require('/abs')", "package-hallucination", False),
    ("typescript", "import fs from 'node:fs'\nimport { readFile } from 'fs/promises'\nimport t from 'node:test'", "package-hallucination", False),
    ("javascript", "const a = require('fs'), b = require('nowhere-to-be')", "package-hallucination", True),
    ("javascript", "import x from 'node:nowhere'", "package-hallucination", True),
    ("javascript", "import x from 'fs/nowhere'", "package-hallucination", True),
    ("javascript", "import x from '@scope/nowhere/deep'", "package-hallucination", True),
    ("ruby", "require 'net/http'\nrequire 'digest/sha2'\nrequire './own'", "package-hallucination", False),
    ("ruby", "require 'net/nowhere'", "package-hallucination", True),
    ("python", "import os\nos.getcwd()", "unused-declaration", False),
    ("python", "import os", "unused-declaration", True),
    ("rust", "let a = b.unwrap();", "swallowed-error", True),
    ("typescript", "try { f() } catch (e) {}", "swallowed-error", True),
    ("typescript", "try { f() } catch (e) { /* why */ }", "swallowed-error", True),
    ("typescript", "try { f() } catch (e) { console.error('f', e) }", "swallowed-error", False),
    ("typescript", "// try { f() } catch (e) {}\nconst s = 'catch (e) ok'", "swallowed-error", False),
    ("python", "try:\n    f()\nexcept:\n    pass\n", "swallowed-error", True),
    ("python", "try:\n    f()\nexcept Exception as e: pass\n", "swallowed-error", True),
    ("python", "try:\n    f()\nexcept Exception as e:\n    pass\n\n    g()\n", "swallowed-error", False),
    ("python", "try:\n    f()\nexcept ImportError:\n    pass\n", "swallowed-error", False),
    ("java", "try { f(); } catch (Exception e) { e.printStackTrace(); }", "swallowed-error", True),
    ("java", "try { f(); } catch (Exception e) { throw e; }", "swallowed-error", False),
    ("go", "if err != nil {\n\tlog.Println(err)\n}", "swallowed-error", True),
    ("go", "if err != nil {\n\treturn err\n}", "swallowed-error", False),
    ("php", "try { f(); } catch (E $e) { }", "swallowed-error", True),
    ("ruby", "begin\n  f\nrescue => e\n  puts e\nend\n", "swallowed-error", True),
    ("ruby", "begin\n  f\nrescue => e\n  g(e)\nend\n", "swallowed-error", False),
    ("typescript", "\n      function foo() {\n        return 42;\n        console.log('unreachable');\n      }\n    ", "unreachable-code", True),
    ("typescript", "\n      function foo() {\n        return 42;\n      }\n    ", "unreachable-code", False),
    ("typescript", "function f() {\n  return [\n  1];\n}\nconst s = `\n  return 1;\n  x`", "unreachable-code", False),
    ("python", "def f(x):\n    if x:\n        return 1\n    y = 2\n    return y\n", "unreachable-code", False),
    ("python", 'def f(x):\n    return x\n    # only said\n    """\n    return 1\n    text\n    """\n', "unreachable-code", True),
    ("python", "def f(x):\n    raise x\n    y = 2\n", "unreachable-code", True),
    ("go", "switch x {\ncase 1:\n\treturn 1\n\tdefault:\n}", "unreachable-code", False),
    ("python", "if x == x:", "unreachable-code", True),
    ("python", "if x == y:", "unreachable-code", False),
    ("typescript", "function processOrder() { return null; }", "stub-function", True),
    ("typescript", "function total(xs) { let s = 0; for (const x of xs) { s += x; } return s; }", "stub-function", False),
    ("typescript", "const f = (a) => { return {}; }", "stub-function", True),
    ("typescript", "function createThing() { return null; }", "stub-function", False),
    ("python", "def f(x):\n    return None\n\ndef g(x):\n    return x + 1\n", "stub-function", True),
    ("python", "def f(x):\n    return 0 + x\n", "stub-function", False),
    ("python", "class A:\n    def my_method(self):\n        pass\n", "empty-impl", True),
    ("python", "def f(x):\n    pass\n    return x\n", "empty-impl", False),
    ("typescript", "function f() { try { g(); } catch (e) { console.error(e); } }", "empty-impl", False),
    ("go", "func work(x int) error {\n\treturn nil\n}", "empty-impl", True),
    ("rust", "fn work() {}", "empty-impl", True),
    ("javascript", "function v(data) { if (!data) { return null; } return data; }", "weak-validation", True),
    ("javascript", "function v(d) { if (!d) return; if (d.length > 3 && /x/.test(d)) throw 1; }", "weak-validation", False),
    ("python", "# create the counter\ncounter = 1", "narrative-comments", True),
    ("python", "# create the counter because readers need it\ncounter = 1", "narrative-comments", False),
    ("typescript", "\nexport function alone(x) { return x; }", "dead-code", True),
    ("typescript", "export const used = 1\nlog(used)", "dead-code", False),
]


@pytest.mark.parametrize("language,source,rule,hit", CASES)
def test_rule(spark, language, source, rule, hit):
    files = spark.createDataFrame([("src/a", language, source), ("src/none", language, None), *([] if rule == "dead-code" else [("src/tests/a", language, source)])], SCHEMA)
    found = issues(files, Options(only=(rule,))).collect()
    assert bool(found) == hit
    assert {r.path for r in found} <= {"src/a"}


UNUSED = [
    ("python", "import os, re as r\nfrom a import (b,\n  c as d)\nfrom e import f, g  # both\nr(f)\n", {("import os, re as r", 1), ("from a import (b,", 2), ("from e import f, g  # both", 4)}),
    ("python", "from __future__ import annotations\nimport numpy as np\n_x = 1\nLIMIT = 2\nnp.y == 3\n", set()),
    ("python", "kept = 1\nlost = 2  # kept lost\nprint(f'{kept}')\ns = 'lost'\ns == 1\n", {("lost = 2  # kept lost", 2)}),
    ("python", "__all__ = ['open_one']\ndef open_one(): pass\ndef lone(): pass\ndef shared(): pass\nclass A:\n    def inner(self): pass\n", {("def lone(): pass", 3)}),
    ("python", '"""\nwords = 1\n"""\n', set()),
    ("typescript", "import React, { a as b, type T } from 'x'\nimport * as ns from 'y'\nimport type { U } from 'z'\nb()\n", {("import React, { a as b, type T } from 'x'", 1), ("import * as ns from 'y'", 2)}),
    ("javascript", "import {\n  one,\n  two\n} from 'x'\nexport const e = 1\nconst { d } = two\nlet v = 1\nconst w = 2\nlog(`${w}`)\n", {("import {", 1), ("let v = 1", 7)}),
    ("go", 'import (\n\t"fmt"\n\tx "a/b"\n\t_ "c"\n\t. "d"\n\t"e/yaml.v3"\n\t"os"\n)\nfunc f() {\n\tfmt.Print(yaml.A)\n\tn := 1\n\tvar m int\n}\n', {('x "a/b"', 3), ('"os"', 7), ("n := 1", 11), ("var m int", 12)}),
    ("go", 'import "fmt"\nimport y "os"\nfunc f() { fmt.Print(1) }\n', {('import y "os"', 2)}),
    ("java", "import a.b.List;\nimport a.b.Map;\nMap m;\nvoid f() {\n  final int k = 1;\n  String s = m.get();\n  use(s);\n}\n", {("import a.b.List;", 1), ("final int k = 1;", 5)}),
    ("rust", "use a::b::Kept;\nuse a::c as other;\nfn f<'a>(x: &'a Kept) {\n  let mut y: u8 = 1;\n  let z = 2;\n  println!(\"{z}\");\n}\n", {("use a::c as other;", 2), ("let mut y: u8 = 1;", 4)}),
]


def test_every_unused_declaration(spark):
    rows = [(f"src/{i}", language, source) for i, (language, source, _) in enumerate(UNUSED)]
    files = spark.createDataFrame([*rows, ("src/none", "python", None), ("src/tests/a", "python", "from a import shared")], SCHEMA)
    found = issues(files, Options(only=("unused-declaration",), every_declaration=True)).collect()
    assert {(r.path, r.snippet.strip(), r.line) for r in found} == {(f"src/{i}", *hit) for i, (*_, want) in enumerate(UNUSED) for hit in want}


def test_empty_table_and_extra_columns(spark):
    files = spark.createDataFrame([], SCHEMA + ", rule string, line int")
    assert issues(files).count() == 0


def test_tree(spark, tmp_path):
    for name in ("src/a.py", "node_modules/b.py", "c.txt", "d.min.js"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    assert [tuple(r) for r in source_files.scan(spark, str(tmp_path)).collect()] == [("src/a.py", "python", "x = 1\n")]


def test_reduced_and_ordered(spark):
    rows = [("p", 1, "r", s, c, "k", "m", "") for s, c in (("low", "low"), ("low", "high"), ("info", "high"), ("critical", "low"))]
    found = spark.createDataFrame(rows, "path string, line int, rule string, severity string, confidence string, category string, message string, snippet string")
    assert [r.severity for r in issue_filters.ordered(issue_filters.reduce_false_positives(found)).collect()] == ["critical", "low"]


def test_code_without_comments(spark):
    rows = [
        ("typescript", "a = 'x // y' // z\nb = `/* ${1} */` /* q\nr */ + /'\\/\"/g.test(s) / 2", "a = 'x // y'     \nb = `/* ${1} */`     \n     + /'\\/\"/g.test(s) / 2"),
        ("python", "a = '#' # b\nc = \"\"\"d # e\n'f\"\"\"", "a = '#'    \nc = \"\"\"d # e\n'f\"\"\""),
        ("rust", "fn f<'a>(x: &'a u8) -> char { '\"' } // b", "fn f<'a>(x: &'a u8) -> char { '\"' }     "),
        ("go", "x := '/' // é", "x := '/'     "),
        ("python", None, None),
        ("c", "", ""),
    ]
    files = spark.createDataFrame(rows, "language string, source string, want string")
    assert [r.got for r in files.select(code(F.col("source"), F.col("language")).alias("got"), "want").collect()] == [w for *_, w in rows]


def test_known_false_alarms(spark):
    rows = [
        ("stub-function", 'Stub function "isValid" only returns simple value: return true', "", "a.ts", True), ("api-hallucination", 'API hallucination: "Object.map()" does not exist', "", "a.ts", False),
        ("empty-impl", "__init__ method is empty", "", "a.py", True), ("security", "x", "os.path.join(a, b)", "a.py", True), ("security", None, None, None, False), ("other", "__init__", "", "", False),
        ("unhandled-promise", "trackUser() not awaited", "", "", True), ("api-hallucination", "pandas.DataFrame.merge", "", "", True), ("swallowed-error", "logger.error(e)", "", "", True),
        ("unreachable-code", "", "if __name__ == '__main__':", "", True), ("fake-url", "https://api.example.com", "", "", True), ("hardcoded-value", "hard-coded IP", "const DB_HOST = 1", "", True),
    ]
    issues = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "id int, rule string, message string, snippet string, path string")
    assert {r.id for r in known_false.prefiltered(issues).collect()} == {i for i, r in enumerate(rows) if not r[4]}
    assert sum(r.n for r in known_false.removals_by_rule(issues).collect()) == sum(r[4] for r in rows)


LINES = [
    ("typescript", '"Object.map(x)"; // Object.map(y)\nObject.map(z)\n', "api-hallucination", [2]),
    ("typescript", "let x = 1 // const password = 'abcdefgh'\nconst password = 'abcdefgh'\n", "security", [2]),
    ("python", "db.execute(f\"SELECT * FROM t WHERE a = {a}\")\ndb.execute('SELECT * FROM t WHERE a = ?', a)\nlog(f\"SELECT {a}\")\n", "security", [1]),
    ("typescript", "db.query(`SELECT a FROM t WHERE b = ${b}`)\ndb.query('SELECT a FROM t WHERE b = $1', [b])\n", "security", [1]),
    ("python", "os.system('rm ' + name)\nos.system('ls')\nsubprocess.run(['ls', name])\n", "security", [1]),
    ("typescript", "exec(`rm ${name}`)\nexec('ls')\nre.exec('a' + b)\n", "security", [1]),
    ("typescript", "const apiToken = 'abcdefghijkl'\nconst token = readToken()\n", "security", [1]),
    ("typescript", "\tconst u = 'https://api.acme9.com/v1/users'\n", "fake-url", [1]),
    ("python", "/* no comment here\nx = eval(user_input)\n", "security", [2]),
]


@pytest.mark.parametrize("language,source,rule,lines", LINES)
def test_lines_are_code(spark, language, source, rule, lines):
    rows = issues(spark.createDataFrame([("src/a", language, source)], SCHEMA), Options(only=(rule,))).collect()
    assert sorted(r.line for r in rows) == lines
    assert all(r.snippet == r.snippet.strip() for r in rows)


def test_only_whole_words_of_a_path_excuse_values(spark):
    source = 'const u = "https://acme.example9.com/x"\n'
    rows = [(p, "typescript", source) for p in ("src/blockchain/x.ts", "src/config/x.ts", "src/app.config.ts", "src/blocklist.ts", "src/reconfigured.ts")]
    found = {r.path for r in issues(spark.createDataFrame(rows, SCHEMA), Options(only=("hardcoded-value",))).collect()}
    assert found == {"src/blockchain/x.ts", "src/reconfigured.ts"}
