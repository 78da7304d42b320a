"""The symbol graph: imports, definitions, resolution, references and dead code of six languages."""

import pytest
from pyspark.sql import functions as F

from codequarry.operators import symbols as G

FILES = [
    ("src/a/util.ts", "typescript", "export function fa() {\n  return go();\n}\nexport const K = 1;\nexport class C {}\nconst hid = 2\nexport { hid as shown, q };\n"),
    ("src/a/use.ts", "typescript", "import {\n  fa as f,\n  type K\n} from './util';\nimport D from \"../b\"\nimport * as ns from '../../lib/x.js'\nconst { p, r: z } = require('./pr')\nconst s = 'import { no } from \"./util\"'\nexport * from './all'\n// import { C } from './util'\n"),
    ("src/b/index.js", "javascript", "export class D {}\n"),
    ("src/b.css.ts", "typescript", "export const css = 1\n"),
    ("lib/x.js", "javascript", "export const used = 1\n"),
    ("src/a/pr.js", "javascript", "export const p = 1\n"),
    ("pk/__init__.py", "python", "LIMIT = 3\n"),
    ("pk/m.py", "python", "def f(x):\n    return x + 1\nclass K:\n    def inner(self):\n        return self.x\nMAX_N: int = 4\nsmall = 1\ndef __getattr__(n):\n    return n.x\n"),
    ("pk/lone.py", "python", "def alone(x):\n    return x + 1\n"),
    ("pk/u.py", "python", "from .m import (f,\n    K as Z)\nfrom . import m, LIMIT\nimport pk.m as pm, os\nfrom ..pk.m import MAX_N\n"),
    ("g/a.go", "go", 'package a\nimport (\n  "fmt"\n  al "x/y/z"\n)\ntype T struct {\n  A int\n}\nfunc (t *T) Run() {\n  fmt.Println()\n}\nfunc small() {\n}\n'),
    ("g/b.go", "go", "package b\nfunc Other() {\n  t.Run()\n}\n"),
    ("j/A.java", "java", "import java.util.List;\npublic class A {\n  public int walk(String s) {\n    return 1;\n  }\n  private void x() {\n  }\n}\n"),
    ("r/a.rs", "rust", "use std::collections::{HashMap, BTreeMap as B};\nuse crate::b::c;\npub struct S { a: i32 }\npub fn going() -> i32 {\n  1\n}\nfn own() {\n}\n"),
    ("rb/a.rb", "ruby", "require_relative 'b'\nrequire 'json'\nclass Cat\n  def purr(x)\n    x\n  end\nend\n"),
    ("rb/b.rb", "ruby", "module B\nend\n"),
    ("php/a.php", "php", "<?php\nuse App\\Models\\User as U;\n"),
    ("none.py", "python", None),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "path string, language string, source string").withColumn("name", F.lit("clash"))


def test_imports(files):
    got = {(r.path, r.line, r.source, r.name, r.local) for r in G.imports(files).collect()}
    assert {r[1:] for r in got if r[0] == "src/a/use.ts"} == {
        (1, "./util", "fa", "f"), (1, "./util", "K", "K"), (5, "../b", "default", "D"), (6, "../../lib/x.js", "*", "ns"), (7, "./pr", "p", "p"), (7, "./pr", "r", "z"), (9, "./all", "*", ""),
    }
    assert {r[1:] for r in got if r[0] == "pk/u.py"} == {
        (1, ".m", "f", "f"), (1, ".m", "K", "Z"), (3, ".", "m", "m"), (3, ".", "LIMIT", "LIMIT"), (4, "pk.m", "*", "pm"), (4, "os", "*", "os"), (5, "..pk.m", "MAX_N", "MAX_N"),
    }
    assert {r[2:] for r in got if r[0] == "g/a.go"} == {("fmt", "*", "fmt"), ("x/y/z", "*", "al")}
    assert {r[2:] for r in got if r[0] == "r/a.rs"} == {("std::collections", "HashMap", "HashMap"), ("std::collections", "BTreeMap", "B"), ("crate::b", "c", "c")}
    assert {r[2:] for r in got if r[0] in ("j/A.java", "rb/a.rb", "php/a.php")} == {("java.util.List", "List", "List"), ("./b", "*", "b"), ("json", "*", "json"), ("App\\Models\\User", "User", "U")}


def test_resolution_takes_the_first_candidate(files):
    got = {(r.path, r.source, r.name): r.target for r in G.resolved_imports(files).collect()}
    assert got["src/a/use.ts", "./util", "fa"] == "src/a/util.ts"
    assert got["src/a/use.ts", "../b", "default"] == "src/b/index.js"
    assert got["src/a/use.ts", "../../lib/x.js", "*"] == "lib/x.js"
    assert got["src/a/use.ts", "./all", "*"] is None
    assert got["pk/u.py", ".", "m"] == "pk/m.py" and got["pk/u.py", ".", "LIMIT"] == "pk/__init__.py" and got["pk/u.py", "..pk.m", "MAX_N"] == "pk/m.py"
    assert got["pk/u.py", "pk.m", "*"] == "pk/m.py" and got["pk/u.py", "os", "*"] is None
    assert got["rb/a.rb", "./b", "*"] == "rb/b.rb"


def test_an_ending_goes_before_an_index(spark):
    files = spark.createDataFrame([("a/x.ts", "typescript", "import { k } from './y'"), ("a/y.js", "javascript", ""), ("a/y.ts", "typescript", ""), ("a/y/index.ts", "typescript", "")], "path string, language string, source string")
    assert [r.target for r in G.resolved_imports(files).collect()] == ["a/y.ts"]


def test_definitions_and_references(files):
    exported = {(r.path, r.name, r.line) for r in G.symbols(files).filter("exported").collect()}
    assert {("src/a/util.ts", "fa", 1), ("src/a/util.ts", "K", 4), ("src/a/util.ts", "hid", 6), ("pk/m.py", "MAX_N", 6), ("g/a.go", "Run", 9), ("j/A.java", "walk", 3), ("r/a.rs", "S", 3), ("rb/a.rb", "purr", 4)} <= exported
    assert not {n for p, n, _ in exported} & {"small", "x", "own", "inner"}
    refs = {(r.path, r.name, r.from_path, r.from_line) for r in G.symbol_references(files).collect()}
    assert ("src/a/util.ts", "fa", "src/a/use.ts", 1) in refs and ("src/b/index.js", "D", "src/a/use.ts", 5) in refs and ("pk/m.py", "K", "pk/u.py", 1) in refs
    counts = {(r.path, r.name): (r.n, r.from_paths) for r in G.reference_counts(files).collect()}
    assert counts["pk/m.py", "f"] == (1, ["pk/u.py"]) and counts["src/a/util.ts", "C"] == (0, [])
    assert {"fa", "f", "D", "ns"} <= {r.name for r in G.referenced_names(files).collect()}


def test_dead_code(files):
    dead = {(r.path, r.line) for r in G.dead_code(files).collect()}
    assert {("src/a/util.ts", 5), ("pk/lone.py", 1), ("g/b.go", 2), ("r/a.rs", 4), ("rb/a.rb", 4), ("j/A.java", 3)} <= dead
    assert not {p for p, _ in dead} & {"pk/m.py", "lib/x.js", "src/b/index.js", "rb/b.rb", "src/a/use.ts"}
    assert ("g/a.go", 9) not in dead and ("src/a/util.ts", 1) not in dead


def test_modules(files):
    got = {(r.module, r.path) for r in G.module_index(files).collect()}
    assert {("pk", "pk/__init__.py"), ("pk.m", "pk/m.py"), ("m", "pk/m.py")} <= got


def test_paths_are_folded(spark):
    rows = spark.createDataFrame([("a/./b/../c//d",), ("../../x",), ("",), (None,)], "p string").select(G.normalized(F.col("p")).alias("p")).collect()
    assert [r.p for r in rows] == ["a/c/d", "x", "", None]
