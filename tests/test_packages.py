"""Packages of nine more languages: catalogs by beginnings, manifests of the nearest folder, files of the project."""

import re
import time

import pytest
from pyspark.sql import functions as F

from codequarry.operators import packages as P
from codequarry.plans.scan import Options, issues
from codequarry.sources import manifests

SCHEMA = "path string, language string, source string"
CASES = [
    ("java", "import java.util.List;\nimport java.util.*;\nimport static java.lang.Math.max;\nimport com.madeup.X;\nimport java.madeup.Y;\n", [4, 5]),
    ("java", "// import com.madeup.X;\nString s = \"import com.madeup.X;\";\n", []),
    ("rust", "use std::collections::HashMap;\nuse crate::x;\npub use madeup::{A, B};\n", [3]),
    ("php", "<?php\nuse PDO;\nuse SPL\\X;\nuse Madeup\\Thing as T;\n", [4]),
    ("c", "#include <stdio.h>\n#include \"own.h\"\n#include <madeup.h>\n#include <vector>\n", [3, 4]),
    ("cpp", "#include <vector>\n#include <stdio.h>\n# include <madeup>\n", [3]),
    ("kotlin", "import kotlin.math.max\nimport kotlinx.coroutines.*\nimport com.madeup.X as Y\n", [3]),
    ("swift", "import Foundation\nimport struct Foundation.Date\n@testable import Madeup\n", [3]),
    ("csharp", "using System.Linq;\nusing static System.Math;\nusing Madeup.Core;\nusing X = Madeup.Y;\nusing (var f = open()) {}\n", [3]),
    ("go", "package a\nimport (\n\t\"fmt\"\n\tm \"madeup.org/x\"\n\t\"net/http\"\n\t\"net/madeup\"\n)\nimport \"os\"\nvar s = \"madeup.org/x\"\n", [4, 6]),
    ("php", "<?php\nrequire_once './c0';\ninclude('../src/none.php');\nrequire 'plain.php';\n", [3]),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"src/c{i}", language, source) for i, (language, source, _) in enumerate(CASES)]
    rows += [(f"src/tests/c{i}", language, source) for i, (language, source, _) in enumerate(CASES)] + [("src/none", "java", None)]
    files = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("clash"))
    return issues(files, Options(only=("package-hallucination",))).collect()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_imports(found, i):
    assert sorted(r.line for r in found if r.path == f"src/c{i}") == CASES[i][2]


def test_severity_and_tests(found):
    assert {r.severity for r in found if r.path == "src/c9"} == {"high"} and {r.severity for r in found if r.path == "src/c0"} == {"medium"}
    assert not any("tests/" in r.path or r.path == "src/none" for r in found)


def test_what_the_project_has_and_declares(spark):
    files = spark.createDataFrame(
        [
            ("a/src/main/java/org/own/Thing.java", "java", "import org.own.Thing;\nimport org.own.Missing;\n"),
            ("a/src/util.rs", "rust", "use util::x;\nuse serde_json::Value;\nuse other::y;\n"),
            ("b/src/lib.rs", "rust", "use serde_json::Value;\n"),
            ("b/sub/src/lib.rs", "rust", "use nested::Value;\nuse outer::Value;\n"),
            ("g/x.go", "go", 'package x\nimport "example.org/m/inner"\nimport "example.org/dep/v2/k"\nimport "example.org/no"\n'),
            ("w/a.rb", "ruby", "require 'madegem'\nrequire 'nogem'\n"),
            ("w/a.py", "python", "import declared_one\nimport never_declared\n"),
            ("v/a.py", "python", "import declared_one\n"),
        ],
        SCHEMA,
    )
    said = spark.createDataFrame(
        [
            ("a/Cargo.toml", '[package]\nname = "a"\n[dependencies]\nserde-json = "1"\n[dev-dependencies.other2]\nversion = "1"\n'),
            ("b/Cargo.toml", '[dependencies]\nouter = "1"\n'),
            ("b/sub/Cargo.toml", '[target.x.dependencies]\nnested = { version = "1" }\n'),
            ("g/go.mod", "module example.org/m\nrequire (\n\texample.org/dep v2.0.0\n)\n"),
            ("w/Gemfile", "source 'x'\ngem 'madegem', '~> 1'\n"),
            ("w/requirements.txt", "declared_one==1\n"),
            ("bad/Cargo.toml", None),
        ],
        "path string, source string",
    )
    got = {(r.path, r.line) for r in issues(files, Options(only=("package-hallucination",)), manifests.declared(said)).collect()}
    assert got == {("a/src/main/java/org/own/Thing.java", 2), ("a/src/util.rs", 3), ("b/src/lib.rs", 1), ("b/sub/src/lib.rs", 2), ("g/x.go", 4), ("w/a.rb", 2), ("w/a.py", 2), ("v/a.py", 1)}


def test_nearest_manifest(spark):
    paths = spark.createDataFrame([("a/b/c/x.rs", "rust"), ("a/x.rs", "rust"), ("x.rs", "rust"), ("a/b/x.go", "go")], "path string, language string")
    held = spark.createDataFrame([("a/b/Cargo.toml", "rust"), ("Cargo.toml", "rust")], "path string, language string")
    assert {r.path: r.folder for r in P.nearest_manifests(paths, held).collect()} == {"a/b/c/x.rs": "a/b", "a/x.rs": "", "x.rs": ""}


def test_beginnings(spark):
    rows = spark.createDataFrame([("java", "a.b.c"), ("rust", "a::b"), ("php", "A\\B"), ("swift", "A"), ("lisp", "a.b")], "language string, module string")
    got = {r.language: r.b for r in rows.select("language", P.beginnings(F.col("module"), F.col("language")).alias("b")).collect()}
    assert got == {"java": ["a", "a.b", "a.b.c"], "rust": ["a", "a::b"], "php": ["A", "A\\B"], "swift": ["A"], "lisp": ["a.b"]}


def test_long_comments_take_no_longer_than_they_are(spark):
    said = "x" * 100_000
    rows = [("a.go", "go", f'package a\n// {said}\nimport ( // {said}\n\tm "net/x" // {said}\n)\n'), ("b.kt", "kotlin", f"import a.b // {said}\nimport c /* {said} */ d\n")]
    start = time.time()
    got = P.package_imports(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.path, r.line, r.module) for r in got) == [("a.go", 4, "net/x"), ("b.kt", 1, "a.b")]
    assert time.time() - start < 60


@pytest.mark.parametrize("line", ['import "a/b"', '  "a/b"', ' ( "a/b" )', 'import (x.y "a/b")', 'import\t_ "a/b"', 'import x "a/b"  ', 'x "a/b")', 'importx "a/b"', 'import import "a/b"', 'import( "a/b"', 'x y "a/b"', '"a/b" x', '""', '("a/b") )', '( ( "a/b"', 'x"a/b"', 'import"a/b"', '"a/b"\r'])
def test_lines_of_go_that_hold_a_path(line):
    """As the plain pattern, which gives white space back, says."""
    plain = re.match(r'^\s*(?:import\s+)?\(?\s*(?:[\w.]+\s+)?"([^"]+)"\s*\)?\s*$', line)
    found = re.match(P.QUOTED, line)
    assert (plain and plain[1]) == (found and found[1])


def test_long_comments_among_unknown_modules(spark):
    said = "x" * 100_000
    rows = [("src/a.go", "go", f'package a\nimport (\n\t"net/http" // {said}\n\t"madeup.org/x"\n)\n// {said}\n'), ("src/b.kt", "kotlin", f"import kotlin.math.max // {said}\nimport com.madeup.X\n")]
    start = time.time()
    got = P.unknown_modules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.path, r.line) for r in got) == [("src/a.go", 4), ("src/b.kt", 2)]
    assert time.time() - start < 60
