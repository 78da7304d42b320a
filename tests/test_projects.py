"""Gaps of projects: a hit and a near miss of each."""

from codequarry.operators import projects
from codequarry.plans.scan import Options, issues


def _gaps(spark, rows):
    files = spark.createDataFrame(rows, "project string, path string, source string")
    return {(r.project, r.path, r.severity, r.message) for r in projects.gaps(files).collect()}


def test_projects_do_not_mix(spark):
    rows = [
        ("a", "package.json", '{"main": "./lib/x", "module": "es/i.mjs", "bin": {"c": "bin/c.js", "d": "bin"}, "dependencies": {"left": "1", "@s/p": "2"}, "devDependencies": {"right": "1"}}'),
        ("a", "lib/x/index.js", None), ("a", "bin/c.js", None), ("a", "src/a.js", "const a = 1\nimport b from 'b'"), ("a", "node_modules/@s/p/i.js", None), ("a", ".gitignore", ""), ("a", "x.d.ts", ""),
        ("b", "package.json", '{"type": "module", "bin": "cli.js", "dependencies": {"left": "1"}}'),
        ("b", "x.ts", ""), ("b", "tsconfig.json", "{}"), ("b", "es/i.mjs", ""), ("b", "src/a.js", "import b from 'b'"), ("b", ".gitignore", ""),
        ("c", "m.py", ""), ("c", "node_modules/x/y.go", ""), ("c", "n.rs", ""), ("c", ".gitignore", ""),
        ("d", "package.json", "{ no json"), ("d", "x.ts", ""), (None, "setup.py", ""), (None, "setup.py", ""), (None, "m.go", ""), (None, "go.mod", ""),
    ]
    assert _gaps(spark, rows) == {
        ("a", "package.json", "medium", "package.json names es/i.mjs as module, which does not exist"),
        ("a", "package.json", "medium", 'package.json does not say "type": "module", but scripts import'),
        ("a", "package.json", "medium", "dependency left is declared and not installed"),
        ("a", "package.json", "medium", "dependency right is declared and not installed"),
        ("b", "package.json", "high", "package.json names cli.js as bin, which does not exist"),
        ("c", "requirements.txt", "medium", "no list of dependencies"),
        ("c", "Cargo.toml", "high", "Cargo.toml is missing"),
        ("d", "tsconfig.json", "medium", "tsconfig.json is missing"),
        ("d", ".gitignore", "low", ".gitignore is missing"),
        ("", ".gitignore", "low", ".gitignore is missing"),
    }


def test_no_project_at_all(spark):
    assert _gaps(spark, []) == set()


def test_structure_is_a_rule_of_the_scan(spark):
    files = spark.createDataFrame([("m.go", "go", "package a")], "path string, language string, source string")
    assert {(r.path, r.rule) for r in issues(files, Options(only=("structure",))).collect()} == {("go.mod", "structure"), (".gitignore", "structure")}
    listing = spark.createDataFrame([("p", "m.go", None), ("p", "go.mod", None)], "project string, path string, source string")
    assert [r.path for r in issues(files, Options(), listing=listing).filter("rule = 'structure'").collect()] == ["p/.gitignore"]
