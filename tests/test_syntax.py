"""Blocks, statements, Python's tree, promises and reachability: a hit and a near miss of each."""

import pytest
from pyspark.sql import functions as F

from codequarry.functions import scopes
from codequarry.operators import python_tree, syntax
from codequarry.plans.scan import Options, issues

SCHEMA = "path string, language string, source string"
PY_BRANCHES = "def f(x):\n    if x:\n        return 1\n    elif x > 2:\n        raise E\n    else:\n        return 2\n    y = 1\n    z = 2\n"
TS_BRANCHES = "function f(x) {\n  if (x) { return 1; } else { return 2; }\n  const y = 1;\n  show(y);\n}\n"
CASES = [
    ("python", PY_BRANCHES, "unreachable-code", [8]),
    ("python", PY_BRANCHES.replace("    else:\n        return 2\n", ""), "unreachable-code", []),
    ("typescript", TS_BRANCHES, "unreachable-code", [3]),
    ("typescript", TS_BRANCHES.replace("else { return 2; }", "else { x = 2; }"), "unreachable-code", []),
    ("typescript", "function f() {\n  if (a)\n    return 1\n  g()\n}\n", "unreachable-code", []),
    ("typescript", "function f() {\n  return g(\n    1)\n  function g() { return 1 }\n}\n", "unreachable-code", []),
    ("typescript", "switch (x) {\n  case 1:\n    return a;\n  case 2:\n    b();\n}\n", "unreachable-code", []),
    ("java", "class A {\n  int f() {\n    try { return 1; } catch (E e) { throw e; }\n    g();\n  }\n}\n", "unreachable-code", [4]),
    ("java", "class A {\n  int f() {\n    try { return 1; } catch (E e) { log(e); }\n    g();\n  }\n}\n", "unreachable-code", []),
    ("go", "func f() error {\n\tif err := g(); err != nil {\n\t\treturn err\n\t}\n\th()\n\treturn nil\n}\n", "unreachable-code", []),
    ("go", "func f() {\n\tfor {\n\t\tbreak\n\t\th()\n\t}\n\tk()\n}\n", "unreachable-code", [4]),
    ("ruby", "def f(x)\n  if x\n    return 1\n  else\n    return 2\n  end\n  y\nend\n", "unreachable-code", [7]),
    ("rust", "fn f() -> i32 {\n    if a { return 1; } else { return 2; }\n    g();\n}\n", "unreachable-code", [3]),
    ("php", "<?php\nfunction f() {\n  return 1;\n  g();\n}\n", "unreachable-code", [4]),
    ("typescript", "load(x)\n  .then(a)\n  .then(b)\nnext()\n", "unhandled-promise", [1]),
    ("typescript", "load(x)\n  .then(a)\n  .catch(b)\n", "unhandled-promise", []),
    ("typescript", "load(x).then(() => { toast('a') });\n", "unhandled-promise", []),
    ("typescript", "const s = 'x.then(y)';\n// x.then(y);\n", "unhandled-promise", []),
    ("typescript", "async function f() {\n  const r = await fetch(u);\n}\n", "unhandled-promise", [2]),
    ("typescript", "async function f() {\n  try {\n    if (x) { await fetch(u); }\n  } catch (e) { throw e; }\n}\n", "unhandled-promise", []),
    ("typescript", "async function f() {\n  try {\n    a();\n  } catch (e) { throw e; }\n  await fetch(u);\n}\n", "unhandled-promise", []),
    ("typescript", "async function f() {\n  g();\n  try {\n    a();\n  } catch (e) { throw e; }\n  await fetch(u);\n}\n", "unhandled-promise", [6]),
    ("typescript", "async function f() {\n  g();\n  const tx = await db.begin();\n  try {\n    a();\n  } finally { b(); }\n}\n", "unhandled-promise", []),
    ("typescript", "async function f() {\n  await sleep(1);\n}\n", "unhandled-promise", []),
    ("python", "async def f():\n    await client.get(u)\n", "unhandled-promise", [2]),
    ("python", "async def f():\n    g()\n    try:\n        await client.get(u)\n    except E:\n        raise\n", "unhandled-promise", []),
    ("java", "class A {\n  void f() {\n    int x = future.get();\n  }\n}\n", "unhandled-promise", [3]),
    ("java", "class A {\n  void f() {\n    try {\n      int x = future.get();\n    } catch (E e) { throw e; }\n  }\n}\n", "unhandled-promise", []),
    ("typescript", "class A {\n  run() {}\n  getX() { return null; }\n  keep() { return this.x; }\n}\n", "empty-impl", [2]),
    ("typescript", "class A {\n  run() {}\n  getX() { return null; }\n  keep() { return this.x; }\n}\n", "stub-function", [3]),
    ("php", "<?php\nclass A {\n  public function run() {\n  }\n}\n", "empty-impl", [3]),
    ("python", "from abc import ABC, abstractmethod\nclass A(ABC):\n    @abstractmethod\n    def f(self):\n        pass\n", "empty-impl", []),
    ("python", "class A:\n    def f(self):\n        '''only said'''\n        ...\n", "empty-impl", [2]),
    ("python", "class P(Protocol):\n    def f(self): ...\n", "empty-impl", []),
    ("python", "def f(x):\n    '''text'''\n    return []\n", "stub-function", [1]),
    ("python", "def f(x):\n    return [x]\n", "stub-function", []),
    ("python", "try:\n    f()\nexcept ValueError as e:\n    logger.error('no', e)\n", "swallowed-error", []),
    ("python", "try:\n    f()\nexcept ValueError as e:\n    logger.error('no')\n", "swallowed-error", [3]),
    ("python", "try:\n    f()\nexcept OSError:\n    pass\n", "swallowed-error", []),
    ("python", "def broken(:\n\ntry:\n    f()\nexcept ValueError:\n    pass\n", "swallowed-error", [5]),
]


@pytest.fixture(scope="module")
def found(spark):
    """All cases in one scan of each rule, as files of their own, also once more as tests and without a source."""
    rows = [(f"src/c{i}", language, source) for i, (language, source, *_) in enumerate(CASES)]
    rows += [(f"src/tests/c{i}", language, source) for i, (language, source, *_) in enumerate(CASES)] + [("src/none", "python", None), ("src/no", "typescript", "")]
    files = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("clash")).withColumn("nodes", F.lit(1))
    return {rule: issues(files, Options(only=(rule,))).select("path", "line").collect() for rule in {c[2] for c in CASES}}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rule(found, i):
    assert sorted(r.line for r in found[CASES[i][2]] if r.path == f"src/c{i}") == CASES[i][3]


def test_tests_and_empty_sources_have_no_issues(found):
    assert all(r.path.startswith("src/c") for rows in found.values() for r in rows)


def test_blocks_nest_and_have_names(spark):
    source = "export class A {\n  async run(q: string): Promise<void> {\n    for (const x of q) {\n      if (x) continue;\n    }\n  }\n}\nconst f = async (x) => {\n  return x;\n};\n"
    files = spark.createDataFrame([("a", "typescript", source), ("b", "cobol", "x"), ("c", "go", None)], SCHEMA)
    rows = [tuple(r) for r in syntax.ast_nodes(files).filter("path = 'a'").select("kind", "name", "line", "end", "depth", "parent").orderBy("node").collect()]
    assert rows == [("file", "", 1, 11, 0, -1), ("class", "A", 1, 7, 1, 0), ("method", "run", 2, 6, 2, 1), ("loop", "", 3, 5, 3, 2), ("function", "f", 8, 10, 1, 0)]
    assert {r.path for r in syntax.ast_nodes(files).collect()} == {"a", "c"}


def test_deep_and_unbalanced_code_does_not_raise():
    for language in syntax.LANGUAGES:
        for text in ("{" * 3000, "}" * 3000, "(" * 3000 + "{", "if x:\n" * 500, "def f\n" * 500, "\"'`", "else {", "end\nend", "x = [\n" * 200, "\t" * 50 + "return"):
            tree = scopes.parse(text, language)
            assert all(n[4] <= n[5] for n in tree.nodes)


def test_lines_meet_intervals(spark):
    lines = spark.createDataFrame([("a", n) for n in (1, 5, 64, 65, 130, 400)] + [("b", 5)], "path string, line int")
    blocks = spark.createDataFrame([("a", 4, 65, "x"), ("a", 60, 64, "y"), ("a", 128, 399, "z")], "path string, line int, end int, name string")
    assert sorted((r.path, r.line) for r in syntax.inside(lines, blocks).collect()) == [("a", 5), ("a", 64), ("a", 65), ("a", 130)]
    assert sorted((r.path, r.line) for r in syntax.inside(lines, blocks, "left_anti").collect()) == [("a", 1), ("a", 400), ("b", 5)]
    inner = {(r.path, r.line): r.block and r.block["name"] for r in syntax.innermost(lines, blocks).collect()}
    assert inner == {("a", 1): None, ("a", 5): "x", ("a", 64): "y", ("a", 65): "x", ("a", 130): "z", ("a", 400): None, ("b", 5): None}


def test_definitions_know_their_class(spark):
    files = spark.createDataFrame([("a", "python", "class A:\n    def f(self):\n        pass\ndef g():\n    return 1\n")], SCHEMA)
    assert {(r.name, r.owner) for r in syntax.enclosed_definitions(files).collect()} == {("f", "A"), ("g", None)}


def test_python_functions_and_handlers(spark):
    source = "import abc\nclass A(abc.ABC):\n    @property\n    async def f(self):\n        'doc'\n        return None\n    def g(self):\n        raise NotImplementedError()\ntry:\n    f()\nexcept (A, B):\n    return_(1)\nfinally:\n    h()\n"
    files = spark.createDataFrame([("a", "python", source), ("bad", "python", "def ("), ("deep", "python", "(" * 5000), ("nul", "python", "a\0b"), ("none", "python", None)], SCHEMA)
    rows = {r.name: r for r in python_tree.py_functions(files).collect()}
    f, g = rows["f"], rows["g"]
    assert (f.line, f.end, f.owner, f.bases, f.decorators, f.statements, f.only, f.docstring, f.is_async) == (4, 6, "A", ["ABC"], ["property"], 1, "return None", True, True)
    assert (g.only, g.statements, g.is_async) == ("raise NotImplementedError", 1, False)
    handlers = [(r.line, r.try_line, r.type, r.statements, r.swallowed) for r in python_tree.py_handlers(files).orderBy("line").collect()]
    assert handlers == [(11, 9, "(A, B)", 1, False), (14, 9, "finally", 1, False)]
    assert {r.path for r in python_tree.py_errors(files).collect()} == {"bad", "deep", "nul"}
