"""Source files spliced from ``documents`` for the symbol graph and for promises, in SQL that both engines read.

Every file ends with a whole text as comment lines, which nothing may look into.
"""

_SAID = """CASE WHEN language = 'python' THEN '# ' ELSE '// ' END, replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), concat(chr(10), CASE WHEN language = 'python' THEN '# ' ELSE '// ' END)), chr(10)"""


def _files(kinds: list[tuple[str, str, str]], of: str) -> str:
    """Kinds are (language, path, source), all SQL over ``k``, the doc_id."""
    pick = lambda i: f"CASE {of} " + " ".join(f"WHEN {n} THEN {x[i]}" for n, x in enumerate(kinds)) + " END"
    rows = f"SELECT text, {pick(0)} AS language, {pick(1)} AS path, {pick(2)} AS body FROM (SELECT doc_id AS k, text FROM documents) d"
    return f"SELECT path, language, concat(body, chr(10), {_SAID}) AS source FROM ({rows}) r"


def _said(*lines: str) -> str:
    """Lines of a file; what stands in brackets ``<...>`` is SQL."""
    out = []
    for line in lines:
        parts = line.replace(">", "<").split("<")
        out.append("concat(" + ", ".join(f"CAST({x} AS STRING)" if i % 2 else "'" + x.replace("'", "''") + "'" for i, x in enumerate(parts)) + ")")
    return "concat(" + ", chr(10), ".join(out) + ")"


#: Definitions and the files that import them, by relative paths, an index file, a whole module, or only by a word.
DERIVED_GRAPH = _files(
    [
        ("'typescript'", _said("src/a<k % 7>/util<k>.ts"), _said("export function fn<k>(x) {", "  return x;", "}", "export const K<k> = 1;")),
        ("'typescript'", _said("src/a<(k - 1) % 7>/use<k>.ts"), _said("import {", "  fn<k - 1> as f,", "  missing", '} from "./util<k - 1>";', "f(1);")),
        ("'javascript'", _said("lib/d<k>/index.js"), _said("export class C<k> {", "}")),
        ("'javascript'", _said("app/m<k>.js"), f"""CASE WHEN k % 16 = 3 THEN {_said('import C<k - 1> from "../lib/d<k - 1>";')} ELSE {_said('import * as all from "../lib/d<k - 1>/index.js";')} END"""),
        ("'python'", _said("py/p<k>.py"), _said("def f<k>(x):", "    return x + 1", "LIMIT_<k> = 3")),
        ("'python'", _said("py/q<k>.py"), _said("from .p<k - 1> import f<k - 1> as g", "g(1)")),
        ("'go'", _said("go/g<k>.go"), _said("func Do<k>() {", "\tcall()", "}")),
        ("'go'", _said("go/h<k>.go"), f"""CASE WHEN k % 16 = 7 THEN {_said('func use() {', '    Do<k - 1>()', '}')} ELSE {_said('func use() {', '    call()', '}')} END"""),
    ],
    "k % 8",
)

#: Chains, awaits and futures with and without a handler.
DERIVED_PROMISES = _files(
    [
        ("'typescript'", _said("src/w<k>.ts"), _said("load(x)", "  .then(r = r.json())", "  .then(show);")),
        ("'typescript'", _said("src/w<k>.ts"), _said("load(x)", "  .then(r = r.json())", "  .catch(report);")),
        ("'typescript'", _said("src/w<k>.ts"), _said("async function g() {", "  const r = await fetch(u);", "  return r;", "}")),
        ("'typescript'", _said("src/w<k>.ts"), _said("async function g() {", "  prepare();", "  try {", "    const r = await fetch(u);", "  } catch (e) {", "    throw e;", "  }", "}")),
        ("'python'", _said("src/w<k>.py"), _said("async def g():", "    await db.execute(q)")),
        ("'python'", _said("src/w<k>.py"), _said("async def g():", "    prepare()", "    try:", "        await db.execute(q)", "    except E:", "        raise")),
        ("'java'", _said("src/w<k>.java"), _said("class A {", "  void g() {", "    future.get();", "  }", "}")),
        ("'java'", _said("src/w<k>.java"), _said("class A {", "  void g() {", "    try {", "      future.get();", "    } catch (E e) {", "      throw e;", "    }", "  }", "}")),
        ("'typescript'", _said("src/w<k>.ts"), _said("save(x).then(function () {", '  console.log("saved");', "});")),
        ("'typescript'", _said("src/w<k>.ts"), f"""CASE WHEN k % 20 = 9 THEN {_said('async function g() {', '  const tx = await db.begin();', '  try {', '    work(tx);', '  } finally {', '    done(tx);', '  }', '}')} ELSE {_said('async function g() {', '  const tx = await db.begin();', '  work(tx);', '}')} END"""),
    ],
    "k % 10",
)

#: Imports of six languages: of a standard package, and of one that only some manifests know.
DERIVED_PACKAGES = _files(
    [
        ("'java'", _said("src/k<k>.java"), _said("import java.util.List;", "import com.acme<k % 5>.X;")),
        ("'rust'", _said("src/k<k>.rs"), _said("use std::fmt;", "use acme<k % 5>::y;")),
        ("'go'", _said("src/k<k>.go"), _said("import (", '  "net/http"', '  "acme.org/p<k % 5>/inner"', ")")),
        ("'csharp'", _said("src/k<k>.cs"), _said("using System.Linq;", "using Acme<k % 5>.Core;")),
        ("'kotlin'", _said("src/k<k>.kt"), _said("import kotlin.math.max", "import com.acme<k % 5>.X")),
        ("'swift'", _said("src/k<k>.swift"), _said("import Foundation", "import Acme<k % 5>")),
    ],
    "k % 6",
)

#: Projects of eight files each, with package.json files that name what is there and what is not.
DERIVED_PROJECTS = """
SELECT concat('p', CAST(p AS STRING)) AS project,
  CASE k % 8 WHEN 0 THEN 'package.json' WHEN 1 THEN 'src/a.js' WHEN 2 THEN 'src/b.ts' WHEN 3 THEN CASE WHEN p % 2 = 0 THEN 'node_modules/have/index.js' ELSE 'other/have.js' END WHEN 4 THEN CASE WHEN p % 5 = 0 THEN 'bin/y.js' ELSE 'bin/x.js' END
    WHEN 5 THEN CASE WHEN p % 4 = 0 THEN '.gitignore' ELSE 'README.md' END WHEN 6 THEN 'main.go' ELSE CASE WHEN p % 3 = 1 THEN 'tsconfig.json' ELSE 'notes.txt' END END AS path,
  CASE k % 8 WHEN 0 THEN CASE WHEN p % 7 = 0 THEN '{ not json' ELSE concat('{"name": "x", "main": "', CASE WHEN p % 2 = 0 THEN 'lib/index.js' ELSE './src/a.js' END, '", "module": "src", "bin": ', CASE WHEN p % 3 = 0 THEN '"bin/x.js"' ELSE '{"x": "bin/x.js", "z": "bin"}' END,
    ', "dependencies": {"left', CAST(p % 9 AS STRING), '": "1", "have": "2"}', CASE WHEN p % 6 = 1 THEN ', "type": "module"' ELSE '' END, '}') END
    WHEN 1 THEN concat('import x from "y";', chr(10), coalesce(text, '')) ELSE text END AS source
FROM (SELECT doc_id AS k, CAST(floor(doc_id / 8) AS BIGINT) AS p, text FROM documents) d
"""
