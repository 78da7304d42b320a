"""Registered queries of the engine itself, each with its SQL where SQL can say it.

They run over source files derived from ``documents`` (see ``source_files.DERIVED``).
The SQL restates each rule by other means: DuckDB's patterns know no look-around,
and it splits lines by ``unnest``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.operators import file_rules, issue_filters, known_false, line_rules, packages, projects, promise_rules, python_tree, review, symbols, syntax
from codequarry.plans import scan
from codequarry.runtime import shared_folder
from codequarry.sources import fixtures, manifests
from codequarry.sources import source_files as S
from codequarry.sources.verdict_store import VerdictStore

_FILES = f"WITH source_files AS ({S.DERIVED.replace('AS STRING', 'AS VARCHAR')})"
_LINES = (
    _FILES
    + r""", live AS (SELECT * FROM source_files WHERE path NOT LIKE '%/tests/%'),
lines AS (SELECT path, language, CAST(generate_subscripts(string_split(source, chr(10)), 1) AS INT) AS line, unnest(string_split(source, chr(10))) AS text FROM live)"""
)
_ISSUE = "SELECT path, line, '{rule}' AS rule, '{severity}' AS severity, '{confidence}' AS confidence, '{category}' AS category, '{message}' AS message, trim(text) AS snippet FROM lines WHERE {where}"


def _issue(rule, category, severity, confidence, message, where):
    return _ISSUE.format(**{k: v for k, v in locals().items()})


_SQL_RULES = {
    "fake-url": [_issue("fake-url", "hallucination", "medium", "high", "API URL of an unknown host", "text LIKE '%://api.%' AND NOT text LIKE '%://api.github.%'")],
    "hardcoded-value": [
        _issue("hardcoded-value", "quality", "medium", "medium", "hard-coded URL", "text LIKE '%\"https://%' AND NOT text LIKE '%github%'"),
        _issue("hardcoded-value", "quality", "medium", "medium", "hard-coded IP address", "regexp_matches(text, '\"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+\"')"),
    ],
    "security": [
        _issue("security", "security", "high", "medium", "GitHub token in the source", "regexp_matches(text, '\"ghp_[a-zA-Z0-9]{36}\"')"),
        _issue("security", "security", "critical", "medium", "eval of untrusted input", "text LIKE '%eval(user%' AND text NOT LIKE '#%'"),
    ],
    "api-hallucination": [_issue("api-hallucination", "hallucination", "high", "high", "call of an API that does not exist", "contains(text, 'Object.map(') AND language = 'typescript'")],
    "swallowed-error": [
        _issue("swallowed-error", "ai-code", "high", "medium", "error result discarded", "language = 'go' AND text LIKE '%, _ :=%'"),
        _issue("swallowed-error", "ai-code", "medium", "medium", "unwrap() may panic", "language = 'rust' AND contains(text, '.unwrap()')"),
    ],
    "resource-leak": [
        _issue("resource-leak", "ai-code", "medium", "medium", "resource is never closed", "text LIKE 'f = open(%' AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.path = lines.path AND c.line > lines.line AND c.text LIKE 'f.close(%')")
    ],
    "package-hallucination": [_issue("package-hallucination", "hallucination", "high", "high", "package is not known", "text LIKE 'import madeup%'")],
    "unused-declaration": [_issue("unused-declaration", "quality", "low", "medium", "import is not used", "text LIKE 'import %' AND (SELECT count(*) FROM lines c WHERE c.path = lines.path AND contains(c.text, substr(lines.text, 8))) = 1")],
}
_ALL = " UNION ALL ".join(s for part in _SQL_RULES.values() for s in part)
_ISSUES = f"{_LINES}, issues AS ({_ALL})"
_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"


_FUNCTION_LINES = _LINES.replace(_FILES, f"WITH source_files AS ({S.DERIVED_FUNCTIONS.replace('AS STRING', 'AS VARCHAR')})")
_SQL_FUNCTION_RULES = {
    "stub-function": [
        _issue("stub-function", "ai-code", "high", "high", "function only returns a fixed value", "text LIKE 'export function part%'"),
        _issue("stub-function", "ai-code", "low", "high", "function only returns a fixed value", "text LIKE 'def is_ready%'"),
    ],
    "empty-impl": [_issue("empty-impl", "ai-code", "high", "high", "function does nothing", "text LIKE 'def step%' OR text LIKE 'func Work%'")],
    "weak-validation": [
        _issue("weak-validation", "ai-code", "medium", "medium", "only presence is checked", "text LIKE 'function check%' AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.path = lines.path AND contains(c.text, 'typeof'))")
    ],
    "narrative-comments": [
        _issue("narrative-comments", "ai-code", "low", "low", "comment retells the code", "text = '# create the counter' AND EXISTS (SELECT 1 FROM lines c WHERE c.path = lines.path AND c.line = lines.line + 1 AND starts_with(c.text, 'counter'))")
    ],
    "dead-code": [
        _issue(
            "dead-code", "quality", "low", "medium", "exported name is never used",
            "text LIKE 'export %' AND regexp_extract(text, 'part[0-9]+') NOT IN (SELECT regexp_extract(source, 'part[0-9]+') FROM source_files WHERE contains(source, 'import {'))",
        ),
        _issue("dead-code", "quality", "low", "medium", "exported name is never used", "(language = 'python' AND regexp_matches(text, '^def [a-z]')) OR (language = 'go' AND regexp_matches(text, '^func [A-Z]'))"),
    ],
}


_FLOW_FILES = f"WITH source_files AS ({S.DERIVED_FLOW.replace('AS STRING', 'AS VARCHAR')})"
_FLOW_LINES = _LINES.replace(_FILES, _FLOW_FILES) + ", pairs AS (SELECT a.*, b.text AS before, c.text AS after FROM lines a LEFT JOIN lines b ON b.path = a.path AND b.line = a.line - 1 LEFT JOIN lines c ON c.path = a.path AND c.line = a.line + 1)"
_SQL_FLOW = {
    "handlers": "SELECT path, line, 'swallowed-error' AS rule, 'high' AS severity, 'medium' AS confidence, 'ai-code' AS category, 'error is caught and not handled' AS message, trim(text) AS snippet FROM pairs WHERE NOT regexp_matches(text, '^(//|#)') AND ("
    r"(language = 'typescript' AND regexp_matches(text, 'catch \(\w+\) \{$') AND after = '}') OR (language = 'java' AND regexp_matches(text, 'catch \(.*\) \{ \w+[.]printStackTrace\(\); \}')) OR (language = 'php' AND regexp_matches(text, 'catch \(.*\) \{ echo [^;]*; \}'))"
    r" OR (language = 'go' AND text = 'if err != nil {' AND regexp_matches(after, '^\s*(log|fmt)[.]')) OR (language = 'python' AND regexp_matches(text, '^except \w+:$') AND regexp_matches(after, '^ +pass$') AND NOT EXISTS (SELECT 1 FROM lines d WHERE d.path = pairs.path AND d.line = pairs.line + 2 AND regexp_matches(d.text, '^ +\S'))))",
    "after_return": "SELECT path, line, 'unreachable-code' AS rule, 'low' AS severity, CASE WHEN regexp_matches(coalesce(after, ''), '^[ ]+[a-z]') THEN 'medium' ELSE 'low' END AS confidence, 'correctness' AS category, 'code behind a return is never reached' AS message, trim(text) AS snippet FROM pairs"
    r" WHERE regexp_matches(before, '^ +(return|throw|raise) .*[^\[({,]$') AND regexp_matches(text, '^ +[a-z]') AND regexp_extract(text, '^ +') = regexp_extract(before, '^ +')",
}
_ISSUE_ROWS = f"WITH found AS ({S.DERIVED_ISSUES.replace('FROM documents', 'FROM orders')})"
#: The tests that these issues can meet, said by rule.
_KNOWN_FALSE = """CASE WHEN rule = 'stub-function' AND message LIKE '%isOpen%return true%' THEN 'stub_with_a_reason' WHEN rule = 'empty-impl' AND contains(message, '__init__') THEN 'empty_by_design'
  WHEN rule = 'unused-declaration' AND starts_with(snippet, 'export ') THEN 'public_name' WHEN rule = 'security' AND message LIKE '%http%localhost%' THEN 'local_http'
  WHEN rule = 'hardcoded-value' AND contains(path, 'config') THEN 'settings_file' WHEN rule = 'hardcoded-value' AND message LIKE '%URL%' AND contains(snippet, '_URL') THEN 'settings_name'
  WHEN rule = 'unreachable-code' AND regexp_matches(snippet, '^(case |default:)') THEN 'case_label' WHEN rule = 'fake-url' AND contains(snippet, 'DB_HOST') THEN 'address_setting'
  WHEN rule = 'package-hallucination' AND contains(path, 'node_modules/') THEN 'installed_package' WHEN rule = 'resource-leak' AND starts_with(snippet, 'with ') THEN 'managed_resource'
  WHEN rule = 'resource-leak' AND starts_with(snippet, 'defer ') THEN 'deferred_close' END"""


#: Manifests by other means than the engine's: a window carries each line's section forward.
_MANIFESTS = (
    f"WITH m AS ({manifests.DERIVED_MANIFESTS.replace('FROM documents', 'FROM orders').replace('AS STRING', 'AS VARCHAR')})"
    + r""", raw AS (SELECT path, generate_subscripts(string_split(source, chr(10)), 1) AS line, trim(unnest(string_split(source, chr(10))), concat(' ', chr(9))) AS text FROM m),
said AS (SELECT *, last_value(CASE WHEN regexp_matches(text, '^\[[^\]]+\]') THEN regexp_extract(text, '^\[([^\]]+)\]', 1) END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line) AS section FROM raw),
numbered AS (SELECT *, sum(CASE WHEN starts_with(text, '[') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line) AS block FROM said),
named AS (
  SELECT path, 'python' AS language, lower(regexp_extract(text, '^([^=<>!~\s\[]+)', 1)) AS name FROM said WHERE path LIKE '%/requirements.txt' AND NOT starts_with(text, '#') AND NOT starts_with(text, '-')
  UNION ALL SELECT path, 'python', lower(regexp_extract(text, '^["'']([a-zA-Z0-9_-]+)["'']', 1)) FROM said WHERE path LIKE '%/pyproject.toml' AND section = 'project.dependencies'
  UNION ALL SELECT path, 'python', lower(regexp_extract(text, '^([a-zA-Z0-9_-]+)\s*=', 1)) FROM said WHERE path LIKE '%/pyproject.toml' AND section LIKE 'tool.poetry.%dependencies%' AND NOT starts_with(text, 'python ')
  UNION ALL SELECT path, 'python', lower(regexp_extract(text, '^["'']([a-zA-Z0-9_-]+)', 1)) FROM said WHERE path LIKE '%/pyproject.toml' AND section LIKE 'tool.pdm.%dependencies%'
  UNION ALL SELECT path, 'python', lower(regexp_extract(text, '^["'']([a-zA-Z0-9_-]+)["'']\s*[=<>!~\[,]', 1)) FROM said WHERE path LIKE '%/pyproject.toml' AND section NOT LIKE '%dependencies%'
  UNION ALL SELECT path, 'python', lower(arg_min(regexp_extract(text, '^name\s*=\s*"([^"]+)"', 1), line)) FROM numbered WHERE path LIKE '%.lock' AND section = '[package' AND regexp_matches(text, '^name\s*=') AND NOT contains(text, '"python"') GROUP BY path, block
  UNION ALL SELECT path, 'python', lower(regexp_extract(text, '^([a-zA-Z0-9_-]+)\s*=', 1)) FROM said WHERE path LIKE '%/Pipfile' AND section IN ('packages', 'dev-packages')
  UNION ALL SELECT path, 'python', lower(unnest(regexp_extract_all(source, '["'']([a-zA-Z0-9_-]+)["'']\s*[=<>!~]', 1))) FROM m WHERE path LIKE '%/setup.py'
  UNION ALL SELECT path, unnest(['javascript', 'typescript']), name FROM (SELECT path, unnest(json_keys(source, '$.dependencies') || json_keys(source, '$.devDependencies')) AS name FROM m WHERE path LIKE '%/package.json' AND json_valid(source))
  UNION ALL SELECT path, 'go', coalesce(nullif(regexp_extract(text, '^module\s+(\S+)', 1), ''), regexp_extract(text, '^(\S+)\s+v[\d.]+', 1)) FROM said WHERE path LIKE '%/go.mod')"""
)
_REVIEWED = "(rule IN ('api-hallucination', 'package-hallucination') OR (rule IN ('fake-url', 'security') AND severity <> 'low') OR (rule IN ('swallowed-error', 'hardcoded-value', 'resource-leak', 'unused-declaration') AND severity IN ('critical', 'high') AND confidence = 'high'))"


def _with_files(sql: str) -> str:
    """The files, and their sources without the comment lines."""
    return f"WITH source_files AS ({sql.replace('AS STRING', 'AS VARCHAR')}), plain AS (SELECT path, language, regexp_replace(source, '(?m)^(//|#).*$', '', 'g') AS code, regexp_replace(path, '/?[^/]*$', '') AS folder FROM source_files)"


#: Imports by patterns over the first lines, their candidates and the paths that exist, by priority.
_GRAPH = (
    _with_files(fixtures.DERIVED_GRAPH)
    + r""", listed AS (SELECT path, language, folder, regexp_extract(code, 'from "([^"]+)"', 1) AS source, regexp_replace(unnest(string_split(regexp_extract(code, 'import \{([^}]*)\}', 1), ',')), '^\s+|\s+$', '', 'g') AS item FROM plain WHERE regexp_matches(code, '^import \{')),
found AS (SELECT path, language, folder, source, string_split(item, ' as ')[1] AS name, string_split(item, ' as ')[-1] AS local FROM listed
  UNION ALL SELECT path, language, folder, regexp_extract(code, 'from "([^"]+)"', 1), 'default', regexp_extract(code, '^import (\w+) from', 1) FROM plain WHERE regexp_matches(code, '^import \w+ from')
  UNION ALL SELECT path, language, folder, regexp_extract(code, 'from "([^"]+)"', 1), '*', regexp_extract(code, '^import \* as (\w+)', 1) FROM plain WHERE regexp_matches(code, '^import \* as')
  UNION ALL SELECT path, language, folder, regexp_extract(code, '^from (\S+) import', 1), regexp_extract(code, ' import (\w+)', 1), regexp_extract(code, ' as (\w+)', 1) FROM plain WHERE regexp_matches(code, '^from ')),
stems AS (SELECT *, CASE WHEN language = 'python' THEN concat(folder, '/', substr(source, 2)) ELSE regexp_replace(replace(concat(folder, '/', source), '/./', '/'), '[^/]+/\.\./', '') END AS stem FROM found),
tried AS (SELECT s.*, f.path AS target, e.prio FROM stems s, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '.py', '/index.ts', '/index.js', '/__init__.py']) AS ending, unnest(range(9)) AS prio) e JOIN source_files f ON f.path = concat(s.stem, e.ending)),
resolved AS (SELECT s.path, s.source, s.name, s.local, arg_min(t.target, t.prio) AS target FROM stems s LEFT JOIN tried t ON t.path = s.path AND t.name = s.name AND t.source = s.source GROUP BY ALL),
defined AS (SELECT path, language, regexp_extract(code, 'export function (\w+)', 1) AS name, 1 AS line FROM plain UNION ALL SELECT path, language, regexp_extract(code, 'export const (\w+)', 1), 4 FROM plain UNION ALL SELECT path, language, regexp_extract(code, 'export class (\w+)', 1), 1 FROM plain
  UNION ALL SELECT path, language, regexp_extract(code, '^def (\w+)', 1), 1 FROM plain UNION ALL SELECT path, language, regexp_extract(code, '(?m)^([A-Z]+_\d+) =', 1), 3 FROM plain UNION ALL SELECT path, language, regexp_extract(code, '^func ([A-Z]\w*)', 1), 1 FROM plain),
exported AS (SELECT * FROM defined WHERE name <> ''),
named AS (SELECT target AS path, CASE WHEN name = 'default' THEN local ELSE name END AS name, path AS from_path FROM resolved WHERE target IS NOT NULL AND name <> '*')"""
)
_DEAD = r"""SELECT e.path, e.line, 'dead-code' AS rule, 'low' AS severity, 'medium' AS confidence, 'quality' AS category, 'exported name is never used' AS message, string_split(s.source, chr(10))[e.line] AS snippet FROM exported e JOIN source_files s ON s.path = e.path
WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.path = e.path AND n.name = e.name) AND e.path NOT IN (SELECT target FROM resolved WHERE name = '*' AND target IS NOT NULL) AND NOT (e.language = 'go' AND EXISTS (SELECT 1 FROM plain p WHERE p.language = 'go' AND p.path <> e.path AND regexp_matches(p.code, concat('\b', e.name, '\b'))))"""

#: Braces matched by windows: a closing one belongs to the opening one before it on the same level.
_BLOCKS = (
    _with_files(fixtures.DERIVED_PROMISES)
    + """, marks AS (SELECT path, generate_subscripts(string_split(code, ''), 1) AS nth, unnest(string_split(code, '')) AS c FROM plain WHERE language <> 'python'),
placed AS (SELECT *, 1 + sum(CASE WHEN c = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY nth) AS line, sum(CASE c WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER (PARTITION BY path ORDER BY nth) AS depth FROM marks),
edges AS (SELECT path, nth, c, line, CASE WHEN c = '{' THEN depth ELSE depth + 1 END AS level FROM placed WHERE c IN ('{', '}')),
blocks AS (SELECT path, c, line, lead(line) OVER (PARTITION BY path, level ORDER BY nth) AS last FROM edges)"""
)
#: An await is guarded by a try above it of less indent that has a handler of the same indent below it.
_PROMISE_LINES = (
    _with_files(fixtures.DERIVED_PROMISES)
    + r""", l AS (SELECT path, language, code, CAST(generate_subscripts(string_split(code, chr(10)), 1) AS INT) AS line, unnest(string_split(code, chr(10))) AS text FROM plain), indented AS (SELECT *, length(regexp_extract(text, '^\s*')) AS indent FROM l),
open AS (SELECT * FROM indented a WHERE NOT EXISTS (SELECT 1 FROM indented t WHERE t.path = a.path AND t.line < a.line AND t.indent < a.indent AND regexp_matches(t.text, '^\s*try\b') AND EXISTS (SELECT 1 FROM indented h WHERE h.path = t.path AND h.line > a.line AND h.indent = t.indent AND regexp_matches(h.text, '^\s*[}]?\s*(catch|finally|except)\b')))),
awaits AS (SELECT path, line FROM open WHERE regexp_matches(text, '\bawait\b')),
bare AS (SELECT o.path, o.line, 'await of an operation that may fail outside try' AS message, 'low' AS confidence, trim(o.text) AS snippet FROM open o LEFT JOIN indented n ON n.path = o.path AND n.line = o.line + 1 WHERE regexp_matches(o.text, '\bawait\b.*\b(fetch|db)\b') AND NOT (regexp_matches(o.text, '\btx =') AND coalesce(regexp_matches(n.text, '^\s*try\b'), false))),
chains AS (SELECT path, 1 AS line, 'chain of then() without catch()' AS message, 'high' AS confidence, string_split(code, chr(10))[1] AS snippet FROM plain WHERE language = 'typescript' AND contains(code, '.then(') AND NOT contains(code, '.catch(') AND NOT contains(code, 'console.')),
futures AS (SELECT path, line, 'Future.get() outside try' AS message, 'medium' AS confidence, trim(text) AS snippet FROM open WHERE language = 'java' AND contains(text, 'future.get()'))"""
)


#: A name is known if it is, or begins with, one that is; what manifests declare is made of ``nation``.
_MODULES = (
    _with_files(fixtures.DERIVED_PACKAGES)
    + r""", l AS (SELECT path, language, CAST(generate_subscripts(string_split(code, chr(10)), 1) AS INT) AS line, unnest(string_split(code, chr(10))) AS text FROM plain),
used AS (SELECT path, language, line, CASE language WHEN 'java' THEN regexp_extract(text, '^import ([\w.]+);', 1) WHEN 'rust' THEN regexp_extract(text, '^use ([\w:]+);', 1) WHEN 'go' THEN regexp_extract(text, '^ *"([^"]+)"', 1) WHEN 'csharp' THEN regexp_extract(text, '^using ([\w.]+);', 1) ELSE regexp_extract(text, '^import ([\w.]+)$', 1) END AS module FROM l),
known(language, name) AS (SELECT * FROM (VALUES ('java', 'java.util'), ('rust', 'std'), ('go', 'net/http'), ('csharp', 'System'), ('kotlin', 'kotlin'), ('swift', 'Foundation')) v UNION ALL SELECT 'rust', concat('acme', n_nationkey) FROM nation WHERE n_nationkey < 2 UNION ALL SELECT 'go', concat('acme.org/p', n_nationkey) FROM nation WHERE n_nationkey < 2)"""
)


#: What package.json says, and whether its project has it.
_PROJECTS = (
    f"WITH f AS ({fixtures.DERIVED_PROJECTS.replace('AS STRING', 'AS VARCHAR')})"
    + r""", p AS (SELECT DISTINCT project FROM f), m AS (SELECT project, CASE WHEN json_valid(source) THEN source ELSE '{}' END AS js FROM f WHERE path = 'package.json'),
entry AS (SELECT project, 'main' AS kind, 'high' AS severity, json_extract_string(js, '$.main') AS named FROM m UNION ALL SELECT project, 'module', 'medium', json_extract_string(js, '$.module') FROM m
  UNION ALL SELECT project, 'bin', 'high', json_extract_string(js, '$.bin') FROM m WHERE json_type(js, '$.bin') = 'VARCHAR' UNION ALL SELECT project, 'bin', 'high', unnest(json_extract_string(js, ['$.bin.x', '$.bin.z'])) FROM m WHERE json_type(js, '$.bin') = 'OBJECT'),
gap AS (SELECT project, 'tsconfig.json' AS path, 'medium' AS severity, 'tsconfig.json is missing' AS message FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path = 'package.json') AND EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path LIKE '%.ts') AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path = 'tsconfig.json')
  UNION ALL SELECT project, 'package.json', 'medium', 'package.json does not say "type": "module", but scripts import' FROM m WHERE json_extract_string(js, '$.type') IS DISTINCT FROM 'module' AND EXISTS (SELECT 1 FROM f WHERE f.project = m.project AND path LIKE 'src/%.js' AND source LIKE 'import %')
  UNION ALL SELECT project, 'go.mod', 'high', 'go.mod is missing' FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path LIKE '%.go') AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path IN ('package.json', 'go.mod'))
  UNION ALL SELECT project, '.gitignore', 'low', '.gitignore is missing' FROM p WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.project = p.project AND path = '.gitignore')
  UNION ALL SELECT project, 'package.json', severity, concat('package.json names ', named, ' as ', kind, ', which does not exist') FROM entry e WHERE named IS NOT NULL AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = e.project AND (path = regexp_replace(named, '^[.]/', '') OR starts_with(path, concat(named, '/'))))
  UNION ALL SELECT project, 'package.json', 'medium', concat('dependency ', name, ' is declared and not installed') FROM (SELECT project, unnest(json_keys(js, '$.dependencies')) AS name FROM m) d WHERE EXISTS (SELECT 1 FROM f WHERE f.project = d.project AND path LIKE 'node_modules/%') AND NOT EXISTS (SELECT 1 FROM f WHERE f.project = d.project AND starts_with(path, concat('node_modules/', d.name, '/'))))"""
)


def _with_verdicts(spark, sf_dir):
    """Issues and verdicts on them: those of files whose number is a multiple of three are false, those of multiples of five get a new message."""
    found = _scan(spark, sf_dir)
    n = F.regexp_extract("path", "m([0-9]+)", 1).cast("long")
    verdict = F.when(n % 3 == 0, "false_positive").when(n % 5 == 0, "enhanced").otherwise("confirmed")
    return found, found.filter(n % 2 == 0).select("path", "line", "rule", "message", verdict.alias("verdict"), F.lit("better").alias("new_message"), F.lit(None).cast("string").alias("new_severity"))


def _judged(spark, sf_dir):
    return review.judged(*_with_verdicts(spark, sf_dir)).select("path", "line", "rule", "message", "severity", "verdict")


def _cached(spark, sf_dir):
    """Verdicts written in two runs, the older of which has run out for all it holds."""
    found = _scan(spark, sf_dir)
    n = F.regexp_extract("path", "m([0-9]+)", 1).cast("long")
    store = VerdictStore(spark, f"{shared_folder(spark)}/codequarry/verdicts-{uuid.uuid4().hex}")
    at = lambda text: F.lit(text).cast("timestamp")
    keyed = review.verdict_key(found).withColumn("n", n)
    store.put(keyed.filter("n % 3 = 0").select("key", F.lit("old").alias("value")), at("2024-01-01 00:00:00"))
    store.put(keyed.filter("n % 4 = 0").select("key", F.lit("new").alias("value")), at("2024-01-02 12:00:00"))
    store.compact(at("2024-01-02 00:00:00"))
    return review.already_judged(found, store, at("2024-01-02 13:00:00")).select("path", "line", "rule", "cached", "hit")


def _declared(spark, sf_dir):
    """In the files' folder: two crates and two modules; in another folder: all."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    at = lambda rows, folder: rows.select(F.lit(f"{folder}/Cargo.toml").alias("path"), F.lit("rust").alias("language"), F.format_string("acme%s", "n_nationkey").alias("name")).unionByName(rows.select(F.lit(f"{folder}/go.mod").alias("path"), F.lit("go").alias("language"), F.format_string("acme.org/p%s", "n_nationkey").alias("name")))
    return at(n.filter("n_nationkey < 2"), "src").unionByName(at(n, "elsewhere"))


def _graph(f):
    return lambda spark, sf_dir: f(S.derived(spark, sf_dir, fixtures.DERIVED_GRAPH))


def _promises(f):
    return lambda spark, sf_dir: f(S.derived(spark, sf_dir, fixtures.DERIVED_PROMISES))


def _found_issues(spark, sf_dir):
    return S.derived(spark, sf_dir, S.DERIVED_ISSUES, "orders")


def _flow(rule):
    return lambda spark, sf_dir: scan.issues(S.derived(spark, sf_dir, S.DERIVED_FLOW), scan.Options(only=(rule,)))


def _code_lines(spark, sf_dir):
    files = S.derived(spark, sf_dir, S.DERIVED_FLOW)
    return S.lines(files.withColumn("source", code(F.col("source"), F.col("language")))).filter(F.trim("text") != "")


def _function_rule(name):
    return lambda spark, sf_dir: scan.issues(S.derived(spark, sf_dir, S.DERIVED_FUNCTIONS), scan.Options(only=(name,)))


def _scan(spark, sf_dir, **options):
    return scan.issues(S.derived(spark, sf_dir), scan.Options(**options))


def _rule(name):
    return lambda spark, sf_dir: _scan(spark, sf_dir, only=(name,))


def _listed(spark, sf_dir):
    """Ignored: every issue of files of suppliers, and line 1 of those of nations."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("fake-url").alias("rule"), F.format_string("src/m%s.ts", F.col("s_suppkey")).alias("path"), F.lit(None).cast("int").alias("line"))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.lit("hardcoded-value").alias("rule"), F.format_string("src/m%s.ts", F.col("n_nationkey")).alias("path"), F.lit(1).alias("line"))
    return s.unionByName(n)


_LISTED = "SELECT 1 FROM supplier WHERE rule = 'fake-url' AND path = concat('src/m', s_suppkey, '.ts')"
_LISTED_1 = "SELECT 1 FROM nation WHERE rule = 'hardcoded-value' AND line = 1 AND path = concat('src/m', n_nationkey, '.ts')"


def _page_paths(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ext = F.element_at(F.array(*map(F.lit, [".py", ".d.ts", ".min.js", ".GO", ".txt", ".mjs", ".tsx"])), (F.col("page_id") % 7 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ["src", "dist", "lib/node_modules/x", "data", "app"])), (F.col("page_id") % 5 + 1).cast("int"))
    return p.select(F.concat(folder, F.lit("/p"), F.col("page_id").cast("string"), ext).alias("path"))


_PATHS = "WITH paths AS (SELECT concat(['src', 'dist', 'lib/node_modules/x', 'data', 'app'][page_id % 5 + 1], '/p', page_id, ['.py', '.d.ts', '.min.js', '.GO', '.txt', '.mjs', '.tsx'][page_id % 7 + 1]) AS path FROM pages)"


def _known(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_nationkey < 3").select(F.concat(F.lit("madeup"), F.col("n_nationkey").cast("string")).alias("name"))


def queries() -> dict:
    out = {
        "scan_issues": lambda s, d: _scan(s, d),
        "source_files": lambda s, d: S.derived(s, d),
        "source_lines": lambda s, d: S.lines(S.derived(s, d)),
        "language_detect": lambda s, d: _page_paths(s, d).select("path", S.language_of(F.col("path")).alias("language")),
        "code_files": lambda s, d: _page_paths(s, d).filter(S.scannable(F.col("path"))),
        "test_files": lambda s, d: S.derived(s, d).filter(S.is_test_file(F.col("path"))).select("path"),
        "imports": lambda s, d: file_rules.imports(S.derived(s, d)).select("path", "line", "name"),
        "structure": lambda s, d: file_rules.structure(S.derived(s, d)).select("path", "severity", "message"),
        "ignore_rules": lambda s, d: issue_filters.ignore_rules(_scan(s, d), ["security", "fake-url"]),
        "ignore_paths": lambda s, d: issue_filters.ignore_paths(_scan(s, d), ["src/*.go", "m11"]),
        "ignore_issues": lambda s, d: issue_filters.ignore_issues(_scan(s, d), _listed(s, d)),
        "min_confidence": lambda s, d: issue_filters.min_confidence(_scan(s, d), "high"),
        "strict": lambda s, d: _scan(s, d, strict=True),
        "skip_rules": lambda s, d: _scan(s, d, skip=("hardcoded-value", "resource-leak")),
        "rule_every_unused_declaration": lambda s, d: _scan(s, d, only=("unused-declaration",), every_declaration=True),
        "registry_confirm": lambda s, d: issue_filters.confirmed_by_registry(_scan(s, d), _known(s, d)),
        "statistics": lambda s, d: issue_filters.statistics(_scan(s, d)),
        "report_by_file": lambda s, d: issue_filters.by_file(_scan(s, d)),
        "code_lines": _code_lines,
        "rule_handlers": _flow("swallowed-error"),
        "rule_unreachable_code": _flow("unreachable-code"),
        "known_false": lambda s, d: known_false.with_reason(_found_issues(s, d)),
        "prefilter": lambda s, d: known_false.prefiltered(_found_issues(s, d)),
        "removals_by_rule": lambda s, d: known_false.removals_by_rule(_found_issues(s, d)),
        "json_report": lambda s, d: issue_filters.as_json(_scan(s, d)),
        "declared_packages": lambda s, d: manifests.declared(S.derived(s, d, manifests.DERIVED_MANIFESTS, "orders")),
        "review_eligible": lambda s, d: review.eligible(_scan(s, d)),
        "review_portions": lambda s, d: review.portion_rules(_found_issues(s, d).withColumns({"severity": F.lit("high"), "line": F.col("id")}), 25),
    }
    out |= {
        "review_judged": _judged,
        "review_cached": _cached,
        "review_context": lambda s, d: review.with_context(_scan(s, d), S.derived(s, d)).select("path", "line", "rule", "context"),
        "report_lines": lambda s, d: review.report_lines(_scan(s, d)),
        "project_gaps": lambda s, d: projects.gaps(S.derived(s, d, fixtures.DERIVED_PROJECTS)),
        "package_imports": lambda s, d: packages.package_imports(S.derived(s, d, fixtures.DERIVED_PACKAGES)),
        "unknown_modules": lambda s, d: packages.unknown_modules(S.derived(s, d, fixtures.DERIVED_PACKAGES), _declared(s, d)),
        "resolved_imports": _graph(lambda f: symbols.resolved_imports(f).select("path", "source", "name", "local", "target")),
        "project_symbols": _graph(lambda f: symbols.symbols(f).filter("exported").select("path", "name", "line")),
        "symbol_references": _graph(lambda f: symbols.symbol_references(f).select("path", "name", "line", "from_path")),
        "reference_counts": _graph(lambda f: symbols.reference_counts(f).filter("exported").select("path", "name", F.col("n").cast("long").alias("n"))),
        "module_index": _graph(symbols.module_index),
        "graph_dead_code": _graph(symbols.dead_code),
        "code_blocks": _promises(lambda f: syntax.ast_nodes(f).filter("node > 0 and language <> 'python'").select("path", "line", F.col("end").alias("last"))),
        "awaits_outside_try": _promises(lambda f: promise_rules.awaits_outside_try(f)),
        "rule_unhandled_promise": _promises(lambda f: scan.issues(f, scan.Options(only=("unhandled-promise",)))),
        "py_functions": lambda s, d: python_tree.py_functions(S.derived(s, d, S.DERIVED_FUNCTIONS)).select("path", "name", "line", "statements", F.col("only").alias("single")),
        "py_handlers": lambda s, d: python_tree.py_handlers(S.derived(s, d, S.DERIVED_FLOW)).select("path", "line", "type", "statements", "swallowed"),
    }
    out |= {f"rule_{name.replace('-', '_')}": _function_rule(name) for name in _SQL_FUNCTION_RULES}
    return out | {f"rule_{name.replace('-', '_')}": _rule(name) for name in _SQL_RULES}


def oracle_sql() -> dict[str, str]:
    of = lambda tail: f"{_ISSUES} {tail}"
    count = lambda kind: f"SELECT '{kind}' AS kind, {kind} AS value, count(*) AS n FROM issues GROUP BY {kind}"
    lang = "CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%js' THEN 'javascript' WHEN path LIKE '%.GO' THEN 'go' ELSE 'unknown' END"
    out = {
        "scan_issues": of("SELECT * FROM issues"),
        "source_files": f"{_FILES} SELECT * FROM source_files",
        "source_lines": f"{_LINES.replace(chr(39) + '%/tests/%' + chr(39), chr(39) * 2)} SELECT path, language, line, text FROM lines",
        "language_detect": f"{_PATHS} SELECT path, {lang} AS language FROM paths",
        "code_files": f"{_PATHS} SELECT path FROM paths WHERE (path LIKE '%.py' OR path LIKE '%.GO' OR path LIKE '%.tsx') AND (path LIKE 'src/%' OR path LIKE 'app/%')",
        "test_files": f"{_FILES} SELECT path FROM source_files WHERE path LIKE '%/tests/%'",
        "imports": f"{_LINES} SELECT path, line, substr(text, 8) AS name FROM lines WHERE text LIKE 'import %'",
        "structure": "SELECT * FROM (VALUES ('tsconfig.json', 'medium', 'tsconfig.json is missing', 0), ('requirements.txt', 'medium', 'no list of dependencies', 1), ('go.mod', 'high', 'go.mod is missing', 1), ('Cargo.toml', 'high', 'Cargo.toml is missing', 1), ('.gitignore', 'low', '.gitignore is missing', 1)) v(path, severity, message, ok) WHERE ok = 1",
        "ignore_rules": of("SELECT * FROM issues WHERE rule NOT IN ('security', 'fake-url')"),
        "ignore_paths": of("SELECT * FROM issues WHERE NOT (path LIKE 'src/%.go' OR path LIKE '%m11%')"),
        "ignore_issues": of(f"SELECT * FROM issues WHERE NOT EXISTS ({_LISTED}) AND NOT EXISTS ({_LISTED_1})"),
        "min_confidence": of("SELECT * FROM issues WHERE confidence = 'high'"),
        "strict": of("SELECT * FROM issues WHERE severity NOT IN ('low', 'info')"),
        "skip_rules": of("SELECT * FROM issues WHERE rule NOT IN ('hardcoded-value', 'resource-leak')"),
        "registry_confirm": of("SELECT * FROM issues WHERE NOT (rule = 'package-hallucination' AND right(snippet, 7) IN ('madeup0', 'madeup1', 'madeup2'))"),
        "statistics": of(f"{count('severity')} UNION ALL {count('confidence')} UNION ALL {count('category')} UNION ALL SELECT 'total', '', count(*) FROM issues"),
        "json_report": of(f"SELECT CAST(to_json({{{', '.join(repr(c) + ': ' + c for c in line_rules.ISSUE)}}}) AS VARCHAR) AS json FROM issues"),
        "report_by_file": of(f"SELECT path, count(*) AS n, CAST(min({_RANK}) AS INT) AS worst, min(line) AS first_line FROM issues GROUP BY path"),
    }
    out["code_lines"] = f"{_LINES.replace(_FILES, _FLOW_FILES).replace(chr(39) + '%/tests/%' + chr(39), chr(39) * 2)} SELECT path, language, line, text FROM lines WHERE NOT regexp_matches(text, '^(//|#)') AND trim(text) <> ''"
    out["rule_handlers"] = f"{_FLOW_LINES} {_SQL_FLOW['handlers']}"
    out["rule_unreachable_code"] = f"{_FLOW_LINES} {_SQL_FLOW['after_return']}"
    out["known_false"] = f"{_ISSUE_ROWS} SELECT *, {_KNOWN_FALSE} AS known_false FROM found"
    out["prefilter"] = f"{_ISSUE_ROWS} SELECT * FROM found WHERE {_KNOWN_FALSE} IS NULL"
    out["removals_by_rule"] = f"{_ISSUE_ROWS} SELECT rule, count(*) AS n FROM found WHERE {_KNOWN_FALSE} IS NOT NULL GROUP BY rule"
    out["declared_packages"] = f"{_MANIFESTS} SELECT DISTINCT path, language, name FROM named WHERE name <> ''"
    out["review_eligible"] = of(f"SELECT * FROM issues WHERE {_REVIEWED}")
    out["review_portions"] = f"{_ISSUE_ROWS}, placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY path ORDER BY id) - 1) // 25 AS INT) AS portion FROM found) SELECT path, portion, count(*) AS n, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM placed GROUP BY path, portion"
    where = "(language = 'python' AND regexp_matches(text, '^[a-z]+ =') AND NOT text LIKE 'f = %') OR regexp_matches(text, '^(const|let) [a-z] =') OR text LIKE 'import madeup%'"
    out["rule_every_unused_declaration"] = f"{_LINES} {_issue('unused-declaration', 'quality', 'low', 'medium', 'declaration is not used', where)}"
    out["project_gaps"] = f"{_PROJECTS} SELECT project, path, severity, message FROM gap"
    number = "CAST(regexp_extract(path, 'm([0-9]+)', 1) AS BIGINT)"
    out["review_judged"] = of(f"SELECT path, line, rule, CASE WHEN {number} % 10 = 0 THEN 'better' ELSE message END AS message, severity, CASE WHEN {number} % 2 = 1 THEN NULL WHEN {number} % 5 = 0 THEN 'enhanced' ELSE 'confirmed' END AS verdict FROM issues WHERE {number} % 6 <> 0")
    out["review_cached"] = of(f"SELECT path, line, rule, CASE WHEN {number} % 4 = 0 THEN 'new' END AS cached, {number} % 4 = 0 AS hit FROM issues")
    near = " ".join(f"WHEN '{r}' THEN {k}" for r, k in review.AROUND_RULE.items())
    worse = " ".join(f"WHEN '{r}' THEN {k}" for r, k in review.AROUND_SEVERITY.items())
    out["review_context"] = f"{_ISSUES}, sized AS (SELECT row_number() OVER () AS id, path, line, rule, CASE rule {near} ELSE CASE severity {worse} ELSE {review.AROUND} END END AS k FROM issues) SELECT s.path, s.line, s.rule, string_agg(concat(CASE WHEN l.line = s.line THEN '>>> ' ELSE '    ' END, l.line, '| ', l.text), chr(10) ORDER BY l.line) AS context FROM sized s JOIN lines l ON l.path = s.path AND abs(l.line - s.line) <= s.k GROUP BY s.id, s.path, s.line, s.rule"
    out["report_lines"] = of("SELECT path, line, concat(path, ':', line, '  [', upper(severity), ']  ', message) AS text FROM issues")
    out["package_imports"] = f"{_MODULES} SELECT path, language, line, module FROM used WHERE module <> ''"
    out["unknown_modules"] = f"{_MODULES} SELECT path, language, line, module FROM used u WHERE module <> '' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.language = u.language AND (module = k.name OR starts_with(module, concat(k.name, CASE k.language WHEN 'rust' THEN '::' WHEN 'go' THEN '/' ELSE '.' END))))"
    out["resolved_imports"] = f"{_GRAPH} SELECT path, source, name, local, target FROM resolved"
    out["project_symbols"] = f"{_GRAPH} SELECT path, name, line FROM exported"
    out["symbol_references"] = f"{_GRAPH} SELECT e.path, e.name, e.line, n.from_path FROM exported e JOIN named n ON n.path = e.path AND n.name = e.name"
    out["reference_counts"] = f"{_GRAPH} SELECT e.path, e.name, count(n.from_path) AS n FROM exported e LEFT JOIN named n ON n.path = e.path AND n.name = e.name GROUP BY ALL"
    out["module_index"] = f"{_GRAPH} SELECT regexp_extract(path, '([^/.]+)[.][a-z]+$', 1) AS module, path FROM plain UNION SELECT replace(regexp_replace(path, '[.][a-z]+$', ''), '/', '.'), path FROM plain"
    out["graph_dead_code"] = f"{_GRAPH} {_DEAD}"
    out["code_blocks"] = f"{_BLOCKS} SELECT path, CAST(line AS INT) AS line, CAST(last AS INT) AS last FROM blocks WHERE c = '{{'"
    out["awaits_outside_try"] = f"{_PROMISE_LINES} SELECT path, line FROM awaits"
    out["rule_unhandled_promise"] = f"{_PROMISE_LINES} SELECT path, line, 'unhandled-promise' AS rule, 'medium' AS severity, confidence, 'ai-code' AS category, message, snippet FROM (SELECT * FROM bare UNION ALL SELECT * FROM chains UNION ALL SELECT * FROM futures)"
    python = "language = 'python' AND path LIKE"
    out["py_functions"] = f"{_FUNCTION_LINES.replace('NOT LIKE', 'NOT LIKE concat(' + repr('!') + ', path) OR path LIKE')} SELECT path, regexp_extract(text, '^def (\\w+)', 1) AS name, line, CASE WHEN contains(text, 'def step') THEN 0 ELSE 1 END AS statements, CASE WHEN contains(text, 'def step') THEN '' ELSE 'return True' END AS single FROM lines WHERE language = 'python' AND text LIKE 'def %'"
    out["py_handlers"] = f"{_FLOW_FILES}, l AS (SELECT path, language, CAST(generate_subscripts(string_split(source, chr(10)), 1) AS INT) AS line, unnest(string_split(source, chr(10))) AS text FROM source_files), n AS (SELECT *, lead(text) OVER (PARTITION BY path ORDER BY line) AS a, lead(text, 2) OVER (PARTITION BY path ORDER BY line) AS b FROM l) SELECT path, line, regexp_extract(text, '^except (\\w+)', 1) AS type, CASE WHEN b LIKE ' %' THEN 2 ELSE 1 END AS statements, a LIKE '%pass' AND NOT b LIKE ' %' AS swallowed FROM n WHERE language = 'python' AND text LIKE 'except %'"
    out["structure"] = out["structure"].replace("SELECT *", "SELECT path, severity, message")
    out |= {f"rule_{name.replace('-', '_')}": f"{_FUNCTION_LINES} {' UNION ALL '.join(parts)}" for name, parts in _SQL_FUNCTION_RULES.items()}
    return out | {f"rule_{name.replace('-', '_')}": f"{_LINES} {' UNION ALL '.join(parts)}" for name, parts in _SQL_RULES.items()}
