"""Source trees as a table: source_files(path, language, source) and its lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".go": "go", ".java": "java", ".rs": "rust", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".h": "c",
    ".hpp": "cpp", ".hh": "cpp", ".kt": "kotlin", ".kts": "kotlin", ".swift": "swift", ".cs": "csharp",
}
#: Scripts of these two extensions have a language but are not scanned.
UNSCANNED = {".mjs", ".cjs"}
# Folders left out.
IGNORED_FOLDERS = [
    "node_modules", ".git", "dist", "build", ".next", ".nuxt", "coverage", ".cache", ".codegraph", ".aide", "target", "vendor", "pods", "carthage",
    "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "_archive", "data", "constants",
]
BUILT = r"(?:\.(?:min|bundle|chunk)\.(?:js|css|mjs)|\.d\.ts|\.generated\.(?:ts|js|mjs)|\.map)$"
TEST_FILE = (
    r"\.(?:test|spec)\.(?:ts|js|jsx|tsx|py|go|rs|java|rb|php|c|cpp|cs|kt|swift)$"
    r"|(?:^|[/_])(?:test|spec)[_/]|_test\.(?:go|py)$|__tests__/|[\\/]tests?[\\/]"
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_FILE)


def in_ignored_folder(path: Column, more: tuple[str, ...] = ()) -> Column:
    """Whether a folder of the path is left out; a name with a slash counts from the root only."""
    anywhere = [n for n in [*IGNORED_FOLDERS, *more] if "/" not in n]
    out = F.arrays_overlap(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), F.array(*map(F.lit, anywhere)))
    for n in more:
        if "/" in n:
            out = out | path.startswith(n.rstrip("/") + "/")
    return out


def scannable(path: Column, more: tuple[str, ...] = ()) -> Column:
    return extension(path).isin(sorted(set(LANGUAGES) - UNSCANNED)) & ~path.rlike(BUILT) & ~in_ignored_folder(path, more)


def scan(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), language, source of the code files of a tree; unreadable files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(root)
    below = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    prefix = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.when(below.startswith(prefix), F.substring(below, len(prefix) + 1, 1 << 20)).otherwise(below)
    return files.withColumn("path", path).filter(scannable(F.col("path"), ignore)).select("path", language_of(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("source"))


def lines(files: DataFrame) -> DataFrame:
    """path, language, line (from 1), text; null sources have no lines."""
    return files.select("path", "language", F.posexplode(F.split("source", "\n", -1)).alias("at", "text")).select("path", "language", (F.col("at") + 1).alias("line"), "text")


#: Source files spliced from ``documents``, in SQL that both engines read. Each of twelve kinds has
#: a good or a bad line; the sixth part lies in test folders.
DERIVED = """
SELECT concat(CASE WHEN doc_id % 24 >= 20 THEN 'pkg/tests/m' ELSE 'src/m' END, CAST(doc_id AS STRING),
  CASE doc_id % 12 WHEN 0 THEN '.ts' WHEN 1 THEN '.ts' WHEN 4 THEN '.js' WHEN 7 THEN '.ts' WHEN 8 THEN '.go' WHEN 9 THEN '.rs' ELSE '.py' END) AS path,
  CASE doc_id % 12 WHEN 0 THEN 'typescript' WHEN 1 THEN 'typescript' WHEN 4 THEN 'javascript' WHEN 7 THEN 'typescript' WHEN 8 THEN 'go' WHEN 9 THEN 'rust' ELSE 'python' END AS language,
  concat(CASE doc_id % 12
    WHEN 0 THEN concat('const u = "https://api.acme', CAST(doc_id % 50 AS STRING), '.com/v1/users"')
    WHEN 1 THEN 'const u = "https://api.github.com/v1/users"'
    WHEN 2 THEN 'x = eval(user_input)'
    WHEN 3 THEN concat('host = "10.0.0.', CAST(doc_id % 250 AS STRING), '"')
    WHEN 4 THEN concat('const t = "ghp_', 'abcdefghijklmnopqrstuvwxyz0123456789', '"')
    WHEN 5 THEN concat('f = open(path)', chr(10), 'x = f.read()')
    WHEN 6 THEN concat('f = open(path)', chr(10), 'x = f.read()', chr(10), 'f.close()')
    WHEN 7 THEN 'const y = Object.map(items, fn)'
    WHEN 8 THEN concat('v, _ := strconv.Atoi(s)', chr(10), 'use(v)')
    WHEN 9 THEN 'let x = y.unwrap()'
    WHEN 10 THEN '# eval(user_input) is left out here'
    ELSE concat('import os', chr(10), 'import madeup', CAST(doc_id % 5 AS STRING), chr(10), 'import requests', chr(10), 'requests.get(os.name)') END,
    chr(10), 'n = ', CAST(n_chars AS STRING), chr(10)) AS source
FROM documents
"""

#: As DERIVED, with functions, comments and exports of eight kinds.
DERIVED_FUNCTIONS = """
SELECT concat(CASE WHEN doc_id % 40 >= 32 THEN 'pkg/tests/m' ELSE 'src/m' END, CAST(doc_id AS STRING),
  CASE doc_id % 8 WHEN 0 THEN '.ts' WHEN 1 THEN '.ts' WHEN 4 THEN '.go' WHEN 5 THEN '.js' WHEN 6 THEN '.js' ELSE '.py' END) AS path,
  CASE doc_id % 8 WHEN 0 THEN 'typescript' WHEN 1 THEN 'typescript' WHEN 4 THEN 'go' WHEN 5 THEN 'javascript' WHEN 6 THEN 'javascript' ELSE 'python' END AS language,
  concat('', chr(10), CASE doc_id % 8
    WHEN 0 THEN concat('export function part', CAST(doc_id AS STRING), '() {', chr(10), '  return null;', chr(10), '}')
    WHEN 1 THEN concat('import { part', CAST(doc_id - doc_id % 16 AS STRING), ' } from "./m"')
    WHEN 2 THEN concat('def is_ready', CAST(doc_id AS STRING), '(x):', chr(10), '    return True')
    WHEN 3 THEN concat('def step', CAST(doc_id AS STRING), '(x):', chr(10), '    pass')
    WHEN 4 THEN concat('func Work', CAST(doc_id AS STRING), '(x int) {', chr(10), '}')
    WHEN 5 THEN concat('function check', CAST(doc_id AS STRING), '(data) {', chr(10), '  if (!data) return null;', chr(10), '  return data;', chr(10), '}')
    WHEN 6 THEN concat('function check', CAST(doc_id AS STRING), '(data) {', chr(10), '  if (!data) return null;', chr(10), '  if (typeof data === "string") { return data; }', chr(10), '}')
    ELSE concat('# create the counter', chr(10), CASE WHEN doc_id % 16 = 7 THEN 'counter = ' ELSE 'n = ' END, CAST(n_chars AS STRING)) END, chr(10)) AS source
FROM documents
"""


#: Handlers and returns of ten kinds; every file ends with a whole text as comment lines, which no rule may look into.
DERIVED_FLOW = """
SELECT concat(CASE WHEN doc_id % 40 >= 35 THEN 'pkg/tests/m' ELSE 'src/m' END, CAST(doc_id AS STRING),
  CASE doc_id % 10 WHEN 2 THEN '.py' WHEN 3 THEN '.py' WHEN 8 THEN '.py' WHEN 4 THEN '.java' WHEN 5 THEN '.go' WHEN 9 THEN '.php' ELSE '.ts' END) AS path,
  CASE doc_id % 10 WHEN 2 THEN 'python' WHEN 3 THEN 'python' WHEN 8 THEN 'python' WHEN 4 THEN 'java' WHEN 5 THEN 'go' WHEN 9 THEN 'php' ELSE 'typescript' END AS language,
  concat(CASE doc_id % 10
    WHEN 0 THEN concat('try { f(); } catch (e) {', chr(10), '}')
    WHEN 1 THEN 'try { f(); } catch (e) { console.error("no f", e); }'
    WHEN 2 THEN concat('try:', chr(10), '    f()', chr(10), 'except ValueError:', chr(10), '    pass')
    WHEN 3 THEN concat('try:', chr(10), '    f()', chr(10), 'except ValueError:', chr(10), '    pass', chr(10), '    g()', chr(10), 's = "except KeyError: pass"')
    WHEN 4 THEN concat('try { f(); }', chr(10), 'catch (Exception e) { e.printStackTrace(); }')
    WHEN 5 THEN concat('if err != nil {', chr(10), chr(9), 'log.Println(err)', chr(10), '}')
    WHEN 6 THEN concat('function g(x) {', chr(10), '  return x;', chr(10), '  show(x);', chr(10), '}')
    WHEN 7 THEN concat('function g(x) {', chr(10), '  return [', chr(10), '  x];', chr(10), '}', chr(10), 'h = "// return 1;"')
    WHEN 8 THEN concat('def g(x):', chr(10), '    raise x', chr(10), '    y = 1', chr(10), '    z = 2')
    ELSE concat('try { f(); } catch (E $e) { echo "x"; }') END,
    chr(10), CASE WHEN doc_id % 10 IN (2, 3, 8) THEN '# ' ELSE '// ' END,
    replace(replace(coalesce(text, ''), chr(13), ' '), chr(10), concat(chr(10), CASE WHEN doc_id % 10 IN (2, 3, 8) THEN '# ' ELSE '// ' END)), chr(10)) AS source
FROM documents
"""

#: Issues for the tests of known false alarms, spliced from ``orders``: messages, snippets and paths that hit and miss.
DERIVED_ISSUES = """
SELECT o_orderkey AS id,
  CASE o_orderkey % 9 WHEN 0 THEN 'stub-function' WHEN 1 THEN 'empty-impl' WHEN 2 THEN 'unused-declaration' WHEN 3 THEN 'security' WHEN 4 THEN 'hardcoded-value'
    WHEN 5 THEN 'unreachable-code' WHEN 6 THEN 'fake-url' WHEN 7 THEN 'package-hallucination' ELSE 'resource-leak' END AS rule,
  CASE o_orderkey % 9 WHEN 0 THEN concat('body of ', CASE WHEN o_custkey % 2 = 0 THEN 'isOpen' ELSE 'total' END, ' only gives: return true') WHEN 1 THEN concat(CASE WHEN o_custkey % 2 = 0 THEN '__init__' ELSE 'work' END, ' is bare')
    WHEN 3 THEN concat('plain http to ', CASE WHEN o_custkey % 3 = 0 THEN 'localhost' ELSE 'host' END) WHEN 4 THEN 'fixed URL' ELSE concat('seen ', o_orderstatus) END AS message,
  CASE o_orderkey % 9 WHEN 2 THEN CASE WHEN o_custkey % 2 = 0 THEN 'export const a = 1' ELSE 'const a = 1' END WHEN 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'const BASE_URL = x' ELSE 'let a = x' END
    WHEN 5 THEN CASE WHEN o_custkey % 2 = 0 THEN 'case 3:' ELSE 'f()' END WHEN 6 THEN CASE WHEN o_custkey % 2 = 0 THEN 'let DB_HOST = x' ELSE 'let a = x' END
    WHEN 8 THEN CASE WHEN o_custkey % 3 = 0 THEN 'with open(f)' WHEN o_custkey % 3 = 1 THEN 'defer f.Close()' ELSE 'open(f)' END ELSE 'a()' END AS snippet,
  CASE o_orderkey % 9 WHEN 4 THEN CASE WHEN o_custkey % 5 = 0 THEN 'src/config/a.ts' ELSE 'src/a.ts' END WHEN 7 THEN CASE WHEN o_custkey % 2 = 0 THEN 'x/node_modules/y/a.js' ELSE 'src/a.js' END ELSE 'src/b.ts' END AS path
FROM documents
"""


def derived(spark: SparkSession, sf_dir: str, sql: str = DERIVED, table: str = "documents") -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), documents=spark.read.parquet(f"{sf_dir}/{table}.parquet"))
