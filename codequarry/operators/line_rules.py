"""Rules that judge single lines: one pass over all lines, all rules at once, no shuffle.

A line is seen three ways: as it is, without comments, and without what strings
hold too. Rules about values look at the second, rules about calls at the third,
so a call in a string or in a comment is none.

A null source has no lines and so no issues; equal files give equal issues each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.functions.lexer import code
from codequarry.sources.source_files import is_test_file

ISSUE = ("path", "line", "rule", "severity", "confidence", "category", "message", "snippet")


@dataclass(frozen=True)
class LineRule:
    """Reports each match of ``pattern`` in lines of ``languages`` (all if empty) that match all of ``also`` and not ``unless``."""

    rule: str
    category: str
    severity: str
    confidence: str
    message: str
    pattern: str
    languages: tuple[str, ...] = ()
    unless: str = ""
    path_unless: str = ""
    also: tuple[str, ...] = ()
    over: str = "code"  # or "raw", "bare"

    def hits(self) -> Column:
        text = F.col(self.over)
        ok = text.rlike(self.pattern)
        if self.languages:
            ok = F.col("language").isin(*self.languages) & ok
        for pattern in self.also:
            ok = ok & F.col("code").rlike(pattern)
        if self.unless:
            ok = ok & ~F.col("code").rlike(self.unless)
        if self.path_unless:
            ok = ok & ~F.col("path").rlike(self.path_unless)
        row = [F.lit(x).alias(n) for n, x in zip(("rule", "severity", "confidence", "category", "message"), (self.rule, self.severity, self.confidence, self.category, self.message))]
        found = F.transform(F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0)), lambda _: F.struct(*row))
        return F.when(ok, found).otherwise(F.slice(F.array(F.struct(*row)), 1, 0))


JS = ("javascript", "typescript")
PLACEHOLDER = r"(?i)your|example|placeholder|changeme|xxx|dummy|process\.env|os\.environ"
# API hosts that exist.
KNOWN_HOSTS = [
    "github", "openai", "anthropic", "google", "stripe", "cloudflare", "aws", "azure", "firebase", "vercel", "deepseek", "zhipu", "baidu", "aliyun", "tencent",
    "moonshot", "minimax", "baichuan", "baichuan-ai", "spark", "doubao", "qwen", "cohere", "mistral", "huggingface", "replicate", "stability", "perplexity", "groq",
    "together", "ollama", "siliconflow", "stepfun", "lingyiwanwu", "bigmodel", "baidubce", "dashscope", "aliyuncs", "weixin", "ilinkai", "example",
]
#: Folders and files that are there to hold values, as whole words of a path.
CONFIG_PATH = r"(?i)(?:^|[/_.-])(?:presets?|configs?|configuration|constants?|settings|ssrf|(?:allow|block|black|white)-?_?lists?)(?=[/_.-]|$)"
#: A text in which something is put together: a template, or a string that goes on with an operator.
PUT_TOGETHER = r"""(?:\bf["'][^"']*\{|`[^`]*\$\{|["']\s*(?:\+|%(?!\d)|\.\s*format\b))"""
SQL_TEXT = r"""(?i)["'`]\s*(?:select|insert|update|delete|replace|drop|create|alter|truncate|with)\s"""
MIGRATIONS = r"(?i)migrat|schema|fixture|seed"

RULES = (
    LineRule("fake-url", "hallucination", "medium", "high", "API URL of an unknown host", rf"(?i)https?://api\.(?!(?:{'|'.join(KNOWN_HOSTS)})\.)[a-z0-9-]+\.[a-z]{{2,}}(?:\.[a-z]{{2,}})?/\S*", over="raw"),
    LineRule("hardcoded-value", "quality", "medium", "medium", "hard-coded URL", r"""['"`]https?://(?!example|localhost|docs|www\.w3|schema)[^'"`{}\s]+['"`]""", unless=r"https?://(?:[a-z]+\.)?(?:github|gitlab|google|openai|npmjs|pypi|unpkg|jsdelivr)\.", path_unless=CONFIG_PATH),
    LineRule("hardcoded-value", "quality", "medium", "medium", "hard-coded IP address", r"""['"`](?!127\.0\.0\.1|0\.0\.0\.0|255\.255\.255\.255|169\.254\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}['"`]""", path_unless=CONFIG_PATH),
    LineRule("hardcoded-value", "quality", "medium", "medium", "hard-coded port", r"(?:localhost|127\.0\.0\.1|0\.0\.0\.0):(?:3306|5432|6379|27017|9200|5672|8080|3000|5000)\b", unless=r"process\.env.*\|\|", path_unless=CONFIG_PATH),
    LineRule("hardcoded-value", "quality", "low", "low", "hard-coded path", r"""['"`](?:/(?:usr|var|etc|opt|home)/[^'"`\s]+|C:\\Users[^'"`]*)['"`]""", path_unless=CONFIG_PATH),
    LineRule("security", "security", "high", "medium", "OpenAI API key in the source", r"""['"`]sk-[a-zA-Z0-9]{20,}['"`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "GitHub token in the source", r"""['"`]gh[po]_[a-zA-Z0-9]{36}['"`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "AWS access key in the source", r"""['"`]AKIA[A-Z0-9]{16}['"`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "Google API key in the source", r"""['"`]AIza[a-zA-Z0-9_-]{35}['"`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "secret in the source", r"""(?i)\b\w*(?:secret|token|credential|(?:api|access|auth|private)[_-]?key)\w*["']?\s*(?::=|[:=])\s*["'`][^"'`\s]{8,}["'`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "password in the source", r"""(?i)\b\w*(?:passw(?:or)?d|passphrase|pwd)\w*["']?\s*(?::=|[:=])\s*["'`][^"'`\s]{3,}["'`]""", unless=PLACEHOLDER),
    LineRule("security", "security", "high", "medium", "SQL built from parts", r"\.(?:execute\w*|query|raw)\s*\(", path_unless=MIGRATIONS, also=(SQL_TEXT, PUT_TOGETHER), over="bare"),
    LineRule("security", "security", "low", "medium", "innerHTML set directly", r"""\.innerHTML\s*=(?!=)""", JS, unless=r"(?i)sanitize|escape|purify|xss\s*\(", over="bare"),
    LineRule("security", "security", "low", "medium", "document.write", r"document\.write\s*\(", JS, unless=r"(?i)sanitize|escape|purify", over="bare"),
    LineRule("security", "security", "high", "medium", "dangerouslySetInnerHTML", r"dangerouslySetInnerHTML\s*=\s*\{", JS, unless=r"(?i)sanitize|purify", over="bare"),
    LineRule("security", "security", "high", "medium", "shell command built from parts", r"\b(?:os\s*\.\s*(?:system|popen)|subprocess\s*\.\s*\w+)\s*\(", ("python",), also=(PUT_TOGETHER,), over="bare"),
    LineRule("security", "security", "high", "medium", "shell command built from parts", r"(?<![.\w])(?:child_process\s*\.\s*)?(?:exec|spawn)\w*\s*\(", JS, also=(PUT_TOGETHER,), over="bare"),
    LineRule("security", "security", "critical", "medium", "eval of untrusted input", r"(?<![A-Za-z0-9_.])eval\s*\(\s*(?:user|req|request|input|params|query|body)\w*", ("python", *JS), over="bare"),
    LineRule("security", "security", "medium", "medium", "eval", r"(?<![A-Za-z0-9_.])(?:eval|exec)\s*\((?!\s*(?:user|req|request|input|params|query|body))", ("python",), over="bare"),
    LineRule("security", "security", "medium", "medium", "eval", r"(?<![A-Za-z0-9_.])(?:eval\s*\(|new\s+Function\s*\()(?!\s*(?:user|req|request|input|params|query|body))", JS, over="bare"),
    LineRule("security", "security", "medium", "medium", "unencrypted HTTP", r"""['"`]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|www\.w3\.org)[^'"`{$\s]+['"`]"""),
    LineRule("security", "security", "critical", "medium", "yaml.load without a loader", r"yaml\.load\s*\((?!.*Loader)", ("python",), over="bare"),
    LineRule("security", "security", "critical", "medium", "pickle.loads of untrusted input", r"pickle\.loads?\s*\(\s*(?:user|req|request|input|data)\w*", ("python",), over="bare"),
    LineRule("swallowed-error", "ai-code", "high", "medium", "error result discarded", r",\s*_\s*:=", ("go",), over="bare"),
    LineRule("swallowed-error", "ai-code", "medium", "medium", "unwrap() may panic", r"\.unwrap\(\)", ("rust",), over="bare"),
    LineRule("swallowed-error", "ai-code", "high", "medium", "result ignored", r"""\blet\s+_\s*=(?!\s*['"0-9])""", ("rust",)),
    LineRule("swallowed-error", "ai-code", "high", "medium", "rescue without handling", r"\brescue\s+(?:nil|false|null)\s*$", ("ruby",), over="bare"),
    LineRule("unreachable-code", "correctness", "low", "medium", "condition is constant", r"\b(?:if|while)\s*\(?\s*(?:false|False|0)\s*\)?\s*[:{]", over="bare"),
    LineRule("unreachable-code", "correctness", "low", "medium", "value compared with itself", r"\bif\b.*(?<![\w.])(\w+)\s*={2,3}\s*\1(?![\w.(])", over="bare"),
    LineRule("unhandled-promise", "ai-code", "medium", "medium", "promise not awaited", r"^\s*(?:fetch|\w+Async)\s*\(", JS, unless=r"\bawait\b|\.catch\(|\bvoid\b|return ", over="bare"),
    LineRule("unhandled-promise", "ai-code", "medium", "medium", "future without handler", r"CompletableFuture\.(?:supply|run)Async\(", ("java",), unless=r"exceptionally|handle\(", over="bare"),
)

# Calls that do not exist, by language.
UNKNOWN_CALLS = {
    "python": [
        r"os\.path\.join\([^)]*encoding\s*=", r"requests\.(?:post|get|put|delete|patch)\([^)]*verify_cert\s*=", r"subprocess\.run\([^)]*text_mode\s*=",
        r"\.removeprefix\([^)]*start\s*=", r"iterrows\(\)\.apply\(", r"\.tolist\([^)]*dtype\s*=", r"asyncio\.run\([^)]*loop\s*=", r"Path\.mkdir\([^)]*recursive\s*=",
        r"torch\.cuda\.is_available\(\)\.device\(", r"np\.array\.flatten\(\s*axis\s*=", r"cv2\.imshow\([^)]*block\s*=", r"fastapi\.FastAPI\.run\(",
    ],
    "typescript": [
        r"\.last\(\)", r"Object\.map\(", r"classList\.contains\([^)]+\)\.toggle\(", r"JSON\.parse\([^)]+\)\.stringify\(\)", r"\.unique\(\)",
        r"Map\.prototype\.map\(", r"process\.env\.set\(", r"Object\.deepCopy\(", r"String\.format\(", r"Array\.range\(", r"Math\.randomInt\(", r"useEffect\(\s*async\s",
    ],
    "go": [r"context\.withTimeout", r"fmt\.Sprintf\([^)]+\)\.Print\(\)", r"context\.Background\(\)\.WithValue\(", r"json\.Marshal\([^)]*indent\s*="],
    "java": [r"\.isEmptyOrNull\(\)", r"List\.of\([^)]*\)\.add\(", r"\.toList\(\)\.add\("],
    "rust": [r"Vec::new\(\s*\w+\s*\)", r"Vec::new\(\)\.push\(", r"HashMap::new\(\)\.insert\("],
}
RULES += tuple(
    LineRule("api-hallucination", "hallucination", "high", "high", "call of an API that does not exist", p, JS if language == "typescript" else (language,), over="bare")
    for language, patterns in UNKNOWN_CALLS.items()
    for p in patterns
)


def line_issues(files: DataFrame, only: tuple[str, ...] = (), skip: tuple[str, ...] = ()) -> DataFrame:
    """One row per match; test files are left out before their lines are made."""
    rules = [r for r in RULES if (r.rule in only if only else r.rule not in skip)]
    live = files.filter(~is_test_file(F.col("path"))).select("path", "language", "source", code(F.col("source"), F.col("language")).alias("code"), code(F.col("source"), F.col("language"), True).alias("bare"))
    cut = lambda c: F.split(c, "\n", -1)
    rows = live.select("path", "language", F.posexplode(F.arrays_zip(cut("source").alias("raw"), cut("code").alias("code"), cut("bare").alias("bare"))).alias("at", "x"))
    rows = rows.select("path", "language", (F.col("at") + 1).alias("line"), "x.raw", "x.code", "x.bare")
    found = rows.select("path", "line", F.regexp_replace("raw", r"^\s+|\s+$", "").alias("snippet"), F.explode(F.flatten(F.array(*[r.hits() for r in rules]))).alias("x"))
    return found.select("path", "line", *[F.col(f"x.{n}").alias(n) for n in ISSUE[2:7]], "snippet")
