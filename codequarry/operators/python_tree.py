"""Python's own syntax tree of source files: functions and handlers as rows.

``ast.parse`` runs inside the tasks, file by file in Arrow batches; nothing is
imported or executed. What the rows say is judged by column expressions. A
source that does not parse, or is nested too deep for the parser, has a row of
``py_errors``, and of its functions and handlers only those that patterns find
to do nothing or give a fixed value. A null source is an empty file. Equal files give equal rows each. Extra columns are ignored.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.runtime import ship

# Exceptions that are often left alone on purpose, names under which an exception is told, and calls that tell.
SILENT = ["OSError", "FileNotFoundError", "PermissionError", "ImportError", "asyncio.CancelledError", "KeyboardInterrupt", "StopIteration"]
TOLD = {"e", "exc", "err", "exception", "ex"}
LOGS = {"debug", "info", "warning", "error", "critical", "log"}
#: Bases and decorators that excuse a body without work.
ABSTRACT_BASES = ["ABC", "ABCMeta", "Protocol"]
EXCUSING = ["abstractmethod", "abstractproperty", "overload", "setter", "deleter", "override"]

_FUNCTION = {"name": pa.string(), "line": pa.int32(), "end": pa.int32(), "owner": pa.string(), "bases": pa.list_(pa.string()), "decorators": pa.list_(pa.string()), "statements": pa.int32(), "only": pa.string(), "docstring": pa.bool_(), "is_async": pa.bool_()}
_HANDLER = {"line": pa.int32(), "try_line": pa.int32(), "end": pa.int32(), "type": pa.string(), "statements": pa.int32(), "raises": pa.bool_(), "returns": pa.bool_(), "silent": pa.bool_()}
_FUNCTIONS = "array<struct<name:string,line:int,end:int,owner:string,bases:array<string>,decorators:array<string>,statements:int,only:string,docstring:boolean,is_async:boolean>>"
_HANDLERS = "array<struct<line:int,try_line:int,end:int,type:string,statements:int,raises:boolean,returns:boolean,silent:boolean>>"


def _last_name(x: ast.expr) -> str:
    x = x.func if isinstance(x, ast.Call) else x
    return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else ""


def _text(x: ast.stmt) -> bool:
    return isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)


def _idle(x: ast.stmt) -> bool:
    """A statement that does nothing: pass, an ellipsis or a text."""
    return isinstance(x, ast.Pass) or _text(x) or (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and x.value.value is ...)


def _only(body: list[ast.stmt]) -> str:
    """What a body of one working statement is: a fixed value it returns, what it raises, or neither."""
    x = body[0] if len(body) == 1 else None
    if isinstance(x, ast.Return):
        value = x.value
        fixed = value is None or isinstance(value, ast.Constant) or isinstance(value, ast.List | ast.Tuple | ast.Set) and not value.elts or isinstance(value, ast.Dict) and not value.keys
        return f"return {ast.unparse(value) if value else ''}".strip()[:80] if fixed else ""
    if isinstance(x, ast.Raise) and x.exc is not None:
        return f"raise {_last_name(x.exc)}"
    return ""


def _logged(x: ast.stmt) -> bool:
    """A log line that does not tell of the exception itself."""
    if not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Attribute)):
        return False
    values = [*x.value.args, *(k.value for k in x.value.keywords)]
    return x.value.func.attr in LOGS and not any(isinstance(v, ast.Name) and v.id in TOLD for v in values)


_DEF = r"^[ \t]*(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\([^()]*\)[^:\n]*:[ \t]*\n(?:[ \t]*#[^\n]*\n)*[ \t]+"
_DEF_END = r"[ \t]*(?:\n[ \t]*)*(?=\n\S|\n[ \t]*(?:async[ \t]+)?(?:def|class|@)|\s*\Z)"
_IDLE_DEF = re.compile(rf"{_DEF}(?:pass|\.\.\.){_DEF_END}", re.M)
_FIXED_DEF = re.compile(rf"{_DEF}(return(?:[ \t]+(?:None|True|False|0|''|\"\"|\[\]|\{{\}}))?){_DEF_END}", re.M)
_IDLE_EXCEPT = re.compile(r"^([ \t]*)except\b([^:\n]*):[ \t]*(?:(?:pass|\.\.\.)[ \t]*$|\n(?:[ \t]*\n)*\1[ \t]+(?:pass|\.\.\.)[ \t]*$(?!(?:\n[ \t]*$)*\n\1[ \t]+\S))", re.M)


def guessed(source: str) -> tuple[list[dict], list[dict]]:
    """What patterns tell of a source that does not parse."""
    line = lambda m: source.count("\n", 0, m.start()) + 1
    function = {"owner": None, "bases": [], "decorators": [], "docstring": False, "is_async": False}
    functions = [function | {"name": m[1], "line": line(m), "end": line(m), "statements": 0, "only": ""} for m in _IDLE_DEF.finditer(source)]
    functions += [function | {"name": m[1], "line": line(m), "end": line(m), "statements": 1, "only": " ".join(m[2].split())} for m in _FIXED_DEF.finditer(source)]
    handlers = [{"line": line(m), "try_line": line(m), "end": line(m), "type": re.sub(r"\s+as\s+\w+$", "", m[2].strip()), "statements": 1, "raises": False, "returns": False, "silent": True} for m in _IDLE_EXCEPT.finditer(source)]
    return functions, handlers


def facts(source: str) -> tuple[list[dict], list[dict], str | None]:
    """Functions, handlers and the parser's complaint of one source."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return *guessed(source), f"{type(e).__name__}: {getattr(e, 'msg', e)}"[:200]
    functions, handlers = [], []
    todo: list[tuple[ast.AST, ast.ClassDef | None]] = [(tree, None)]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            work = [x for x in node.body if not _idle(x)]
            bases = [*map(_last_name, owner.bases), *(_last_name(k.value) for k in owner.keywords)] if owner else []
            functions.append({"name": node.name, "line": node.lineno, "end": node.end_lineno, "owner": owner.name if owner else None, "bases": bases, "decorators": [_last_name(d) for d in node.decorator_list], "statements": len(work), "only": _only(work), "docstring": _text(node.body[0]), "is_async": isinstance(node, ast.AsyncFunctionDef)})
        if isinstance(node, ast.Try | ast.TryStar):
            for h in node.handlers:
                work = [x for x in h.body if not (isinstance(x, ast.Pass) or _logged(x))]
                handlers.append({"line": h.lineno, "try_line": node.lineno, "end": h.end_lineno, "type": ast.unparse(h.type)[:200] if h.type else "", "statements": len(h.body), "raises": any(isinstance(x, ast.Raise) for x in h.body), "returns": any(isinstance(x, ast.Return) for x in h.body), "silent": all(_idle(x) for x in work)})
            if node.finalbody:
                f = node.finalbody
                handlers.append({"line": f[0].lineno, "try_line": node.lineno, "end": f[-1].end_lineno, "type": "finally", "statements": len(f), "raises": any(isinstance(x, ast.Raise) for x in f), "returns": any(isinstance(x, ast.Return) for x in f), "silent": False})
        inside = node if isinstance(node, ast.ClassDef) else None if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef) else owner
        todo += [(x, inside) for x in ast.iter_child_nodes(node)]
    return sorted(functions, key=lambda r: r["line"]), sorted(handlers, key=lambda r: r["line"]), None


def _parsed(batches):
    for batch in batches:
        found = [facts(s or "") for s in batch.column("source").to_pylist()]
        structs = lambda of, i: pa.array([x[i] for x in found], pa.list_(pa.struct(list(of.items()))))  # noqa: B023, E731
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("source"), structs(_FUNCTION, 0), structs(_HANDLER, 1), pa.array([x[2] for x in found], pa.string())], ["path", "source", "functions", "handlers", "error"]
        )


def parsed(files: DataFrame) -> DataFrame:
    """path, source, functions, handlers and error (null where it parsed) of Python files."""
    ship(files.sparkSession)
    rows = files.filter("language = 'python'").select("path", "source")
    return rows.mapInArrow(_parsed, f"path string, source string, functions {_FUNCTIONS}, handlers {_HANDLERS}, error string")


def py_functions(files: DataFrame) -> DataFrame:
    """One row for each function: path, name, line, end, owner (class), bases, decorators, statements, only, docstring, is_async."""
    return parsed(files).select("path", F.inline("functions"))


def py_handlers(files: DataFrame) -> DataFrame:
    """One row for each handler and finally: path, line, try_line, end, type, statements, raises, returns, silent, swallowed."""
    rows = parsed(files).select("path", F.inline("handlers"))
    return rows.withColumn("swallowed", F.col("silent") & ~F.col("type").isin(*SILENT))


def py_errors(files: DataFrame) -> DataFrame:
    """path and error of files that do not parse."""
    return parsed(files).filter("error is not null").select("path", "error")


# Names that say a function only makes something, or asks a question.
MAKES, ASKS = "^(?:create|make|build|default|noop|empty|new)", "^(?:is|has|can|should)_"
FIXED = "^return (?:None|True|False|0|''|\\[\\]|\\(\\)|\\{\\})$"


def findings(rules: set[str]):
    """array<struct<line, rule, severity, confidence, category, message>> of one file's functions and handlers, of the rules asked for."""

    def issue(x, rule, severity, confidence, message):
        return F.struct(x["line"].alias("line"), F.lit(rule).alias("rule"), severity.alias("severity"), F.lit(confidence).alias("confidence"), F.lit("ai-code").alias("category"), F.lit(message).alias("message"))

    def blamed(x):  # not abstract, not excused by a decorator, not special or a test
        excused = F.arrays_overlap(x["decorators"], F.array(*map(F.lit, EXCUSING))) | F.arrays_overlap(x["bases"], F.array(*map(F.lit, ABSTRACT_BASES)))
        return ~excused & ~x["name"].rlike("^(?:__.*__|test_.*)$")

    empty = F.filter("functions", lambda x: blamed(x) & (x["statements"] == 0))
    stub = F.filter("functions", lambda x: blamed(x) & x["only"].rlike(FIXED) & ~x["name"].rlike(MAKES))
    silent = F.filter("handlers", lambda x: x["silent"] & ~x["type"].isin(*SILENT))
    found = {
        "empty-impl": F.transform(empty, lambda x: issue(x, "empty-impl", F.lit("high"), "high", "function does nothing")),
        "stub-function": F.transform(stub, lambda x: issue(x, "stub-function", F.when(x["name"].rlike(ASKS), "low").otherwise("high"), "high", "function only returns a fixed value")),
        "swallowed-error": F.transform(silent, lambda x: issue(x, "swallowed-error", F.lit("high"), "medium", "error is caught and not handled")),
    }
    return [v for k, v in found.items() if k in rules]
