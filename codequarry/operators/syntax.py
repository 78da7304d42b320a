"""Blocks and statements of source files, and joins of lines with the blocks around them.

The lexer is a column expression; only the stack of scopes runs in Python, file
by file in Arrow batches, without a shuffle. Lines meet intervals of lines by an
equi-join on (path, stretch of lines), so neither side is crossed with the other.

A null source has no blocks but the file's own. Files that do not parse give
what their brackets and indents say; nothing raises. Equal files give equal rows
each. Extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.functions import scopes
from codequarry.functions.lexer import code
from codequarry.runtime import ship

LANGUAGES = ("python", "javascript", "typescript", "go", "java", "rust", "ruby", "php")
_NODE = "struct<node:int,parent:int,kind:string,name:string,line:int,end:int,depth:int,exits:boolean,size:int,only:string,lead:string>"
_STATEMENT = "struct<node:int,seq:int,line:int,last:int,text:string,reached:boolean>"
#: Lines in a stretch.
STRETCH = 64


def _arrow(spec: str) -> pa.DataType:
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.list_(pa.struct([(n, kinds[t]) for n, t in (x.split(":") for x in spec[7:-1].split(","))]))


def _parsed(batches):
    node, statement = _arrow(_NODE), _arrow(_STATEMENT)
    names = lambda t: [f.name for f in t.value_type]
    for batch in batches:
        trees = [scopes.parse(c or "", k or "") for c, k in zip(batch.column("code").to_pylist(), batch.column("language").to_pylist())]
        rows = lambda t, found: pa.array([[dict(zip(names(t), r)) for r in x] for x in found], t)
        yield pa.RecordBatch.from_arrays(
            [batch.column("path"), batch.column("language"), batch.column("source"), batch.column("code"), rows(node, [t.nodes for t in trees]), rows(statement, [t.statements for t in trees])],
            ["path", "language", "source", "code", "nodes", "statements"],
        )


def parsed(files: DataFrame) -> DataFrame:
    """path, language, source, code (comments and strings blanked), nodes and statements of files in eight languages."""
    ship(files.sparkSession)
    rows = files.filter(F.col("language").isin(*LANGUAGES)).select("path", "language", "source", code(F.col("source"), F.col("language"), True).alias("code"))
    return rows.mapInArrow(_parsed, f"path string, language string, source string, code string, nodes array<{_NODE}>, statements array<{_STATEMENT}>")


def ast_nodes(files: DataFrame) -> DataFrame:
    """One row for each block: path, language, node, parent, kind, name, line, end, depth, exits, size, only, lead."""
    return parsed(files).select("path", "language", F.inline("nodes"))


def statements(files: DataFrame) -> DataFrame:
    """One row for each statement: path, language, node (the block it stands in), seq, line, last, text, reached."""
    return parsed(files).select("path", "language", F.inline("statements"))


def _stretches(rows: DataFrame, first: str, last: str) -> DataFrame:
    of = lambda c: F.floor(F.col(c) / STRETCH)
    return rows.withColumn("stretch", F.explode(F.sequence(of(first), F.greatest(of(first), of(last)))))


def inside(lines: DataFrame, blocks: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``lines`` (path, line, any others) that lie in an interval of ``blocks`` (path, line, end), or in none (``left_anti``)."""
    spans = _stretches(blocks.select(F.col("path").alias("b_path"), F.col("line").alias("b_line"), F.col("end").alias("b_end")), "b_line", "b_end").withColumnRenamed("stretch", "b_stretch")
    rows = lines.withColumn("stretch", F.floor(F.col("line") / STRETCH))
    same = (F.col("path") == F.col("b_path")) & (F.col("stretch") == F.col("b_stretch")) & F.col("line").between(F.col("b_line"), F.col("b_end"))
    return rows.join(spans, same, how).drop("stretch")


def innermost(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``lines`` with ``block``, the narrowest interval of ``blocks`` around their line (a struct of its columns), null outside."""
    row = F.struct(*[F.col(c) for c in blocks.columns])
    spans = _stretches(blocks.select(F.col("path").alias("b_path"), F.col("line").alias("b_line"), F.col("end").alias("b_end"), row.alias("block")), "b_line", "b_end").withColumnRenamed("stretch", "b_stretch")
    rows = lines.withColumn("stretch", F.floor(F.col("line") / STRETCH)).withColumn("at", F.monotonically_increasing_id())
    same = (F.col("path") == F.col("b_path")) & (F.col("stretch") == F.col("b_stretch")) & F.col("line").between(F.col("b_line"), F.col("b_end"))
    met = rows.join(spans, same, "left")
    first = [F.first(c).alias(c) for c in lines.columns]
    return met.groupBy("at").agg(*first, F.min_by("block", F.struct(F.col("b_end") - F.col("b_line"), -F.col("b_line"))).alias("block")).drop("at")


def enclosed_definitions(files: DataFrame) -> DataFrame:
    """Functions and methods with the class around them: path, line, name, owner (null outside classes)."""
    nodes = ast_nodes(files)
    own = nodes.filter(F.col("kind").isin("function", "method") & (F.col("name") != "")).select("path", "line", "name")
    classes = nodes.filter("kind = 'class'").select("path", "line", "end", "name")
    return innermost(own, classes).select("path", "line", "name", F.col("block.name").alias("owner"))
