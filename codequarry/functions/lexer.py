"""Code without comments and string contents, as a column expression.

One pattern takes a source apart into strings, comments and the rest; the pieces
are blanked or kept and joined again. Every character but a line feed gives way
to one space, so offsets, lines and indents stay what they were. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOUBLE, _SINGLE, _BACK = (rf"{q}(?:\\.|[^{q}\\{end}])*+{q}?" for q, end in (('"', r"\n"), ("'", r"\n"), ("`", "")))
_TRIPLE = r'"""(?:\\.|(?!""")[^\\])*+(?:""")?|' + r"'''(?:\\.|(?!''')[^\\])*+(?:''')?"
_BLOCK, _SLASHES, _HASH = r"/\*(?:[^*]|\*(?!/))*+(?:\*/)?", r"//[^\n]*+", r"#[^\n]*+"
#: A slash after one of these begins a regular expression, not a division.
_REGEX = r"(?<=[(,=:\[!&|?{};\n] {0,4})/(?![/*])(?:\\.|\[(?:\\.|[^\]\n])*+\]|[^/\\\n\[])++/[a-z]*+"
_CHAR = r"'(?:\\[^\n']*+|[^'\\\n])'"
#: A family's strings, comments and the characters that neither begins with.
_KINDS = {
    "script": (f"{_DOUBLE}|{_SINGLE}|{_BACK}|{_REGEX}", f"{_SLASHES}|{_BLOCK}", "\"'`/"),
    "brace": (f"{_DOUBLE}|{_SINGLE}", f"{_SLASHES}|{_BLOCK}", "\"'/"),
    "go": (f"{_DOUBLE}|{_CHAR}|{_BACK}", f"{_SLASHES}|{_BLOCK}", "\"'`/"),
    "rust": (f"{_DOUBLE}|{_CHAR}", f"{_SLASHES}|{_BLOCK}", "\"'/"),
    "php": (f"{_DOUBLE}|{_SINGLE}", f"{_SLASHES}|{_HASH}|{_BLOCK}", "\"'/#"),
    "python": (f"{_TRIPLE}|{_DOUBLE}|{_SINGLE}", _HASH, "\"'#"),
    "ruby": (f"{_DOUBLE}|{_SINGLE}", _HASH, "\"'#"),
}
_FAMILY = {"javascript": "script", "typescript": "script", "go": "go", "rust": "rust", "php": "php", "python": "python", "ruby": "ruby"}


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def _masked(source: Column, family: str, strings_too: bool) -> Column:
    strings, comments, marks = _KINDS[family]
    pieces = F.regexp_extract_all(source, F.lit(f"(?s){strings}|{comments}|[^{marks}]++|."), F.lit(0))

    def shown(x):
        out = F.when(x.rlike(f"^(?s:{comments})$") & ~x.rlike("^[\"'`]"), _blank(x))
        if strings_too:
            begins = r"""^["'`/]""" if family == "script" else r"""^["'`]"""  # only there a slash may begin a literal
            out = out.when(x.rlike(begins) & (F.length(x) > 1), F.concat(F.left(x, F.lit(1)), _blank(F.substring(x, F.lit(2), F.length(x) - 2)), F.right(x, F.lit(1))))
        return out.otherwise(x)

    return F.array_join(F.transform(pieces, shown), "")


def code(source: Column, language: Column, strings_too: bool = False) -> Column:
    """The source with its comments blanked, and what strings hold too if asked for; one of the seven families by language."""
    out = None
    for family in sorted(_KINDS):
        names = [k for k, v in _FAMILY.items() if v == family]
        if names:
            out = (F if out is None else out).when(language.isin(*names), _masked(source, family, strings_too))
    return out.otherwise(_masked(source, "brace", strings_too))
