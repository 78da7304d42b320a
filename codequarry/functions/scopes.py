"""Blocks and statements of one source, by a stack of scopes; used inside tasks by ``operators.syntax``.

What comes in is code whose comments and strings are blanked (see ``lexer``),
so brackets, keywords and line ends mean what they say. A block is (node,
parent, kind, name, line, end, depth, exits, size, only, lead): ``size`` counts
its statements, ``only`` is the text of a single one, ``lead`` that of the first
that is no plain assignment; ``exits`` says that every way
through its body ends in a return, throw, break or the like; the name of a
``try`` that has a handler is "handled". A statement is (node, seq, line, last,
text, reached), its text without the blocks inside it. Node 0 is the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

# What a first word opens, in all languages with braces.
CONTROL = {
    "if": "if", "for": "loop", "foreach": "loop", "while": "loop", "loop": "loop", "do": "loop", "switch": "switch", "match": "switch", "select": "switch",
    "try": "try", "catch": "catch", "finally": "finally", "else": "else", "synchronized": "block", "unsafe": "block", "using": "with",
}
TYPES = ("class", "interface", "enum", "struct", "trait", "impl", "record", "namespace")
EXITS = {"return", "throw", "raise", "break", "continue", "goto"}
#: Kinds that may follow a block and belong to it.
FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "try", "catch", "loop"}, "catch": {"try", "catch"}, "finally": {"try", "catch", "else"}}
#: Languages in which the end of a line ends a statement that is not open.
BY_LINE = {"javascript", "typescript", "go"}
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_ASSIGNED, _AWAIT = re.compile(r"(?:(?:const|let|var)\s+)?\w+\s*="), re.compile(r"\bawait\b")
_TYPE = re.compile(rf"(?:^|\s)(?:{'|'.join(TYPES)})\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)")
_GO_TYPE = re.compile(r"^type\s+(\w+)\s+(?:struct|interface)$")
_NAMED = {"go": re.compile(r"\bfunc\b\s*(\([^)]*\))?\s*(\w+)?"), "rust": re.compile(r"\bfn\s+(\w+)")}
_FUNCTION = re.compile(r"\bfunction\b\s*[*&]?\s*([A-Za-z_$][\w$]*)?")
_GIVEN = re.compile(r"([A-Za-z_$][\w$]*)\s*(?::[^=()]*)?[=:]\s*(?:async\b\s*)?(?:function\b|\(|[A-Za-z_$])")
_METHOD = re.compile(r"([A-Za-z_$#][\w$]*)\s*(?:<[^<>]*>)?\s*\([^{}]*\)\s*(?:(?:throws\s+[\w.,\s]+|:[^{}=]+)\s*)?$")


class Scope:
    __slots__ = ("node", "kind", "block", "dead", "chain", "seq", "start", "parts", "first", "indent", "line", "opening", "lead")

    def __init__(self, node: int, kind: str, block: bool, line: int, start: int = 0, indent: int = -1):
        self.node, self.kind, self.block, self.line, self.start, self.indent = node, kind, block, line, start, indent
        self.dead, self.chain, self.seq, self.parts, self.first, self.opening, self.lead = False, [], 0, [], None, "", ""


class Tree:
    """The rows that a parser fills in."""

    def __init__(self, lines: int):
        self.nodes = [[0, -1, "file", "", 1, lines, 0, False, 0, "", ""]]
        self.statements: list[list] = []

    def open(self, parent: int, kind: str, name: str, line: int) -> int:
        self.nodes.append([len(self.nodes), parent, kind, name, line, line, self.nodes[parent][6] + 1, False, 0, "", ""])
        return len(self.nodes) - 1

    def close(self, scope: Scope, line: int) -> None:
        settle(scope)
        self.nodes[scope.node][5] = line
        self.nodes[scope.node][7:] = [scope.dead, scope.seq, scope.opening if scope.seq == 1 else "", scope.lead]

    def _state(self, scope: Scope, line: int, last: int, text: str) -> None:
        self.statements.append([scope.node, scope.seq, line, last, text, not scope.dead])
        if not scope.seq:
            scope.opening = text
        if not scope.lead and not (_ASSIGNED.match(text) and not _AWAIT.search(text)):
            scope.lead = text
        scope.seq += 1

    def say(self, scope: Scope, line: int, last: int, text: str) -> None:
        """A whole statement of this scope."""
        settle(scope)
        text = " ".join(text.split())
        if scope.kind == "switch" and re.match(r"(?:case\b|default\b|when\b|.*=>)", text):
            scope.dead = False
        self._state(scope, line, last, text)
        word = _WORD.match(text)
        if word and word[0] in EXITS and not re.search(r"\s(?:if|unless)\s", text):
            scope.dead = True

    def meet(self, scope: Scope, kind: str, line: int) -> None:
        """A block begins in this scope: a statement of its own, or one more part of the one before."""
        if scope.chain and scope.chain[-1][0] in FOLLOWS.get(kind, ()):
            for before, _, node in scope.chain:
                if before == "try":
                    self.nodes[node][3] = "handled"
            return
        settle(scope)
        self._state(scope, line, line, f"{kind} {{}}")

    def leave(self, scope: Scope, kind: str, dead: bool, line: int, node: int) -> None:
        """A block of this scope has ended."""
        if self.statements and kind in CONTROL.values():
            for row in reversed(self.statements):
                if row[0] == scope.node:
                    row[3] = line
                    break
        if kind in ("if", "try") or kind in FOLLOWS:
            scope.chain = [*(scope.chain if kind in FOLLOWS else []), (kind, dead, node)]
        elif kind in ("block", "with"):
            scope.dead |= dead


def settle(scope: Scope) -> None:
    """What the blocks that belong together let through, once no more of them follows."""
    chain, scope.chain = scope.chain, []
    kinds = {k for k, _, _ in chain}
    if not chain:
        return
    if any(k == "finally" and dead for k, dead, _ in chain):
        scope.dead = True
    ways = [dead for k, dead, _ in chain if k != "finally"]
    whole = "else" in kinds if chain[0][0] == "if" else bool(kinds & {"catch", "finally"})
    scope.dead |= whole and bool(ways) and all(ways)


def header(text: str, language: str, inside: str) -> tuple[str, str]:
    """Kind and name of the block that a text stands before."""
    text = " ".join(text.split())
    text = re.sub(r"^(?:@[\w.]+(?:\([^()]*\))?\s*|#\[[^\]]*\]\s*|\w+:\s+(?=for|while|loop))+", "", text)
    word = (_WORD.match(text) or [""])[0]
    if word == "else":
        return ("elif", "") if re.match(r"else\s*if\b", text) else ("else", "")
    if word in CONTROL and (word != "match" or language == "rust"):
        return CONTROL[word], ""
    if language == "php" and word == "elseif":
        return "elif", ""
    if language in _NAMED and (m := _NAMED[language].search(text)):
        named = m[m.lastindex] if m.lastindex else ""
        if language == "go":
            return ("method" if m[1] and m[2] else "function"), m[2] or ""
        return ("method" if inside == "class" else "function"), named
    if text.endswith("=>") or (language not in ("go", "rust") and (m := _FUNCTION.search(text))):
        m = _FUNCTION.search(text)
        name = (m and m[1]) or ((g := _GIVEN.search(text)) and g[1]) or ""
        return ("method" if inside == "class" else "function"), name
    if m := (_GO_TYPE.search(text) if language == "go" else _TYPE.search(text)):
        return "class", m[1]
    if (inside == "class" or (language == "java" and inside == "file")) and (m := _METHOD.search(text)) and not re.search(r"\bnew\s|=", text[: m.start()]):
        return "method", m[1]
    if not text or word in ("static", "default", "defer", "go", "move") and len(text.split()) == 1:
        return "block", ""
    return "value", ""


_EVENT = re.compile(r"""(["'`])\s*\1|[{}()\[\];\n]""")
_OPEN_END = re.compile(r"(?:[-+*/%&|^<>=?:,.!~\\(\[{]|\b(?:else|in|of|instanceof|typeof|new|return))$")
_GOES_ON = re.compile(r"\s*(?:[.?:&|+*/%=<>,{)\]]|-[^-])")
_HEAD_ONLY = re.compile(r"^(?:(?:else\s+)?if|for|while)\b.*\)$|^else$", re.S)

_DECLARED = re.compile(r"\s*(?:(?:export|default|async|public|private|protected|static|final|abstract|pub(?:\([^)]*\))?|const|unsafe|extern)\s+)*(?:function|func|fn)\b")
_GO_HEAD = re.compile(r"\s*(?:else\s+)?(?:if|for|switch|select)\b")


def braces(code: str, language: str) -> Tree:
    feeds = [m.start() for m in re.finditer("\n", code)]
    line_of = lambda at: bisect_right(feeds, at - 1) + 1
    tree = Tree(len(feeds) + 1)
    stack = [Scope(0, "file", True, 1)]
    by_line = language in BY_LINE

    def text_of(scope, end):
        return "".join([*scope.parts, code[scope.start : end]])

    def first_of(scope, end):
        if scope.first is None:
            m = re.compile(r"\S").search(code, scope.start, end)
            scope.first = m.start() if m else None
        return scope.first

    def flush(scope, end):
        first = first_of(scope, end)
        text = text_of(scope, end)
        if first is not None and text.strip():
            tree.say(scope, line_of(first), line_of(max(first, end - 1)), text)
        fresh(scope, end)

    def fresh(scope, at):
        scope.parts, scope.first, scope.start = [], None, at

    for m in _EVENT.finditer(code):
        at, mark, top = m.start(), m[0], stack[-1]
        if len(mark) > 1:
            continue
        if mark in "([":
            stack.append(Scope(top.node, mark, False, line_of(at), at + 1))
        elif mark in ")]":
            if not top.block and top.kind in "([" and len(stack) > 1:
                stack.pop()
        elif mark == ";":
            if top.block and not (language == "go" and _GO_HEAD.match(text_of(top, at))):
                flush(top, at)
                top.start = at + 1
        elif mark == "\n":
            if by_line and top.block and top.kind not in ("value",):
                text = text_of(top, at).strip()
                if text and not _OPEN_END.search(text) and not _HEAD_ONLY.match(text) and not _GOES_ON.match(code, at + 1):
                    flush(top, at)
        elif mark == "{":
            first = first_of(top, at)
            begin = top.start
            if not top.block:  # inside brackets: what stands since the last comma
                begin = max(top.start, code.rfind(",", top.start, at) + 1)
                if code[begin:at].count("(") != code[begin:at].count(")"):
                    begin = top.start
            text = code[begin:at] if not top.block else text_of(top, at)
            kind, name = header(text, language, top.kind if top.block else "")
            line = line_of(at if first is None else first) if top.block else line_of(at)
            if kind == "value":
                stack.append(Scope(top.node, "value", False, line, at + 1))
                continue
            if top.block and (kind != "function" or _DECLARED.match(text)):
                tree.meet(top, kind, line)
                own = Scope(tree.open(top.node, kind, name, line), kind, True, line, at + 1)
                own.indent = 1  # a statement of its own
            else:  # a function inside an expression
                own = Scope(tree.open(top.node, kind, name, line), kind, True, line, at + 1)
                if top.block:
                    top.parts.append(code[top.start : at + 1])
                    top.start = at + 1
            stack.append(own)
        elif mark == "}":
            while len(stack) > 1 and not stack[-1].block and stack[-1].kind in "([":
                stack.pop()
            if len(stack) == 1:
                flush(stack[0], at)
                stack[0].start = at + 1
                continue
            top = stack[-1]
            if top.kind == "value" and not top.block:
                stack.pop()
                continue
            flush(top, at)
            stack.pop()
            tree.close(top, line_of(at))
            below = stack[-1]
            if below.block:
                if top.indent == 1:
                    tree.leave(below, top.kind, top.dead, line_of(at), top.node)
                    fresh(below, at + 1)
                else:
                    below.start = at
    while len(stack) > 1:
        top = stack.pop()
        if top.block:
            flush(top, len(code))
            tree.close(top, len(feeds) + 1)
    flush(stack[0], len(code))
    settle(stack[0])
    return tree


_PY_BLOCK = re.compile(r"^(?:async\s+)?(if|elif|else|for|while|try|except|finally|with|def|class|match|case)\b(?P<rest>.*)$", re.S)
_PY_KIND = {"if": "if", "elif": "elif", "else": "else", "for": "loop", "while": "loop", "try": "try", "except": "catch", "finally": "finally", "with": "with", "match": "switch", "case": "block"}


def _logical(code: str):
    """(line, last, indent, text) of Python's logical lines."""
    depth, first, parts, indent, quote = 0, 0, [], 0, ""
    for number, text in enumerate(code.split("\n"), 1):
        if not parts and not text.strip():
            continue
        if not parts:
            first, indent = number, len(text.expandtabs(8)) - len(text.expandtabs(8).lstrip())
        parts.append(text)
        for c in text:
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            else:
                depth += (c in "([{") - (c in ")]}")
        if depth <= 0 and not quote and not text.rstrip().endswith("\\"):
            yield first, number, indent, " ".join(p.strip().rstrip("\\") for p in parts)
            depth, parts = 0, []
    if parts:
        yield first, first + len(parts) - 1, indent, " ".join(p.strip() for p in parts)


def indents(code: str) -> Tree:
    tree = Tree(code.count("\n") + 1)
    stack, last = [Scope(0, "file", True, 1)], 1

    def end():
        top = stack.pop()
        tree.close(top, last)
        tree.leave(stack[-1], top.kind, top.dead, last, top.node)

    for line, until, indent, text in _logical(code):
        while len(stack) > 1 and indent <= stack[-1].indent:
            end()
        m = _PY_BLOCK.match(text)
        inline = text.rstrip().endswith(":")
        if m and inline and not re.match(r"(?:match|case)\b\s*[=.,)(\[]?\s*:?$", text):
            word = m[1]
            kind = _PY_KIND.get(word) or ("class" if word == "class" else "method" if stack[-1].kind == "class" else "function")
            name = (_WORD.match(m["rest"].strip()) or [""])[0] if word in ("def", "class") else ""
            tree.meet(stack[-1], kind, line)
            stack.append(Scope(tree.open(stack[-1].node, kind, name, line), kind, True, line, indent=indent))
        elif m and m[1] in ("elif", "else", "except", "finally"):  # with its body on the same line
            kind, body = _PY_KIND[m[1]], text.split(":", 1)[-1].strip()
            tree.meet(stack[-1], kind, line)
            tree.leave(stack[-1], kind, (_WORD.match(body) or [""])[0] in EXITS, until, 0)
        else:
            tree.say(stack[-1], line, until, text)
        last = until
    while len(stack) > 1:
        end()
    settle(stack[0])
    return tree


_RUBY = re.compile(r"^(def|class|module|if|unless|while|until|for|begin|case)\b\s*(?:self\.)?([A-Za-z_]\w*[?!]?)?")
_RUBY_KIND = {"class": "class", "module": "class", "if": "if", "unless": "if", "while": "loop", "until": "loop", "for": "loop", "begin": "try", "case": "switch"}
_RUBY_PART = {"elsif": "elif", "else": "else", "rescue": "catch", "ensure": "finally"}


def ends(code: str) -> Tree:
    """Ruby: blocks from a keyword to its ``end``; the parts between are blocks beside each other."""
    tree = Tree(code.count("\n") + 1)
    stack = [Scope(0, "file", True, 1)]

    def end(line):
        top = stack.pop()
        tree.close(top, line)
        tree.leave(stack[-1], top.kind, top.dead, line, top.node)

    for line, raw in enumerate(code.split("\n"), 1):
        text = raw.strip()
        if not text:
            continue
        word = (_WORD.match(text) or [""])[0]
        m = _RUBY.match(text)
        below = stack[-1]
        if word == "end" and len(stack) > 1:
            end(line)
        elif word in _RUBY_PART and below.kind in ("if", "elif", "else", "try", "catch", "finally", "function", "method", "switch"):
            kind = _RUBY_PART[word]
            if below.kind == "switch":
                below.dead = False
                continue
            if below.kind in ("function", "method"):  # a handler of the whole body
                tree.say(below, line, line, text)
                below.dead = False
                continue
            end(line - 1)
            tree.meet(stack[-1], kind, line)
            stack.append(Scope(tree.open(stack[-1].node, kind, "", line), kind, True, line))
        elif m and not re.search(r"\bend$", text) and not (m[1] == "def" and re.search(r"\)?\s=\s", text)):
            kind = _RUBY_KIND.get(m[1]) or ("method" if below.kind == "class" else "function")
            tree.meet(below, kind, line)
            stack.append(Scope(tree.open(below.node, kind, (m[2] or "") if m[1] in ("def", "class", "module") else "", line), kind, True, line))
        elif re.search(r"\bdo\b\s*(?:\|[^|]*\|)?$", text) or re.search(r"=\s*(?:if|case|begin|unless)\b", text) and not text.endswith("end"):
            tree.say(below, line, line, text)
            stack.append(Scope(tree.open(below.node, "function", "", line), "function", True, line))
        else:
            tree.say(below, line, line, text)
    while len(stack) > 1:
        end(tree.nodes[0][5])
    settle(stack[0])
    return tree


def parse(code: str, language: str) -> Tree:
    return indents(code) if language == "python" else ends(code) if language == "ruby" else braces(code, language)
