"""The statement around a call, from the structure of the source.

Python sources are parsed; in the other languages the statement is bounded by semicolons and by the brackets of
the masked source, in which strings and comments are blank. A call in the head of a condition or loop has the
whole of it as its statement. Statements are cut after ``MOST`` lines. Where a line has no call, its language is
unknown or the source does not parse, the line and its neighbours come out.
"""

from __future__ import annotations

import ast
import functools
import re

from symweave.sources.extract import detect_language
from symweave.sources.masking import Text, mask_rust, mask_script

MOST = 20
_CALL = re.compile(r"[\w$]+!?\s*(?:(?:::)?<[\w\s,.&'\[\]|<>:]*>)?\(")
#: Before such a sign or word a brace opens a value, not a block.
_VALUE = re.compile(r"(?:[(,=:\[?]|\breturn)\s*\Z")
#: A line that begins so continues the statement of the line before.
_GOES_ON = re.compile(r"\s*(?:[.?:+*/&|=,)\]%<>]|-(?!-)|else\b|catch\b|finally\b)")
#: A line that ends so is continued by the next one.
_OPEN = re.compile(r"[=(\[{,+\-*&|?:.<>]\s*\Z")
_PARTS = (ast.Expr, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return, ast.If)


def _cut(text: str) -> str:
    return "\n".join(text.split("\n")[:MOST])


def _window(source: str, line: int) -> str | None:
    rows = source.split("\n")
    return "\n".join(rows[max(0, line - 2) : line + 1]) if 1 <= line <= len(rows) else None


@functools.lru_cache(maxsize=64)
def _tree(source: str) -> ast.AST | None:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None


@functools.lru_cache(maxsize=64)
def _text(source: str, rust: bool) -> tuple[Text, dict[int, int]]:
    t = Text(source, (mask_rust if rust else mask_script)(source))
    return t, {b: a for a, b in t.match.items()}


def _python(source: str, line: int) -> str | None:
    tree = _tree(source)
    if tree is None:
        return None
    found: ast.stmt | None = None
    todo: list[tuple[ast.AST, ast.stmt | None]] = [(tree, None)]
    deepest = (-1, -1)
    while todo:
        node, holder = todo.pop()
        if isinstance(node, _PARTS):
            holder = node
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            holder = None
        if isinstance(node, ast.Call) and node.lineno == line and (node.col_offset, -(node.end_col_offset or 0)) > deepest and holder is not None:
            deepest, found = (node.col_offset, -(node.end_col_offset or 0)), holder
        todo += [(child, holder) for child in ast.iter_child_nodes(node)]
    return ast.get_source_segment(source, found) if found is not None else None


def _begin(t: Text, opens: dict[int, int], at: int, rust: bool) -> int:
    """Where the statement begins that holds a place."""
    i = at - 1
    while i >= 0:
        c = t.mask[i]
        if c == ";":
            return i + 1
        if c in ")]}":
            if c == "}" and re.match(r"[^\S\n]*\n", t.mask[i + 1 :]) and not _GOES_ON.match(t.mask[i + 1 :].lstrip()):
                return i + 1  # a block that ends its line ends a statement
            i = opens.get(i, i)
        elif c == "{" and not _VALUE.search(t.mask[max(0, i - 200) : i]):
            return i + 1
        elif c == "\n" and not rust and not _GOES_ON.match(t.mask, i + 1) and not _OPEN.search(t.mask[max(0, i - 200) : i]):
            return i + 1
        i -= 1
    return 0


def _end(t: Text, at: int, rust: bool) -> int:
    """Behind the statement that begins at a place."""
    i, n, depth = at, len(t.mask), 0
    while i < n:
        c = t.mask[i]
        if c in "([{":
            close = t.match.get(i, n - 1)
            if c == "{" and not _VALUE.search(t.mask[max(0, i - 200) : i]):
                rest = t.mask[close + 1 :]
                if not re.match(r"\s*(?:[.?;,)\]]|else\b|catch\b|finally\b|while\b|&&|\|\|)", rest):
                    return close + 1
            i = close
        elif c in ")]":
            depth -= 1
        elif c == "}":
            return i
        elif c == ";":
            return i + 1
        elif c == "\n" and not rust and depth >= 0 and t.mask[at:i].strip() and not _GOES_ON.match(t.mask, i + 1) and not _OPEN.search(t.mask[at:i]):
            return i
        i += 1
    return n


def _by_brackets(source: str, line: int, rust: bool) -> str | None:
    t, opens = _text(source, rust)
    if line > len(t.starts):
        return None
    a, b = t.starts[line - 1], t.starts[line] if line < len(t.starts) else len(source)
    calls = [m.start() for m in _CALL.finditer(t.mask, a, b)]
    if not calls:
        return None
    begin = _begin(t, opens, calls[-1], rust)
    begin += len(t.mask[begin:]) - len(t.mask[begin:].lstrip())
    return source[begin : _end(t, begin, rust)].rstrip()


def enclosing_statement(path: str | None, source: str | None, line: int) -> str | None:
    """The statement around the innermost call on a line; None for a null source or a line that is not there."""
    if source is None:
        return None
    language = detect_language(path or "")
    found = None
    if line >= 1:
        if language == "python":
            found = _python(source, line)
        elif language is not None:
            found = _by_brackets(source, line, language == "rust")
    return _cut(found) if found else _window(source, line)
