"""Source text with comments and the contents of strings blanked out, at unchanged positions.

Declarations and calls are then found with patterns and bracket matching, without tripping over code that
is merely quoted. Line breaks stay, and so do the quotes themselves.
"""

from __future__ import annotations

import bisect
import re


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


_RUST = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>\bb?r(?P<h>\#*)"(?s:.*?)"(?P=h))|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')""",
    re.DOTALL,
)


def mask_rust(src: str) -> str:
    """Rust: nested block comments, raw strings, characters as against lifetimes."""
    out, at = [], 0
    while m := _RUST.search(src, at):
        out.append(src[at : m.start()])
        end = m.end()
        if m["block"]:
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(src, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            if depth:
                end = len(src)
        text = src[m.start() : end]
        out.append('"' + _blank(text[1:-1]) + '"' if (m["str"] or m["raw"]) and len(text) > 1 else _blank(text))
        at = end
    return "".join([*out, src[at:]])


_BEFORE_REGEX = re.compile(r"(?:^|[=(,:;!&|?{}\[+\-*%<>~^]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|new|yield|await))\s*\Z")


def mask_script(src: str) -> str:
    """TypeScript and JavaScript: comments, strings, regular expressions, template literals with their code."""
    out: list[str] = []
    n, i = len(src), 0
    nesting: list[int] = []  # depth of braces inside each open ${ }
    depth = 0

    def template(i: int) -> int:
        """From inside a template to its end or to the next ${."""
        while i < n:
            if src[i] == "\\":
                out.append(_blank(src[i : i + 2]))
                i += 2
            elif src[i] == "`":
                out.append("`")
                return i + 1
            elif src.startswith("${", i):
                out.append("  ")
                nesting.append(depth)
                return i + 2
            else:
                out.append("\n" if src[i] == "\n" else " ")
                i += 1
        return i

    while i < n:
        c = src[i]
        if src.startswith("//", i):
            j = src.find("\n", i)
            j = n if j < 0 else j
            out.append(" " * (j - i))
            i = j
        elif src.startswith("/*", i):
            j = src.find("*/", i + 2)
            j = n if j < 0 else j + 2
            out.append(_blank(src[i:j]))
            i = j
        elif c in "\"'":
            m = re.compile(r"(?:\\.|[^\\\n" + c + r"])*" + c + "?", re.DOTALL).match(src, i + 1)
            text = m[0]
            closed = text.endswith(c) and text != ""
            out.append(c + _blank(text[:-1] if closed else text) + (c if closed else ""))
            i = m.end()
        elif c == "`":
            out.append("`")
            i = template(i + 1)
        elif c == "/" and _BEFORE_REGEX.search("".join(out[-40:])[-60:]) and (m := re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(src, i)):
            out.append(_blank(m[0]))
            i = m.end()
        elif c == "{":
            depth += 1
            out.append(c)
            i += 1
        elif c == "}":
            if nesting and depth == nesting[-1]:
                nesting.pop()
                out.append(" ")
                i = template(i + 1)
            else:
                depth -= 1
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    return "".join(out)


class Text:
    """A source with its mask, line numbers and matching brackets."""

    def __init__(self, src: str, mask: str):
        self.src, self.mask = src, mask
        self.starts = [0, *[m.end() for m in re.finditer("\n", src)]]
        self.match: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        self.broken = False
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{}]", mask):
            c, at = m[0], m.start()
            if c in "([{":
                stack.append((c, at))
            else:
                while stack and stack[-1][0] != pairs[c]:
                    if all(o != pairs[c] for o, _ in stack):
                        break
                    stack.pop()
                    self.broken = True
                if stack and stack[-1][0] == pairs[c]:
                    self.match[stack.pop()[1]] = at
                else:
                    self.broken = True
        self.broken = self.broken or bool(stack)

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def close(self, at: int) -> int:
        """The place of the bracket that closes the one at ``at``, or the end."""
        return self.match.get(at, len(self.src) - 1)

    def angle(self, at: int) -> int:
        """Behind the generic parameters that may begin at ``at``."""
        if at >= len(self.mask) or self.mask[at] != "<":
            return at
        depth = 0
        for i in range(at, len(self.mask)):
            c = self.mask[i]
            if c == "<":
                depth += 1
            elif c == ">" and self.mask[i - 1] not in "-=":
                depth -= 1
                if not depth:
                    return i + 1
            elif c in ";{" and depth == 1:
                break
        return at
