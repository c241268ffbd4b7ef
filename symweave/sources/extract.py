"""Symbols, edges and library imports of one source file, for four languages.

Every driver returns an :class:`Extract`. Calls are kept once for each caller and callee name, at their first
place; a call outside of any function is left out; arrow functions are transparent, so what they call
belongs to the named function around them. A file with syntax errors gives what could be read and is
marked ``partial_parse``. Lines are numbered from 1.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.sources.masking import Text, mask_rust, mask_script

# File extensions of each language.
EXTENSIONS = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust",
}


def detect_language(path: str) -> str | None:
    return EXTENSIONS.get(os.path.splitext(path)[1][1:].lower())


@dataclass
class Extract:
    path: str
    symbols: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    partial: bool = False
    _calls: set[tuple[str, str]] = field(default_factory=set)

    @property
    def stem(self) -> str:
        return os.path.splitext(os.path.basename(self.path))[0]

    def symbol(self, name, kind, start, end, signature, visibility, params=(), result=None, is_async=False, body=""):
        self.symbols.append({"name": name, "kind": kind, "line_start": start, "line_end": end, "signature": signature, "params": list(params), "return_type": result, "visibility": visibility, "is_async": is_async, "body": body})

    def call(self, caller: dict, callee: str, line: int) -> None:
        if (caller["name"], callee) not in self._calls:
            self._calls.add((caller["name"], callee))
            self.edges.append({"src_name": caller["name"], "src_kind": caller["kind"], "dst_file": self.path, "dst_name": callee, "dst_kind": "Function", "kind": "Calls", "line": line, "confidence": "Unresolved", "spec": None})

    def import_(self, spec: str, line: int) -> None:
        self.edges.append({"src_name": self.stem, "src_kind": "Module", "dst_file": spec, "dst_name": "", "dst_kind": "Module", "kind": "Imports", "line": line, "confidence": "Unresolved", "spec": spec})

    def library(self, name: str, line: int) -> None:
        self.imports.append({"library": name, "symbol": "", "line": line})


def split_params(text: str) -> list[str]:
    return [p for p in (x.strip() for x in text.split(",")) if p]


def render_signature(name: str, params: list[str], result: str | None) -> str:
    return f"{name}({', '.join(params)})" + (f": {result}" if result else "")


def _innermost(spans: list[tuple[int, int, dict]], at: int) -> dict | None:
    best = None
    for a, b, s in spans:
        if a <= at <= b and (best is None or a > best[0]):
            best = (a, s)
    return best[1] if best else None


# ---------------------------------------------------------------- Python


def _python_visibility(name: str) -> str:
    return "Export" if name.startswith("__") and name.endswith("__") else "Private" if name.startswith("_") else "Export"


def extract_python(path: str, src: str) -> Extract:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return _scan_python(path, src)
    out = Extract(path)
    lines = src.split("\n")

    coded = [x.encode() for x in lines]  # the parser's columns are bytes

    def text(node) -> str:
        if node.lineno == node.end_lineno:
            return coded[node.lineno - 1][node.col_offset : node.end_col_offset].decode()
        first, *between = coded[node.lineno - 1 : node.end_lineno]
        return b"\n".join([first[node.col_offset :], *between[:-1], between[-1][: node.end_col_offset]]).decode()

    def visit(node, owner: dict | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                is_async = isinstance(child, ast.AsyncFunctionDef)
                kind = "Method" if in_class else "AsyncFunction" if is_async else "Function"
                a = child.args
                given = [*a.posonlyargs, *a.args]
                params = [text(x) or x.arg for x in given]
                params += ["*" + text(a.vararg)] if a.vararg else []
                params += [text(x) for x in a.kwonlyargs] + (["**" + text(a.kwarg)] if a.kwarg else [])
                result = text(child.returns) if child.returns else None
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                out.symbol(child.name, kind, child.lineno, child.end_lineno, render_signature(child.name, params, result), _python_visibility(child.name), params, result, is_async, body)
                visit(child, {"name": child.name, "kind": kind}, False)
            elif isinstance(child, ast.ClassDef):
                out.symbol(child.name, "Class", child.lineno, child.end_lineno, child.name, _python_visibility(child.name), body="\n".join(lines[child.lineno - 1 : child.end_lineno]))
                visit(child, owner, True)
            elif isinstance(child, ast.Import):
                for alias in child.names:
                    out.library(alias.name.split(".")[0], child.lineno)
                    out.import_(alias.name, child.lineno)
            elif isinstance(child, ast.ImportFrom):
                spec = "." * child.level + (child.module or "")
                out.library(spec.lstrip(".").split(".")[0] or ".", child.lineno)
                if child.module:
                    out.import_(spec, child.lineno)
            else:
                if isinstance(child, ast.Call) and owner:
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        out.call(owner, name, child.lineno)
                visit(child, owner, in_class and not isinstance(child, ast.Lambda))

    visit(tree, None, False)
    return out


def _scan_python(path: str, src: str) -> Extract:
    """Definitions and imports by their lines and indentation, for files that do not parse."""
    out = Extract(path, partial=True)
    lines = src.split("\n")
    open_: list[tuple[int, dict, bool]] = []
    for n, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        if m := re.match(r"\s*(async\s+)?def\s+(\w+)\s*\((.*?)(?:\)\s*(?:->\s*([^:]+))?:?|$)", line):
            kind = "Method" if open_ and open_[-1][2] else "AsyncFunction" if m[1] else "Function"
            end = n
            for k in range(n, len(lines)):
                if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                end = k + 1 if lines[k].strip() else end
            params, result = split_params(m[3]), (m[4] or "").strip() or None
            out.symbol(m[2], kind, n, end, render_signature(m[2], params, result), _python_visibility(m[2]), params, result, bool(m[1]), "\n".join(lines[n - 1 : end]))
            open_.append((indent, {"name": m[2], "kind": kind}, False))
        elif m := re.match(r"\s*class\s+(\w+)", line):
            out.symbol(m[1], "Class", n, n, m[1], _python_visibility(m[1]), body=line)
            open_.append((indent, {}, True))
        elif m := re.match(r"\s*from\s+(\.*)([\w.]*)\s+import\b", line):
            out.library(m[2].split(".")[0] or ".", n)
            if m[2]:
                out.import_(m[1] + m[2], n)
        elif m := re.match(r"\s*import\s+(.+)", line):
            for part in m[1].split(","):
                name = part.split(" as ")[0].strip()
                if re.fullmatch(r"[\w.]+", name):
                    out.library(name.split(".")[0], n)
                    out.import_(name, n)
        else:
            owner = next((s for _, s, is_class in reversed(open_) if not is_class), None)
            for m in re.finditer(r"(\w+)\s*\(", line) if owner else ():
                out.call(owner, m[1], n)
    return out


# ---------------------------------------------------------------- Rust

_RUST_NO_CALL = frozenset("if while for match loop return fn let in as move where impl struct enum trait mod use pub unsafe async await dyn ref mut else".split())


def extract_rust(path: str, src: str, crate: str | None = None) -> Extract:
    t = Text(src, mask_rust(src))
    mask = t.mask
    out = Extract(path, partial=t.broken)
    impls, functions = [], []
    for m in re.finditer(r"\b(?:unsafe\s+)?(impl|trait)\b[^;{}]*\{", mask):
        impls.append((m.end() - 1, t.close(m.end() - 1), {"impl": m[1]}))
    head = r"(?P<vis>pub(?:\s*\([^)]*\))?\s+)?(?P<mods>(?:(?:const|async|unsafe|extern(?:\s*\"[^\"]*\")?|default)\s+)*)fn\s+(?P<name>\w+)\s*"
    for m in re.finditer(head, mask):
        at = t.angle(m.end())
        while at < len(mask) and mask[at].isspace():
            at += 1
        if at >= len(mask) or mask[at] != "(":
            out.partial = True
            continue
        shut = t.close(at)
        stop = re.compile(r"[{;]").search(mask, shut)
        stop_at = stop.start() if stop else len(mask) - 1
        if not stop or stop[0] == ";":
            continue  # a declaration without a body is none
        end = t.close(stop_at)
        arrow = re.match(r"\)\s*->\s*(.*?)\s*(?:\bwhere\b.*)?\Z", src[shut:stop_at], re.DOTALL)
        result = re.sub(r"\s+", " ", arrow[1]).strip() if arrow else None
        params = split_params(re.sub(r"\s+", " ", src[at + 1 : shut]))
        around = [(a, "fn") for a, b, _ in functions if a <= m.start() <= b] + [(a, "impl") for a, b, s in impls if a <= m.start() <= b and s["impl"] == "impl"]
        is_method = bool(around) and max(around)[1] == "impl"
        is_async = "async" in m["mods"].split()
        kind = "Method" if is_method else "AsyncFunction" if is_async else "Function"
        vis = "Private" if not m["vis"] else "Public" if "(" in m["vis"] else "Export"
        out.symbol(m["name"], kind, t.line(m.start()), t.line(end), render_signature(m["name"], params, result), vis, params, result, is_async, src[m.start() : end + 1])
        functions.append((m.start(), end, {"name": m["name"], "kind": kind}))
    for m in re.finditer(r"(?P<vis>\bpub(?:\s*\([^)]*\))?\s+)?\b(?:unsafe\s+)?(?P<what>struct|enum|trait|mod)\s+(?P<name>\w+)", mask):
        stop = re.compile(r"[{;(]").search(mask, m.end())
        end = t.close(stop.start()) if stop and stop[0] in "{(" else stop.start() if stop else m.end()
        kind = {"struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module"}[m["what"]]
        vis = "Private" if not m["vis"] else "Public" if "(" in m["vis"] else "Export"
        out.symbol(m["name"], kind, t.line(m.start()), t.line(end), m["name"], vis, body=src[m.start() : end + 1])
    for m in re.finditer(r"\buse\s+([^;]+);", mask):
        spec = re.sub(r"\s+", "", re.split(r"\s+as\s+|\{|\*", src[m.start(1) : m.end(1)])[0]).strip(":")
        head_ = spec.split("::")[0]
        if crate and head_ == crate.replace("-", "_"):
            spec = "::".join(["crate", *spec.split("::")[1:]])
            head_ = "crate"
        line = t.line(m.start())
        if head_ in ("crate", "self", "super"):
            out.import_(spec, line)
        elif head_:
            out.library(head_, line)
    for m in re.finditer(r"(?<![\w!])(\w+)\s*(?:::\s*<[^<>()]*(?:<[^<>]*>[^<>()]*)*>\s*)?\(", mask):
        name = m[1]
        if name in _RUST_NO_CALL or name[0].isdigit() or re.search(r"\b(?:fn|struct|enum)\s+\Z", mask[max(0, m.start() - 12) : m.start()]):
            continue
        caller = _innermost(functions, m.start())
        if caller:
            out.call(caller, name, t.line(m.start()))
    return out


# ---------------------------------------------------------------- TypeScript and JavaScript

_SCRIPT_NO_CALL = frozenset("if for while switch catch return function typeof new await super import with throw delete void yield do else in of instanceof case async constructor require".split())


def _quoted(t: Text, at: int) -> str | None:
    """The string whose opening quote is at ``at``."""
    q = t.mask[at]
    end = t.mask.find(q, at + 1)
    return t.src[at + 1 : end] if end > 0 else None


def extract_script(path: str, src: str, typed: bool) -> Extract:
    t = Text(src, mask_script(src))
    mask = t.mask
    out = Extract(path, partial=t.broken)
    functions: list[tuple[int, int, dict]] = []

    def parameters(at: int) -> tuple[list[str], str | None, int] | None:
        """Parameters, return type and the place behind both, from an opening bracket on."""
        if at >= len(mask) or mask[at] != "(":
            return None
        shut = t.close(at)
        params = split_params(re.sub(r"\s+", " ", src[at + 1 : shut]))
        end, result = shut + 1, None
        if typed and (m := re.compile(r"\s*:\s*").match(mask, end)):
            i, depth = m.end(), 0
            while i < len(mask):
                c = mask[i]
                if c in "<([" or (c == "{" and (i == m.end() or mask[i - 1] in "|&<,: ") and not re.sub(r"\s", "", mask[m.end() : i])):
                    depth += 1
                elif c in ">)]}" and mask[i - 1] != "=":
                    depth -= 1
                elif depth <= 0 and (c in "{;" or mask.startswith("=>", i) or (c == "\n" and re.match(r"\s*\S", mask[i:]) and not re.match(r"\s*[|&{=]", mask[i:]))):
                    break
                i += 1
            result, end = re.sub(r"\s+", " ", src[m.end() : i]).strip() or None, i
        return params, result, end

    def skip(at: int) -> int:
        while at < len(mask) and mask[at].isspace():
            at += 1
        return at

    def body_end(at: int) -> int:
        at = skip(at)
        return t.close(at) if at < len(mask) and mask[at] == "{" else at

    for m in re.finditer(r"(?<![\w.$])(?:export\s+)?(?:default\s+)?(?P<a>async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*", mask):
        if re.search(r"=\s*\Z", mask[max(0, m.start() - 40) : m.start()]):
            continue
        p = parameters(skip(t.angle(m.end())))
        if not p:
            out.partial = True
            continue
        end = body_end(p[2])
        kind = "AsyncFunction" if m["a"] else "Function"
        out.symbol(m["name"], kind, t.line(m.start()), t.line(end), render_signature(m["name"], p[0], p[1]), "Export", p[0], p[1], bool(m["a"]), src[m.start() : end + 1])
        functions.append((m.start(), end, {"name": m["name"], "kind": kind}))
    for m in re.finditer(r"(?<![\w.$])(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::(?:[^=;]|=>)*?)?=\s*(?P<a>async\b\s*)?(?P<what>function\b\s*\*?\s*[\w$]*\s*|<|\(|[\w$]+\s*=>)", mask):
        at = m.start("what")
        if m["what"].startswith("function"):
            p = parameters(skip(t.angle(m.end())))
        elif m["what"][0] in "<(":
            p = parameters(skip(t.angle(at)))
            if p and not re.match(r"\s*=>", mask[p[2] :]):
                p = None
        else:
            p = ([m["what"].split("=")[0].strip()], None, m.end("what") - 2)
        if not p:
            continue
        arrow = re.compile(r"\s*=>\s*").match(mask, p[2])
        start = arrow.end() if arrow else p[2]
        end = body_end(start) if mask[skip(start) : skip(start) + 1] == "{" else max(start, (re.compile(r"[;\n]").search(mask, start) or re.compile(r"\Z").search(mask)).start() - 1)
        out.symbol(m["name"], "AsyncFunction" if m["a"] else "Function", t.line(m.start()), t.line(end), render_signature(m["name"], p[0], p[1]), "Export", p[0], p[1], bool(m["a"]), src[m.start() : end + 1])
    for m in re.finditer(r"(?<![\w.$])(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)[^{;]*\{", mask):
        begin, end = m.end() - 1, t.close(m.end() - 1)
        out.symbol(m["name"], "Class", t.line(m.start()), t.line(end), m["name"], "Export", body=src[m.start() : end + 1])
        at = begin + 1
        member = re.compile(r"(?P<mods>(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+|\*\s*)*)(?P<name>[\w$#]+)\s*(?=[(<])")
        while at < end:
            c = mask[at]
            if c in "({[":
                at = t.close(at) + 1
                continue
            m2 = member.match(mask, at) if re.search(r"[\s;{}*]\Z", mask[at - 1 : at]) or at == begin + 1 else None
            if m2 and m2["name"] not in ("if", "for", "while", "switch", "return", "new"):
                p = parameters(skip(t.angle(m2.end())))
                if p and mask[skip(p[2]) : skip(p[2]) + 1] == "{":
                    stop = body_end(p[2])
                    is_async = "async" in m2["mods"].split()
                    out.symbol(m2["name"], "Method", t.line(at), t.line(stop), render_signature(m2["name"], p[0], p[1]), "Export", p[0], p[1], is_async, src[at : stop + 1])
                    functions.append((at, stop, {"name": m2["name"], "kind": "Method"}))
                    at = stop + 1
                    continue
            at += 1
    if typed:
        for m in re.finditer(r"(?<![\w.$])(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)[^{;]*\{", mask):
            end = t.close(m.end() - 1)
            out.symbol(m["name"], "Interface", t.line(m.start()), t.line(end), m["name"], "Export", body=src[m.start() : end + 1])
        for m in re.finditer(r"(?<![\w.$])(?:export\s+)?(?:declare\s+)?type\s+(?P<name>[\w$]+)\s*(?:<[^=]*>)?\s*=", mask):
            end = (re.compile(r";|\n(?=\S)|\Z").search(mask, m.end())).start()
            out.symbol(m["name"], "TypeAlias", t.line(m.start()), t.line(end), m["name"], "Export", body=src[m.start() : end])
    found = [(m.start(), _quoted(t, m.end() - 1)) for m in re.finditer(r"(?<![\w.$])import\b(?:[^;'\"`()]*?\bfrom)?\s*['\"]", mask)]
    if not typed:
        found += [(m.start(), _quoted(t, m.end() - 1)) for m in re.finditer(r"(?<![\w.$])require\s*\(\s*['\"]", mask)]
    for at, spec in sorted(found):
        if not spec:
            continue
        out.import_(spec, t.line(at))
        if not spec.startswith((".", "/")):
            out.library("/".join(spec.split("/")[: 2 if spec.startswith("@") else 1]), t.line(at))
    sites = [(m.start(1), m[1]) for m in re.finditer(r"(?<![\w$#])([\w$#]+)\s*(?:<[\w\s,.\[\]|<>]*>)?\(", mask)]
    if path.endswith(("x",)):
        sites += [(m.start(), m[1].split(".")[-1]) for m in re.finditer(r"<((?:[A-Z][\w$]*\.)*[A-Z][\w$]*)(?=[\s/>])", mask)]
    declared = {a + src[a:].find(s["name"]) for a, _, s in functions}
    for at, name in sorted(sites):
        if name in _SCRIPT_NO_CALL or name[0].isdigit() or at in declared or re.search(r"\bfunction\s*\*?\s*\Z", mask[max(0, at - 14) : at]):
            continue
        caller = _innermost(functions, at)
        if caller:
            out.call(caller, name, t.line(at))
    return out


# ---------------------------------------------------------------- as a Spark operator


def extract(path: str, source: str, crate: str | None = None) -> Extract:
    """The driver for a path's language; files of other languages give nothing."""
    language = detect_language(path)
    if language == "python":
        return extract_python(path, source)
    if language == "rust":
        return extract_rust(path, source, crate)
    if language in ("typescript", "javascript"):
        return extract_script(path, source, language == "typescript")
    return Extract(path)


_SYMBOL = "array<struct<name:string,kind:string,line_start:int,line_end:int,signature:string,params:array<string>,return_type:string,visibility:string,is_async:boolean,body:string>>"
_EDGE = "array<struct<src_name:string,src_kind:string,dst_file:string,dst_name:string,dst_kind:string,kind:string,line:int,confidence:string,spec:string>>"
_IMPORT = "array<struct<library:string,symbol:string,line:int>>"


#: What an extraction gives for a file.
EXTRACTED = f"partial_parse boolean, failed boolean, symbols {_SYMBOL}, edges {_EDGE}, imports {_IMPORT}"


def extract_row(path: str, content: str | None, crate: str | None = None) -> tuple:
    """The values of ``EXTRACTED``; ``partial_parse`` is null for files of unknown languages."""
    if detect_language(path) is None:
        return None, False, [], [], []
    try:
        x = extract(path, content or "", crate)
        return x.partial, False, x.symbols, x.edges, x.imports
    except Exception:  # noqa: BLE001 - one odd file must not end the run; it is counted in ``failed``
        return True, True, [], [], []


def extract_files(files: DataFrame, crate: str | None = None) -> DataFrame:
    """``file, partial_parse, failed, symbols, edges, imports``: one row for each file (``path, content``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(path, *extract_row(path, content, crate)) for path, content in zip(b["path"], b["content"])]
            yield pd.DataFrame(rows, columns=["file", "partial_parse", "failed", "symbols", "edges", "imports"])

    known = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*EXTENSIONS))
    return known.select("path", "content").mapInPandas(run, f"file string, {EXTRACTED}")


def relations(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, edges and library imports in the canonical schemas."""
    from symweave.operators.textscan import body_hash

    s = extracted.select("file", F.explode("symbols").alias("s")).select("file", "s.*")
    symbols = s.select("file", "name", "kind", "line_start", "line_end", "signature", "params", "return_type", "visibility", body_hash(F.col("body")).alias("body_hash"), "is_async", F.lit(None).cast("bigint").alias("embedding_id"))
    e = extracted.select("file", F.explode("edges").alias("e")).select(F.col("file").alias("src_file"), "e.*")
    edges = e.select("src_file", "src_name", "src_kind", "dst_file", "dst_name", "dst_kind", "kind", "line", "confidence", "spec")
    i = extracted.select("file", F.explode("imports").alias("i")).select("i.library", "i.symbol", "file", "i.line")
    return symbols, edges, i
