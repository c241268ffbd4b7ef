"""Project files: walking a tree, ignore rules, and the small configuration files beside the sources.

The walk runs on the driver and yields paths only; contents are read by the tasks, in batches of bounded size.
(Spark's own file sources leave out names that begin with ``_`` or ``.``, ``__init__.py`` among them.)
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tomllib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from symweave.functions.paths import is_test_path
from symweave.sources.extract import EXTENSIONS, detect_language

#: Contents that a task sends on at once.
BATCH_BYTES = 8 << 20


class Ignore:
    """The rules of one ignore file: the last rule that fits decides."""

    def __init__(self, text: str = ""):
        self.rules = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            pattern = line[1:] if keep else line
            only_dir = pattern.endswith("/")
            pattern = pattern.rstrip("/")
            anchored = "/" in pattern
            self.rules.append((self._regex(pattern.lstrip("/"), anchored), keep, only_dir))

    @staticmethod
    def _regex(pattern: str, anchored: bool) -> re.Pattern[str]:
        out = []
        for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\])", pattern):
            out.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, part if part.startswith("[") else re.escape(part)))
        return re.compile(("" if anchored else "(?:.*/)?") + "".join(out) + r"\Z")

    def decide(self, rel: str, is_dir: bool) -> bool | None:
        """Whether a path is ignored; None where no rule fits."""
        ignored = None
        for regex, keep, only_dir in self.rules:
            if only_dir and not is_dir:
                continue
            if regex.match(rel):
                ignored = not keep
        return ignored

    def match(self, rel: str, is_dir: bool) -> bool:
        return bool(self.decide(rel, is_dir))


def _rules(*paths: str) -> Ignore:
    text = []
    for p in paths:
        try:
            with open(p, encoding="utf-8", errors="replace") as f:
                text.append(f.read())
        except OSError:
            continue
    return Ignore("\n".join(text))


def load_ignore(root: str) -> Ignore:
    return _rules(os.path.join(root, ".gitignore"))


def walk(root: str, parseable_only: bool = True) -> list[str]:
    """Relative paths of a project's files in order, without hidden and ignored ones.

    Every folder may have ignore files; rules of the nearest folder decide first, ``.ignore`` before ``.gitignore``,
    and the repository's own exclude file last.
    """
    out = []
    above: dict[str, list[tuple[str, Ignore]]] = {"": [("", _rules(os.path.join(root, ".git", "info", "exclude")))]}
    for folder, dirs, names in os.walk(root):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        prefix = "" if rel == "." else rel + "/"
        rules = above.pop(prefix)
        own = [x for x in (".gitignore", ".ignore") if x in names]
        if own:
            rules = [(prefix, _rules(*[os.path.join(folder, x) for x in own])), *rules]

        def ignored(path: str, is_dir: bool) -> bool:
            told = (r.decide(path[len(p) :], is_dir) for p, r in rules)
            return next((t for t in told if t is not None), False)

        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not ignored(prefix + d, True))
        for d in dirs:
            above[f"{prefix}{d}/"] = rules
        for n in names:
            if n.startswith(".") or ignored(prefix + n, False) or (parseable_only and detect_language(n) is None):
                continue
            out.append(prefix + n)
    return sorted(out)


def is_relevant(path: str, root: str, ignore: Ignore) -> bool:
    """Whether a changed path matters: inside the root, not ignored with its folders, of a known language."""
    rel = os.path.relpath(path, root).replace(os.sep, "/")
    if rel.startswith("../") or detect_language(rel) is None:
        return False
    parts = rel.split("/")
    return not any(ignore.match("/".join(parts[: i + 1]), i < len(parts) - 1) for i in range(len(parts)))


def relevant(events: DataFrame, ignore: Ignore, parseable_only: bool = False) -> DataFrame:
    """The file events (``path`` relative to the root) that matter: not hidden, not ignored with one of their folders."""

    def keep(path: pd.Series) -> pd.Series:
        def matters(p: str) -> bool:
            parts = p.split("/")
            if p.startswith(("../", "/")) or any(x.startswith(".") for x in parts) or (parseable_only and detect_language(p) is None):
                return False
            return not any(ignore.match("/".join(parts[: i + 1]), i < len(parts) - 1) for i in range(len(parts)))

        return path.map(lambda p: p is not None and matters(p))

    return events.where(F.pandas_udf(keep, BooleanType())("path"))


def _content(full: str, source: bool) -> tuple[str | None, str]:
    """A file's text and the hash of its bytes. Other files than sources have no text if they hold a zero byte."""
    try:
        with open(full, "rb") as f:
            data = f.read()
    except OSError as e:
        return None, hashlib.sha256(f"unreadable {e.errno}".encode()).hexdigest()
    text = data.decode("utf-8", errors="replace") if source or b"\0" not in data else None
    return text, hashlib.sha256(data).hexdigest()


#: Parts of every relation of a stored graph, by a checksum of the file.
BUCKETS = 16


def _listed(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The paths, those of one bucket together, so that each task writes few buckets later."""
    n = max(1, min(len(paths) // 50 + 1, spark.sparkContext.defaultParallelism), len(paths) // 5_000)
    ordered = sorted(paths, key=lambda p: (zlib.crc32(p.encode("utf-8", "surrogateescape")) % BUCKETS, p))
    listed = spark.createDataFrame(pd.DataFrame({"path": pd.Series(ordered, dtype=object), "slot": range(len(ordered))}), "path string, slot bigint")
    return listed.repartitionByRange(n, "slot").select("path") if n > 1 else listed.select("path").coalesce(1)


def hash_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content_hash`` of all files of a project; contents stay with the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content_hash": [_content(os.path.join(root, p), False)[1] for p in b["path"]]})

    return _listed(spark, walk(root, parseable_only=False)).mapInPandas(run, "path string, content_hash string")


def read_files(spark: SparkSession, root: str, paths: list[str] | DataFrame | None = None, also: Callable | None = None, columns: str = "") -> DataFrame:
    """The canonical files table: all files that are not ignored, those of unknown languages without a language.

    Texts are whole, whatever their size; bytes that are no UTF-8 come out as replacement characters. Unreadable
    files, and other files than sources that hold a zero byte, have a null content. The hash is that of the bytes.
    ``also(path, content)`` gives further values (``columns``) of a file in the task that reads it.
    """
    paths = walk(root, parseable_only=False) if paths is None else paths

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        names = ["path", "content", "content_hash", *[c.split()[0] for c in columns.split(", ") if c]]
        for b in batches:
            for p in b["path"]:
                text, digest = _content(os.path.join(root, p), detect_language(p) is not None)
                rows.append((p, text, digest, *(also(p, text) if also else ())))
                size += len(text or "") + 200
                if size >= BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    listed = _listed(spark, paths) if isinstance(paths, list) else paths.select("path")
    rows = listed.mapInPandas(run, "path string, content string, content_hash string" + (", " + columns if columns else ""))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]
    extra = [c.split()[0] for c in columns.split(", ") if c]
    return rows.select("path", F.col("path").alias("rel_path"), ext.alias("ext"), language.alias("language"), "content", "content_hash", is_test_path(F.col("path")).alias("is_test_path"), *extra)


def strip_json_comments(text: str) -> str:
    """JSON without ``//`` and block comments and trailing commas; strings are left alone."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)


def load_alias_rules(root: str) -> list[tuple[str, bool, list[str]]]:
    """``prefix, wildcard, targets`` of the alias configuration; empty where there is none."""
    try:
        with open(os.path.join(root, "tsconfig.json"), encoding="utf-8") as f:
            options = json.loads(strip_json_comments(f.read())).get("compilerOptions", {})
    except (OSError, ValueError):
        return []
    base = options.get("baseUrl", "").strip("./")
    join = lambda t: "/".join(x for x in (base, t.removeprefix("./")) if x)
    rules = []
    for pattern, targets in (options.get("paths") or {}).items():
        rules.append((pattern.split("*")[0], pattern.endswith("*"), [join(t) for t in targets]))
    if "baseUrl" in options:
        rules.append(("", True, [join("*")]))
    return rules


def read_crate_name(root: str) -> str | None:
    try:
        with open(os.path.join(root, "Cargo.toml"), "rb") as f:
            return tomllib.load(f).get("package", {}).get("name")
    except (OSError, tomllib.TOMLDecodeError):
        return None


@dataclass(frozen=True)
class Config:
    test_command: str | None = None
    watcher_debounce_ms: int = 100


def load_config(root: str, name: str = ".symweave.toml") -> Config:
    try:
        with open(os.path.join(root, name), "rb") as f:
            d = tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError):
        return Config()
    return Config(d.get("test_command"), int(d.get("watcher_debounce_ms", 100)))


def top_level_dirs(root: str) -> list[str]:
    return sorted(d for d in os.listdir(root) if os.path.isdir(os.path.join(root, d)))


def native_grep(root: str, pattern: str, most: int = 50, skip: tuple[str, ...] = ("node_modules", "target", "dist", "__pycache__")) -> list[tuple[str, int, str]] | str:
    """The plain search tool of the benchmark: no ignore file, no hidden folders, an invalid pattern is told as text."""
    try:
        regex = re.compile(pattern)
    except re.error as e:
        return f"invalid pattern: {e}"
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and d not in skip)
        for n in sorted(names):
            try:
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    for i, line in enumerate(f, 1):
                        if regex.search(line):
                            out.append((os.path.relpath(os.path.join(folder, n), root), i, line.rstrip("\n")))
                            if len(out) >= most:
                                return out
            except (OSError, UnicodeDecodeError):
                continue
    return out


def read_text(path: str, most: int = 50_000) -> str:
    """A file's text, cut after so many characters with a note."""
    with open(path, encoding="utf-8", errors="replace") as f:
        text = f.read()
    return text if len(text) <= most else text[:most] + f"\n[... {len(text) - most} more characters]"


