"""Editing files on the driver, and the whole change cascade around an edit."""

from __future__ import annotations

import difflib
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import impact
from symweave.runtime import cut
from symweave.sources import scan
from symweave.sources.extract import detect_language
from symweave.sources.index import Index, applied, renew


class EditError(ValueError):
    """An edit that does not apply; the message tells where the text nearly is, or all places where it is."""


@dataclass
class Change:
    old: str
    new: str


@dataclass
class Outcome:
    status: str
    snippet: str = ""
    warnings: DataFrame | None = None
    summary: str = ""
    context: DataFrame | None = None
    tests: list[str] = field(default_factory=list)
    index: Index | None = None


def match_lines(text: str, wanted: str) -> list[int]:
    """The lines on which a text begins, for each of its occurrences."""
    out, at = [], text.find(wanted) if wanted else -1
    while at >= 0:
        out.append(text.count("\n", 0, at) + 1)
        at = text.find(wanted, at + len(wanted))
    return out


def closest(text: str, wanted: str) -> tuple[int, str, float]:
    """The line most like the first line of what was wanted; the first of equals."""
    first = wanted.strip().split("\n")[0].strip()
    best = (0, "", -1.0)
    for n, line in enumerate(text.split("\n"), 1):
        s = _similarity(line.strip(), first)
        if s > best[2]:
            best = (n, line.strip(), s)
    return best


def _similarity(a: str, b: str) -> float:
    most = max(len(a), len(b))
    if not most:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / most


def apply_edits(text: str, changes: list[Change]) -> str:
    """The text after all changes; each must fit exactly once."""
    for c in changes:
        places = match_lines(text, c.old)
        if not places:
            n, line, s = closest(text, c.old)
            raise EditError(f"text not found; closest is line {n} ({s * 100:.0f} % similar): {line}")
        if len(places) > 1:
            raise EditError(f"text found {len(places)} times, on lines {', '.join(map(str, places))}")
        text = text.replace(c.old, c.new, 1)
    return text


def snippet(old: str, new: str, path: str) -> str:
    """The changed lines as a unified diff without context."""
    return "\n".join(difflib.unified_diff(old.split("\n"), new.split("\n"), path, path, n=0, lineterm=""))


def apply_change(spark: SparkSession, root: str, index: Index, path: str, changes: list[Change] | None = None, create: str | None = None, delete: bool = False) -> Outcome:
    """Edits, creates or deletes a file and tells what that breaks. A failed edit leaves the file as it was."""
    full = os.path.join(root, path)
    before = None
    if os.path.exists(full):
        with open(full, encoding="utf-8") as f:
            before = f.read()
    if create is not None:
        if before is not None:
            raise EditError(f"{path} exists already")
        os.makedirs(os.path.dirname(full) or ".", exist_ok=True)
        after, status = create, "CREATED"
    elif delete:
        if before is None:
            raise EditError(f"{path} does not exist")
        after, status = None, "DELETED"
    else:
        if before is None:
            raise EditError(f"{path} does not exist")
        after = apply_edits(before, changes or [])
        status = "APPLIED" if after != before else "NO_OP"
    if after is None:
        os.remove(full)
    elif after != before:
        with open(full, "w", encoding="utf-8") as f:
            f.write(after)
    diff = snippet(before or "", after or "", path)
    if status == "NO_OP" or detect_language(path) is None:
        return Outcome(status, diff, index=index)
    touched = spark.createDataFrame([(path,)], "file string")
    old_symbols = cut(index.symbols.where(F.col("file") == path))
    fresh = scan.read_files(spark, root, [path] if after is not None else [])
    r = renew(index, fresh, touched, scan.read_crate_name(root), scan.load_alias_rules(root))
    new = applied(index, r)
    changed = cut(impact.diff(old_symbols, r.rows.symbols))
    # callers are looked up among the edges as they were resolved before the change, too: they may now dangle
    seen = cut(index.edges.where(F.col("src_file") != path).unionByName(r.rows.edges.select(*index.edges.columns)).distinct())
    found = cut(impact.warnings(changed, seen))
    of = changed.where("change_class in ('modified_sig', 'modified_body')").select("file", "name", F.coalesce("new.own_kind", "kind").alias("kind"))
    context = impact.context_bundle(of, new.edges, new.symbols)
    tests = [x.file for x in impact.test_importers(new.edges, touched).orderBy("file").collect()]
    return Outcome(status, diff, found, impact.warning_summary(found).first().summary, context, tests, new)
