"""The text query language: a ladder of anchored patterns, the first that fits wins."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    """A classified query: what is asked, its subject, and a second argument where there is one."""

    kind: str
    subject: str = ""
    target: str = ""
    with_context: bool = False


# The patterns of the query language, in the order in which they are tried.
LADDER = (
    ("callers", r"callers of (?P<subject>.+?)(?P<context> with context)?"),
    ("callers", r"what calls (?P<subject>.+)"),
    ("callees", r"callees of (?P<subject>.+)"),
    ("callees", r"what does (?P<subject>.+) call"),
    ("outline", r"outline of (?P<subject>.+)"),
    ("chain", r"chain from (?P<subject>.+?) to (?P<target>.+)"),
    ("find", r"(?:find|where is) (?P<subject>.+)"),
    ("tests", r"tests for (?P<subject>.+)"),
    ("imports", r"imports of (?P<subject>.+)"),
    ("importers", r"importers of (?P<subject>.+)"),
    ("exports", r"exports of (?P<subject>.+)"),
    ("libraries", r"libraries"),
)

#: Hits for each kind of query. For outline and exports the header counts, elsewhere it comes on top.
CAPS = {"outline": 50, "exports": 50, "find": 5, "callers": 10, "callees": 10, "libraries": 30, "grep": 30, "siblings": 10}


def classify(text: str) -> Query:
    """The query a text asks; anything that fits no pattern is a search for the whole text."""
    text = text.strip()
    for kind, pattern in LADDER:
        m = re.fullmatch(pattern, text, re.DOTALL)
        if m:
            g = m.groupdict()
            return Query(kind, (g.get("subject") or "").strip(), (g.get("target") or "").strip(), bool(g.get("context")))
    return Query("grep", text)


def is_path_like(text: str) -> bool:
    """Whether a chain's target names a file: it has a separator or a source extension."""
    return "/" in text or "\\" in text or text.lower().endswith((".rs", ".ts", ".tsx", ".js", ".jsx", ".py"))


def safe_pattern(text: str) -> str:
    """A regular expression; a text that is none is searched literally."""
    try:
        re.compile(text)
        return text
    except re.error:
        return re.escape(text)


def query_path(root: str, path: str) -> str:
    """A path of a query as the tables have it: relative to the root, in plain form."""
    plain = posixpath.normpath(path.replace("\\", "/"))
    base = root.rstrip("/") + "/"
    return plain[len(base) :] if plain.startswith(base) else plain
