"""Text forms of hits, signatures and warnings."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LIMIT = 200


def clamp(text: Column, most: int = LIMIT) -> Column:
    """At most ``most`` characters; a longer text ends with an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def without_return_type(signature: Column) -> Column:
    """A signature up to its parameters' closing bracket."""
    return F.regexp_replace(signature, r"(?s)(\))\s*(:|->).*$", "$1")


def compact(signature: str | None) -> str | None:
    """A signature on one line: no doc lines, lifetimes, generic bounds, ``where`` tail or ``fn``; ``->`` before the result."""
    if signature is None:
        return None
    lines = [x.strip() for x in signature.split("\n")]
    s = " ".join(x for x in lines if x and not x.startswith(("///", "//!", "/**", "*")))
    s = re.sub(r"\bwhere\b.*$", "", s)
    s = re.sub(r"&'\w+ ", "&", s)
    out, depth = [], 0
    for i, c in enumerate(s):  # generic parameters of the name itself: from its first < to the matching >
        if c == "<" and (depth or ("(" not in s[:i] and re.search(r"\w$", s[:i]))):
            depth += 1
        elif c == ">" and depth and s[i - 1] != "-":
            depth -= 1
            continue
        if not depth:
            out.append(c)
    s = "".join(out)
    s = re.sub(r"'\w+\s*,?\s*", "", s)
    s = re.sub(r"\bfn\s+", "", s)
    s = re.sub(r"\)\s*:\s*", ") -> ", s)
    return re.sub(r"\s+", " ", s).strip()


@F.pandas_udf(StringType())
def compact_signature(s: pd.Series) -> pd.Series:
    return s.map(compact, na_action="ignore")


def hit_line(root: str = "") -> Column:
    """``path:line body`` with context lines below it; hints are their text alone."""
    from symweave.functions.paths import relative_to

    body = F.coalesce("signature", "snippet", F.lit(""))
    place = F.concat(relative_to(F.col("file"), root) if root else F.col("file"), F.lit(":"), F.col("line").cast("string"))
    context = F.concat(F.lit("\n  | "), F.regexp_replace("context", "\n", "\n  | "))
    full = F.concat(place, F.when(body != "", F.concat(F.lit(" "), body)).otherwise(""), F.coalesce(context, F.lit("")))
    return F.when(F.col("is_hint"), body).otherwise(full)


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def failure_line() -> Column:
    """``FAIL file:line name — message``."""
    return F.format_string("FAIL %s:%d %s — %s", F.coalesce("file", F.lit("?")), F.coalesce("line", F.lit(0)), "test_name", "message")



def status_text(last_run: str | None = None) -> Column:
    """The status block from a row of :func:`symweave.operators.incremental.status`."""
    languages = F.when(F.col("extensions") == "", "(none, the index is empty)").otherwise(F.col("extensions"))
    return F.format_string("symbols: %d\nedges: %d\nfiles: %d\nlanguages: %s\nedits: %d\nlast test run: %s", "symbols", "edges", "files", languages, "edits", F.lit(last_run or "no test run yet"))
