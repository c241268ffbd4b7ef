"""Line-wise operators on file contents: search, nearest lines, hashes, enclosing statements.

Contents are split to lines by the JVM; a final empty line is no line, as for any line reader. Null contents
have no lines. Lines are numbered from 1.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from symweave.sources.statements import enclosing_statement

SNIPPET = 120


def lines(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``file, line, text`` of all lines."""
    rows = files.where(F.col(content).isNotNull()).select(F.col(path).alias("file"), F.posexplode(F.split(F.regexp_replace(content, r"\r?\n\z", ""), r"\r?\n")).alias("pos", "text"))
    return rows.select("file", (F.col("pos") + 1).alias("line"), "text")


def grep(files: DataFrame, pattern: str, path: str = "path", content: str = "content") -> DataFrame:
    """All lines that a regular expression matches.

    Contents without any match are dropped before the split, except where the pattern may match a line and not
    the content as a whole: with anchors of the whole input, or where it looks around or behind itself.
    """
    matching = files if re.search(r"\\[AzZGbB]|\(\?[<=!]|\(\?[a-z]*-|\\\d", pattern) else files.where(F.col(content).rlike("(?m)" + pattern))
    return lines(matching, path, content).where(F.col("text").rlike(pattern))


def grep_top(files: DataFrame, pattern: str, most: int = 30, path: str = "path", content: str = "content") -> DataFrame:
    """The first matching lines by file and line: each task keeps ``most`` rows."""
    hits = grep(files, pattern, path, content).orderBy("file", "line").limit(most)
    return hits.select("file", "line", F.substring(trimmed(F.col("text")), 1, SNIPPET).alias("snippet"))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length; two empty texts are equal."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / most)


def closest_line(files: DataFrame, wanted: str, path: str = "path", content: str = "content") -> DataFrame:
    """``file, line, text, similarity`` of the line of each file that is most like ``wanted``; the first wins."""
    scored = lines(files, path, content).withColumn("similarity", similarity(trimmed(F.col("text")), F.lit(wanted.strip())))
    best = scored.groupBy("file").agg(F.max_by(F.struct("line", "text", "similarity"), F.struct("similarity", -F.col("line"))).alias("b"))
    return best.select("file", "b.*")


def match_lines(files: DataFrame, wanted: str, path: str = "path", content: str = "content") -> DataFrame:
    """``file, line`` of every occurrence of a text, which may span lines; occurrences do not overlap."""
    pieces = F.split(F.col(content), "\\Q" + wanted.replace("\\E", "\\E\\\\E\\Q") + "\\E")
    rows = files.where(F.contains(content, F.lit(wanted))).select(F.col(path).alias("file"), pieces.alias("p"))
    upto = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.aggregate(F.slice("p", F.lit(1), i), F.lit(1), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("\n")))) + (i - 1) * wanted.count("\n"))
    return rows.select("file", F.explode(upto).alias("line"))


def normalized_body(source: Column) -> Column:
    """Source without comments and layout: block comments out, lines cut at ``//`` or else ``#``, blanks trimmed."""
    no_blocks = F.regexp_replace(source, r"(?s)/\*.*?(\*/|\z)", "")
    cut = F.transform(
        F.split(no_blocks, r"\r?\n"),
        lambda x: trimmed(F.when(F.contains(x, F.lit("//")), F.substring_index(x, "//", 1)).otherwise(F.substring_index(x, "#", 1))),
    )
    return F.array_join(F.filter(cut, lambda x: x != ""), " ")


def body_hash(source: Column) -> Column:
    return F.xxhash64(normalized_body(source))


def split_params(params: Column) -> Column:
    """The parameters of a list in brackets: split at every comma, trimmed, empty ones dropped."""
    inner = F.regexp_replace(params, r"^\s*\(|\)\s*$", "")
    return F.filter(F.transform(F.split(inner, ","), trimmed), lambda x: x != "")


# ---------------------------------------------------------------- call sites


def call_arguments(content: str | None, line: int, name: str) -> str | None:
    """The arguments of the call of ``name`` on a line: up to the matching bracket, 10 lines and 200 characters."""
    if not content:
        return None
    part = content.split("\n")[line - 1 : line + 9]
    if not part:
        return None
    text = "\n".join(part)
    m = re.search(re.escape(name) + r"\s*\(", text.split("\n", 1)[0] if name in part[0] else "")
    if not m:
        return None
    depth, out = 1, []
    for c in text[m.end() :]:
        depth += (c in "([{") - (c in ")]}")
        if depth == 0:
            break
        out.append(c)
    if depth:
        return None
    args = re.sub(r"\s+", " ", "".join(out)).strip()
    return (args if len(args) <= 200 else args[:197] + "...") or None


@F.pandas_udf(StringType())
def call_arguments_udf(content: pd.Series, line: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([call_arguments(c, int(n), x) if c is not None and x is not None and not pd.isna(n) else None for c, n, x in zip(content, line, name)])


@F.pandas_udf(StringType())
def enclosing_statement_udf(path: pd.Series, content: pd.Series, line: pd.Series) -> pd.Series:
    return pd.Series([enclosing_statement(p, c, int(n)) if c is not None and not pd.isna(n) else None for p, c, n in zip(path, content, line)])
