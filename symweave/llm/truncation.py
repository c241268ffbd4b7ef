"""Texts that lost their end.

A stack automaton reads every text and tells what is still open at its end: code fences, code spans,
brackets, quotes, table rows and list entries, escapes and multibyte sequences that break off, or a mark
that stands for the rest. Brackets and quotes are followed through the whole text outside fences, whatever its
last line; code spans and bold type are read on the last line only. What counts as a proper end beyond a closing sentence mark is learned per source,
not listed: the shapes of last lines that stand in front of the closing word in the source's complete texts
are the baseline (those of all sources where a source has no complete text), and a last line of another
shape without a terminator is missing its end. Lengths at
which a source's texts pile up although few of them are complete are field limits; a text of exactly that
length was cut even if it happens to end well. White space at the end tells of a cut in a source where it is rare.

Defined results: null, empty and blank texts are no case, nor is a text that merely lacks the closing word.
A text with the closing word as its last line is complete. Of re-delivered rows the one with the largest
``loaded_at`` holds (ties break by a hash of the row). A null source is a source of its own. Rows with a null id are
left out. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symweave.operators import skew
from symweave.runtime import cut

CLOSING = "DONE"
#: A last-line shape in front of the closing word is a proper end of a source if it stands there in at least this
#: share of the source's complete texts, and more than once.
SUPPORT, SUPPORT_SHARE = 2, 0.0003
#: Longer last lines are running text, which needs a terminator.
SHAPE = 80
#: Where fewer texts of a source than this end in white space, a text that does was followed by something.
RARE = 0.05
#: A field limit: so many texts of one length, so many times the usual number around it, so many incomplete.
LIMIT_ROWS, LIMIT_TIMES, LIMIT_OPEN, LIMIT_AROUND = 4, 8.0, 0.6, 8

_CLOSED = re.compile(r"(?:^|\n)[ \t]*[*_`]*DONE[*_`]*[.!]?\s*\Z")
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)(.*)$")
_MARK = re.compile(r"(\.{3}|…|\[(?:…|\.\.\.)?\s*(?:truncated|cut|snip)[^\]\n]*\]|\((?:…|\.\.\.)?\s*(?:truncated|cut)[^)\n]*\)|\[(?:…|\.\.\.)\]|<truncated>)\s*\Z", re.I)
_BROKEN = re.compile(r"(\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&#?\w{1,8}|%[0-9A-Fa-f]?|�+)\Z")
_ITEM = re.compile(r"^\s*(\d+[.)]|[-*+])(?:\s+(.*))?$")
_TOKEN = re.compile(r"`[^`]*`|\S+\.(?:tsx?|jsx?|py|rs|[mc]ts|[mc]js)(?!\w)|\d+")
_END = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\Z")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _span_open(line: str) -> bool:
    return line.count("`") % 2 == 1


def _brackets_open(text: str) -> bool:
    """Whether a bracket or double quote is open at the end of running text.

    Code spans, which end with their paragraph, and inch marks are skipped.
    """
    text = "\n\n".join(re.sub(r"`[^`]*`", "", x) for x in text.split("\n\n"))
    stack: list[str] = []
    for before, c in zip(" " + text, text):
        if c in "([{":
            stack.append(c)
        elif c in _PAIRS:
            if stack and stack[-1] == _PAIRS[c]:
                stack.pop()
        elif c == '"':
            if stack and stack[-1] == '"':
                stack.pop()
            elif not before.isdigit():
                stack.append('"')
    return bool(stack)


def shape(line: str) -> str:
    """A line with its code spans, paths and numbers replaced by placeholders; running text has no shape."""
    out = _TOKEN.sub(lambda m: "`c`" if m[0][0] == "`" else "9" if m[0].isdigit() else "p", line.strip())
    return out if len(out) <= SHAPE else ""


def inspect(text: str) -> tuple[str, str, bool]:
    """``(why the text is open or '', shape of its last line, whether it is closed by the closing word)``."""
    closed = bool(_CLOSED.search(text))
    body = _CLOSED.sub("", text).rstrip()
    lines = body.split("\n")
    fence = ""
    outside = []
    for line in lines:
        m = _FENCE.match(line)
        if m and not fence:
            fence = m[1]
        elif m and m[1].startswith(fence[:3]) and not m[2].strip():
            fence = ""
        elif not fence:
            outside.append(line)
    last = lines[-1]
    end = shape(last)
    if closed:
        return "", end, True
    mark = _MARK.search(body)
    if fence:
        return "fence", end, False
    if mark:
        return "mark", end, False
    if _BROKEN.search(body):
        return "broken sequence", end, False
    bracket = "bracket" if _brackets_open("\n".join(outside)) else ""
    if _FENCE.match(last):
        return bracket, "```", False
    if _span_open(last):
        return "code span", end, False
    if re.search(r"(?<!\*)\*\*(?!\*)", last) and len(re.findall(r"\*\*", last)) % 2:
        return "markup", end, False
    if last.lstrip().startswith("|"):
        rows = [x for x in lines if x.lstrip().startswith("|")]
        cells = [len(re.findall(r"(?<!\\)\|", x)) for x in rows]
        if not last.rstrip().endswith("|") or cells[-1] < max(cells):
            return "table row", end, False
        return bracket, "| |", False
    item = _ITEM.match(last)
    if item and not (item[2] or "").strip():
        return "list entry", end, False
    if bracket:
        return bracket, end, False
    return ("" if _END.search(last) else "no terminator"), end, False


def inspected(rows: DataFrame, key: str, source: str, text: str, at: str | None) -> DataFrame:
    """``k, s, n_chars, n_bytes, why, shape, closed, blank`` of the latest delivery of each key, blank texts left out.

    Only what the automaton says about a text is shuffled, not the text.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [inspect(t) if t and not t.isspace() else ("", "", None) for t in b["t"]]
            out = b[["k", "s", "n_chars", "n_bytes", "at", "h"]].copy()
            out["why"], out["shape"], out["closed"] = ([x[i] for x in seen] for i in range(3))
            out["blank"] = [bool(t) and t[-1].isspace() for t in b["t"]]
            yield out

    kind = dict(rows.dtypes)
    moment = F.unix_micros(F.col(at).cast("timestamp")) if at else F.lit(None).cast("bigint")
    given = rows.where(F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(source).alias("s"), F.length(text).alias("n_chars"), F.octet_length(text).alias("n_bytes"),
        F.coalesce(moment, F.lit(-1)).alias("at"), F.xxhash64(source, text).alias("h"), F.col(text).alias("t"),
    )
    seen = given.mapInPandas(run, f"k {kind[key]}, s {kind[source]}, n_chars int, n_bytes int, at bigint, h bigint, why string, shape string, closed boolean, blank boolean")
    row = F.struct("s", "n_chars", "n_bytes", "why", "shape", "closed", "blank")
    one = seen.groupBy("k").agg(F.max_by(row, F.struct("at", "h")).alias("r"))
    return one.select("k", "r.*").where(F.col("closed").isNotNull())


def _hash(*cols: str) -> Column:
    return F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())])


def judged(rows: DataFrame, key: str = "rollout_id", source: str = "run_label", text: str = "final_answer", at: str | None = "loaded_at") -> DataFrame:
    """``key, source, truncated, why`` for each text that is not blank."""
    seen = cut(inspected(rows, key, source, text, at).withColumns({"sh": _hash("s"), "ph": _hash("s", "shape")}))
    # sources and shapes are judged in a table of their own, which then meets the rows once
    ends = seen.groupBy("s", "sh", "shape", "ph").agg(F.count(F.lit(1)).alias("n"), F.count_if("blank").alias("blanks"), F.count_if("closed").alias("complete"))
    ends = cut(ends.withColumn("before", F.when(F.col("shape") != "", F.col("complete")).otherwise(0)))
    of = F.struct((F.sum("blanks") < RARE * F.sum("n")).alias("rare"), F.sum("complete").alias("complete"))
    sources = ends.groupBy(F.col("s").alias("bs"), "sh").agg(of.alias("source"))
    everywhere = ends.agg(F.coalesce(F.sum("complete"), F.lit(0))).first()[0]
    pooled = ends.where("shape != ''").groupBy("shape").agg(F.sum("before").alias("pooled"))
    known = skew.joined(ends, sources, ["sh"], "shape").where(F.col("s").eqNullSafe(F.col("bs"))).join(pooled, "shape", "left")
    enough = lambda n, complete: n >= F.greatest(F.lit(float(SUPPORT)), SUPPORT_SHARE * complete)
    proper = F.when(F.col("source.complete") > 0, enough(F.col("before"), F.col("source.complete"))).otherwise(enough(F.coalesce("pooled", F.lit(0)), F.lit(everywhere)))
    known = known.select(F.col("s").alias("ks"), F.col("shape").alias("kshape"), "ph", proper.alias("proper"), F.col("source.rare").alias("rare"))
    fit = skew.joined(seen, known, ["ph"], "k").where(F.col("s").eqNullSafe(F.col("ks")) & (F.col("shape") == F.col("kshape")))
    why = (
        F.when(~F.col("closed") & F.col("blank") & F.col("rare") & ((F.col("why") == "") | F.col("why").isin("no terminator", "mark")), "blank end")
        .when(F.col("why").isin("no terminator", "mark") & F.col("proper"), "")
        .otherwise(F.col("why"))
    )
    fit = cut(fit.select("k", "s", "n_chars", "n_bytes", "closed", why.alias("why"), *[_hash("s", x).alias(f"h_{x}") for x in ("n_chars", "n_bytes")]))
    out = fit
    for size in ("n_chars", "n_bytes"):
        counts = fit.where("not closed").groupBy("s", size, f"h_{size}").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("why") != "").alias("open"))
        near = Window.partitionBy("s").orderBy(size).rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
        around = (F.sum("n").over(near) - F.col("n")) / (2 * LIMIT_AROUND)
        full = (F.col("n") >= LIMIT_ROWS) & (F.col("n") >= LIMIT_TIMES * F.col("around")) & (F.col("open") >= LIMIT_OPEN * F.col("n"))
        spikes = counts.withColumn("around", around).where(full).select(f"h_{size}", F.struct("s", size).alias(f"at_{size}"))
        out = skew.joined(out, spikes, [f"h_{size}"], "k", how="left", hot=skew.hot_values(fit, f"h_{size}"))
        same = F.col(f"at_{size}.s").eqNullSafe(F.col("s")) & (F.col(f"at_{size}.{size}") == F.col(size))
        out = out.withColumn(f"at_{size}", F.col(f"at_{size}").isNotNull() & same)
    at = ~F.col("closed") & (F.col("at_n_chars") | F.col("at_n_bytes"))
    reason = F.when((F.col("why") == "") & at, "field limit").otherwise(F.col("why"))
    return out.select(F.col("k").alias(key), F.col("s").alias(source), (reason != "").alias("truncated"), reason.alias("why"))


def shares(rows: DataFrame, source: str = "run_label") -> DataFrame:
    """Texts, truncated texts and their share for each source."""
    out = judged(rows).groupBy(source).agg(F.count(F.lit(1)).alias("texts"), F.count_if("truncated").alias("truncated"))
    return out.withColumn("share", F.col("truncated") / F.col("texts"))
