"""Operators on the code graph: one DataFrame of symbols, one of edges.

Edges carry both directions: callers join on ``dst_*``, callees on ``src_*``. All orders are total, so that
every result is the same on every run. Null key parts match nothing; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symweave.functions.paths import has_suffix, is_test_path
from symweave.operators import skew
from symweave.runtime import cut
from symweave.schema import KEY

DST, SRC = [f"dst_{k}" for k in KEY], [f"src_{k}" for k in KEY]


def _as(df: DataFrame, names: list[str], prefix: str) -> DataFrame:
    return df.select(*[F.col(f"{prefix}_{k}").alias(k) for k in KEY], *names)


def centrality(edges: DataFrame) -> DataFrame:
    """In-degree of every edge target, over all kinds of edges."""
    return _as(edges.where("dst_file is not null and dst_name is not null and dst_kind is not null"), [], "dst").groupBy(*KEY).agg(F.count(F.lit(1)).alias("in_degree"))


def ranked(symbols: DataFrame, central: DataFrame) -> DataFrame:
    """Symbols with ``in_degree`` (0 where nothing points)."""
    return symbols.join(central, KEY, "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))


def by_centrality(prefix: str = "") -> list[Column]:
    """The order of hits: most central first, ties by place."""
    return [F.desc("in_degree"), *[F.col(prefix + c).asc_nulls_first() for c in ("file", "line_start", "name", "kind")]]


def with_rank(df: DataFrame, order: list[Column], limit: int | None = None, first: int = 1) -> DataFrame:
    """Rows with their place in the order; with a limit, the plan keeps only so many rows for each task."""
    if limit is not None:
        df = df.orderBy(*order).limit(limit)
    return df.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) + F.lit(first - 1)).cast("int"))


def callers(edges: DataFrame, targets: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges that point at one of the targets (``file, name, kind``)."""
    chosen = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return chosen.join(targets.select(*[F.col(k).alias(d) for k, d in zip(KEY, DST)]).distinct(), DST, "left_semi")


def callees(edges: DataFrame, sources: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Edges that start at one of the sources."""
    chosen = edges if kinds is None else edges.where(F.col("kind").isin(kinds))
    return chosen.join(sources.select(*[F.col(k).alias(d) for k, d in zip(KEY, SRC)]).distinct(), SRC, "left_semi")


def endpoint_symbols(edges: DataFrame, symbols: DataFrame, side: str) -> DataFrame:
    """The symbols at one end (``src`` or ``dst``) of edges, with the edge's line; dangling ends drop out.

    Where several edges join the same two symbols, the one with the largest line counts.
    """
    ends = _as(edges, ["line"], side).groupBy(*KEY).agg(F.max("line").alias("edge_line"))
    return symbols.join(ends, KEY)


def callers_relaxed(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Callers of each target by its full key; where there are none, by file and name whatever the kind.

    Columns: the target's ``file, name, kind``, the edge's ``src_*`` and ``line``, and ``tier`` (0 exact, 1 relaxed).
    Which targets have exact callers is told by the distinct ends of the edges; the edges themselves meet the
    targets once, those of frequent ends in several tasks.
    """
    t = targets.select(*KEY).where("file is not null and name is not null").distinct()
    ends = edges.select(*[F.col(d).alias(k) for d, k in zip(DST, KEY)]).distinct().withColumn("tier", F.lit(0))
    t = t.join(ends, KEY, "left").withColumn("tier", F.coalesce("tier", F.lit(1))).withColumn("h", F.xxhash64("file", "name"))
    e = edges.where("dst_file is not null and dst_name is not null").select(*DST, *SRC, "line", F.xxhash64("dst_file", "dst_name").alias("h"))
    same = (F.col("dst_file") == F.col("file")) & (F.col("dst_name") == F.col("name")) & ((F.col("tier") == 1) | (F.col("dst_kind") == F.col("kind")))
    return skew.joined(e, t, ["h"], "src_name").where(same).select(*KEY, *SRC, "line", "tier")


def find_by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of that name; only if there are none, those within two edits. ``distance`` tells which."""
    exact = symbols.where(F.col("name") == name).withColumn("distance", F.lit(0))
    near = symbols.where(F.abs(F.length("name") - F.lit(len(name))) <= 2).withColumn("distance", F.levenshtein("name", F.lit(name), 2)).where("distance >= 0")
    return near if exact.isEmpty() else exact


def best_match(symbols: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """The most central symbol of a name, as at most one row, which is known to the driver.

    Only edges that point at the name are counted; symbols within two edits are looked for where there is none.
    """
    exact = ranked(symbols.where(F.col("name") == name), centrality(edges.where(F.col("dst_name") == name)))
    row = exact.orderBy(*by_centrality()).first()
    if row is None:
        row = ranked(find_by_name(symbols, name), centrality(edges)).orderBy(*by_centrality()).select(*exact.columns).first()
    return few(exact, [] if row is None else [row])


def few(like: DataFrame, rows: list) -> DataFrame:
    """Rows that the driver has, as a table of the same columns."""
    return like.sparkSession.createDataFrame([tuple(r) for r in rows], like.schema)


def pointing_at(edges: DataFrame, row: Row) -> DataFrame:
    """Edges that point at one symbol."""
    return edges.where((F.col("dst_file") == row.file) & (F.col("dst_name") == row.name) & (F.col("dst_kind") == row.kind))


def exports_of(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.where((F.col("file") == file) & (F.col("visibility") == "Export"))


def _certain_imports(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("kind") == "Imports") & (F.col("confidence") == "Certain"))


def imports_of(edges: DataFrame, file: str) -> DataFrame:
    """Certain imports that leave a file's module anchor."""
    return _certain_imports(edges).where((F.col("src_file") == file) & (F.col("src_kind") == "Module"))


def importers_of(edges: DataFrame, file: str) -> DataFrame:
    """Certain imports that point at a file's module anchor."""
    return _certain_imports(edges).where((F.col("dst_file") == file) & (F.col("dst_name") == "") & (F.col("dst_kind") == "Module"))


def tests_for(edges: DataFrame, file: str) -> DataFrame:
    """Importers of a file whose own path is a test path."""
    return importers_of(edges, file).where(is_test_path(F.col("src_file")))


def libraries(imports: DataFrame, internal: list[str] = ()) -> DataFrame:
    """Import sites for each library, without the project's own packages."""
    outside = imports.where(F.col("library").isNotNull())
    if internal:
        outside = outside.where(~F.col("library").isin(*internal))
    return outside.groupBy("library").agg(F.count(F.lit(1)).alias("uses"))


# ---------------------------------------------------------------- traversal


def bfs(edges: DataFrame, start: DataFrame, max_depth: int | None = None, stop: Callable[[DataFrame], DataFrame] | None = None) -> list[DataFrame]:
    """Levels of a breadth-first walk along edges of all kinds: ``file, name, kind`` and the parent's ``p_*``.

    The adjacency is written to the shared folder once, partitioned by its source, so that a level's join
    moves the frontier and not the edges. The parent of a node is the smallest of its discoverers. The walk ends with the level in which ``stop`` finds a row,
    else with the last node reached, or after ``max_depth`` levels where that is given.
    """
    parents = [f"p_{k}" for k in KEY]
    adjacent = edges.where("dst_file is not null and dst_name is not null and dst_kind is not null").select(*SRC, *DST).repartition(*SRC).distinct()
    adjacent = cut(adjacent)
    level = cut(start.select(*KEY).distinct().select(*KEY, *[F.lit(None).cast("string").alias(p) for p in parents]))
    levels = [level]
    seen = level.select(*KEY)
    while max_depth is None or len(levels) <= max_depth:
        if level.isEmpty() or (stop is not None and not stop(level).isEmpty()):
            break
        step = adjacent.join(level.select(*[F.col(k).alias(s) for k, s in zip(KEY, SRC)]), SRC)
        reached = step.groupBy(*DST).agg(F.min(F.struct(*SRC)).alias("p"))
        fresh = reached.select(*[F.col(d).alias(k) for k, d in zip(KEY, DST)], *[F.col(f"p.{s}").alias(p) for s, p in zip(SRC, parents)])
        level = cut(fresh.join(seen, KEY, "left_anti"))
        levels.append(level)
        seen = seen.unionByName(level.select(*KEY))
        if len(levels) % 16 == 0:  # keeps the plans of long walks short
            seen = cut(seen.coalesce(16))
    return levels if not levels[-1].isEmpty() else levels[:-1]


def depths(levels: list[DataFrame]) -> DataFrame:
    """``file, name, kind, depth`` of all reached nodes."""
    out = None
    for d, level in enumerate(levels):
        part = level.select(*KEY, F.lit(d).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out


def shortest_path(edges: DataFrame, start: DataFrame, goal: Callable[[DataFrame], DataFrame], max_depth: int | None = None) -> DataFrame | None:
    """``step, file, name, kind`` of a shortest path to the first level with a goal; None where there is none.

    Among goals of one level the smallest key is taken. A start that is a goal gives a path of one step.
    """
    levels = bfs(edges, start, max_depth, goal)
    if not levels:
        return None
    node = goal(levels[-1]).orderBy(*KEY).limit(1).collect()
    if not node:
        return None
    steps = []
    row = node[0]
    for d in range(len(levels) - 1, -1, -1):
        steps.append((d, row.file, row.name, row.kind))
        if d:
            is_parent = (F.col("file") == row.p_file) & (F.col("name") == row.p_name) & (F.col("kind") == row.p_kind)
            row = levels[d - 1].where(is_parent).first()
    return edges.sparkSession.createDataFrame(steps[::-1], "step int, file string, name string, kind string")


def to_symbol(name: str) -> Callable[[DataFrame], DataFrame]:
    return lambda level: level.where(F.col("name") == name)


def to_file(suffix: str) -> Callable[[DataFrame], DataFrame]:
    return lambda level: level.where(has_suffix(F.col("file"), suffix))


def siblings(edges: DataFrame, path: DataFrame, suffix: str) -> DataFrame:
    """Call targets of the nodes of a path that lie in a file and are not on the path."""
    calls = callees(edges, path, ["Calls"]).where(has_suffix(F.col("dst_file"), suffix))
    return _as(calls, [], "dst").distinct().join(path.select(*KEY), KEY, "left_anti")


# ---------------------------------------------------------------- outline


def function_name(signature: Column) -> Column:
    """The name in a signature: the last word before the parameters."""
    head = F.regexp_replace(F.substring_index(signature, "(", 1), r"^fn ", "")
    return F.regexp_extract(head, r"(\S+)\s*$", 1)


def outline(symbols: DataFrame) -> DataFrame:
    """Entries of every file's outline: ``file, entry, line, label, group, members``.

    Functions and methods in line order. Runs of two or more methods become one entry, then runs of private
    functions, then runs of ``test_`` functions; a later symbol of a name already seen in the file is tagged
    as a test. ``group`` is function, method, helper or test. Files are independent: each is one window.
    """
    per_file = Window.partitionBy("file").orderBy("line", "name", "kind")
    rows = symbols.where(F.col("kind").isin("Function", "AsyncFunction", "Method")).select(
        "file", F.col("line_start").alias("line"), "name", "kind",
        F.coalesce(F.regexp_replace("signature", r"(?s)(\)).*$", "$1"), F.col("name")).alias("signature"),
        (F.col("kind") == "Method").alias("is_method"),
        ((F.col("kind") != "Method") & (F.coalesce("visibility", F.lit("")) == "Private")).alias("is_private"),
    )
    seen = F.row_number().over(Window.partitionBy("file", "name").orderBy("line", "kind")) > 1
    rows = rows.withColumn("label", F.when(seen, F.concat(F.lit("[test] "), "signature")).otherwise(F.col("signature")))
    rows = rows.withColumn("run", F.when(F.col("is_method"), 1).when(F.col("is_private"), 2).when(F.startswith("name", F.lit("test_")), 3).otherwise(0))
    changed = (F.col("run") == 0) | (F.coalesce(F.lag("run").over(per_file), F.lit(-1)) != F.col("run"))
    rows = rows.withColumn("island", F.sum(changed.cast("int")).over(per_file))
    found = rows.groupBy("file", "island", "run").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by(F.struct("line", "label"), F.struct("line", "name", "kind")).alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "name", "kind"))), lambda x: x["name"]), ", ").alias("names"),
    )
    many = F.col("members") > 1
    label = (
        F.when(many & (F.col("run") == 1), F.format_string("impl { (%d methods) }", "members"))
        .when(many & (F.col("run") == 2), F.concat(F.lit("[helpers] "), "names"))
        .when(many & (F.col("run") == 3), F.format_string("[test] (%d functions)", "members"))
        .otherwise(F.col("first.label"))
    )
    group = F.when(many & (F.col("run") == 1), "method").when(F.startswith(label, F.lit("[test]")), "test").when(many & (F.col("run") == 2), "helper").otherwise("function")
    entry = F.row_number().over(Window.partitionBy("file").orderBy("island"))
    return found.select("file", entry.alias("entry"), F.col("first.line").alias("line"), label.alias("label"), group.alias("group"), "members")


def outline_headers(entries: DataFrame) -> DataFrame:
    """The summary line of each file's outline."""
    n = entries.groupBy("file").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("group") == g).alias(g) for g in ("function", "method", "test", "helper")])
    said = {"function": "functions", "method": "method groups", "test": "test groups", "helper": "helper groups"}
    parts = F.filter(F.array(*[F.when(F.col(g) > 0, F.format_string(f"%d {text}", g)) for g, text in said.items()]), lambda x: x.isNotNull())
    return n.select("file", F.format_string("%d entries (%s)", "n", F.array_join(parts, ", ")).alias("header"))
