"""What a change breaks: symbol diff, cascade warnings, context.

Symbol tables before and after a change are compared on ``file, name, kind``; ``AsyncFunction`` counts as
``Function`` there, so that a function turning async is a change and not a removal with an addition. Values
are compared with nulls equal to nulls. Warnings list at most ten places; the lists are ordered and cut in
the aggregation buffers of their own target, callers are counted exactly whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import is_test_path
from symweave.functions.render import clamp
from symweave.operators import graph, skew
from symweave.runtime import cut
from symweave.schema import KEY

LISTED = 10


def base_kind(kind: Column) -> Column:
    return F.when(kind == "AsyncFunction", "Function").otherwise(kind)


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``file, name, kind, change_class`` and the old and new values of all symbols of either table.

    Classes: added, removed, modified_sig (signature, return type, parameters or async differ),
    modified_body (only the hash differs), same. Repeated symbols count once, with the smallest line.
    """
    fields = ["signature", "params", "return_type", "is_async", "visibility", "body_hash", "line_start", "line_end"]

    def side(df: DataFrame, name: str) -> DataFrame:
        have = [c for c in fields if c in df.columns]
        row = F.struct(*[F.col(c) for c in have], F.col("kind").alias("own_kind"))
        first = F.struct("line_start", "kind") if "line_start" in have else F.struct("kind")
        return df.groupBy("file", "name", base_kind(F.col("kind")).alias("kind")).agg(F.min_by(row, first).alias(name))

    both = side(old, "old").join(side(new, "new"), KEY, "full_outer")
    signed = [c for c in ("signature", "return_type", "is_async", "params") if c in old.columns and c in new.columns]
    changed = F.lit(False)
    for c in signed:
        changed = changed | ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    kind = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(changed, "modified_sig")
        .when(~F.col("old.body_hash").eqNullSafe(F.col("new.body_hash")), "modified_body")
        .otherwise("same")
    )
    return both.select(*KEY, kind.alias("change_class"), "old", "new")


def diff_summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_class").agg(F.count(F.lit(1)).alias("n"))


def listed(rows: DataFrame, key: list[str], place: Column, most: int = LISTED) -> DataFrame:
    """``key, n, listed``: the number of distinct places of a key and the first ten of them as text.

    Places are made distinct first, by key and place, which spreads the places of a hot key; the ten first
    are then chosen in two steps, within hashed parts of a key and over the parts' firsts.
    """
    one = rows.select(*key, place.alias("place")).distinct()
    counts = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    firsts = skew.top_of(one, key, [F.col("place")], most, "place", "r").groupBy(*key).agg(F.array_sort(F.collect_list("place")).alias("places"))
    both = counts.join(firsts, key)
    more = F.when(F.col("n") > most, F.format_string(" (+%d more)", F.col("n") - most)).otherwise("")
    return both.select(*key, "n", F.concat(F.array_join("places", ", "), more).alias("listed"))


def _place() -> Column:
    return F.format_string("%s:%s", "src_file", "src_name")


def _found(changes: DataFrame, classes: list[str]) -> DataFrame:
    return changes.where(F.col("change_class").isin(classes)).select(*KEY, "old", "new", F.coalesce("new.own_kind", "old.own_kind").alias("own_kind"))


def _warning(kind: str, df: DataFrame, body: Column) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), "file", "name", F.col("own_kind").alias("symbol_kind"), clamp(body).alias("body"))


def _by_name(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst_file").alias("file"), F.col("dst_name").alias("name"), F.col("dst_kind"), "src_file", "src_name", "src_kind", F.col("kind").alias("edge_kind"))


def warn_signature(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """SIGNATURE: a changed signature with at least one caller (of any kind of the name if none has the exact one)."""
    found = _found(changes, ["modified_sig"])
    targets = found.select("file", "name", F.col("own_kind").alias("kind"))
    hits = graph.callers_relaxed(edges, targets).withColumnRenamed("kind", "own_kind")
    sites = listed(hits, ["file", "name", "own_kind"], _place())
    df = found.join(sites, ["file", "name", "own_kind"])
    return _warning("SIGNATURE", df, F.format_string("%s changed its signature; %d caller%s may break: %s", "name", "n", F.when(F.col("n") == 1, "").otherwise("s"), "listed"))


def warn_async(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """ASYNC_CHANGE: the async flag flipped, with the number of callers, which may be 0."""
    found = _found(changes, ["modified_sig"]).where(~F.col("old.is_async").eqNullSafe(F.col("new.is_async")))
    hits = graph.callers_relaxed(edges, found.select("file", "name", F.col("own_kind").alias("kind"))).withColumnRenamed("kind", "own_kind")
    n = hits.select("file", "name", "own_kind", *graph.SRC).distinct().groupBy("file", "name", "own_kind").agg(F.count(F.lit(1)).alias("n"))
    df = found.join(n, ["file", "name", "own_kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    now = F.when(F.col("new.is_async"), "async").otherwise("sync")
    return _warning("ASYNC_CHANGE", df, F.format_string("%s is now %s; %d caller%s must be checked", "name", now, "n", F.when(F.col("n") == 1, "").otherwise("s")))


def warn_orphan(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """ORPHAN: a removed symbol that edges still point at, by file and name."""
    found = _found(changes, ["removed"])
    sites = listed(_by_name(edges).where("src_file is not null and src_name is not null"), ["file", "name"], _place())
    df = found.join(sites, ["file", "name"])
    return _warning("ORPHAN", df, F.format_string("%s was removed; %d caller%s still refer to it: %s", "name", "n", F.when(F.col("n") == 1, "").otherwise("s"), "listed"))


def warn_interface(changes: DataFrame, edges: DataFrame, edge_kind: str = "Implements") -> DataFrame:
    """INTERFACE_BREAK: a changed interface or trait with at least one implementor."""
    found = _found(changes, ["modified_sig"]).where(F.col("kind").isin("Interface", "Trait"))
    impl = _by_name(edges).where(F.col("edge_kind") == edge_kind).withColumnRenamed("dst_kind", "own_kind")
    sites = listed(impl, ["file", "name", "own_kind"], _place())
    df = found.join(sites, ["file", "name", "own_kind"])
    return _warning("INTERFACE_BREAK", df, F.format_string("%s changed; %d implementor%s may break: %s", "name", "n", F.when(F.col("n") == 1, "").otherwise("s"), "listed"))


def warn_param_order(changes: DataFrame) -> DataFrame:
    """PARAM_ORDER: the same parameters in another order."""
    found = _found(changes, ["modified_sig"])
    same = (F.array_sort("old.params") == F.array_sort("new.params")) & (F.col("old.params") != F.col("new.params"))
    return _warning("PARAM_ORDER", found.where(same), F.format_string("%s has its parameters in another order: (%s) -> (%s)", "name", F.array_join("old.params", ", "), F.array_join("new.params", ", ")))


def warn_visibility(changes: DataFrame) -> DataFrame:
    """VISIBILITY: an exported or public symbol became less visible."""
    level = lambda c: F.when(c == "Export", 3).when(c == "Public", 2).when(c == "Default", 1).otherwise(0)
    found = changes.where("old is not null and new is not null").select(*KEY, "old", "new", F.col("new.own_kind").alias("own_kind"))
    less = level(F.col("new.visibility")) < level(F.col("old.visibility"))
    return _warning("VISIBILITY", found.where(less), F.format_string("%s went from %s to %s", "name", "old.visibility", F.coalesce("new.visibility", F.lit("none"))))


def in_cycle(edges: DataFrame, start: DataFrame) -> bool:
    """CIRCULAR_DEP: whether a walk from a symbol comes back to it."""
    first = graph.callees(edges, start).select(*[F.col(d).alias(k) for k, d in zip(KEY, graph.DST)]).where("file is not null and name is not null and kind is not null").distinct()
    row = start.select(*KEY).first()
    if row is None:
        return False
    goal = lambda level: level.where((F.col("file") == row.file) & (F.col("name") == row.name) & (F.col("kind") == row.kind))
    levels = graph.bfs(edges, first, stop=goal)
    return bool(levels) and not goal(levels[-1]).isEmpty()


def warn_reexports(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """REEXPORT_CHAIN: a removed or changed symbol that other files pass on, directly or through further re-exports."""
    found = cut(_found(changes, ["removed", "modified_sig"]))
    passed = edges.where("kind = 'ReExports' and dst_file is not null and dst_name is not null and src_file is not null and src_name is not null")
    step = cut(passed.select(F.col("dst_file").alias("at_file"), F.col("dst_name").alias("at_name"), "src_file", "src_name").distinct())
    here = found.select("file", "name", "own_kind", F.col("file").alias("at_file"), F.col("name").alias("at_name"))
    seen, reached, steps = here, None, 0
    while True:
        further = here.join(step, ["at_file", "at_name"]).select("file", "name", "own_kind", F.col("src_file").alias("at_file"), F.col("src_name").alias("at_name")).distinct()
        here = cut(further.join(seen, seen.columns, "left_anti"))
        if here.isEmpty():
            break
        seen = seen.unionByName(here)
        reached = here if reached is None else reached.unionByName(here)
        steps += 1
        if steps % 16 == 0:  # keeps the plans of long chains short
            seen, reached = cut(seen.coalesce(16)), cut(reached.coalesce(16))
    if reached is None:
        return _warning("REEXPORT_CHAIN", found.limit(0), F.lit(""))
    sites = listed(reached, ["file", "name", "own_kind"], F.format_string("%s:%s", "at_file", "at_name"))
    return _warning("REEXPORT_CHAIN", found.join(sites, ["file", "name", "own_kind"]), F.format_string("%s is passed on by %d other name%s: %s", "name", "n", F.when(F.col("n") == 1, "").otherwise("s"), "listed"))


def warnings(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """All warnings of the four cascades."""
    parts = [warn_signature(changes, edges), warn_async(changes, edges), warn_orphan(changes, edges), warn_interface(changes, edges)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def warning_summary(found: DataFrame) -> DataFrame:
    """One row: warnings by kind, in alphabetical order, or a text that there are none."""
    n = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    parts = F.array_sort(F.collect_list(F.format_string("%s: %d", "kind", "n")))
    return n.agg(F.when(F.count(F.lit(1)) == 0, "no warnings").otherwise(F.array_join(parts, ", ")).alias("summary"))


def context_bundle(changed: DataFrame, edges: DataFrame, symbols: DataFrame, per_symbol: int = 5, most: int = 10) -> DataFrame:
    """Callers of changed symbols: at most five for each, by centrality, and ten altogether."""
    hits = graph.callers_relaxed(edges, changed).select(*[F.col(k).alias(f"of_{k}") for k in KEY], *[F.col(s).alias(k) for s, k in zip(graph.SRC, KEY)]).distinct()
    full = graph.ranked(hits.join(symbols.select(*KEY, "line_start", "signature"), KEY), graph.centrality(edges))
    firsts = skew.top_of(full, ["of_file", "of_name", "of_kind"], [F.desc("in_degree"), *map(F.col, KEY), F.col("line_start")], per_symbol, "name")
    top = firsts.orderBy("of_file", "of_name", "of_kind", "n").limit(most)
    return top.select("of_file", "of_name", "of_kind", "n", *KEY, "line_start", "in_degree")


def test_importers(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Test files that import one of the files (column ``file``), distinct and in order."""
    certain = edges.where((F.col("kind") == "Imports") & (F.col("confidence") == "Certain") & is_test_path(F.col("src_file")))
    hit = certain.join(files.select(F.col("file").alias("dst_file")).distinct(), "dst_file", "left_semi")
    return hit.select(F.col("src_file").alias("file")).distinct()
