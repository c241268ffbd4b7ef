"""From a text query to a lazy DataFrame of hits (``rank, file, line, signature, snippet, context, is_hint``)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.paths import basename, has_suffix
from symweave.functions.render import without_return_type
from symweave.operators import graph, textscan
from symweave.plans.classify import CAPS, Query, classify, is_path_like, safe_pattern
from symweave.runtime import cut
from symweave.schema import HITS, KEY


# The notes of answers, which callers of the query language may rely on.
NO_SYMBOL = "no symbol named '{name}' found; try `find {name}` for fuzzy matches or grep across files"
NO_SYMBOL_IN_CHAIN = "no symbol named '{name}' found; try `find {name}` for fuzzy matches"
IMPORTER = "cross-file importer — file imports `{file}`; grep `{name}` here for call sites"
NO_IMPORTS = 'no internal imports in the graph; use grep for "use X::"'
NO_TESTS = "no same-file tests found; use grep for 'test_{subject}'"
NO_FILE = "no symbols indexed in {target}; try `outline of {target}` or check the path spelling"
NO_PATH_TO_FILE = "no call-graph path from {name} to any symbol in {target}; try `callees of {name}` then filter by file"
NO_PATH = "no call-graph path from {name} to {target}; re-export chains and dynamic dispatch are not followed"
MORE_SIBLINGS = "{over} more candidate symbols in {target} truncated; use `outline of {target}` for the full list"


@dataclass
class Graph:
    """The relations of a code graph. Paths in queries are relative to the root as those in the tables are."""

    symbols: DataFrame
    edges: DataFrame
    library_imports: DataFrame | None = None
    files: DataFrame | None = None
    internal_packages: list[str] = field(default_factory=list)
    _central: DataFrame | None = None

    @property
    def central(self) -> DataFrame:
        if self._central is None:
            self._central = graph.centrality(self.edges)
        return self._central


def _hits(df: DataFrame, signature: Column, line: str = "line_start", context: Column | None = None) -> DataFrame:
    return df.select(
        "rank", "file", F.col(line).cast("int").alias("line"), signature.alias("signature"),
        F.lit(None).cast("string").alias("snippet"), (F.lit(None) if context is None else context).cast("string").alias("context"), F.lit(False).alias("is_hint"),
    )


def _hint(df: DataFrame, text: Column, rank: int = 0) -> DataFrame:
    """One row of text computed from an aggregate of one row."""
    return df.select(F.lit(rank).alias("rank"), F.lit("").alias("file"), F.lit(0).alias("line"), text.alias("signature"), F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("context"), F.lit(True).alias("is_hint"))


def _note(spark, text: str, rank: int = 0) -> DataFrame:
    return spark.createDataFrame([(rank, "", 0, text, None, None, True)], HITS)


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))


def _signature() -> Column:
    return without_return_type(F.coalesce("signature", "name"))


def search(g: Graph, text: str) -> DataFrame:
    """Hits of a text query."""
    q = classify(text)
    return {
        "callers": lambda: callers(g, q.subject, q.with_context),
        "callees": lambda: callees(g, q.subject),
        "outline": lambda: outline(g, q.subject),
        "chain": lambda: chain(g, q.subject, q.target),
        "find": lambda: find(g, q.subject),
        "tests": lambda: tests(g, q.subject),
        "imports": lambda: imports(g, q.subject),
        "importers": lambda: importers(g, q.subject),
        "exports": lambda: exports(g, q.subject),
        "libraries": lambda: libraries(g),
        "grep": lambda: grep(g, q.subject),
    }[q.kind]()


def find(g: Graph, name: str, most: int = CAPS["find"]) -> DataFrame:
    """Symbols of a name, most central first, under a header; text hits where there is no such symbol."""
    found = graph.find_by_name(g.symbols, name)
    if found.isEmpty():
        hits = grep(g, name)
        return hits.where(F.col("rank") <= most)
    order = [F.desc("in_degree"), "distance", *[F.col(c).asc_nulls_first() for c in ("file", "line_start", "name", "kind")]]
    top = cut(graph.with_rank(graph.ranked(found, g.central), order, most))
    names = F.array_sort(F.collect_set(basename(F.col("file"))))
    head = top.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("f"), names.alias("names"))
    listed = F.array_join(F.slice("names", 1, 3), ", ")
    where = (
        F.when(F.col("f") == 1, F.concat(F.lit(" in "), F.element_at("names", 1)))
        .when(F.col("f") <= 3, F.format_string(" across %d files (%s)", "f", listed))
        .otherwise(F.format_string(" across %d files (e.g. %s, +%d more)", "f", listed, F.col("f") - 3))
    )
    text = F.concat(F.lit("=== "), _plural(F.col("n"), "symbol"), F.lit(f" matching '{name}'"), where, F.lit(" ==="))
    return _hint(head, text).unionByName(_hits(top, _signature()))


def callers(g: Graph, name: str, with_context: bool = False, most: int = CAPS["callers"]) -> DataFrame:
    """Callers of the most central symbol of a name, then files that import its file without a caller in them."""
    spark = g.symbols.sparkSession
    best = graph.best_match(g.symbols, g.edges, name)
    target = best.first()
    if target is None:
        return _note(spark, NO_SYMBOL.format(name=name))
    ends = graph.endpoint_symbols(graph.pointing_at(g.edges, target), g.symbols, "src")
    order = graph.by_centrality()
    rows = graph.ranked(ends, g.central).orderBy(*order).limit(most).collect()
    top = graph.few(ends.withColumn("in_degree", F.lit(0).cast("bigint")).withColumn("rank", F.lit(0)), [(*r, i) for i, r in enumerate(rows, 1)])
    context = None
    shown = top
    if with_context and g.files is not None:
        content = g.files.select(F.col("path").alias("file"), "content")
        shown = top.join(content, "file", "left")
        body = textscan.enclosing_statement_udf("file", "content", "edge_line")
        args = textscan.call_arguments_udf("content", "edge_line", F.lit(target.name))
        context = F.when(body.isNotNull(), F.concat_ws("\n", F.concat(F.lit("// args: "), args), F.lit(f"// callee: {(target.signature or target.name).split('): ')[0]}" + (")" if "): " in (target.signature or "") else "")), body))
    known = sorted({r.file for r in rows} | {target.file})
    others = graph.importers_of(g.edges, target.file).where(~F.col("src_file").isin(known))
    hint = others.groupBy(F.col("src_file").alias("file")).agg(F.min("line").alias("line_start"))
    hint = graph.with_rank(hint, ["file"], first=most + 1)
    said = F.lit(IMPORTER.format(file=target.file, name=name))
    n, f = len(rows), len({r.file for r in rows})
    text = f"=== {n} caller{'' if n == 1 else 's'} of {name} in {f} file{'' if f == 1 else 's'} ===" if n else f"=== 0 callers of {name} ==="
    return _note(spark, text).unionByName(_hits(shown, _signature(), context=context)).unionByName(_hits(hint, said))


def callees(g: Graph, name: str, most: int = CAPS["callees"]) -> DataFrame:
    """Symbols that the most central symbol of a name refers to; nothing for an unknown name."""
    best = graph.best_match(g.symbols, g.edges, name)
    ends = graph.endpoint_symbols(graph.callees(g.edges, best), g.symbols, "dst")
    return _hits(graph.with_rank(graph.ranked(ends, g.central), graph.by_centrality(), most), _signature())


def outline(g: Graph, file: str, most: int = CAPS["outline"]) -> DataFrame:
    entries = graph.outline(g.symbols.where(F.col("file") == file))
    head = graph.outline_headers(entries)
    rows = entries.where(F.col("entry") < most).withColumnRenamed("entry", "rank")
    return _hint(head, F.col("header")).unionByName(_hits(rows, F.col("label"), "line"))


def exports(g: Graph, file: str, most: int = CAPS["exports"]) -> DataFrame:
    return _hits(graph.with_rank(graph.exports_of(g.symbols, file), ["line_start", "name", "kind"], most), F.coalesce("signature", "name"))


def _import_hits(edges: DataFrame, file: str, said: Column) -> DataFrame:
    rows = edges.select(F.col(file).alias("file"), F.col("line").alias("line_start"), said.alias("said"))
    return _hits(graph.with_rank(rows, ["file", "line_start"]), F.col("said"))


def imports(g: Graph, file: str) -> DataFrame:
    found = graph.imports_of(g.edges, file)
    if found.isEmpty():
        return _note(g.edges.sparkSession, NO_IMPORTS)
    return _import_hits(found, "dst_file", F.concat(F.lit("imports "), "dst_file"))


def importers(g: Graph, file: str) -> DataFrame:
    return _import_hits(graph.importers_of(g.edges, file), "src_file", F.concat(F.lit("imports "), "dst_file"))


def tests(g: Graph, subject: str) -> DataFrame:
    """Test files that import a file, or the file that declares a symbol."""
    spark = g.edges.sparkSession
    file = subject
    if "/" not in subject and "\\" not in subject:
        row = graph.best_match(g.symbols, g.edges, subject).first()
        file = row.file if row else None
    found = graph.tests_for(g.edges, file) if file else None
    if found is None or found.isEmpty():
        return _note(spark, NO_TESTS.format(subject=subject))
    return _import_hits(found, "src_file", F.concat(F.lit("imports "), "dst_file"))


def libraries(g: Graph, most: int = CAPS["libraries"]) -> DataFrame:
    used = graph.libraries(g.library_imports, g.internal_packages)
    rows = graph.with_rank(used, ["library"], most).select("rank", F.lit("").alias("file"), F.lit(0).alias("line_start"), F.format_string("%s (%d uses)", "library", "uses").alias("said"))
    return _hits(rows, F.col("said"))


def grep(g: Graph, text: str, most: int = CAPS["grep"]) -> DataFrame:
    """Matching lines by file and line under a header."""
    top = cut(textscan.grep_top(g.files, safe_pattern(text), most))
    head = top.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("f"))
    said = F.concat(F.lit("=== "), _plural(F.col("n"), "match").cast("string"), F.lit(" in "), _plural(F.col("f"), "file"), F.lit(" ==="))
    said = F.regexp_replace(said, "matchs", "matches")
    rows = graph.with_rank(top, ["file", "line"], most)
    hits = rows.select("rank", "file", "line", F.lit(None).cast("string").alias("signature"), "snippet", F.lit(None).cast("string").alias("context"), F.lit(False).alias("is_hint"))
    return _hint(head, said).unionByName(hits)


def chain(g: Graph, name: str, target: str, most: int = CAPS["siblings"]) -> DataFrame:
    """A shortest path from a symbol to a symbol or into a file, with the path's other call targets in that file."""
    spark = g.symbols.sparkSession
    start = graph.best_match(g.symbols, g.edges, name)
    if start.isEmpty():
        return _note(spark, NO_SYMBOL_IN_CHAIN.format(name=name))
    into_file = is_path_like(target)
    if into_file:
        if g.symbols.where(has_suffix(F.col("file"), target)).isEmpty():
            return _note(spark, NO_FILE.format(target=target))
        goal = graph.to_file(target)
    else:
        end = graph.best_match(g.symbols, g.edges, target)
        if end.isEmpty():
            return _note(spark, NO_SYMBOL_IN_CHAIN.format(name=target))
        wanted = end.first()
        goal = lambda level: level.where((F.col("file") == wanted.file) & (F.col("name") == wanted.name) & (F.col("kind") == wanted.kind))
    path = graph.shortest_path(g.edges, start, goal)
    if path is None:
        if into_file:
            return _hits(start.withColumn("rank", F.lit(1)), _signature()).unionByName(_note(spark, NO_PATH_TO_FILE.format(name=name, target=target), 2))
        ends = start.withColumn("rank", F.lit(1)).unionByName(end.withColumn("rank", F.lit(2)))
        return _hits(ends, _signature()).unionByName(_note(spark, NO_PATH.format(name=name, target=target), 3))
    steps = path.join(g.symbols, KEY).withColumn("rank", (F.col("step") + 1).cast("int"))
    hits = _hits(steps, _signature())
    if into_file:
        n = path.count()
        near = graph.ranked(g.symbols.join(graph.siblings(g.edges, path, target), KEY), g.central)
        hits = hits.unionByName(_hits(graph.with_rank(near, graph.by_centrality(), most, n + 1), _signature()))
        over = near.count() - most
        if over > 0:
            hits = hits.unionByName(_note(spark, MORE_SIBLINGS.format(over=over, target=target), n + most + 1))
    return hits



