"""Named queries of the graph, search, impact, resolution and incremental operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from symweave.functions.paths import has_suffix, is_test_path
from symweave.functions.render import without_return_type
from symweave.operators import graph, impact, incremental, resolve, textscan
from symweave.plans import views
from symweave.plans.search import Graph, search
from symweave.plans.views import CEN, DIFF, EDG, NEW, OLD, ORDER, RANKED, SYM, TEST_PATH
from symweave.runtime import cut, table
from symweave.schema import KEY
from symweave.streaming.pipeline import debounce

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

Q = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


BASE = f"WITH RECURSIVE {SYM}, {EDG}, {CEN}, {RANKED}"
START = ("prelude/boot/registry.ts", "installAll", "Function")


@query(f"{BASE} SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, name, kind, in_degree FROM ranked ORDER BY {ORDER} LIMIT 50")
def centrality_topk(spark, d):
    """F1 H1 H2: the most central symbols."""
    top = graph.ranked(views.symbols(spark, d, "line_start"), graph.centrality(views.edges(spark, d, *graph.DST)))
    return graph.with_rank(top, graph.by_centrality(), 50).select("rank", *KEY, "in_degree")


@query(f"""{BASE}, best AS (SELECT file, name, kind FROM ranked ORDER BY {ORDER} LIMIT 1),
    hit AS (SELECT src_file AS file, src_name AS name, src_kind AS kind, max(e.line) AS edge_line FROM edg e JOIN best b ON dst_file = b.file AND dst_name = b.name AND dst_kind = b.kind GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, name, kind, in_degree, edge_line FROM hit JOIN ranked USING (file, name, kind) ORDER BY {ORDER} LIMIT 10""")
def callers_topk(spark, d):
    """Callers of the most central symbol."""
    s, e = views.symbols(spark, d, "line_start"), views.edges(spark, d, *graph.SRC, *graph.DST, "line")
    central = graph.centrality(e)
    best = graph.ranked(s, central).orderBy(*graph.by_centrality()).limit(1)
    ends = graph.endpoint_symbols(graph.callers(e, best), s, "src")
    return graph.with_rank(graph.ranked(ends, central), graph.by_centrality(), 10).select("rank", *KEY, "in_degree", "edge_line")


@query(f"""{BASE}, best AS (SELECT src_file, src_name, src_kind FROM edg GROUP BY ALL ORDER BY count(*) DESC, 1, 2, 3 LIMIT 1),
    hit AS (SELECT dst_file AS file, dst_name AS name, dst_kind AS kind, max(e.line) AS edge_line FROM edg e JOIN best USING (src_file, src_name, src_kind) GROUP BY ALL)
    SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, name, kind, in_degree, edge_line FROM hit JOIN ranked USING (file, name, kind) ORDER BY {ORDER} LIMIT 10""")
def callees_topk(spark, d):
    """What the symbol with the most outgoing edges refers to."""
    s, e = views.symbols(spark, d, "line_start"), views.edges(spark, d, *graph.SRC, *graph.DST, "line")
    best = e.groupBy(*graph.SRC).count().orderBy(F.desc("count"), *graph.SRC).limit(1).select(*[F.col(x).alias(k) for x, k in zip(graph.SRC, KEY)])
    ends = graph.endpoint_symbols(graph.callees(e, best), s, "dst")
    return graph.with_rank(graph.ranked(ends, graph.centrality(e)), graph.by_centrality(), 10).select("rank", *KEY, "in_degree", "edge_line")


@query(f"""{BASE}, hit AS (SELECT t.file, t.name, t.kind, src_file, src_name, src_kind, line, CASE WHEN dst_kind = t.kind THEN 0 ELSE 1 END AS tier
        FROM edg JOIN (SELECT DISTINCT file, name, kind FROM sym) t ON dst_file = t.file AND dst_name = t.name WHERE dst_kind IS NOT NULL),
    best AS (SELECT *, min(tier) OVER (PARTITION BY file, name, kind) AS b FROM hit)
    SELECT file, name, kind, tier, count(*) AS n FROM best WHERE tier = b GROUP BY ALL""")
def callers_relaxed(spark, d):
    """Callers of every symbol by its full key, else by file and name."""
    hits = graph.callers_relaxed(views.edges(spark, d, *graph.SRC, *graph.DST, "line").where("dst_kind is not null"), views.symbols(spark, d, "kind"))
    return hits.groupBy(*KEY, "tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"{BASE} SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, name, kind, in_degree FROM ranked WHERE name = 'emit' ORDER BY {ORDER} LIMIT 5")
def find_exact(spark, d):
    """Symbols of a name."""
    found = graph.find_by_name(views.symbols(spark, d, "line_start"), "emit")
    return graph.with_rank(graph.ranked(found, graph.centrality(views.edges(spark, d, *graph.DST))), graph.by_centrality(), 5).select("rank", *KEY, "in_degree")


@query(f"""{BASE}, near AS (SELECT *, levenshtein(name, 'emitt') AS distance FROM ranked WHERE abs(length(name) - 5) <= 2 AND levenshtein(name, 'emitt') <= 2)
    SELECT row_number() OVER (ORDER BY in_degree DESC, distance, file NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, kind NULLS FIRST)::INT AS rank, file, name, kind, distance::INT AS distance, in_degree FROM near
    ORDER BY in_degree DESC, distance, file NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, kind NULLS FIRST LIMIT 5""")
def find_fuzzy(spark, d):
    """Names within two edits where no symbol has the name."""
    found = graph.ranked(graph.find_by_name(views.symbols(spark, d, "line_start"), "emitt"), graph.centrality(views.edges(spark, d, *graph.DST)))
    order = [F.desc("in_degree"), "distance", *[F.col(c).asc_nulls_first() for c in ("file", "line_start", "name", "kind")]]
    return graph.with_rank(found, order, 5).select("rank", *KEY, "distance", "in_degree")


_OUTLINE = f"""WITH {SYM}, f AS (SELECT file, line_start AS line, name, kind, coalesce(regexp_replace(signature, '(?s)(\\)).*$', '\\1'), name) AS signature,
        kind = 'Method' AS is_method, kind <> 'Method' AND coalesce(visibility, '') = 'Private' AS is_private,
        row_number() OVER (PARTITION BY file, name ORDER BY line_start, kind) > 1 AS seen FROM sym WHERE kind IN ('Function', 'AsyncFunction', 'Method')),
    r AS (SELECT *, CASE WHEN seen THEN '[test] ' || signature ELSE signature END AS label,
        CASE WHEN is_method THEN 1 WHEN is_private THEN 2 WHEN starts_with(name, 'test_') THEN 3 ELSE 0 END AS run FROM f),
    c AS (SELECT *, CASE WHEN run = 0 OR coalesce(lag(run) OVER (PARTITION BY file ORDER BY line, name, kind), -1) <> run THEN 1 ELSE 0 END AS changed FROM r),
    i AS (SELECT *, sum(changed) OVER (PARTITION BY file ORDER BY line, name, kind) AS island FROM c),
    g AS (SELECT file, island, run, count(*) AS members, arg_min(line, (line, name, kind)) AS line, arg_min(label, (line, name, kind)) AS first_label, string_agg(name, ', ' ORDER BY line, name, kind) AS names FROM i GROUP BY file, island, run),
    l AS (SELECT *, CASE WHEN members > 1 AND run = 1 THEN 'impl {{ (' || members || ' methods) }}' WHEN members > 1 AND run = 2 THEN '[helpers] ' || names WHEN members > 1 AND run = 3 THEN '[test] (' || members || ' functions)' ELSE first_label END AS label FROM g),
    o AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY island)::INT AS entry, line, label,
        CASE WHEN members > 1 AND run = 1 THEN 'method' WHEN starts_with(label, '[test]') THEN 'test' WHEN members > 1 AND run = 2 THEN 'helper' ELSE 'function' END AS "group", members FROM l)"""


@query(_OUTLINE + ' SELECT file, entry, line, label, "group", members FROM o')
def outline_collapse(spark, d):
    """The outlines of all files."""
    return graph.outline(views.symbols(spark, d, "line_start", "signature", "visibility"))


@query(
    _OUTLINE
    + """ SELECT file, count(*) || ' entries (' || array_to_string(list_filter([
        CASE WHEN count(*) FILTER ("group" = 'function') > 0 THEN count(*) FILTER ("group" = 'function') || ' functions' END,
        CASE WHEN count(*) FILTER ("group" = 'method') > 0 THEN count(*) FILTER ("group" = 'method') || ' method groups' END,
        CASE WHEN count(*) FILTER ("group" = 'test') > 0 THEN count(*) FILTER ("group" = 'test') || ' test groups' END,
        CASE WHEN count(*) FILTER ("group" = 'helper') > 0 THEN count(*) FILTER ("group" = 'helper') || ' helper groups' END], lambda x: x IS NOT NULL), ', ') || ')' AS header FROM o GROUP BY file"""
)
def outline_header(spark, d):
    """the summary lines of all outlines."""
    return graph.outline_headers(graph.outline(views.symbols(spark, d, "line_start", "signature", "visibility")))


@query(f"WITH {SYM}, best AS (SELECT file FROM sym GROUP BY file ORDER BY count(*) DESC, file LIMIT 1) SELECT row_number() OVER (ORDER BY line_start, name, kind)::INT AS rank, file, name, kind, line_start FROM sym JOIN best USING (file) WHERE visibility = 'Export' ORDER BY line_start, name, kind LIMIT 50")
def exports_of(spark, d):
    """Exports of the file with the most symbols."""
    s = views.symbols(spark, d, "line_start", "visibility")
    file = s.groupBy("file").count().orderBy(F.desc("count"), "file").first().file
    return graph.with_rank(graph.exports_of(s, file), ["line_start", "name", "kind"], 50).select("rank", *KEY, "line_start")


def _hub(e: DataFrame, column: str) -> str:
    certain = e.where("kind = 'Imports' and confidence = 'Certain'")
    return certain.groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


@query(f"WITH {EDG}, hub AS (SELECT src_file FROM edg WHERE kind = 'Imports' AND confidence = 'Certain' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT dst_file AS file, line, count(*) AS n FROM edg JOIN hub USING (src_file) WHERE kind = 'Imports' AND confidence = 'Certain' AND src_kind = 'Module' GROUP BY ALL")
def imports_of(spark, d):
    """Imports of the file that imports most."""
    e = views.edges(spark, d, "src_file", "src_kind", *graph.DST, "kind", "line", "confidence")
    return graph.imports_of(e, _hub(e, "src_file")).groupBy(F.col("dst_file").alias("file"), "line").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDG}, hub AS (SELECT dst_file FROM edg WHERE kind = 'Imports' AND confidence = 'Certain' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT src_file AS file, line, count(*) AS n FROM edg JOIN hub USING (dst_file) WHERE kind = 'Imports' AND confidence = 'Certain' AND dst_name = '' AND dst_kind = 'Module' GROUP BY ALL")
def importers_of(spark, d):
    """Importers of the file that is imported most."""
    e = views.edges(spark, d, "src_file", "src_kind", *graph.DST, "kind", "line", "confidence")
    return graph.importers_of(e, _hub(e, "dst_file")).groupBy(F.col("src_file").alias("file"), "line").agg(F.count(F.lit(1)).alias("n"))


_TESTED = f"WITH {EDG}, t AS (SELECT src_file, dst_file FROM edg WHERE kind = 'Imports' AND confidence = 'Certain' AND dst_name = '' AND dst_kind = 'Module' AND {TEST_PATH.format('src_file')})"


def _tested(e: DataFrame) -> DataFrame:
    certain = e.where("kind = 'Imports' and confidence = 'Certain' and dst_name = '' and dst_kind = 'Module'").where(is_test_path(F.col("src_file")))
    return certain.groupBy("dst_file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst_file").limit(5)


@query(_TESTED + " SELECT DISTINCT dst_file AS file, src_file AS test_file FROM t WHERE dst_file IN (SELECT dst_file FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5)")
def tests_for(spark, d):
    """The tests of the five files that tests import most."""
    e = views.edges(spark, d, "src_file", "src_kind", *graph.DST, "kind", "line", "confidence")
    found = None
    for file in [r.dst_file for r in _tested(e).collect()]:
        one = graph.tests_for(e, file).select(F.col("dst_file").alias("file"), F.col("src_file").alias("test_file"))
        found = one if found is None else found.unionByName(one)
    return (found if found is not None else e.select(F.col("dst_file").alias("file"), F.col("src_file").alias("test_file")).limit(0)).distinct()


def _library_rows(e: DataFrame) -> DataFrame:
    outside = e.where("kind = 'Imports' and confidence = 'Unresolved' and spec is not null").where(~F.startswith("spec", F.lit(".")))
    return outside.select(resolve.library_head(F.col("spec"), F.lit("typescript")).alias("library"), F.col("src_file").alias("file"), "line")


_LIBS = f"WITH {EDG}, lib AS (SELECT CASE WHEN starts_with(spec, '@') THEN regexp_extract(spec, '^(@[^/]+/[^/]+)', 1) ELSE split_part(spec, '/', 1) END AS library, src_file AS file, line FROM edg WHERE kind = 'Imports' AND confidence = 'Unresolved' AND spec IS NOT NULL AND NOT starts_with(spec, '.'))"


@query(_LIBS + " SELECT library, count(*) AS uses FROM lib WHERE library NOT IN ('graph') GROUP BY library")
def libraries(spark, d):
    """Imported packages with their sites."""
    return graph.libraries(_library_rows(views.edges(spark, d, "src_file", "kind", "line", "confidence", "spec")), ["graph"])


_GREP = "judge (reply|pass)"


@query(f"WITH l AS (SELECT source || '/' || doc_id AS file, unnest(string_split(regexp_replace(text, '\\r?\\n\\z', ''), chr(10))) AS text, generate_subscripts(string_split(regexp_replace(text, '\\r?\\n\\z', ''), chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL) SELECT file, line::INT AS line, substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 120) AS snippet FROM l WHERE regexp_matches(text, '{_GREP}') ORDER BY file, line LIMIT 30")
def grep_topk(spark, d):
    """A3 L3 H3: the first matching lines."""
    return textscan.grep_top(views.texts(spark, d), _GREP)


@query(f"WITH l AS (SELECT source || '/' || doc_id AS file, unnest(string_split(text, chr(10))) AS text FROM documents) SELECT count(*) AS hits, count(DISTINCT file) AS files FROM l WHERE regexp_matches(text, '{_GREP}')")
def grep_counts(spark, d):
    """Matching lines and files."""
    return textscan.grep(views.texts(spark, d), _GREP).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("file").alias("files"))


# ---------------------------------------------------------------- traversal

_START = f"SELECT '{START[0]}' AS file, '{START[1]}' AS name, '{START[2]}' AS kind"
_WALK = f"""WITH RECURSIVE {SYM}, {EDG}, adj AS (SELECT DISTINCT src_file, src_name, src_kind, dst_file, dst_name, dst_kind FROM edg WHERE dst_file IS NOT NULL AND dst_name IS NOT NULL AND dst_kind IS NOT NULL),
    walk AS (SELECT *, 0 AS depth FROM ({_START}) UNION SELECT dst_file, dst_name, dst_kind, depth + 1 FROM walk JOIN adj ON src_file = file AND src_name = name AND src_kind = kind WHERE depth < 24),
    dist AS (SELECT file, name, kind, min(depth) AS depth FROM walk GROUP BY ALL),
    par AS (SELECT c.file, c.name, c.kind, c.depth, min((a.src_file, a.src_name, a.src_kind)) AS p FROM dist c JOIN adj a ON c.file = dst_file AND c.name = dst_name AND c.kind = dst_kind
        JOIN dist b ON b.file = src_file AND b.name = src_name AND b.kind = src_kind AND b.depth = c.depth - 1 GROUP BY ALL)"""


def _start(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([START], "file string, name string, kind string")


@query(_WALK + " SELECT depth::INT AS depth, count(*) AS nodes FROM dist GROUP BY depth")
def chain_depths(spark, d):
    """Nodes at each distance from a start."""
    return graph.depths(graph.bfs(views.edges(spark, d, *graph.SRC, *graph.DST), _start(spark))).groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


_PATH = """, goal AS (SELECT file, name, kind, depth FROM dist WHERE {goal} AND depth = (SELECT min(depth) FROM dist WHERE {goal}) ORDER BY file, name, kind LIMIT 1),
    back AS (SELECT file, name, kind, depth FROM goal UNION ALL SELECT p.p[1], p.p[2], p.p[3], back.depth - 1 FROM back JOIN par p USING (file, name, kind) WHERE back.depth > 0)"""


@query(_WALK + _PATH.format(goal="name = 'emit'") + " SELECT depth::INT AS step, file, name, kind FROM back")
def chain_path(spark, d):
    """A shortest path to a symbol."""
    path = graph.shortest_path(views.edges(spark, d, *graph.SRC, *graph.DST), _start(spark), graph.to_symbol("emit"))
    return path if path is not None else spark.createDataFrame([], "step int, file string, name string, kind string")


@query(_WALK + _PATH.format(goal="'/' || file LIKE '%/std/result.rs'") + " SELECT depth::INT AS step, file, name, kind FROM back")
def chain_to_file(spark, d):
    """I4: a shortest path into a file."""
    path = graph.shortest_path(views.edges(spark, d, *graph.SRC, *graph.DST), _start(spark), graph.to_file("std/result.rs"))
    return path if path is not None else spark.createDataFrame([], "step int, file string, name string, kind string")


@query(_WALK + _PATH.format(goal="'/' || file LIKE '%/std/result.rs'") + """ SELECT DISTINCT dst_file AS file, dst_name AS name, dst_kind AS kind FROM edg JOIN back b ON src_file = b.file AND src_name = b.name AND src_kind = b.kind
    WHERE edg.kind = 'Calls' AND '/' || dst_file LIKE '%/std/result.rs' AND dst_name IS NOT NULL AND dst_kind IS NOT NULL AND NOT EXISTS (SELECT 1 FROM back x WHERE x.file = dst_file AND x.name = dst_name AND x.kind = dst_kind)""")
def chain_siblings(spark, d):
    """Further call targets of the path in that file."""
    e = views.edges(spark, d, *graph.SRC, *graph.DST, "kind")
    path = graph.shortest_path(e, _start(spark), graph.to_file("std/result.rs"))
    if path is None:
        return spark.createDataFrame([], "file string, name string, kind string")
    return graph.siblings(e, path, "std/result.rs").where("name is not null and kind is not null")


# ---------------------------------------------------------------- resolution

_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in resolve.SCRIPT_SUFFIXES) + "]"
_SUFFIXES6 = "[" + ", ".join(f"'{s}'" for s in resolve.SCRIPT_SUFFIXES[1:7]) + "]"


def _imports(spark, d) -> DataFrame:
    e = views.edges(spark, d, "src_file", "kind", "spec").where("kind = 'Imports' and spec is not null")
    return e.select(F.col("edge_id").alias("import_id"), "src_file", "spec")


def _script_files(spark, d) -> DataFrame:
    return table(spark, d, "source_files").select(F.col("file").alias("path")).distinct()


@query(f"""WITH {EDG}, imp AS (SELECT edge_id AS import_id, {views.norm_sql("regexp_replace(src_file, '/[^/]*$', '') || '/' || spec")} AS base FROM edg WHERE kind = 'Imports' AND starts_with(spec, '.')),
    cand AS (SELECT import_id, list_concat(list_transform({_SUFFIXES}, lambda s: base || s), CASE WHEN regexp_replace(base, '\\.(m|c)?(j|t)sx?$', '') <> base THEN list_transform({_SUFFIXES6}, lambda s: regexp_replace(base, '\\.(m|c)?(j|t)sx?$', '') || s) ELSE [] END) AS c FROM imp),
    each AS (SELECT import_id, unnest(c) AS path, generate_subscripts(c, 1) AS priority FROM cand)
    SELECT import_id, arg_min(path, priority) AS resolved_file FROM each WHERE path IN (SELECT file FROM source_files) GROUP BY import_id""")
def resolve_candidates(spark, d):
    """Relative imports to the first candidate file that exists."""
    i = _imports(spark, d).where(F.startswith("spec", F.lit(".")))
    work = i.select("import_id", resolve.script_candidates(F.col("src_file"), F.col("spec")).alias("candidates"))
    return resolve.pick_existing(work, _script_files(spark, d))


_RULES = [("@dunlin/", True, ["dunlin/src/*", "dunlin/lib/*"]), ("@", True, ["*"]), ("runner/graph", False, ["runner/graph/index"])]
_RULES_SQL = ", ".join("('{}', {}, {})".format(p, str(w).lower(), t) for p, w, t in _RULES)


@query(f"""WITH {EDG}, imp AS (SELECT edge_id AS import_id, spec FROM edg WHERE kind = 'Imports' AND spec IS NOT NULL), rules(prefix, wildcard, targets) AS (VALUES {_RULES_SQL}),
    hit AS (SELECT import_id, prefix, list_transform(targets, lambda t: CASE WHEN wildcard THEN replace(t, '*', substr(spec, length(prefix) + 1)) ELSE t END) AS bases FROM imp JOIN rules ON CASE WHEN wildcard THEN starts_with(spec, prefix) ELSE spec = prefix END)
    SELECT import_id, array_to_string(flatten(list(bases ORDER BY length(prefix) DESC, prefix)), ' ') AS mapped FROM hit GROUP BY import_id""")
def resolve_alias_prefix(spark, d):
    """The bases that alias rules give."""
    rules = spark.createDataFrame(_RULES, "prefix string, wildcard boolean, targets array<string>")
    return resolve.alias_bases(_imports(spark, d), rules).select("import_id", F.array_join("mapped", " ").alias("mapped"))


@query(f"""WITH {SYM}, {EDG}, calls AS (SELECT * FROM edg WHERE kind = 'Calls' AND confidence = 'Unresolved'),
    decl AS (SELECT file, name, arg_min(kind, (line_start, kind)) AS decl_kind, list(DISTINCT kind) AS kinds FROM sym GROUP BY file, name),
    imp AS (SELECT DISTINCT src_file, dst_file AS file FROM edg WHERE kind = 'Imports' AND confidence = 'Certain'),
    want AS (SELECT DISTINCT src_file, dst_name FROM calls c WHERE NOT EXISTS (SELECT 1 FROM decl WHERE file = c.src_file AND name = c.dst_name)),
    far AS (SELECT w.src_file, w.dst_name, min(d.file) AS far_file, min(d.decl_kind) AS far_kind FROM want w JOIN imp i USING (src_file) JOIN decl d ON d.file = i.file AND d.name = w.dst_name GROUP BY ALL HAVING count(DISTINCT d.file) = 1)
    SELECT c.edge_id, coalesce(CASE WHEN o.file IS NULL THEN f.far_file END, c.dst_file) AS dst_file,
        CASE WHEN o.file IS NULL AND f.far_file IS NOT NULL THEN f.far_kind WHEN o.file IS NOT NULL AND NOT list_contains(o.kinds, c.dst_kind) THEN o.decl_kind ELSE c.dst_kind END AS dst_kind,
        CASE WHEN (o.file IS NULL AND f.far_file IS NOT NULL) OR (o.file IS NOT NULL AND NOT list_contains(o.kinds, c.dst_kind)) THEN 'Inferred' ELSE c.confidence END AS confidence
    FROM calls c LEFT JOIN decl o ON o.file = c.src_file AND o.name = c.dst_name LEFT JOIN far f ON f.src_file = c.src_file AND f.dst_name = c.dst_name""")
def resolve_calls_unique(spark, d):
    """Unresolved calls whose target is clear from the imports."""
    e = views.edges(spark, d)
    open_ = e.where("kind = 'Calls' and confidence = 'Unresolved'").select("edge_id")
    return resolve.resolve_calls(e, views.symbols(spark, d, "line_start")).join(open_, "edge_id").select("edge_id", "dst_file", "dst_kind", "confidence")


@query(_LIBS + ", res AS (SELECT DISTINCT src_file AS file, split_part(dst_file, '/', 1) AS library FROM edg WHERE kind = 'Imports' AND confidence = 'Certain') SELECT l.library, count(*) AS n FROM lib l WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.file = l.file AND r.library = l.library) GROUP BY l.library")
def prune_libraries(spark, d):
    """Library imports without those that were resolved inside."""
    e = views.edges(spark, d, "src_file", "dst_file", "kind", "line", "confidence", "spec")
    inside = e.where("kind = 'Imports' and confidence = 'Certain'").select(F.col("src_file").alias("file"), F.substring_index("dst_file", "/", 1).alias("library"))
    return resolve.prune_libraries(_library_rows(e), inside).groupBy("library").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- impact

_CHANGE = f"WITH {OLD}, {NEW}, {DIFF}, {EDG}"
_LIST = """one AS (SELECT DISTINCT file, name, own_kind, src_file || ':' || src_name AS place FROM hit WHERE src_file IS NOT NULL AND src_name IS NOT NULL),
    agg AS (SELECT file, name, own_kind, count(*) AS n, array_to_string(list(place ORDER BY place)[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ' more)' ELSE '' END AS listed FROM one GROUP BY ALL)"""
_RELAXED = """pre AS (SELECT f.file, f.name, f.own_kind, src_file, src_name, src_kind, CASE WHEN dst_kind = f.own_kind THEN 0 ELSE 1 END AS tier FROM edg JOIN f ON dst_file = f.file AND dst_name = f.name),
    hit AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY file, name, own_kind) AS b FROM pre) WHERE tier = b)"""
_CLAMP = "CASE WHEN length(body) > 200 THEN substr(body, 1, 199) || '…' ELSE body END AS body"


def _changes(spark, d) -> DataFrame:
    return impact.diff(views.symbols_at(spark, d, views.BEFORE), views.changed_symbols(spark, d))


@query(f"WITH {OLD}, {NEW}, {DIFF} SELECT file, name, kind, change_class FROM diff")
def symbol_diff(spark, d):
    """Symbols of two moments compared."""
    return _changes(spark, d).select(*KEY, "change_class")


@query(f"WITH {OLD}, {NEW}, {DIFF} SELECT change_class, count(*) AS n FROM diff GROUP BY change_class")
def diff_summary(spark, d):
    return impact.diff_summary(_changes(spark, d))


_SIGNATURE = _CHANGE + f""", f AS (SELECT * FROM diff WHERE change_class = 'modified_sig'), {_RELAXED}, {_LIST},
    sig AS (SELECT 'SIGNATURE' AS kind, file, name, own_kind AS symbol_kind, name || ' changed its signature; ' || n || ' caller' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' may break: ' || listed AS body FROM f JOIN agg USING (file, name, own_kind))"""
_ASYNC = _CHANGE + f""", f AS (SELECT * FROM diff WHERE change_class = 'modified_sig' AND old_async IS DISTINCT FROM new_async), {_RELAXED},
    cnt AS (SELECT file, name, own_kind, count(*) AS n FROM (SELECT DISTINCT file, name, own_kind, src_file, src_name, src_kind FROM hit) GROUP BY ALL),
    sig AS (SELECT 'ASYNC_CHANGE' AS kind, f.file, f.name, f.own_kind AS symbol_kind, f.name || ' is now ' || CASE WHEN new_async THEN 'async' ELSE 'sync' END || '; ' || coalesce(n, 0) || ' caller' || CASE WHEN coalesce(n, 0) = 1 THEN '' ELSE 's' END || ' must be checked' AS body FROM f LEFT JOIN cnt USING (file, name, own_kind))"""
_ORPHAN = _CHANGE + f""", f AS (SELECT * FROM diff WHERE change_class = 'removed'), hit AS (SELECT f.file, f.name, f.own_kind, src_file, src_name FROM edg JOIN f ON dst_file = f.file AND dst_name = f.name), {_LIST},
    sig AS (SELECT 'ORPHAN' AS kind, file, name, own_kind AS symbol_kind, name || ' was removed; ' || n || ' caller' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' still refer to it: ' || listed AS body FROM f JOIN agg USING (file, name, own_kind))"""
_INTERFACE = _CHANGE + f""", f AS (SELECT * FROM diff WHERE change_class = 'modified_sig' AND kind IN ('Interface', 'Trait')), hit AS (SELECT f.file, f.name, f.own_kind, src_file, src_name FROM edg JOIN f ON dst_file = f.file AND dst_name = f.name AND dst_kind = f.own_kind WHERE edg.kind = 'Calls'), {_LIST},
    sig AS (SELECT 'INTERFACE_BREAK' AS kind, file, name, own_kind AS symbol_kind, name || ' changed; ' || n || ' implementor' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' may break: ' || listed AS body FROM f JOIN agg USING (file, name, own_kind))"""
_OUT = f" SELECT kind, file, name, symbol_kind, {_CLAMP} FROM sig"


@query(_SIGNATURE + _OUT)
def warn_signature(spark, d):
    """K2 E4 F6 H8."""
    return impact.warn_signature(_changes(spark, d), views.edges(spark, d, *graph.SRC, *graph.DST, "kind", "line"))


@query(_ASYNC + _OUT)
def warn_async(spark, d):
    """K3."""
    return impact.warn_async(_changes(spark, d), views.edges(spark, d, *graph.SRC, *graph.DST, "kind", "line"))


@query(_ORPHAN + _OUT)
def warn_orphan(spark, d):
    """K4 E15."""
    return impact.warn_orphan(_changes(spark, d), views.edges(spark, d, *graph.SRC, *graph.DST, "kind", "line"))


@query(_INTERFACE + _OUT)
def warn_interface(spark, d):
    """K5 E16; the data has no Implements edges, so its calls of interfaces stand for them."""
    return impact.warn_interface(_changes(spark, d), views.edges(spark, d, *graph.SRC, *graph.DST, "kind", "line"), "Calls")


@query(f"""SELECT array_to_string(list(kind || ': ' || n ORDER BY kind), ', ') AS summary FROM (
    SELECT kind, count(*) AS n FROM (SELECT kind FROM ({_SIGNATURE} SELECT kind FROM sig) UNION ALL SELECT kind FROM ({_ASYNC} SELECT kind FROM sig) UNION ALL SELECT kind FROM ({_ORPHAN} SELECT kind FROM sig)) GROUP BY kind)""")
def warning_summary(spark, d):
    """warnings by kind."""
    return impact.warning_summary(impact.warnings(cut(_changes(spark, d)), cut(views.edges(spark, d, *graph.SRC, *graph.DST, "kind", "line"))))


@query(_CHANGE + f""", {SYM}, {CEN}, f AS (SELECT * FROM diff WHERE change_class IN ('modified_sig', 'modified_body')), {_RELAXED},
    full_ AS (SELECT DISTINCT h.file AS of_file, h.name AS of_name, h.own_kind AS of_kind, s.file, s.name, s.kind, s.line_start, coalesce(c.in_degree, 0) AS in_degree FROM hit h JOIN sym s ON s.file = h.src_file AND s.name = h.src_name AND s.kind = h.src_kind LEFT JOIN cen c ON c.file = s.file AND c.name = s.name AND c.kind = s.kind),
    top AS (SELECT *, row_number() OVER (PARTITION BY of_file, of_name, of_kind ORDER BY in_degree DESC, file, name, kind, line_start)::INT AS n FROM full_)
    SELECT of_file, of_name, of_kind, n, file, name, kind, line_start, in_degree FROM top WHERE n <= 5 ORDER BY of_file, of_name, of_kind, n LIMIT 10""")
def context_bundle(spark, d):
    """K7 H6: callers of changed symbols."""
    c = _changes(spark, d).where("change_class in ('modified_sig', 'modified_body')").select("file", "name", F.coalesce("new.own_kind", "old.own_kind").alias("kind"))
    return impact.context_bundle(c, views.edges(spark, d, *graph.SRC, *graph.DST, "line"), views.symbols(spark, d, "line_start", "signature"))


# ---------------------------------------------------------------- incremental

@query("SELECT 'user' AS file, user_id::VARCHAR AS name, event_type AS kind, (SELECT max(event_id) FROM events) - max(event_id) AS edits_ago FROM events GROUP BY user_id, event_type")
def edits_ago(spark, d):
    """G1: events as an edit log."""
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.lit("user").alias("file"), F.col("user_id").cast("string").alias("name"), F.col("event_type").alias("kind"))
    return incremental.edits_ago(log)


def _hashes(spark, d, moment) -> DataFrame:
    t = F.lit(moment).cast("timestamp_ntz")
    alive = (F.col("indexed_at") <= t) & (F.col("removed_at").isNull() | (t < F.col("removed_at")))
    return table(spark, d, "source_files").where(alive).select(F.col("file").alias("path"), "content_hash").distinct()


def _hash_sql(m: str) -> str:
    return f"(SELECT file AS path, max(content_hash) AS h FROM source_files WHERE indexed_at <= TIMESTAMP '{m}' AND (removed_at IS NULL OR TIMESTAMP '{m}' < removed_at) GROUP BY file)"


@query(f"SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS change FROM {_hash_sql(views.BEFORE)} a FULL OUTER JOIN {_hash_sql(views.AFTER)} b ON a.path = b.path")
def changed_files(spark, d):
    """Files of two moments."""
    return incremental.changed_files(_hashes(spark, d, views.BEFORE), _hashes(spark, d, views.AFTER))


@query("""WITH f AS (SELECT DISTINCT file AS path, content_hash FROM source_files WHERE removed_at IS NULL), b AS (SELECT substr(sha256(path), 1, 3) AS bucket, sha256(string_agg(path || chr(0) || content_hash, chr(10) ORDER BY path, content_hash)) AS h, count(*) AS n FROM f GROUP BY 1)
    SELECT sha256(string_agg(h, chr(10) ORDER BY bucket)) AS root, sum(n)::BIGINT AS n_files FROM b""")
def merkle_root(spark, d):
    """a hash over all files."""
    return incremental.merkle_root(views.files(spark, d).select(F.col("file").alias("path"), "content_hash").distinct())


@query("SELECT count(DISTINCT array_to_string(list_filter(list_transform(string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?s)/\\*.*?(\\*/|\\z)', '', 'g'), chr(10)), lambda x: regexp_replace(CASE WHEN contains(x, '//') THEN split_part(x, '//', 1) ELSE split_part(x, '#', 1) END, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' ')) AS classes, count(text) AS texts FROM documents")
def body_hash_equiv(spark, d):
    """How many texts differ in more than comments and layout."""
    return table(spark, d, "documents").agg(F.count_distinct(textscan.normalized_body(F.col("text"))).alias("classes"), F.count("text").alias("texts"))


@query(f"WITH {EDG} SELECT src_file, src_name, dst_name, edge_id, line FROM (SELECT *, row_number() OVER (PARTITION BY src_file, src_name, dst_name ORDER BY line NULLS FIRST, edge_id) AS rn FROM edg WHERE kind = 'Calls') WHERE rn = 1")
def dedupe_first(spark, d):
    """The first call of a name from a caller."""
    calls = views.edges(spark, d, "src_file", "src_name", "dst_name", "kind", "line").where("kind = 'Calls'")
    return incremental.first_of(calls, ["src_file", "src_name", "dst_name"], ["line", "edge_id"]).select("src_file", "src_name", "dst_name", "edge_id", "line")


@query(f"WITH {SYM}, {EDG}, gone AS (SELECT DISTINCT file FROM source_files WHERE is_test_path) SELECT (SELECT count(*) FROM sym WHERE file NOT IN (SELECT file FROM gone)) AS symbols, (SELECT count(*) FROM edg WHERE src_file NOT IN (SELECT file FROM gone)) AS edges")
def remove_file(spark, d):
    """The graph without its test files."""
    gone = table(spark, d, "source_files").where("is_test_path").select("file")
    s, e, _ = incremental.remove_files(gone, views.symbols(spark, d, "kind"), views.edges(spark, d, "src_file"))
    counts = s.agg(F.count(F.lit(1)).alias("symbols")).unionByName(e.agg(F.count(F.lit(1)).alias("edges")), allowMissingColumns=True)
    return counts.agg(F.max("symbols").alias("symbols"), F.max("edges").alias("edges"))


@query(f"WITH {SYM}, {EDG} SELECT edge_id FROM edg e WHERE dst_name <> '' AND NOT EXISTS (SELECT 1 FROM sym WHERE file = e.dst_file AND name = e.dst_name)")
def dangling_edges(spark, d):
    """Edges to names that their file does not have now."""
    return incremental.dangling_edges(views.edges(spark, d, "dst_file", "dst_name"), views.symbols(spark, d, "kind")).select("edge_id")


_WANTED = "List every caller of the index and say which of them are tests."


@query(f"""WITH l AS (SELECT id AS file, unnest(string_split(prompt, chr(10))) AS text, generate_subscripts(string_split(prompt, chr(10)), 1) AS line FROM task_registry),
    s AS (SELECT *, 1 - levenshtein(trim(text), '{_WANTED}') / greatest(length(trim(text)), {len(_WANTED)}) AS similarity FROM l)
    SELECT file, arg_max(line, (similarity, -line))::INT AS line, arg_max(text, (similarity, -line)) AS text, round(max(similarity), 9) AS similarity FROM s GROUP BY file""")
def closest_line(spark, d):
    """H7 L1 L2: the line of each prompt that is most like a text."""
    tasks = table(spark, d, "task_registry").select(F.col("id").alias("path"), F.col("prompt").alias("content"))
    return textscan.closest_line(tasks, _WANTED).withColumn("similarity", F.round("similarity", 9))


@query("""WITH p AS (SELECT source || '/' || doc_id AS file, string_split(text, 'symbol table') AS p FROM documents WHERE contains(text, 'symbol table')), e AS (SELECT file, p, unnest(range(1, len(p))) AS i FROM p)
    SELECT file, (1 + list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))))::INT AS line FROM e""")
def match_lines(spark, d):
    """The lines of all occurrences of a text."""
    return textscan.match_lines(views.texts(spark, d), "symbol table")


@query(f"WITH {SYM}, {EDG}, f AS (SELECT DISTINCT file, language, content_hash, is_test_path FROM source_files WHERE removed_at IS NULL) SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count(*) FROM edg) AS edges, (SELECT count(*) FROM f) AS files, (SELECT string_agg(DISTINCT lower(regexp_extract(file, '\\.([^./]+)$', 1)), ', ' ORDER BY lower(regexp_extract(file, '\\.([^./]+)$', 1))) FROM f) AS extensions, (SELECT count(*) FROM events) AS edits")
def status(spark, d):
    """F7 B4."""
    return incremental.status(views.symbols(spark, d, "kind"), views.edges(spark, d, "kind"), views.files(spark, d), table(spark, d, "events"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh, event_id FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM e)
    SELECT user_id, min(ts) AS start, max(ts) AS "last", count(*) AS n FROM s GROUP BY user_id, burst""")
def debounce_events(spark, d):
    """Bursts of events less than a gap apart; the same code runs on a stream."""
    return debounce(table(spark, d, "events"), "10 minutes", "user_id", "ts")


@query(f"WITH {EDG} SELECT edge_id FROM edg WHERE ends_with('/' || dst_file, '/std/result.rs')")
def path_suffix(spark, d):
    """Edges into files by a suffix of their path."""
    return views.edges(spark, d, "dst_file").where(has_suffix(F.col("dst_file"), "std/result.rs")).select("edge_id")


def _graph(spark, d) -> Graph:
    e = views.edges(spark, d)
    return Graph(views.symbols(spark, d), e, _library_rows(e), views.texts(spark, d))


_PLURAL = "{0} || ' {1}' || CASE WHEN {0} = 1 THEN '' ELSE 's' END"
_BARE = "regexp_replace(coalesce(signature, name), '(?s)(\\))\\s*(:|->).*$', '\\1')"
_HIT = "NULL::VARCHAR AS snippet, NULL::VARCHAR AS context"


@query(f"""{BASE}, best AS (SELECT file, name, kind FROM ranked WHERE name = 'emit' ORDER BY {ORDER} LIMIT 1),
    ends AS (SELECT src_file AS file, src_name AS name, src_kind AS kind FROM edg e JOIN best b ON dst_file = b.file AND dst_name = b.name AND dst_kind = b.kind GROUP BY ALL),
    top AS (SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, line_start, signature, name FROM ends JOIN ranked USING (file, name, kind) ORDER BY {ORDER} LIMIT 10),
    head AS (SELECT count(*) AS n, count(DISTINCT file) AS f FROM top),
    imp AS (SELECT src_file AS file, min(line) AS line FROM edg JOIN best b ON dst_file = b.file WHERE edg.kind = 'Imports' AND confidence = 'Certain' AND dst_name = '' AND dst_kind = 'Module' AND src_file <> b.file AND src_file NOT IN (SELECT file FROM top) GROUP BY src_file)
    SELECT 0 AS rank, '' AS file, 0 AS line, CASE WHEN n > 0 THEN '=== ' || {_PLURAL.format('n', 'caller')} || ' of emit in ' || {_PLURAL.format('f', 'file')} || ' ===' ELSE '=== 0 callers of emit ===' END AS signature, {_HIT}, true AS is_hint FROM head
    UNION ALL SELECT rank, file, line_start, {_BARE}, NULL, NULL, false FROM top
    UNION ALL SELECT (10 + row_number() OVER (ORDER BY file))::INT, file, line, 'cross-file importer — file imports `' || (SELECT file FROM best) || '`; grep `emit` here for call sites', NULL, NULL, false FROM imp""")
def search_callers(spark, d):
    """A text query for callers, with header and importer hints."""
    return search(_graph(spark, d), "callers of emit")


@query(f"""{BASE}, top AS (SELECT row_number() OVER (ORDER BY {ORDER})::INT AS rank, file, line_start, signature, name FROM ranked WHERE name = 'emit' ORDER BY {ORDER} LIMIT 5),
    head AS (SELECT count(*) AS n, count(DISTINCT file) AS f, list_sort(list(DISTINCT regexp_extract(file, '[^/]*$'))) AS names FROM top)
    SELECT 0 AS rank, '' AS file, 0 AS line, '=== ' || n || ' symbol' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' matching ' || chr(39) || 'emit' || chr(39) || CASE WHEN f = 1 THEN ' in ' || names[1] WHEN f <= 3 THEN ' across ' || f || ' files (' || array_to_string(names[1:3], ', ') || ')' ELSE ' across ' || f || ' files (e.g. ' || array_to_string(names[1:3], ', ') || ', +' || (f - 3) || ' more)' END || ' ===' AS signature,
        NULL::VARCHAR AS snippet, NULL::VARCHAR AS context, true AS is_hint FROM head
    UNION ALL SELECT rank, file, line_start, regexp_replace(coalesce(signature, name), '(?s)(\\))\\s*(:|->).*$', '\\1'), NULL, NULL, false FROM top""")
def search_find(spark, d):
    """A text query for a symbol."""
    return search(_graph(spark, d), "find emit")


_EMIT = f"(file, name, kind) = (SELECT (file, name, kind) FROM ranked WHERE name = 'emit' ORDER BY {ORDER} LIMIT 1)"


@query(_WALK.replace(f"({_START})", f"(SELECT file, name, kind FROM ranked WHERE name = 'installAll' ORDER BY {ORDER} LIMIT 1)").replace("adj AS", f"{CEN}, {RANKED}, adj AS", 1) + _PATH.format(goal=_EMIT)
    + f" SELECT (depth + 1)::INT AS rank, file, line_start AS line, {_BARE} AS signature, {_HIT}, false AS is_hint FROM back JOIN sym USING (file, name, kind)")
def search_chain(spark, d):
    """A text query for a path."""
    return search(_graph(spark, d), "chain from installAll to emit")


@query(f"""WITH l AS (SELECT source || '/' || doc_id AS file, unnest(regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n')) AS t, generate_subscripts(regexp_split_to_array(regexp_replace(text, '\\r?\\n\\z', ''), '\\r?\\n'), 1) AS line FROM documents WHERE contains(text, '(#')),
    top AS (SELECT row_number() OVER (ORDER BY file, line)::INT AS rank, file, line::INT AS line, substr(regexp_replace(t, '^\\s+|\\s+$', '', 'g'), 1, 120) AS snippet FROM l WHERE contains(t, '(#') ORDER BY file, line LIMIT 30),
    head AS (SELECT count(*) AS n, count(DISTINCT file) AS f FROM top)
    SELECT 0 AS rank, '' AS file, 0 AS line, '=== ' || n || ' match' || CASE WHEN n = 1 THEN '' ELSE 'es' END || ' in ' || {_PLURAL.format('f', 'file')} || ' ===' AS signature, {_HIT}, true AS is_hint FROM head
    UNION ALL SELECT rank, file, line, NULL, snippet, NULL, false FROM top""")
def search_grep(spark, d):
    """L3: a text that is no valid pattern is searched literally."""
    return search(_graph(spark, d), "(#")


@query(_TESTED.replace("src_file, dst_file FROM edg", "src_file, dst_file, line FROM edg") + f""" SELECT row_number() OVER (ORDER BY src_file, line)::INT AS rank, src_file AS file, line, 'imports ' || dst_file AS signature, {_HIT}, false AS is_hint
    FROM t WHERE dst_file = (SELECT dst_file FROM t GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""")
def search_tests(spark, d):
    """A text query for the tests of the file that tests import most."""
    g = _graph(spark, d)
    return search(g, f"tests for {_tested(g.edges).first().dst_file}")


@query(f"WITH {SYM} SELECT file, name, kind, regexp_extract(regexp_replace(string_split(signature, '(')[1], '^fn ', ''), '(\\S+)\\s*$', 1) AS found, {_BARE} AS bare FROM sym WHERE signature IS NOT NULL")
def signature_parts(spark, d):
    """The name in every signature, and the signature without its return type."""
    s = views.symbols(spark, d, "signature", "line_start", "params", "return_type", "visibility", "body_hash", "is_async", "line_end").where("signature is not null")
    return s.select(*KEY, graph.function_name(F.col("signature")).alias("found"), without_return_type(F.coalesce("signature", "name")).alias("bare"))
