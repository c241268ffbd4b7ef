"""The tables of the test data as the relations of a code graph, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.functions.paths import normalize_path
from symweave.runtime import table

SYMBOL_COLUMNS = ("file", "name", "kind", "line_start", "line_end", "signature", "params", "return_type", "visibility", "body_hash", "is_async")
EDGE_COLUMNS = ("edge_id", "src_file", "src_name", "src_kind", "dst_file", "dst_name", "dst_kind", "kind", "line", "confidence", "spec")
#: Two moments between which symbols and files came and went.
BEFORE, AFTER = "2024-01-15 00:00:00", "2024-05-15 00:00:00"


def all_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").unionByName(table(spark, d, "prelude_symbols"))


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Symbols that are there now; repeated rows are equal, so with ``columns`` only these and the key are read."""
    chosen = dict.fromkeys((*SYMBOL_COLUMNS[:3], *columns)) if columns else SYMBOL_COLUMNS
    return all_symbols(spark, d).where("removed_at is null").select(*chosen).distinct()


def symbols_at(spark: SparkSession, d: str, moment: str) -> DataFrame:
    t = F.lit(moment).cast("timestamp_ntz")
    alive = (F.col("indexed_at") <= t) & (F.col("removed_at").isNull() | (t < F.col("removed_at")))
    return all_symbols(spark, d).where(alive).select(*SYMBOL_COLUMNS).distinct()


def changed_symbols(spark: SparkSession, d: str) -> DataFrame:
    """The symbols of the second moment as after a large refactoring: some have other signatures, flags or bodies."""
    part = F.pmod(F.col("body_hash"), F.lit(10))
    return symbols_at(spark, d, AFTER).select(
        "file", "name", "kind", "line_start", "line_end",
        F.when(part == 2, F.concat(F.coalesce("signature", F.lit("")), F.lit(" changed"))).otherwise(F.col("signature")).alias("signature"),
        "params", "return_type", "visibility",
        F.when(part == 3, F.col("body_hash") - F.lit(1).cast("bigint")).otherwise(F.col("body_hash")).alias("body_hash"),
        F.when(part == 4, ~F.col("is_async")).otherwise(F.col("is_async")).alias("is_async"),
    )


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Edges once for each ``edge_id``, with plain paths and spellings.

    Deliveries of an edge are equal but for their time, so with ``columns`` only these are read, shuffled and
    made distinct together with the id.
    """
    rows = table(spark, d, "edges")
    plain = {"src_file": normalize_path(F.col("src_file")), "dst_file": normalize_path(F.col("dst_file")), "confidence": F.initcap(F.trim("confidence"))}
    return rows.withColumns(plain).select(*(dict.fromkeys(("edge_id", *columns)) if columns else EDGE_COLUMNS)).distinct()


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").where("removed_at is null").select("file", "language", "content_hash", "is_test_path").distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as text files."""
    return table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def arm() -> Column:
    return F.lower(F.trim("arm"))


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each rollout: its latest delivery."""
    rows = table(spark, d, "rollouts")
    cols = [c for c in rows.columns if c not in ("rollout_id", "loaded_at", "tool_calls")]
    one = rows.groupBy("rollout_id").agg(F.max_by(F.struct(*cols), "loaded_at").alias("r"))
    return one.select("rollout_id", "r.*").withColumn("arm", arm()).withColumn("seed", F.coalesce("seed", F.lit(0)))


# ---------------------------------------------------------------- the same as SQL


def norm_sql(c: str) -> str:
    x = f"replace({c}, '\\', '/')"
    x = f"regexp_replace({x}, '/+', '/', 'g')"
    x = f"regexp_replace({x}, '(/\\.)+/', '/', 'g')"
    x = f"regexp_replace({x}, '^(\\./)+', '')"
    for _ in range(3):
        x = f"regexp_replace({x}, '(^|/)([^/.][^/]*)/\\.\\./', '\\1', 'g')"
    return f"regexp_replace({x}, '(.)/$', '\\1')"


_COLS = ", ".join(SYMBOL_COLUMNS)
_ALL = "(SELECT * FROM symbols UNION ALL SELECT * FROM prelude_symbols)"
SYM = f"sym AS (SELECT DISTINCT {_COLS} FROM {_ALL} WHERE removed_at IS NULL)"
EDG = f"""edg AS (SELECT DISTINCT edge_id, {norm_sql('src_file')} AS src_file, src_name, src_kind, {norm_sql('dst_file')} AS dst_file, dst_name, dst_kind, kind, line,
    upper(substr(trim(confidence), 1, 1)) || lower(substr(trim(confidence), 2)) AS confidence, spec FROM edges)"""
CEN = "cen AS (SELECT dst_file AS file, dst_name AS name, dst_kind AS kind, count(*) AS in_degree FROM edg WHERE dst_file IS NOT NULL AND dst_name IS NOT NULL AND dst_kind IS NOT NULL GROUP BY ALL)"
RANKED = "ranked AS (SELECT s.*, coalesce(c.in_degree, 0) AS in_degree FROM sym s LEFT JOIN cen c USING (file, name, kind))"
ORDER = "in_degree DESC, file NULLS FIRST, line_start NULLS FIRST, name NULLS FIRST, kind NULLS FIRST"


def at_sql(moment: str) -> str:
    return f"SELECT DISTINCT {_COLS} FROM {_ALL} WHERE indexed_at <= TIMESTAMP '{moment}' AND (removed_at IS NULL OR TIMESTAMP '{moment}' < removed_at)"


OLD = f"old AS ({at_sql(BEFORE)})"
NEW = f"""new AS (SELECT file, name, kind, line_start, line_end,
    CASE WHEN ((body_hash % 10) + 10) % 10 = 2 THEN coalesce(signature, '') || ' changed' ELSE signature END AS signature, params, return_type, visibility,
    CASE WHEN ((body_hash % 10) + 10) % 10 = 3 THEN body_hash - 1 ELSE body_hash END AS body_hash,
    CASE WHEN ((body_hash % 10) + 10) % 10 = 4 THEN NOT is_async ELSE is_async END AS is_async FROM ({at_sql(AFTER)}))"""
DIFF = """o1 AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'AsyncFunction' THEN 'Function' ELSE kind END AS bk, row_number() OVER (PARTITION BY file, name, CASE WHEN kind = 'AsyncFunction' THEN 'Function' ELSE kind END ORDER BY line_start, kind) AS rn FROM old) WHERE rn = 1),
    n1 AS (SELECT * FROM (SELECT *, CASE WHEN kind = 'AsyncFunction' THEN 'Function' ELSE kind END AS bk, row_number() OVER (PARTITION BY file, name, CASE WHEN kind = 'AsyncFunction' THEN 'Function' ELSE kind END ORDER BY line_start, kind) AS rn FROM new) WHERE rn = 1),
    diff AS (SELECT coalesce(o.file, n.file) AS file, coalesce(o.name, n.name) AS name, coalesce(o.bk, n.bk) AS kind, coalesce(n.kind, o.kind) AS own_kind,
        CASE WHEN o.file IS NULL THEN 'added' WHEN n.file IS NULL THEN 'removed'
             WHEN o.signature IS DISTINCT FROM n.signature OR o.return_type IS DISTINCT FROM n.return_type OR o.is_async IS DISTINCT FROM n.is_async OR o.params IS DISTINCT FROM n.params THEN 'modified_sig'
             WHEN o.body_hash IS DISTINCT FROM n.body_hash THEN 'modified_body' ELSE 'same' END AS change_class,
        o.is_async AS old_async, n.is_async AS new_async
        FROM o1 o FULL OUTER JOIN n1 n ON o.file = n.file AND o.name = n.name AND o.bk = n.bk)"""
ROLL = "roll AS (SELECT * EXCLUDE (rn, arm, seed), lower(trim(arm)) AS arm, coalesce(seed, 0) AS seed FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY loaded_at DESC) AS rn FROM rollouts) WHERE rn = 1)"


def json_list(x: str) -> str:
    """The entries of a JSON list; a lone value is a list of one, nothing or null has no entries."""
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN [] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


#: JSON reports alone, among other lines, as a JSON string, or under ``report``.
REPORTS = """o AS (SELECT report_id AS run_id, stdout FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY loaded_at DESC) AS rn FROM runner_reports WHERE stdout IS NOT NULL AND lower(trim(runner)) IS DISTINCT FROM 'cargo') WHERE rn = 1),
    whole AS (SELECT run_id, CASE WHEN json_valid(stdout) THEN stdout ELSE list_filter([regexp_extract(stdout, '(?s)\\{\\s*".*\\}'), regexp_extract(stdout, '(?s)\\{\\s*".*[\\]0-9]\\s*\\}')], lambda x: json_valid(x))[1] END AS t FROM o),
    inner_ AS (SELECT run_id, CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') WHEN json_exists(t, '$.report') THEN json_extract(t, '$.report')::VARCHAR ELSE t END AS t FROM whole WHERE json_valid(t)),
    rep AS (SELECT run_id, t::JSON AS j, json_exists(t, '$.testResults') AS is_jest FROM inner_ WHERE json_valid(t) AND (json_exists(t, '$.testResults') OR json_exists(t, '$.tests')))"""
_POS = "generate_subscripts({0}, 1)::INT - 1"
#: Their tests, failure messages and traceback frames with positions.
REPORT_PARTS = f"""{REPORTS},
    jfile AS (SELECT run_id, unnest(x) AS f, {_POS.format('x')} AS outer_pos FROM (SELECT run_id, {json_list("json_extract(j, '$.testResults')")} AS x FROM rep WHERE is_jest)),
    jtest AS (SELECT run_id, outer_pos, json_extract_string(f, '$.name') AS file, unnest(x) AS t, {_POS.format('x')} AS inner_pos FROM (SELECT *, {json_list("json_extract(f, '$.assertionResults')")} AS x FROM jfile)),
    jsaid AS (SELECT run_id, outer_pos, inner_pos, unnest(x) AS m, {_POS.format('x')} AS leaf_pos FROM (SELECT *, {json_list("json_extract(t, '$.failureMessages')")} AS x FROM jtest)),
    ptest AS (SELECT run_id, unnest(x) AS t, {_POS.format('x')} AS outer_pos FROM (SELECT run_id, {json_list("json_extract(j, '$.tests')")} AS x FROM rep WHERE NOT is_jest)),
    pframe AS (SELECT run_id, outer_pos, unnest(x) AS f, {_POS.format('x')} AS leaf_pos FROM (SELECT *, {json_list("json_extract(t, '$.call.traceback')")} AS x FROM ptest))"""
_SITE = r"'(?:\(|at )([^\s():]+):(\d+)(?::\d+)?\)?'"
#: Failed tests of all JSON reports: ``run_id, test_name, file, line, message`` and the frames as text.
FAILED = f"""{REPORT_PARTS},
    first AS (SELECT run_id, outer_pos, inner_pos, arg_min(json_extract_string(m, '$'), leaf_pos) AS m FROM jsaid WHERE json_type(m) <> 'NULL' GROUP BY ALL),
    jfail AS (SELECT run_id, json_extract_string(t, '$.fullName') AS test_name, file, TRY_CAST(json_extract_string(t, '$.location.line') AS INT) AS line, coalesce(split_part(m, chr(10), 1), '') AS message,
        coalesce(list_transform(list_zip(regexp_extract_all(m, {_SITE}, 1), regexp_extract_all(m, {_SITE}, 2)), lambda x: struct_pack(file := x[1], line := x[2]::INT)), []) AS stack
        FROM jtest LEFT JOIN first USING (run_id, outer_pos, inner_pos) WHERE json_extract_string(t, '$.status') = 'failed'),
    trace AS (SELECT run_id, outer_pos, list(struct_pack(file := json_extract_string(f, '$.path'), line := TRY_CAST(json_extract_string(f, '$.lineno') AS INT)) ORDER BY leaf_pos) AS s FROM pframe WHERE json_type(f) <> 'NULL' AND json_extract_string(f, '$.path') IS NOT NULL GROUP BY ALL),
    pfail AS (SELECT run_id, split_part(json_extract_string(t, '$.nodeid'), '::', -1) AS test_name, coalesce(s[-1].file, split_part(json_extract_string(t, '$.nodeid'), '::', 1)) AS file, coalesce(s[-1].line, TRY_CAST(json_extract_string(t, '$.lineno') AS INT)) AS line,
        split_part(coalesce(json_extract_string(t, '$.call.longrepr.reprcrash.message'), json_extract_string(t, '$.call.longrepr'), ''), chr(10), 1) AS message, coalesce(s, []) AS stack
        FROM ptest LEFT JOIN trace USING (run_id, outer_pos) WHERE json_extract_string(t, '$.outcome') = 'failed'),
    failed AS (SELECT * FROM jfail UNION ALL SELECT * FROM pfail)"""
STACK_TEXT = "array_to_string(list_transform(stack, lambda x: x.file || ':' || coalesce(x.line::VARCHAR, '?')), ' ')"
TEST_PATH = "len(list_filter(string_split({0}, '/'), lambda c: c IN ('tests', '__tests__') OR contains(c, '.test.') OR contains(c, '.spec.') OR contains(c, '_test') OR starts_with(c, 'test_'))) > 0"
