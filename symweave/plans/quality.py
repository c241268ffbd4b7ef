"""Named queries over the data-quality operators of the core."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import heavy_keys, nested, orphans
from symweave.plans import views
from symweave.plans.views import norm_sql
from symweave.runtime import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose resolved target is not alive at ``seen_at``: the direct orphans of the cascade."""
    return orphans.orphan_edges(spark, sf_dir).where("status = 'direct'").select("edge_id").distinct()


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per table they should be in, month and status."""
    return orphans.orphan_report(spark, sf_dir)


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.flatten(cut(nested.report_records(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all failure messages and traceback frames."""
    found = nested.report_leaves(_tables(spark, sf_dir))
    if found is None:
        return spark.createDataFrame([], "report_id bigint, outer_pos int, inner_pos int, leaf_pos int")
    return found


def p3_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and null entries of every flat table."""
    parts = [df.select(F.lit(name).alias("table_path"), (F.col("is_null") if "is_null" in df.columns else F.lit(False)).alias("is_null")) for name, df in _tables(spark, sf_dir).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("table_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("is_null").alias("n_null"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of either side that hold at least one hundredth of all edges."""
    heavy = heavy_keys.key_results(table(spark, sf_dir, "edges"), min_share=0.01)
    return heavy.select("side", "file", "name", "kind")


def p6_key_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree, distinct partners and line quantiles for all keys of both sides."""
    return heavy_keys.key_results(table(spark, sf_dir, "edges"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p3_found, p3_table_counts, p6_found, p6_key_results)
}
_LIVES = f"""l AS (SELECT {norm_sql('file')} AS f, name AS n, kind AS k, indexed_at AS a, coalesce(removed_at, TIMESTAMP '9999-01-01') AS b, 'symbol' AS o FROM (SELECT * FROM symbols UNION ALL SELECT * FROM prelude_symbols)
    UNION ALL SELECT {norm_sql('file')}, '', 'Module', indexed_at, coalesce(removed_at, TIMESTAMP '9999-01-01'), 'file' FROM source_files),
    r AS (SELECT edge_id, {norm_sql('dst_file')} AS f, dst_name AS n, dst_kind AS k, seen_at AS t, CASE WHEN dst_name = '' AND dst_kind = 'Module' THEN 'file' ELSE 'symbol' END AS o FROM edges
        WHERE lower(trim(confidence)) IN ('certain', 'inferred') AND dst_file IS NOT NULL AND dst_name IS NOT NULL AND dst_kind IS NOT NULL),
    x AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.f = r.f AND l.n = r.n AND l.k = r.k AND l.o = r.o AND l.a <= r.t AND r.t < l.b))"""
_ENDS = f"""one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_id ORDER BY loaded_at DESC) AS rn FROM edges) WHERE rn = 1),
    ends AS (SELECT edge_id, line, 'to' AS side, {norm_sql('dst_file')} AS file, dst_name AS name, dst_kind AS kind, CASE WHEN src_file IS NOT NULL AND src_name IS NOT NULL AND src_kind IS NOT NULL THEN {norm_sql('src_file')} || chr(1) || src_name || chr(1) || src_kind END AS other FROM one
        UNION ALL SELECT edge_id, line, 'from', {norm_sql('src_file')}, src_name, src_kind, CASE WHEN dst_file IS NOT NULL AND dst_name IS NOT NULL AND dst_kind IS NOT NULL THEN {norm_sql('dst_file')} || chr(1) || dst_name || chr(1) || dst_kind END FROM one)"""
ORACLES: dict[str, str] = {
    "p3_found": f"""WITH {views.REPORT_PARTS} SELECT run_id AS report_id, outer_pos, inner_pos, leaf_pos FROM jsaid WHERE json_type(m) <> 'NULL'
        UNION ALL SELECT run_id, outer_pos, -1, leaf_pos FROM pframe WHERE json_type(f) <> 'NULL'""",
    "p1_found": f"WITH {_LIVES} SELECT DISTINCT edge_id FROM x",
    "p1_report": f"""WITH {_LIVES}, y AS (SELECT edge_id, o, min(strftime(t, '%Y-%m')) AS month, min(f) AS f FROM x GROUP BY edge_id, o)
        SELECT CASE WHEN o = 'file' THEN 'source_files' WHEN starts_with(f, 'prelude/') THEN 'prelude_symbols' ELSE 'symbols' END AS target_table, month, 'direct' AS status, count(*) AS orphans FROM y GROUP BY ALL""",
    "p6_found": f"WITH {_ENDS} SELECT side, file, name, kind FROM ends WHERE file IS NOT NULL AND name IS NOT NULL AND kind IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.01 * (SELECT count(*) FROM one)",
    "p6_key_results": f"""WITH {_ENDS} SELECT side, file, name, kind, count(*) AS degree, count(DISTINCT other) AS partners, quantile_disc(line::BIGINT, 0.5) AS line_p50, quantile_disc(line::BIGINT, 0.9) AS line_p90, count(*) / (SELECT count(*) FROM one)::DOUBLE AS share
        FROM ends WHERE file IS NOT NULL AND name IS NOT NULL AND kind IS NOT NULL GROUP BY side, file, name, kind""",
}
