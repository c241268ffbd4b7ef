"""Named queries over text and model data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from symweave.llm import canonical, consensus, leakage, packing, quantiles, truncation
from symweave.runtime import table


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of the rollouts' metrics for each arm."""
    return quantiles.rollout_percentiles(table(spark, sf_dir, "rollouts"))


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries for each arm and day that can be combined."""
    return quantiles.rollout_summaries(table(spark, sf_dir, "rollouts"))


def p2_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles for each arm from the combined daily summaries, with the bound of the rank error."""
    return quantiles.merged(p2_daily(spark, sf_dir), ["arm"], [0.1, 0.25, 0.5, 0.75, 0.9, 0.99])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts whose answer lost its end."""
    return truncation.judged(table(spark, sf_dir, "rollouts")).where("truncated").select("rollout_id")


def p4_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truncated answers for each run label."""
    return truncation.shares(table(spark, sf_dir, "rollouts"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer that is truly better on correctness, for each item."""
    return consensus.item_labels(table(spark, sf_dir, "judge_verdicts")).select("verdict_id", "label")


def p5_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus label, difficulty and agreement for each item."""
    return consensus.item_labels(table(spark, sf_dir, "judge_verdicts"))


def p5_judges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each judge."""
    return consensus.judge_reliability(table(spark, sf_dir, "judge_verdicts"))


def p7_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, position and tokens of every text."""
    return packing.layout(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p7_layout(spark, sf_dir))


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, texts and fill of each harmonic class."""
    return packing.classes(p7_layout(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a passage of an evaluation item, with the item."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that look the same and are written differently."""
    return canonical.look_alike_pairs(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of a look that is written in several ways, with its class and the number of variants."""
    return canonical.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "variants")


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text in its consistent form."""
    return canonical.forms(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_percentiles, p2_daily, p2_combined, p4_found, p4_shares, p5_found, p5_items, p5_judges, p7_layout, p7_fill, p7_classes, p8_found, p9_found, p9_classes, p9_forms)}
_QUANTILES = ", ".join(f"quantile_disc(v, {q}) FILTER (v IS NOT NULL AND NOT isnan(v)) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY loaded_at DESC) AS rn FROM rollouts) WHERE rn = 1"
_LONG = f"""one AS ({_LATEST}), long AS (
        SELECT lower(regexp_replace(arm, '^\\s+|\\s+$', '', 'g')) AS arm, started_at::DATE AS day, unnest(['input_tokens', 'wall_seconds', 'total_cost_usd']) AS metric,
               unnest([input_tokens::DOUBLE, wall_seconds, total_cost_usd]) AS v FROM one)"""
_PARTS = f"""{_LONG}, v AS (SELECT arm, day, metric, v, row_number() OVER (PARTITION BY arm, day, metric ORDER BY v) AS r, count(*) OVER (PARTITION BY arm, day, metric) AS n FROM long WHERE v IS NOT NULL AND NOT isnan(v)),
    p AS (SELECT arm, day, metric, n, least(n, 64) AS m, unnest(range(least(n, 64))) AS i FROM (SELECT DISTINCT arm, day, metric, n FROM v)),
    q AS (SELECT *, i * n // m AS a, (i + 1) * n // m AS b FROM p),
    part AS (SELECT q.arm, q.day, q.metric, q.n, v.v AS value, q.b - q.a AS weight FROM q JOIN v ON v.arm IS NOT DISTINCT FROM q.arm AND v.day IS NOT DISTINCT FROM q.day AND v.metric = q.metric AND v.r = q.a + (q.b - q.a + 1) // 2)"""
_AT = ", ".join(f"min(value) FILTER (upto >= greatest(1, total - floor(total - {q} * total))) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99))
ORACLES: dict[str, str] = {
    "p2_percentiles": f"WITH {_LONG} SELECT arm, metric, count(*) FILTER (v IS NOT NULL AND NOT isnan(v)) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS n_missing, {_QUANTILES}, 0::BIGINT AS rank_error FROM long GROUP BY arm, metric",
    "p2_daily": f"WITH {_PARTS} SELECT * FROM part",
    "p2_combined": f"""WITH {_PARTS}, n AS (SELECT arm, metric, sum(n)::BIGINT AS n, sum(CASE WHEN n > 64 THEN ceil(n / 128.0) + 1 ELSE 0 END)::BIGINT AS rank_error FROM (SELECT DISTINCT arm, day, metric, n FROM part) GROUP BY arm, metric),
        w AS (SELECT arm, metric, value, sum(weight) AS weight FROM part GROUP BY ALL),
        u AS (SELECT *, sum(weight) OVER (PARTITION BY arm, metric ORDER BY value) AS upto, sum(weight) OVER (PARTITION BY arm, metric) AS total FROM w),
        r AS (SELECT arm, metric, {_AT} FROM u GROUP BY arm, metric)
        SELECT r.*, n.n, n.rank_error FROM r JOIN n ON r.arm IS NOT DISTINCT FROM n.arm AND r.metric = n.metric""",
}
