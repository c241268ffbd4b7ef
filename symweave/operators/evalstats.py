"""Statistics of benchmark runs: grades, cells, intervals, paired tests, votes, budgets."""

from __future__ import annotations

import functools
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

# Files whose change counts as tampering with the tests' set-up.
TAMPER_NAMES = ("conftest.py", "pytest.ini", "tox.ini", "setup.cfg", "pyproject.toml")
TAMPER_FOLDER = ".github/workflows/"


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 10_000):
        before = f
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + n * d), 1 + n / c
            f *= c * d
        if abs(f - before) <= 1e-16 * f:
            break
    return f * math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a


@functools.cache
def t_quantile(df: int, level: float = 0.95) -> float:
    """The value that Student's t with ``df`` degrees of freedom stays within, up or down, with probability ``level``."""
    if df < 1:
        return math.nan
    low, high = 0.0, 1e9
    while high - low > 1e-13 * high:  # the share outside t is the beta function at df / (df + t * t)
        t = (low + high) / 2
        low, high = (t, high) if _beta_share(df / 2, 0.5, df / (df + t * t)) > 1 - level else (low, t)
    return (low + high) / 2


def _t95(df: Column) -> Column:
    """The quantile for a column of a few rows."""
    def of(d: pd.Series) -> pd.Series:
        return d.map(lambda n: t_quantile(int(n))).astype(float)

    return F.pandas_udf(of, DoubleType())(df)


def grade(rollouts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rollouts of known tasks with ``missing`` (expected substrings that are absent) and ``correct``.

    Matching ignores letter case. The registry of tasks is joined as it is; Spark broadcasts it if it is small.
    """
    rubric = tasks.select(F.col("id").alias("task_id"), F.coalesce("expected_substrings", F.array().cast("array<string>")).alias("wanted"))
    answer = F.lower(F.coalesce("final_answer", F.lit("")))
    missing = F.filter("wanted", lambda w: ~F.contains(answer, F.lower(w)))
    return rollouts.join(rubric, "task_id").withColumn("missing", missing).withColumn("correct", F.size("missing") == 0).drop("wanted")


def correctness(graded: DataFrame, keys: list[str]) -> DataFrame:
    """``n, correct, rate`` and the distinct missing substrings of each cell; the texts are made distinct first."""
    rate = graded.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    gone = graded.select(*keys, F.explode("missing").alias("m")).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("m")), ", ").alias("missing"))
    joined = rate.alias("a").join(gone.alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left")
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], "n", "n_correct", (F.col("n_correct") / F.col("n")).alias("rate"), F.coalesce("missing", F.lit("")).alias("missing"))


def cells(rollouts: DataFrame, keys: list[str], cost: str = "total_cost_usd", means: tuple[str, ...] = ()) -> DataFrame:
    """``n``, mean, population deviation, least and most cost of each cell, and the means of other columns."""
    return rollouts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cost).alias("mean_cost"), F.coalesce(F.stddev_pop(cost), F.lit(0.0)).alias("std_cost"),
        F.min(cost).alias("min_cost"), F.max(cost).alias("max_cost"), *[F.avg(m).alias(f"mean_{m}") for m in means],
    )


def paired_totals(rollouts: DataFrame, arms: tuple[str, str], arm: str = "arm", seed: str = "seed", cost: str = "total_cost_usd") -> DataFrame:
    """One row: totals by seed of two arms, and the mean of their paired differences (first less second) with its 95 % interval.

    With fewer than two common seeds the interval is null.
    """
    a, b = arms
    seeds = rollouts.where(F.col(arm).isin(a, b)).groupBy(seed).agg(F.sum(F.when(F.col(arm) == a, F.col(cost))).alias("a"), F.sum(F.when(F.col(arm) == b, F.col(cost))).alias("b"))
    both = seeds.where("a is not null and b is not null").withColumn("d", F.col("a") - F.col("b"))
    s = both.agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_diff"), F.stddev_samp("d").alias("sd"))
    half = F.when(F.col("n") > 1, _t95(F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    return s.select("n", "mean_a", "mean_b", "mean_diff", (F.col("mean_diff") - half).alias("ci_low"), (F.col("mean_diff") + half).alias("ci_high"))


def regression(rates: DataFrame, base: str, other: str, tolerance: float = 0.1, arm: str = "arm") -> DataFrame:
    """``task_id, base_rate, other_rate, diff, verdict``: regressed below the tolerance, ok, or a missing arm."""
    wide = rates.where(F.col(arm).isin(base, other)).groupBy("task_id").agg(F.max(F.when(F.col(arm) == base, F.col("rate"))).alias("base_rate"), F.max(F.when(F.col(arm) == other, F.col("rate"))).alias("other_rate"))
    diff = F.col("other_rate") - F.col("base_rate")
    verdict = F.when(diff.isNull(), "missing arm").when(diff < -tolerance, "regressed").otherwise("ok")
    return wide.select("task_id", "base_rate", "other_rate", diff.alias("diff"), verdict.alias("verdict"))


def is_infra_failure(error: Column, resolved: Column, patch: Column | None = None) -> Column:
    """An evaluation that says nothing: an error, no verdict, or a patch that is there and blank."""
    said = F.coalesce(F.trim(error) != "", F.lit(False)) | resolved.isNull()
    return said if patch is None else said | F.coalesce(F.trim(patch) == "", F.lit(False))


def pair_arms(results: DataFrame, a: str, b: str, key: list[str], passed: str = "passed", arm: str = "arm") -> DataFrame:
    """``key, pass_a, pass_b`` of the tasks that both arms have; several runs of a task pass if any does."""
    wide = results.groupBy(*key).agg(F.max(F.when(F.col(arm) == a, F.col(passed))).alias("pass_a"), F.max(F.when(F.col(arm) == b, F.col(passed))).alias("pass_b"))
    return wide.where("pass_a is not null and pass_b is not null")


def mcnemar_counts(pairs: DataFrame) -> DataFrame:
    """One row: both, only a, only b, neither."""
    a, b = F.col("pass_a"), F.col("pass_b")
    return pairs.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither"))


def mcnemar_p(only_a: int, only_b: int) -> float:
    """Exact binomial for fewer than 25 discordant pairs, else chi-squared with continuity correction."""
    n = only_a + only_b
    if n == 0:
        return 1.0
    if n < 25:
        k = min(only_a, only_b)
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    stat = max(0, abs(only_a - only_b) - 1) ** 2 / n
    return math.erfc(math.sqrt(stat / 2))


def mcnemar(pairs: DataFrame) -> DataFrame:
    """The counts with their p-value."""
    counts = mcnemar_counts(pairs)
    row = counts.first()
    return counts.withColumn("p_value", F.lit(mcnemar_p(row.only_a, row.only_b)))


def majority(votes: DataFrame, key: list[str], pick: str = "pick") -> DataFrame:
    """``key, winner, votes``: the pick with the most votes, a tie where several have them."""
    counts = votes.where(F.col(pick).isNotNull()).groupBy(*key, pick).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*key).agg(F.max_by(F.struct(pick, "n"), F.struct("n", pick)).alias("b"), F.max("n").alias("m"), F.sum("n").alias("votes"))
    ties = counts.join(best.select(*key, F.col("m").alias("n")), [*key, "n"]).groupBy(*key).agg(F.count(F.lit(1)).alias("k"))
    return best.join(ties, key).select(*key, F.when(F.col("k") > 1, "tie").otherwise(F.col(f"b.{pick}")).alias("winner"), "votes")


def read_picks(verdicts: DataFrame, axes: list[str]) -> DataFrame:
    """``verdict_id, axis, judge, pick`` with picks as raw, treatment or tie; an unreadable axis of a read reply is a tie."""
    rows = verdicts.select("verdict_id", F.explode("per_judge").alias("e")).where(F.col("e.scored").isNotNull() & ~F.coalesce("e.parse_error", F.lit(False)))
    each = rows.select("verdict_id", F.col("e.judge_idx").alias("judge"), F.col("e.a_is_raw").alias("a_is_raw"), F.col("e.scored").alias("scored"), F.explode(F.array(*map(F.lit, axes))).alias("axis"))
    said = F.lower(F.trim(F.try_element_at("scored", "axis")["pick"]))
    first_is_raw = F.coalesce("a_is_raw", F.lit(True))
    pick = F.when(said.isin("raw", "treatment"), said).when(said == "a", F.when(first_is_raw, "raw").otherwise("treatment")).when(said == "b", F.when(first_is_raw, "treatment").otherwise("raw")).otherwise("tie")
    return each.select("verdict_id", "axis", "judge", pick.alias("pick")).distinct()


def judge_pairs(verdicts: DataFrame, axes: tuple[str, ...] = ("correctness", "substance", "conciseness"), decides: str = "correctness") -> DataFrame:
    """``verdict_id, winner, n_judges, raw_wins, treatment_wins, ties`` from the judges' replies.

    The winner is the majority on the deciding axis; tallies count picks on it.
    """
    picks = read_picks(verdicts, [decides])
    tally = picks.groupBy("verdict_id").agg(F.count(F.lit(1)).alias("n_judges"), *[F.count_if(F.col("pick") == p).alias(n) for p, n in (("raw", "raw_wins"), ("treatment", "treatment_wins"), ("tie", "ties"))])
    return tally.join(majority(picks, ["verdict_id"]).select("verdict_id", "winner"), "verdict_id").select("verdict_id", "winner", "n_judges", "raw_wins", "treatment_wins", "ties")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Wins of each side, ties and the treatment's share of decided verdicts, for each task."""
    w = F.lower(F.trim("winner"))
    n = verdicts.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(w == "raw").alias("raw_wins"), F.count_if(w == "treatment").alias("treatment_wins"), F.count_if(w == "tie").alias("ties"))
    decided = F.col("raw_wins") + F.col("treatment_wins")
    return n.withColumn("win_rate", F.when(decided > 0, F.col("treatment_wins") / decided).otherwise(0.0))


def running_budget(costs: DataFrame, key: list[str], order: list[str], cost: str, cap: float) -> DataFrame:
    """Rows with ``spent`` so far within their key and ``over``: whether the cap is passed."""
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return costs.withColumn("spent", F.sum(cost).over(upto)).withColumn("over", F.col("spent") > cap)


def token_cost(tokens: str, cached: str, output: str, in_rate: float, cached_rate: float, out_rate: float) -> Column:
    """Cost of a call: uncached input, cached input and output tokens at their rates for a million."""
    fresh = F.greatest(F.col(tokens) - F.coalesce(cached, F.lit(0)), F.lit(0))
    return (fresh * in_rate + F.coalesce(cached, F.lit(0)) * cached_rate + F.col(output) * out_rate) / 1e6


def tampered(paths: Column) -> Column:
    """The paths of an array that belong to the tests' set-up, distinct and in order."""
    name = lambda p: F.substring_index(p, "/", -1)
    return F.array_sort(F.array_distinct(F.filter(paths, lambda p: name(p).isin(*TAMPER_NAMES) | F.startswith(p, F.lit(TAMPER_FOLDER)))))


def salvage_json(text: Column, schema: str) -> Column:
    """A judge's reply as JSON: the whole text, else its part from the first to the last brace."""
    part = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)).when(F.try_parse_json(part).isNotNull(), F.from_json(part, schema))


def trimmed_text(text: Column, most: int) -> Column:
    """At most so many characters, with a mark for what was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.format_string("\n[... %d characters cut]", F.length(text) - most))).otherwise(text)


def markdown_report(cells_: DataFrame, interval: DataFrame) -> str:
    """Cells as a Markdown table and the interval's verdict; both are aggregates of a few rows."""
    rows = cells_.orderBy(*cells_.columns[:2]).collect()
    head = cells_.columns
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    lines += ["| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows]
    i = interval.first()
    if i is None or i.ci_low is None:
        verdict = "not enough seeds for an interval"
    elif i.ci_low > 0:
        verdict = "the treatment is cheaper"
    elif i.ci_high < 0:
        verdict = "the treatment is dearer"
    else:
        verdict = "no significant difference"
    low, high = (math.nan, math.nan) if i is None or i.ci_low is None else (i.ci_low, i.ci_high)
    return "\n".join([*lines, "", f"Paired difference: {low:.5f} to {high:.5f}; {verdict}."])


def paired_report(pairs: DataFrame) -> str:
    """The paired test as text."""
    r = mcnemar(pairs).first()
    n = r.both + r.only_a + r.only_b + r.neither
    return f"pairs: {n}\nboth pass: {r.both}\nonly a: {r.only_a}\nonly b: {r.only_b}\nneither: {r.neither}\np = {r.p_value:.4f}"
