"""Named queries of the benchmark statistics and the runner reports, each with its SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symweave.operators import evalstats, incremental, runner
from symweave.plans import views
from symweave.plans.views import FAILED, REPORTS, ROLL, STACK_TEXT
from symweave.runtime import cut, table
from symweave.sources.extract import extract_files, relations

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


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


@query(f"WITH {ROLL} SELECT task_id, arm, count(*) AS n, round(avg(total_cost_usd), 13) AS mean_cost, round(coalesce(stddev_pop(total_cost_usd), 0), 13) AS std_cost, round(min(total_cost_usd), 13) AS min_cost, round(max(total_cost_usd), 13) AS max_cost, round(avg(input_tokens), 9) AS mean_input_tokens, round(avg(turns), 9) AS mean_turns FROM roll GROUP BY task_id, arm")
def cell_stats(spark, d):
    """costs of each task and arm."""
    cells = evalstats.cells(views.rollouts(spark, d), ["task_id", "arm"], means=("input_tokens", "turns"))
    costs = {c: F.round(c, 13) for c in ("mean_cost", "std_cost", "min_cost", "max_cost")}
    return cells.withColumns(costs | {c: F.round(c, 9) for c in ("mean_input_tokens", "mean_turns")})


_TOTALS = f"WITH {ROLL}, s AS (SELECT seed, sum(total_cost_usd) FILTER (arm = 'raw') AS a, sum(total_cost_usd) FILTER (arm = 'treatment') AS b FROM roll WHERE arm IN ('raw', 'treatment') GROUP BY seed)"
# The quantile of Student's t by bisection; the probability by its finite series for an even or odd number of degrees of freedom.
_SERIES = """CASE WHEN f % 2 = 0 THEN sin(atan(x / sqrt(f))) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(cos(atan(x / sqrt(f))), 2 * k) for k in range(f // 2)])
    ELSE 2 / pi() * (atan(x / sqrt(f)) + sin(atan(x / sqrt(f))) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(cos(atan(x / sqrt(f))), 2 * k + 1) for k in range((f - 1) // 2)]), 0)) END"""
_T = f"""t AS (SELECT f, 0::DOUBLE AS low, 1000::DOUBLE AS high, 0 AS step FROM (SELECT greatest(n - 1, 1) AS f FROM m)
    UNION ALL SELECT f, CASE WHEN p < 0.95 THEN x ELSE low END, CASE WHEN p < 0.95 THEN high ELSE x END, step + 1 FROM (SELECT *, {_SERIES} AS p FROM (SELECT *, (low + high) / 2 AS x FROM t)) WHERE step < 60)"""


@query(_TOTALS + " SELECT seed, round(a, 6) AS raw_total, round(b, 6) AS treatment_total FROM s")
def arm_totals(spark, d):
    """totals of both arms for each seed."""
    r = views.rollouts(spark, d).where("arm in ('raw', 'treatment')")
    total = lambda x: F.round(F.sum(F.when(F.col("arm") == x, F.col("total_cost_usd"))), 6)
    return r.groupBy("seed").agg(total("raw").alias("raw_total"), total("treatment").alias("treatment_total"))


@query(_TOTALS.replace("WITH", "WITH RECURSIVE", 1) + f""", p AS (SELECT a, b, a - b AS d FROM s WHERE a IS NOT NULL AND b IS NOT NULL), m AS (SELECT count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS mean_diff, stddev_samp(d) AS sd FROM p), {_T}
    SELECT n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(mean_diff, 6) AS mean_diff, round(mean_diff - CASE WHEN n > 1 THEN high END * sd / sqrt(n), 6) AS ci_low, round(mean_diff + CASE WHEN n > 1 THEN high END * sd / sqrt(n), 6) AS ci_high FROM m, t WHERE step = 60""")
def paired_diff(spark, d):
    """The paired difference of the arms with its interval."""
    return _rounded(evalstats.paired_totals(views.rollouts(spark, d), ("raw", "treatment")), 6)


_GRADE = ROLL + ", g AS (SELECT r.*, list_filter(t.expected_substrings, lambda w: NOT contains(lower(coalesce(r.final_answer, '')), lower(w))) AS missing FROM roll r JOIN task_registry t ON t.id = r.task_id)"


def _graded(spark, d) -> DataFrame:
    return evalstats.grade(views.rollouts(spark, d), table(spark, d, "task_registry"))


@query(f"""WITH {_GRADE}, m AS (SELECT task_id, arm, string_agg(DISTINCT w, ', ' ORDER BY w) AS missing FROM (SELECT task_id, arm, unnest(missing) AS w FROM g) GROUP BY ALL)
    SELECT c.task_id, c.arm, n, n_correct, round(n_correct / n, 9) AS rate, coalesce(m.missing, '') AS missing FROM (SELECT task_id, arm, count(*) AS n, count(*) FILTER (len(missing) = 0) AS n_correct FROM g GROUP BY ALL) c LEFT JOIN m ON m.task_id IS NOT DISTINCT FROM c.task_id AND m.arm IS NOT DISTINCT FROM c.arm""")
def grade_rate(spark, d):
    """How many answers hold all expected substrings."""
    return _rounded(evalstats.correctness(_graded(spark, d), ["task_id", "arm"]))


@query(f"""WITH {_GRADE}, c AS (SELECT task_id, avg(CASE WHEN len(missing) = 0 THEN 1.0 ELSE 0.0 END) FILTER (arm = 'raw') AS a, avg(CASE WHEN len(missing) = 0 THEN 1.0 ELSE 0.0 END) FILTER (arm = 'treatment') AS b FROM g WHERE arm IN ('raw', 'treatment') GROUP BY task_id)
    SELECT task_id, round(a, 9) AS base_rate, round(b, 9) AS other_rate, round(b - a, 9) AS diff, CASE WHEN b - a IS NULL THEN 'missing arm' WHEN b - a < -0.1 THEN 'regressed' ELSE 'ok' END AS verdict FROM c""")
def regression_verdict(spark, d):
    """tasks on which the treatment is worse by more than the tolerance."""
    rates = evalstats.correctness(_graded(spark, d), ["task_id", "arm"])
    return _rounded(evalstats.regression(rates, "raw", "treatment"))


_PAIRS = ROLL + ", p AS (SELECT task_id, seed, max(stopped_reason = 'done_marker') FILTER (arm = 'raw') AS pa, max(stopped_reason = 'done_marker') FILTER (arm = 'treatment') AS pb FROM (SELECT * FROM roll WHERE stopped_reason IS NOT NULL) GROUP BY task_id, seed)"


def _pairs(spark, d) -> DataFrame:
    r = views.rollouts(spark, d).where("stopped_reason is not null").withColumn("passed", F.col("stopped_reason") == "done_marker")
    return evalstats.pair_arms(r, "raw", "treatment", ["task_id", "seed"])


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (pa AND pb) AS both, count(*) FILTER (pa AND NOT pb) AS only_a, count(*) FILTER (NOT pa AND pb) AS only_b, count(*) FILTER (NOT pa AND NOT pb) AS neither FROM p WHERE pa IS NOT NULL AND pb IS NOT NULL")
def mcnemar_counts(spark, d):
    """Paired outcomes of two arms."""
    return evalstats.mcnemar_counts(_pairs(spark, d))


_CHOOSE = "exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1))"
_NORMAL = "1 - 2 * exp(-z * z / 2) / sqrt(2 * pi()) * list_sum([exp((2 * k + 1) * ln(greatest(z, 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2) for k in range(400)])"


@query(f"""WITH {_PAIRS}, c AS (SELECT count(*) FILTER (pa AND pb) AS "both", count(*) FILTER (pa AND NOT pb) AS only_a, count(*) FILTER (NOT pa AND pb) AS only_b, count(*) FILTER (NOT pa AND NOT pb) AS neither FROM p WHERE pa IS NOT NULL AND pb IS NOT NULL),
    n AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS least_, greatest(abs(only_a - only_b) - 1, 0) / sqrt(greatest(only_a + only_b, 1)) AS z FROM c)
    SELECT "both", only_a, only_b, neither, round(CASE WHEN n = 0 THEN 1 WHEN n < 25 THEN least(1, 2 * list_sum([{_CHOOSE} for i in range(least_ + 1)]) / pow(2, n)) ELSE {_NORMAL} END, 9) AS p_value FROM n""")
def mcnemar_test(spark, d):
    """the counts with the p-value."""
    return _rounded(evalstats.mcnemar(_pairs(spark, d)))


_PICKS = """e AS (SELECT verdict_id, unnest(per_judge) AS j FROM judge_verdicts),
    s AS (SELECT DISTINCT verdict_id, j.judge_idx AS judge, coalesce(j.a_is_raw, true) AS a_is_raw, lower(trim(j.scored['correctness'].pick)) AS said FROM e WHERE j.scored IS NOT NULL AND NOT coalesce(j.parse_error, false)),
    v AS (SELECT DISTINCT verdict_id, judge, CASE WHEN said IN ('raw', 'treatment') THEN said WHEN said = 'a' THEN CASE WHEN a_is_raw THEN 'raw' ELSE 'treatment' END WHEN said = 'b' THEN CASE WHEN a_is_raw THEN 'treatment' ELSE 'raw' END ELSE 'tie' END AS pick FROM s),
    c AS (SELECT verdict_id, pick, count(*) AS n FROM v GROUP BY ALL), m AS (SELECT verdict_id, max(n) AS m, sum(n)::BIGINT AS votes FROM c GROUP BY ALL),
    w AS (SELECT m.verdict_id, CASE WHEN count(*) > 1 THEN 'tie' ELSE min(pick) END AS winner, any_value(votes) AS votes FROM m JOIN c ON c.verdict_id = m.verdict_id AND c.n = m.m GROUP BY m.verdict_id)"""


@query(f"WITH {_PICKS} SELECT verdict_id, winner, votes FROM w")
def majority_vote(spark, d):
    """the plain majority of the judges."""
    return evalstats.majority(evalstats.read_picks(table(spark, d, "judge_verdicts"), ["correctness"]), ["verdict_id"])


@query(f"WITH {_PICKS} SELECT w.verdict_id, winner, count(*) AS n_judges, count(*) FILTER (pick = 'raw') AS raw_wins, count(*) FILTER (pick = 'treatment') AS treatment_wins, count(*) FILTER (pick = 'tie') AS ties FROM w JOIN v ON v.verdict_id = w.verdict_id GROUP BY w.verdict_id, winner")
def judge_pairs(spark, d):
    """Verdicts made anew from the judges' replies."""
    return evalstats.judge_pairs(table(spark, d, "judge_verdicts"))


@query("""WITH s AS (SELECT DISTINCT verdict_id, task_id, lower(trim(winner)) AS w FROM judge_verdicts), c AS (SELECT task_id, count(*) AS n, count(*) FILTER (w = 'raw') AS raw_wins, count(*) FILTER (w = 'treatment') AS treatment_wins, count(*) FILTER (w = 'tie') AS ties FROM s GROUP BY task_id)
    SELECT *, round(CASE WHEN raw_wins + treatment_wins > 0 THEN treatment_wins / (raw_wins + treatment_wins) ELSE 0 END, 9) AS win_rate FROM c""")
def verdict_summary(spark, d):
    """F16: stored verdicts by task."""
    v = table(spark, d, "judge_verdicts").select("verdict_id", "task_id", F.lower(F.trim("winner")).alias("winner")).distinct()
    return _rounded(evalstats.verdict_summary(v))


@query(f"WITH {ROLL} SELECT rollout_id, run_label, round(spent, 8) AS spent, spent > 5.0 AS \"over\" FROM (SELECT rollout_id, run_label, sum(total_cost_usd) OVER (PARTITION BY run_label ORDER BY started_at, rollout_id ROWS UNBOUNDED PRECEDING) AS spent FROM roll)")
def budget_running(spark, d):
    """costs so far in each run, and whether they pass the cap."""
    spent = evalstats.running_budget(views.rollouts(spark, d), ["run_label"], ["started_at", "rollout_id"], "total_cost_usd", 5.0)
    return spent.select("rollout_id", "run_label", F.round("spent", 8).alias("spent"), "over")


_NAMES = "(" + ", ".join(f"'{x}'" for x in evalstats.TAMPER_NAMES) + ")"


@query(f"WITH p AS (SELECT src_file AS file, list(DISTINCT split_part(src_file, '/', 1) || '/' || kind || CASE WHEN line % 50 = 0 THEN '/conftest.py' ELSE '/main.py' END) AS paths FROM (SELECT DISTINCT edge_id, {views.norm_sql('src_file')} AS src_file, kind, line FROM edges) GROUP BY src_file) SELECT file, array_to_string(list_sort(list_filter(paths, lambda x: regexp_extract(x, '[^/]*$') IN {_NAMES} OR starts_with(x, '{evalstats.TAMPER_FOLDER}'))), ' ') AS tampered FROM p")
def tamper_flags(spark, d):
    """Changed paths that belong to the tests' set-up."""
    e = views.edges(spark, d, "src_file", "kind", "line")
    name = F.when(F.col("line") % 50 == 0, "/conftest.py").otherwise("/main.py")
    paths = e.select(F.col("src_file").alias("file"), F.concat(F.substring_index("src_file", "/", 1), F.lit("/"), "kind", name).alias("p")).distinct().groupBy("file").agg(F.collect_list("p").alias("paths"))
    return paths.select("file", F.array_join(evalstats.tampered(F.col("paths")), " ").alias("tampered"))


@query(f"WITH {ROLL} SELECT rollout_id, round((greatest(input_tokens - coalesce(cached_input_tokens, 0), 0) * 0.3 + coalesce(cached_input_tokens, 0) * 0.03 + output_tokens * 1.2) / 1e6, 9) AS cost FROM roll")
def token_costs(spark, d):
    """costs from tokens and rates."""
    return views.rollouts(spark, d).select("rollout_id", F.round(evalstats.token_cost("input_tokens", "cached_input_tokens", "output_tokens", 0.3, 0.03, 1.2), 9).alias("cost"))


@query(f"WITH {ROLL} SELECT k.key AS tool, sum(k.value)::BIGINT AS calls, count(*) AS rollouts FROM (SELECT unnest(map_entries(tool_calls)) AS k FROM roll) GROUP BY k.key")
def tool_usage(spark, d):
    """Calls of each tool, from the maps of the rollouts."""
    r = table(spark, d, "rollouts")
    one = r.groupBy("rollout_id").agg(F.max_by(F.map_entries("tool_calls"), "loaded_at").alias("e"))
    return one.select(F.explode("e").alias("k")).groupBy(F.col("k.key").alias("tool")).agg(F.sum("k.value").alias("calls"), F.count(F.lit(1)).alias("rollouts"))


@query(f"""WITH {ROLL} SELECT rollout_id, CASE WHEN length(final_answer) > 200 THEN substr(final_answer, 1, 200) || chr(10) || '[... ' || (length(final_answer) - 200) || ' characters cut]' ELSE final_answer END AS answer FROM roll""")
def trimmed_answers(spark, d):
    """Answers cut for a prompt, with a mark for what was cut."""
    return views.rollouts(spark, d).select("rollout_id", evalstats.trimmed_text(F.col("final_answer"), 200).alias("answer"))


# ---------------------------------------------------------------- runner reports


def _outputs(spark, d, cargo: bool) -> DataFrame:
    r = table(spark, d, "runner_reports").where(F.col("stdout").isNotNull())
    mine = F.lower(F.trim("runner")).eqNullSafe("cargo")
    return r.where(mine if cargo else ~mine).groupBy(F.col("report_id").alias("run_id")).agg(F.max_by("stdout", F.struct("loaded_at", F.xxhash64("stdout"))).alias("stdout"))


def _whole_sql(jest: str, pytest: str) -> str:
    return f"greatest(0, least(coalesce(TRY_CAST(CASE WHEN is_jest THEN json_extract_string(j, '$.{jest}') ELSE json_extract_string(j, '$.{pytest}') END AS BIGINT), 0), 2147483647))::INT"


@query(f"""WITH {REPORTS} SELECT run_id, CASE WHEN is_jest THEN 'jest' ELSE 'pytest' END AS shape, {_whole_sql('numPassedTests', 'summary.passed')} AS passed, {_whole_sql('numFailedTests', 'summary.failed')} AS failed, {_whole_sql('numPendingTests', 'summary.skipped')} AS skipped,
    CASE WHEN is_jest THEN 0 ELSE coalesce(round(TRY_CAST(json_extract_string(j, '$.duration') AS DOUBLE) * 1000), 0)::BIGINT END AS duration_ms FROM rep""")
def runner_totals(spark, d):
    """M1 M2 M3 F8: passed, failed and skipped of all JSON reports."""
    return runner.Reports(_outputs(spark, d, False)).totals()


def _stack_text(df: DataFrame) -> DataFrame:
    return df.withColumn("stack", F.array_join(F.transform("stack", lambda x: F.concat(x["file"], F.lit(":"), F.coalesce(x["line"].cast("string"), F.lit("?")))), " "))


@query(f"WITH {FAILED} SELECT run_id, test_name, file, line, message, {STACK_TEXT} AS stack FROM failed")
def runner_failures(spark, d):
    """Failed tests with message, place and frames."""
    return _stack_text(runner.Reports(_outputs(spark, d, False)).failures())


_CARGO = """o AS (SELECT report_id AS run_id, stdout FROM (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY loaded_at DESC) AS rn FROM runner_reports WHERE lower(trim(runner)) = 'cargo' AND stdout IS NOT NULL) WHERE rn = 1),
    l AS (SELECT run_id, unnest(string_split(stdout, chr(10))) AS t FROM o), e AS (SELECT run_id, json_extract_string(t, '$.type') AS type, json_extract_string(t, '$.event') AS event, json_extract_string(t, '$.name') AS name, json_extract_string(t, '$.stdout') AS stdout FROM l WHERE json_valid(t))"""


@query(f"WITH {_CARGO} SELECT run_id, count(*) FILTER (type = 'test' AND event = 'ok')::INT AS passed, count(*) FILTER (type = 'test' AND event = 'failed')::INT AS failed, count(*) FILTER (type = 'test' AND event = 'ignored')::INT AS skipped FROM e WHERE type IS NOT NULL GROUP BY run_id")
def cargo_totals(spark, d):
    """M4 F8: totals from JSON lines."""
    return runner.cargo_totals(_outputs(spark, d, True)).select("run_id", "passed", "failed", "skipped")


@query(f"WITH {_CARGO} SELECT run_id, name AS test_name, nullif(regexp_extract(stdout, 'panicked at .*, ([^\\s,:]+):(\\d+)', 1), '') AS file, nullif(regexp_extract(stdout, 'panicked at .*, ([^\\s,:]+):(\\d+)', 2), '')::INT AS line, count(*) AS n FROM e WHERE type = 'test' AND event = 'failed' GROUP BY ALL")
def cargo_failures(spark, d):
    """Panics with their place."""
    return runner.cargo_failures(_outputs(spark, d, True)).groupBy("run_id", "test_name", "file", "line").agg(F.count(F.lit(1)).alias("n"))


def _own_failures(spark, d) -> DataFrame:
    """Failed tests with the folders of their files, below that of their repository, in place of the files.

    The reports name files that the symbols do not have, but folders that they have.
    """
    reports = table(spark, d, "runner_reports").groupBy(F.col("report_id").alias("run_id")).agg(F.min("repo").alias("repo"))
    found = runner.Reports(_outputs(spark, d, False)).failures()
    path = lambda c: views.folder(F.concat(F.col("repo"), F.lit("/"), F.regexp_replace(c, r"^(/ws/|\./)", "")))
    stack = F.transform("stack", lambda x: F.struct(path(x["file"]).alias("file"), x["line"].alias("line")))
    return found.join(reports, "run_id").withColumns({"file": path(F.col("file")), "stack": stack}).drop("repo")


def _folder_sql(c: str) -> str:
    return f"regexp_replace(repo || '/' || regexp_replace({c}, '^(/ws/|\\./)', ''), '/[^/]*$', '')"


_OWN = f"""{FAILED}, own AS (SELECT f.run_id, test_name, {_folder_sql('file')} AS file, line, message, list_transform(stack, lambda x: struct_pack(file := {_folder_sql('x.file')}, line := x.line)) AS stack
        FROM failed f JOIN (SELECT report_id AS run_id, min(repo) AS repo FROM runner_reports GROUP BY 1) r USING (run_id)),
    spot AS (SELECT DISTINCT run_id, test_name, file, line, message, unnest(list_concat(stack, CASE WHEN file IS NOT NULL AND line IS NOT NULL THEN [struct_pack(file := file, line := line)] ELSE [] END)) AS p FROM own)"""


@query(f"""WITH {views.SYM}, {_OWN} SELECT s.file, s.name, s.kind, s.line_start, count(*) AS frames FROM (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS file, name, kind, line_start, line_end FROM sym) s JOIN spot ON s.file = p.file AND p.line BETWEEN s.line_start AND s.line_end GROUP BY ALL""")
def attribute_failures(spark, d):
    """The frames of failed tests inside of symbols."""
    place = F.when(F.col("file").isNotNull() & F.col("line").isNotNull(), F.array(F.struct("file", "line"))).otherwise(F.array().cast("array<struct<file:string,line:int>>"))
    each = _own_failures(spark, d).select("run_id", "test_name", "file", "line", "message", F.explode(F.concat("stack", place)).alias("p")).distinct()
    spots = each.select("p.file", "p.line")
    spans = views.symbols(spark, d, "line_start", "line_end").withColumn("file", views.folder(F.col("file"))).distinct()
    return runner.frames_in_spans(spots, spans).groupBy("file", "name", "kind", "line_start").agg(F.count(F.lit(1)).alias("frames"))


@query(f"""WITH {views.SYM}, {_OWN}, log AS (SELECT regexp_replace(file, '/[^/]*$', '') AS file, name, kind, max(epoch_us(indexed_at)) AS seq FROM symbols WHERE indexed_at IS NOT NULL GROUP BY 1, 2, 3),
    hit AS (SELECT DISTINCT x.run_id, x.test_name, x.file, x.line, x.message, 'YOU MODIFIED ' || s.name || ' (' || ((SELECT max(seq) FROM log) - l.seq) || ' edits ago)' AS note
        FROM spot x JOIN (SELECT DISTINCT regexp_replace(file, '/[^/]*$', '') AS file, name, kind, line_start, line_end FROM sym) s ON s.file = x.p.file AND x.p.line BETWEEN s.line_start AND s.line_end JOIN log l ON l.file = s.file AND l.name = s.name AND l.kind = s.kind),
    notes AS (SELECT run_id, test_name, file, line, message, string_agg(note, '. ' ORDER BY note) AS notes FROM hit GROUP BY ALL)
    SELECT o.run_id, o.test_name, o.file, o.line, o.message || coalesce('. ' || n.notes, '') AS message, {STACK_TEXT} AS stack
    FROM own o LEFT JOIN notes n ON o.run_id = n.run_id AND o.test_name IS NOT DISTINCT FROM n.test_name AND o.file IS NOT DISTINCT FROM n.file AND o.line IS NOT DISTINCT FROM n.line AND o.message = n.message""")
def failure_attribution(spark, d):
    """M5 G1: failures with notes on the edited symbols that their frames touch."""
    own = _own_failures(spark, d)
    s = views.symbols(spark, d, "line_start", "line_end").withColumn("file", views.folder(F.col("file")))
    log = table(spark, d, "symbols").where("indexed_at is not null").select(F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("seq"), views.folder(F.col("file")).alias("file"), "name", "kind").distinct()
    numbered = log.groupBy("file", "name", "kind").agg(F.max("seq").alias("seq"))
    return _stack_text(runner.attribute(own, s, incremental.edits_ago(numbered)))


# ---------------------------------------------------------------- extraction

#: Lines that begin a declaration, by the extension of their language.
_DECLARED = re.compile(
    (
        r"(?m)^(?:(?P<py>(?:async )?def |class \w+[^{\n]*: *$)"
        r"|(?P<rs>(?:pub(?:\([^)\n]*\))? )?(?:(?:async |const |unsafe )*fn |(?:struct|trait|mod) \w+[^\n]*[{;] *$)|impl\b[^\n]*\{ *$)"
        r"|(?P<ts>(?:export )?(?:default )?(?:async )?function\b|(?:export )?(?:default )?(?:abstract )?class \w+[^\n]*\{ *$|(?:export )?interface \w+[^\n]*\{ *$))"
    ).replace(" ", r"[^\S\n]")  # blanks of any kind
)


def code_parts(text: str | None) -> list[tuple[str, str]]:
    """``(extension, content)`` for each language that declares something at the start of a line of a text.

    The lines from the first declaration on; a paragraph with a declaration and what follows it belong to its
    language until one with a declaration of another. Lines of other languages are blank, so that numbers stay.
    """
    found = [(m.start(), m.lastgroup) for m in _DECLARED.finditer(text or "")]
    if not found:
        return []
    first, now = found[0]
    begins = [(first, now)]
    for at, ext in found:
        if ext != now:
            begins.append((max(text.rfind("\n\n", 0, at) + 2, begins[-1][0]) if "\n\n" in text[begins[-1][0] : at] else at, ext))
            now = ext
    pieces = [(ext, text[a:b]) for (a, ext), (b, _) in zip(begins, [*begins[1:], (len(text), "")])]
    return [(ext, "".join(t if e == ext else "\n" * t.count("\n") for e, t in pieces)) for ext in dict(pieces)]


def code_files(spark, d) -> DataFrame:
    """Documents that hold code, as one source file for each language in them."""
    parts = F.udf(code_parts, "array<struct<ext: string, content: string>>")
    docs = table(spark, d, "documents").select("doc_id", F.explode(parts("text")).alias("p"))
    return docs.select(F.concat(F.lit("code/d"), F.col("doc_id").cast("string"), F.lit("."), "p.ext").alias("path"), "p.content")


@query()
def extract_symbols(spark, d):
    """Symbols of the code in the documents, each language of a document as a file of its own."""
    symbols, _, _ = relations(cut(extract_files(code_files(spark, d))))
    return symbols.select("file", "name", "kind", "line_start", "line_end", "signature", "visibility", "is_async")


@query()
def extract_calls(spark, d):
    """Calls in the code of the documents, resolved within their files."""
    _, edges, _ = relations(cut(extract_files(code_files(spark, d))))
    return edges.groupBy("src_file", "src_name", "dst_name").agg(F.min("line").alias("line"))


# ---------------------------------------------------------------- vectors

@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(a::DOUBLE[], embedding::DOUBLE[]) AS similarity FROM q, embeddings WHERE vec_id <> query_id)
    SELECT query_id, rank::INT AS rank, vec_id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def semantic_topk(spark, d):
    """The ten nearest vectors of every hundredth one."""
    from symweave.operators.vectors import nearest

    e = table(spark, d, "embeddings")
    return nearest(e.where("vec_id % 100 = 0"), e, 10).withColumn("similarity", F.round("similarity", 6))
