import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from symweave.operators import evalstats, runner
from symweave.operators.vectors import nearest
from symweave.sources import readers


def test_cells_and_interval(df):
    # five seeds: the differences plain - tool are -3, -1, -2, -4, 0, with mean -2 and sample variance 2.5
    plain, tool = (7.0, 4.0, 6.0, 2.0, 5.0), (10.0, 5.0, 8.0, 6.0, 5.0)
    rows = [("k", arm, s, c, 3) for arm, costs in (("plain", plain), ("tool", tool)) for s, c in enumerate(costs)]
    r = df(rows, "task_id string, arm string, seed int, total_cost_usd double, turns int")
    cell = evalstats.cells(r.where("seed in (0, 3)"), ["task_id", "arm"]).where("arm = 'tool'").first()
    assert (cell.n, cell.mean_cost, cell.std_cost, cell.min_cost, cell.max_cost) == (2, 8.0, 2.0, 6.0, 10.0)
    assert evalstats.cells(r.where("seed = 1 and arm = 'tool'"), ["arm"]).first().std_cost == 0
    p = evalstats.paired_totals(r, ("plain", "tool")).first()
    half = 2.776445105 * math.sqrt(2.5 / 5)
    assert (p.n, p.mean_diff) == (5, -2.0) and math.isclose(p.ci_low, -2 - half, abs_tol=1e-8) and math.isclose(p.ci_high, -2 + half, abs_tol=1e-8)
    assert evalstats.paired_totals(r.where("seed = 4"), ("plain", "tool")).first().ci_low is None
    assert evalstats.paired_totals(r.limit(0), ("plain", "tool")).first().n == 0
    assert "dearer" in evalstats.markdown_report(evalstats.cells(r, ["task_id", "arm"]), p_frame(df, p))


def p_frame(df, row):
    return df([(row.ci_low, row.ci_high)], "ci_low double, ci_high double")


def test_intervals_of_many_seeds(df):
    # 40 seeds, differences +1 and -1 in turn: mean 0, sample deviation sqrt(40 / 39); t with 39 degrees of freedom is 2.0226909
    rows = [("k", arm, s, 5.0 + (s % 2 * 2 - 1 if arm == "plain" else 0)) for arm in ("plain", "tool") for s in range(40)]
    p = evalstats.paired_totals(df(rows, "task_id string, arm string, seed int, total_cost_usd double"), ("plain", "tool")).first()
    assert abs(p.mean_diff) < 1e-12 and math.isclose(p.ci_high, 2.0226909 / math.sqrt(39), rel_tol=1e-7)


@pytest.mark.parametrize("df, t", [(1, 12.70620474), (2, 4.30265273), (30, 2.04227246), (120, 1.97993041), (10**6, 1.95996636)])
def test_t_quantile(df, t):
    assert math.isclose(evalstats.t_quantile(df), t, rel_tol=1e-8)


# By hand: 2 * (1 + 7 + 21) / 2**7, 2 / 2**6, 1 by symmetry, no pair, and chi-squared (|40 - 20| - 1)**2 / 60 = 6.0166...
@pytest.mark.parametrize("a, b, p", [(2, 5, 58 / 128), (6, 0, 2 / 64), (4, 4, 1.0), (0, 0, 1.0), (40, 20, 0.014171)])
def test_mcnemar(a, b, p):
    assert evalstats.mcnemar_p(a, b) == evalstats.mcnemar_p(b, a) and math.isclose(evalstats.mcnemar_p(a, b), p, rel_tol=1e-3)


def test_pairing(df):
    rows = df([("t1", "a", True), ("t1", "b", False), ("t2", "a", True), ("t3", "a", False), ("t3", "b", True), ("t3", "b", False)], "t string, arm string, passed boolean")
    m = evalstats.mcnemar(evalstats.pair_arms(rows, "a", "b", ["t"])).first()
    assert (m.both, m.only_a, m.only_b, m.neither, m.p_value) == (0, 1, 1, 0, 1.0)
    assert "only a: 1" in evalstats.paired_report(evalstats.pair_arms(rows, "a", "b", ["t"]))


def test_grades(df):
    tasks = df([("t", "p", ["Foo", "bar"]), ("u", "p", None)], "id string, prompt string, expected_substrings array<string>")
    runs = df([("t", "a", "x FOO y bar"), ("t", "a", "foo"), ("t", "a", None), ("u", "a", "z"), ("none", "a", "z")], "task_id string, arm string, final_answer string")
    got = {r.task_id: (r.n, r.n_correct, r.missing) for r in evalstats.correctness(evalstats.grade(runs, tasks), ["task_id", "arm"]).collect()}
    assert got == {"t": (3, 1, "Foo, bar"), "u": (1, 1, "")}
    rates = df([("t", "a", 1.0), ("t", "b", 0.5), ("u", "a", 1.0)], "task_id string, arm string, rate double")
    assert {r.task_id: r.verdict for r in evalstats.regression(rates, "a", "b").collect()} == {"t": "regressed", "u": "missing arm"}


def test_votes(df):
    v = df([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, None)], "id int, pick string")
    assert {r.id: (r.winner, r.votes) for r in evalstats.majority(v, ["id"]).collect()} == {1: ("a", 3), 2: ("tie", 2)}


def test_small_expressions(df):
    r = df([(["a/conftest.py", "myconftest.py", ".github/workflows/x.yml", "a/conftest.py"],)], "p array<string>")
    assert r.select(evalstats.tampered(F.col("p"))).first()[0] == [".github/workflows/x.yml", "a/conftest.py"]
    t = df([('ok {"a": 1} end',), ('{"a": 2}',), ("no",), (None,)], "t string")
    assert [x[0].a if x[0] else None for x in t.select(evalstats.salvage_json(F.col("t"), "a int")).collect()] == [1, 2, None, None]
    assert df([("x" * 10,), ("y",)], "t string").select(evalstats.trimmed_text(F.col("t"), 4)).collect()[0][0] == "xxxx\n[... 6 characters cut]"
    spent = evalstats.running_budget(df([(1, 2.0), (2, 2.0), (3, 2.0)], "i int, c double").withColumn("k", F.lit(1)), ["k"], ["i"], "c", 3.0).orderBy("i")
    assert [(x.spent, x.over) for x in spent.collect()] == [(2.0, False), (4.0, True), (6.0, True)]
    bad = df([(None, True, "p"), ("e", True, "p"), (None, None, "p"), (None, False, " "), (None, False, None)], "error string, resolved boolean, patch string")
    assert [x[0] for x in bad.select(evalstats.is_infra_failure(F.col("error"), F.col("resolved"), F.col("patch"))).collect()] == [False, True, True, True, False]


def script_report():
    """Two files of a shop's tests; the basket loses an article, and a null stands among the messages."""
    lost = "TypeError: basket.articles is undefined\n    at total (shop/basket.ts:88:12)\n    at shop/basket.spec.ts:9:5"
    basket = [{"fullName": f"basket keeps article {i}", "status": "passed"} for i in range(5)]
    basket.append({"fullName": "basket adds up", "status": "failed", "location": {"line": 9, "column": 5}, "failureMessages": [None, lost]})
    till = [{"fullName": "till opens", "status": "pending"}, {"fullName": "till rings", "status": "passed", "failureMessages": []}]
    results = [{"name": "shop/basket.spec.ts", "assertionResults": basket}, {"name": "shop/till.spec.ts", "assertionResults": till}]
    return {"numPassedTests": 6, "numFailedTests": 1, "numPendingTests": 1, "testResults": results}


def python_report():
    """A failure deep in a call, one without a traceback, and a passing test."""
    deep = {"longrepr": "KeyError: 'iron'\nlong story", "traceback": [{"path": "ores/test_smelt.py", "lineno": 51, "message": ""}, {"path": "ores/smelt.py", "lineno": 7, "message": "KeyError"}]}
    tests = [
        {"nodeid": "ores/test_smelt.py::test_iron[hot]", "outcome": "failed", "lineno": 49, "call": deep},
        {"nodeid": "ores/test_mine.py::Shaft::test_depth", "outcome": "failed", "lineno": 14, "call": {"longrepr": "too shallow"}},
        {"nodeid": "ores/test_mine.py::test_lamp", "outcome": "passed", "lineno": 2},
    ]
    return {"summary": {"passed": 1, "failed": 2, "skipped": 4}, "duration": 2.5, "tests": tests}


def test_runner_reports(df):
    out = df([(1, json.dumps(script_report())), (2, "warming up\n" + json.dumps(python_report()) + "\nbye"), (3, "nothing"), (4, None)], "run_id bigint, stdout string")
    r = runner.Reports(out)
    assert {x.run_id: (x.passed, x.failed, x.skipped, x.duration_ms) for x in r.totals().collect()} == {1: (6, 1, 1, 0), 2: (1, 2, 4, 2500)}
    f = {(x.run_id, x.test_name): x for x in r.failures().collect()}
    a, b, c = f[1, "basket adds up"], f[2, "test_iron[hot]"], f[2, "test_depth"]
    assert len(f) == 3 and (a.file, a.line, a.message) == ("shop/basket.spec.ts", 9, "TypeError: basket.articles is undefined")
    assert [(s.file, s.line) for s in a.stack] == [("shop/basket.ts", 88), ("shop/basket.spec.ts", 9)]
    assert (b.file, b.line, b.message, len(b.stack)) == ("ores/smelt.py", 7, "KeyError: 'iron'", 2)
    assert (c.file, c.line, c.message, c.stack) == ("ores/test_mine.py", 14, "too shallow", [])
    assert runner.Reports(df([(3, "nothing")], "run_id bigint, stdout string")).totals().count() == 0


def test_cargo(df):
    tests = [{"event": "ok", "name": f"kiln::heats_{i}"} for i in range(3)] + [{"event": "ignored", "name": "kiln::slow"}]
    tests.append({"event": "failed", "name": "kiln::cools", "stdout": "thread 'kiln::cools' panicked at 'still 900 degrees', kiln/src/cool.rs:130:17\nnote"})
    tests.append({"event": "failed", "name": "kiln::opens", "stdout": "thread 'kiln::opens' panicked at kiln/src/door.rs:8:3:\nstuck"})
    suite = [{"type": "suite", "event": "started", "test_count": 6}, *[{"type": "test", **t} for t in tests], {"type": "suite", "event": "failed", "exec_time": 1.25}]
    lines = ["   Compiling kiln", *map(json.dumps, suite)]
    out = df([(1, "\n".join(lines))], "run_id bigint, stdout string")
    t = runner.cargo_totals(out).first()
    assert (t.passed, t.failed, t.skipped, t.duration_ms) == (3, 2, 1, 1250)
    assert {(x.test_name, x.file, x.line) for x in runner.cargo_failures(out).collect()} == {("kiln::cools", "kiln/src/cool.rs", 130), ("kiln::opens", "kiln/src/door.rs", 8)}


def test_attribution(df):
    failures = df([("r", "t", "a.rs", 12, "boom", [("a.rs", 12), ("z.rs", 1)]), ("r", "u", None, None, "other", [])], "run_id string, test_name string, file string, line int, message string, stack array<struct<file:string,line:int>>")
    spans = df([("a.rs", "f", "Function", 5, 20), ("a.rs", "g", "Function", 1, 3)], "file string, name string, kind string, line_start int, line_end int")
    ago = df([("a.rs", "f", "Function", 0)], "file string, name string, kind string, edits_ago bigint")
    got = {x.test_name: x.message for x in runner.attribute(failures, spans, ago).collect()}
    assert got == {"t": "boom. YOU MODIFIED f (0 edits ago)", "u": "other"}


def test_frames_meet_only_the_spans_near_them(df):
    spans = [(i, "f", 1, 2**31 - 1) for i in range(1)] + [(i, "f", a, a + n) for i, (a, n) in enumerate([(0, 0), (5, 0), (5, 10), (7, 1), (255, 2), (100, 1000), (9, -1)], 1)]
    points = [0, 1, 5, 6, 7, 8, 9, 15, 16, 255, 256, 257, 258, 1100, 1101, 2**31 - 1]
    got = runner.frames_in_spans(df([("f", x) for x in [*points, None]] + [("g", 5)], "file string, line int"), df(spans, "span int, file string, line_start int, line_end int"))
    assert sorted((r.line, r.span) for r in got.collect()) == sorted((x, i) for x in points for i, _, a, b in spans if a <= x <= b)
    assert runner.frames_in_spans(df([("f", 1)], "file string, line int"), df([], "file string, line_start int, line_end int")).count() == 0


def test_running(tmp_path):
    (tmp_path / "package.json").write_text('{"devDependencies": {"vitest": "1", "jest": "1"}}')
    assert runner.autodetect(str(tmp_path)) == "vitest"
    assert runner.build_command("pytest", "x")[-2:] == ["-k", "x"] and runner.build_command("cargo", "x")[:5] == ["cargo", "test", "--no-fail-fast", "x", "--"] and "--no-fail-fast" in runner.build_command("cargo")
    with pytest.raises(TimeoutError):
        runner.run(["sleep", "5"], str(tmp_path), "jest", 0.2)
    with pytest.raises(RuntimeError, match="ended with 1"):
        runner.run(["false"], str(tmp_path), "jest", 5)
    assert runner.run(["echo", '{"tests": []}'], str(tmp_path), "pytest", 5).stdout.startswith("{")


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"task_id":"t","arm":"raw","tool_calls":{"grep":2}}\n\nnot json\n{"task_id":"u","seed":3}\n')
    got = {r.task_id: r.seed for r in readers.load_runs(spark, [str(tmp_path / "*.jsonl"), str(tmp_path / "none.jsonl")]).collect()}
    assert got == {"t": 0, "u": 3} and readers.load_runs(spark, [str(tmp_path / "no")]).count() == 0
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "x.json").write_text('{"instance_id":"x","resolved":true}')
    (tmp_path / "ev" / "y.json").write_text("broken")
    assert {(r.task_id, r.resolved, r.infra_failure) for r in readers.load_evaluations(spark, str(tmp_path / "ev")).collect()} == {("x", True, False), ("y", False, True)}
    (tmp_path / "runs" / "i1").mkdir(parents=True)
    (tmp_path / "runs" / "i1" / "a.traj").write_text("T")
    (tmp_path / "runs" / "i1" / "a.pred").write_text("P")
    (tmp_path / "runs" / "i1" / "b.traj").write_text("U")
    assert {(r.instance, r.stem, r.prediction) for r in readers.load_trajectories(spark, str(tmp_path / "runs")).collect()} == {("i1", "a", "P"), ("i1", "b", None)}
    readers.write_jsonl(spark.createDataFrame([("t", 1)], "a string, b int"), str(tmp_path / "out"))
    readers.write_jsonl(spark.createDataFrame([("u", 2)], "a string, b int"), str(tmp_path / "out"), append=True)
    assert readers.read_jsonl(spark, [str(tmp_path / "out")], "a string, b int").count() == 2
    patches = readers.patches_json(spark.createDataFrame([("i", "diff"), ("j", " ")], "instance_id string, model_patch string"), "p").collect()
    assert [json.loads(r.json) for r in patches] == [[{"instance_id": "i", "patch": "diff", "prefix": "p"}]]
    tasks = spark.createDataFrame([("b", "Python", '["x"]'), ("a", "python", "bad"), ("c", "go", None)], "id string, language string, l string")
    assert [(r.id, r.l) for r in readers.load_tasks(tasks, "python", 1, ("l",)).collect()] == [("a", [])]


def test_nearest(df):
    v = df([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.2])], "vec_id bigint, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(v.where("vec_id in (0, 3)"), v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 5)]
    assert nearest(v.limit(0), v, 2).count() == 0


def test_debounce(df):
    from symweave.streaming.pipeline import debounce

    t = dt.datetime(2024, 1, 1)
    rows = df([("a", t), ("a", t + dt.timedelta(milliseconds=50)), ("a", t + dt.timedelta(milliseconds=200)), ("b", t)], "path string, ts timestamp")
    assert sorted((r.path, r.n) for r in debounce(rows).collect()) == [("a", 1), ("a", 2), ("b", 1)]
