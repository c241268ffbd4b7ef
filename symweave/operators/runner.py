"""Test-runner reports to totals, failures and frames, and the attribution of failures to edits.

Reports in JSON are found in the output and flattened by :mod:`symweave.operators.nested`; cargo's output is
JSON by lines, which are parsed by the JVM, lines that are no JSON being skipped. Runs are keyed by
``run_id``. An output without a report gives no row.
"""

from __future__ import annotations

import os
import re
import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symweave.functions.render import first_line
from symweave.operators import nested
from symweave.runtime import cut

_FRAME = r"(?:\(|at )([^\s():]+):(\d+)(?::\d+)?\)?"


def frames(text: Column) -> Column:
    """The stack frames in a message, ``at f (path:line:col)`` or ``at path:line``, as ``array<struct<file,line>>``."""
    spots = F.regexp_extract_all(text, F.lit(_FRAME), F.lit(0))
    parsed = F.transform(spots, lambda s: F.struct(F.regexp_extract(s, _FRAME, 1).alias("file"), F.least(F.regexp_extract(s, _FRAME, 2).try_cast("bigint"), F.lit(2**31 - 1)).cast("int").alias("line")))
    return F.coalesce(parsed, F.array().cast("array<struct<file:string,line:int>>"))


def _cast(c: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)), F.lit(2**31 - 1))).cast("int")


class Reports:
    """Flat tables of all JSON reports among outputs (``run_id, stdout``)."""

    JEST, PYTEST = "testResults", "tests"

    def __init__(self, outputs: DataFrame):
        self.records = cut(nested.find_records(outputs, "run_id", "stdout", (self.JEST, self.PYTEST)))
        self.tables = nested.flatten(self.records)

    def _table(self, path_: str, **columns: str) -> DataFrame:
        df = self.tables.get(path_)
        if df is None:
            df = self.records.sparkSession.createDataFrame([], "row_key string, parent_key string, key bigint, pos int, positions array<int>, is_null boolean")
        for c, kind in columns.items():
            if c not in df.columns:
                df = df.withColumn(c, F.lit(None).cast(kind))
        return df

    def totals(self) -> DataFrame:
        """``run_id, shape, passed, failed, skipped, duration_ms``."""
        names = ["numPassedTests", "numFailedTests", "numPendingTests", "summary_passed", "summary_failed", "summary_skipped", "duration"]
        root = self._table("", **dict.fromkeys(names, "string"))
        v = nested.parsed("json")
        jest = self.records.select("key", "seq", F.try_variant_get(v, "$.testResults", "variant").isNotNull().alias("is_jest"))
        root = root.withColumn("seq", F.substring_index("row_key", "#", -1).cast("int")).join(jest, ["key", "seq"])
        pick = lambda a, b: F.when(F.col("is_jest"), _cast(a)).otherwise(_cast(b))
        ms = F.coalesce(F.round(F.col("duration").try_cast("double") * 1000), F.lit(0)).cast("bigint")
        return root.select(F.col("key").alias("run_id"), F.when(F.col("is_jest"), "jest").otherwise("pytest").alias("shape"), pick("numPassedTests", "summary_passed").alias("passed"), pick("numFailedTests", "summary_failed").alias("failed"), pick("numPendingTests", "summary_skipped").alias("skipped"), F.when(F.col("is_jest"), F.lit(0)).otherwise(ms).alias("duration_ms"))

    def failures(self) -> DataFrame:
        """``run_id, test_name, file, line, message, stack`` of failed tests of all shapes."""
        results = self._table("testResults[]", name="string")
        tests = self._table("testResults[].assertionResults[]", fullName="string", status="string", location_line="bigint").where("status = 'failed'")
        said = self._table("testResults[].assertionResults[].failureMessages[]", value="string").where("not is_null")
        first = said.groupBy(F.col("parent_key").alias("row_key")).agg(F.min_by("value", "pos").alias("m"))
        files = results.select(F.col("row_key").alias("parent_key"), F.col("name").alias("file"))
        jest = tests.join(files, "parent_key", "left").join(first, "row_key", "left")
        jest = jest.select(F.col("key").alias("run_id"), F.col("fullName").alias("test_name"), "file", F.col("location_line").try_cast("int").alias("line"), F.coalesce(first_line(F.col("m")), F.lit("")).alias("message"), frames(F.col("m")).alias("stack"))
        py = self._table("tests[]", nodeid="string", outcome="string", lineno="string", call_longrepr="string", call_longrepr_reprcrash_message="string").where("outcome = 'failed'")
        trace = self._table("tests[].call.traceback[]", path="string", lineno="string", message="string").where("not is_null and path is not null")
        stacks = trace.groupBy(F.col("parent_key").alias("row_key")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("path").alias("file"), F.col("lineno").try_cast("int").alias("line")))).alias("s"))
        stack = F.coalesce(F.transform("s", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"))), F.array().cast("array<struct<file:string,line:int>>"))
        message = F.coalesce(F.col("call_longrepr_reprcrash_message"), F.col("call_longrepr"), F.lit(""))
        own_file, line = F.split_part("nodeid", F.lit("::"), F.lit(1)), F.col("lineno").try_cast("int")
        last = F.try_element_at(F.col("stack"), F.lit(-1))
        py = py.join(stacks, "row_key", "left").withColumn("stack", stack)
        py = py.select(F.col("key").alias("run_id"), F.element_at(F.split("nodeid", "::"), -1).alias("test_name"), F.coalesce(last["file"], own_file).alias("file"), F.coalesce(last["line"], line).alias("line"), first_line(message).alias("message"), "stack")
        return jest.unionByName(py)


_CARGO = "type string, event string, name string, stdout string, exec_time double"


def cargo_events(outputs: DataFrame) -> DataFrame:
    """``run_id, n, type, event, name, stdout, exec_time`` of the JSON lines of cargo outputs."""
    rows = outputs.select("run_id", F.posexplode(F.split("stdout", r"\r?\n")).alias("n", "text"))
    return rows.select("run_id", "n", F.from_json("text", _CARGO, {"mode": "PERMISSIVE"}).alias("e")).where(F.col("e.type").isNotNull()).select("run_id", "n", "e.*")


def cargo_totals(outputs: DataFrame) -> DataFrame:
    test = F.col("type") == "test"
    suite_time = F.max_by(F.when((F.col("type") == "suite") & F.col("exec_time").isNotNull(), F.col("exec_time")), F.when((F.col("type") == "suite") & F.col("exec_time").isNotNull(), F.col("n")))
    n = lambda event: F.count_if(test & (F.col("event") == event)).cast("int")
    return cargo_events(outputs).groupBy("run_id").agg(F.lit("cargo").alias("shape"), n("ok").alias("passed"), n("failed").alias("failed"), n("ignored").alias("skipped"), F.coalesce(F.round(suite_time * 1000), F.lit(0)).cast("bigint").alias("duration_ms"))


def panic_place(text: Column) -> tuple[Column, Column]:
    """File and line of a panic, in the old form (text, path at the end of the line) and in the new one."""
    old, new = r"panicked at .*, ([^\s,:]+):(\d+)(?::\d+)?", r"panicked at ([^\s,:']+):(\d+):\d+:"
    file = F.coalesce(F.nullif(F.regexp_extract(text, old, 1), F.lit("")), F.nullif(F.regexp_extract(text, new, 1), F.lit("")))
    line = F.coalesce(F.nullif(F.regexp_extract(text, old, 2), F.lit("")), F.nullif(F.regexp_extract(text, new, 2), F.lit("")))
    return file, line.cast("int")


def cargo_failures(outputs: DataFrame) -> DataFrame:
    failed = cargo_events(outputs).where("type = 'test' and event = 'failed'")
    file, line = panic_place(F.col("stdout"))
    return failed.select("run_id", F.col("name").alias("test_name"), file.alias("file"), line.alias("line"), F.coalesce(first_line(F.col("stdout")), F.lit("")).alias("message"), F.array().cast("array<struct<file:string,line:int>>").alias("stack"))


# ---------------------------------------------------------------- attribution


def frames_in_spans(found: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of frames (``frame_id, file, line``) and spans (``file, line_start, line_end, ...``) that hold them.

    Spans of 2**l lines at most lie in one or two blocks of 2**l lines, so frame and span meet by file, l and block:
    a frame meets the spans near it, not all spans of its file.
    """
    length = F.greatest(F.col("line_end").cast("bigint") - F.col("line_start"), F.lit(0)) + 1
    spans = spans.where(F.col("line_start") <= F.col("line_end")).withColumn("level", F.ceil(F.log2(length)).cast("int"))
    levels = sorted(r[0] for r in spans.select("level").distinct().collect())  # at most 33 numbers
    block = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("level"))).cast("bigint")
    spans = spans.withColumn("block", F.explode(F.array_distinct(F.array(block("line_start"), block("line_end")))))
    each = found.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).withColumn("block", block("line"))
    return each.join(spans, ["file", "level", "block"]).where(F.col("line").between(F.col("line_start"), F.col("line_end"))).drop("level", "block")


def attribute(failures: DataFrame, modified: DataFrame, ago: DataFrame) -> DataFrame:
    """Failures with ``message`` extended by the recently edited symbols that their frames touch.

    ``modified`` has symbols with spans, ``ago`` the number of edits since each (:func:`incremental.edits_ago`).
    """
    own = failures.withColumn("failure_id", F.xxhash64("run_id", "test_name", "file", "line", "message"))
    place = F.when(F.col("file").isNotNull() & F.col("line").isNotNull(), F.array(F.struct("file", "line"))).otherwise(F.array().cast("array<struct<file:string,line:int>>"))
    spots = own.select("failure_id", F.explode(F.array_distinct(F.concat("stack", place))).alias("f")).select("failure_id", "f.*").distinct()
    spans = modified.select("file", "name", "kind", "line_start", "line_end").distinct()
    hit = frames_in_spans(spots, spans).join(ago, ["file", "name", "kind"])
    said = F.format_string("YOU MODIFIED %s (%d edits ago)", "name", "edits_ago")
    notes = hit.select("failure_id", said.alias("note")).distinct().groupBy("failure_id").agg(F.array_join(F.array_sort(F.collect_list("note")), ". ").alias("notes"))
    out = own.join(notes, "failure_id", "left")
    message = F.when(F.col("notes").isNull(), F.col("message")).otherwise(F.concat("message", F.lit(". "), "notes"))
    return out.withColumn("message", message).drop("failure_id", "notes")


# ---------------------------------------------------------------- running tests (on the driver)


@dataclass
class Run:
    runner: str
    stdout: str
    duration_ms: int
    returncode: int


def autodetect(root: str) -> str | None:
    """vitest before jest before pytest before cargo, by the files of a project."""
    try:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            package = f.read()
    except OSError:
        package = ""
    here = set(os.listdir(root))
    if '"vitest"' in package or any(x.startswith("vitest.config") for x in here):
        return "vitest"
    if '"jest"' in package or any(x.startswith("jest.config") for x in here):
        return "jest"
    if here & {"pytest.ini", "conftest.py", "pyproject.toml", "setup.cfg"}:
        return "pytest"
    return "cargo" if "Cargo.toml" in here else None


def build_command(runner: str, pattern: str | None = None) -> list[str]:
    """The command line of a runner, with its own way of naming a test."""
    base = {
        "jest": ["npx", "jest", "--json"],
        "vitest": ["npx", "vitest", "run", "--reporter=json"],
        "pytest": ["pytest", "--json-report", "--json-report-file=-", "-q"],
        "cargo": ["cargo", "test", "--no-fail-fast", "--", "-Z", "unstable-options", "--format", "json"],
    }
    if runner not in base:
        raise ValueError(f"unknown runner {runner!r}")
    flag = {"jest": ["-t"], "vitest": ["-t"], "pytest": ["-k"], "cargo": []}[runner]
    if not pattern:
        return base[runner]
    if runner == "cargo":
        return ["cargo", "test", "--no-fail-fast", pattern, *base["cargo"][3:]]
    return [*base[runner], *flag, pattern]


def run(command: list[str], root: str, runner: str, timeout: float) -> Run:
    """Runs tests; a timeout raises TimeoutError, a crash without any result RuntimeError with the error output."""
    import time

    began = time.monotonic()
    try:
        done = subprocess.run(command, cwd=root, capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired as e:
        raise TimeoutError(f"{runner} did not end within {timeout} s") from e
    if done.returncode and not re.search(r'"(testResults|tests|type)"', done.stdout):
        raise RuntimeError(f"{runner} ended with {done.returncode}: {done.stderr[:500]}")
    return Run(runner, done.stdout, round((time.monotonic() - began) * 1000), done.returncode)
