"""Readers and writers of benchmark files, tolerant of what is missing or broken."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROLLOUTS = "task_id string, arm string, seed int, turns int, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, wall_seconds double, tool_calls map<string,int>, final_answer string, stopped_reason string, input_cost_usd double, output_cost_usd double, total_cost_usd double"
VERDICTS = "task_id string, seed int, winner string, n_judges int, raw_wins int, bg_wins int, ties int, axis_summary map<string,string>, raw_answer string, treatment_answer string, per_judge array<struct<judge_idx:int,a_is_raw:boolean,parse_error:boolean,raw_text:string,scored:map<string,struct<pick:string,reason:string>>>>"
TELEMETRY = "task_id string, arm string, input_tokens bigint, cached_input_tokens bigint, output_tokens bigint, turns bigint, patch_bytes bigint, wall_seconds double, cost_usd double, error string"
EVALUATION = "instance_id string, resolved boolean, error string, model_patch string"


def _found(paths: list[str]) -> list[str]:
    return sorted(p for x in paths for p in (glob.glob(x) if "://" not in x else [x]) if "://" in p or os.path.getsize(p) or os.path.isdir(p))


def read_jsonl(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines with a given schema; missing files, blank and broken lines give no rows."""
    found = _found(paths)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(found)


def load_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rollouts; an absent seed is 0."""
    return read_jsonl(spark, paths, ROLLOUTS).withColumn("seed", F.coalesce("seed", F.lit(0)))


def load_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """``task_id, resolved, infra_failure`` of a folder with one JSON file for each task; broken files are failures."""
    from symweave.operators.evalstats import is_infra_failure

    found = _found([os.path.join(folder, "*.json")])
    if not found:
        return spark.createDataFrame([], "task_id string, resolved boolean, infra_failure boolean")
    rows = spark.read.text(found, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("name"), F.from_json("value", EVALUATION).alias("e"))
    bad = is_infra_failure(F.col("e.error"), F.col("e.resolved"), F.col("e.model_patch"))
    return rows.select(F.coalesce("e.instance_id", "name").alias("task_id"), F.coalesce("e.resolved", F.lit(False)).alias("resolved"), bad.alias("infra_failure"))


def load_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """``instance, stem, trajectory, prediction`` of ``.traj`` files with their sibling ``.pred`` files."""

    def texts(ext: str, name: str) -> DataFrame:
        found = _found([os.path.join(folder, "**", f"*.{ext}"), os.path.join(folder, f"*.{ext}")])
        if not found:
            return spark.createDataFrame([], f"instance string, stem string, {name} string")
        path = F.input_file_name()
        return spark.read.text(sorted(set(found)), wholetext=True).select(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("instance"), F.regexp_extract(path, rf"([^/]+)\.{ext}$", 1).alias("stem"), F.col("value").alias(name))

    return texts("traj", "trajectory").join(texts("pred", "prediction"), ["instance", "stem"], "left")


def coerce_list(text: Column) -> Column:
    """A JSON-encoded list of strings; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def load_tasks(tasks: DataFrame, language: str | None = None, limit: int | None = None, lists: tuple[str, ...] = ()) -> DataFrame:
    """Tasks of a language, the first by id where a limit is asked, with their JSON lists decoded."""
    if language is not None:
        tasks = tasks.where(F.lower("language") == language)
    if limit is not None:
        tasks = tasks.orderBy("id").limit(limit)
    return tasks.withColumns({c: coerce_list(F.col(c)) for c in lists})


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def patches_json(df: DataFrame, prefix: str) -> DataFrame:
    """One JSON array text for each patch file: ``[{instance_id, patch, prefix}]``, ordered by id within a part.

    The rows are dealt to parts of bounded size; each part is one array, as the evaluator reads many files.
    """
    rows = df.where(F.trim(F.coalesce("model_patch", F.lit(""))) != "").select(F.struct(F.col("instance_id"), F.col("model_patch").alias("patch"), F.lit(prefix).alias("prefix")).alias("r"))
    part = F.pmod(F.xxhash64("r.instance_id"), F.lit(64))
    return rows.groupBy(part.alias("part")).agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("json"))
