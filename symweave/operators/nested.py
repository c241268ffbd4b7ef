"""Deeply nested records to related flat tables.

``infer_schema`` merges the shapes of all records into one schema in a single pass: for every path the
kinds of value that were seen there, with counts that add up across partitions. ``flatten`` walks that
schema and explodes each list level into a child table that carries the surrogate key of its parent and
the position in the list. Nested objects become columns of the level they stand in.

Defined results: records that are null, empty or no JSON give no rows; one too large to parse is an error. Where one record has a list and
another a lone value, the lone value counts as a list of one. A null or absent list gives no child rows,
an empty one neither; a null entry of a list gives a row whose ``is_null`` is true, so positions stay
true to the record. A field whose type changes comes out as text (objects and lists as JSON). Repeated
rows of the same record give one record. Fields whose column names would clash (``a.b`` beside ``a_b``, or
letter case only) get a number behind the later name. Columns of the input other than the key are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symweave.runtime import table

_START = re.compile(r'[{\[]|"(?=(?:\s|\\[nrt])*(?:\\?[{\[]))')


def _finite(text: str) -> float | None:
    value = float(text)
    return value if math.isfinite(value) else None


#: Bytes of a record from which on it must parse; a VARIANT holds 16 MiB at the least.
LONG = 16 * 1024 * 1024

#: NaN, Infinity and numbers beyond all doubles have no place in the tables; they count as null.
_DECODER = json.JSONDecoder(parse_constant=lambda _: None, parse_float=_finite)


# ---------------------------------------------------------------- records inside of other text


def embedded_objects(text: str | None, wanted: tuple[str, ...]) -> list[dict]:
    """The complete JSON objects with one of the ``wanted`` fields, in order, wherever they stand in ``text``.

    They may be the whole text, lie among other output, under fields of another value, or inside a JSON
    string. An object whose wanted fields are neither lists nor objects is one unless it holds such an object. An object that breaks off is none. Each start is tried once and a complete value is skipped as
    a whole, so the time is linear in the text for every level of nesting that breaks off. An object nested
    deeper than the parser can follow (thousands of levels) raises ValueError, so that no record is lost unseen.
    """
    found: list[dict] = []

    def walk(value: object) -> None:
        if isinstance(value, dict):
            if any(isinstance(value.get(w), (list, dict)) for w in wanted):
                found.append(value)
                return
            before = len(found)
            for v in value.values():
                walk(v)
            if len(found) == before and any(w in value for w in wanted):
                found.append(value)
        elif isinstance(value, list):
            for v in value:
                walk(v)
        elif isinstance(value, str) and any(w in value for w in wanted):
            scan(value)

    def scan(s: str) -> None:
        at = 0
        while m := _START.search(s, at):
            try:
                value, at = _DECODER.raw_decode(s, m.start())
            except RecursionError:
                raise ValueError(f"an object at character {m.start()} is nested deeper than the parser can follow") from None
            except ValueError:
                at = m.end()
                continue
            walk(value)

    if text and any(w in text for w in wanted):
        scan(text)
    return found


def find_records(df: DataFrame, key: str, text: str, wanted: tuple[str, ...]) -> DataFrame:
    """``key, seq, json`` for every complete object with a wanted field in ``text``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, json.dumps(o)) for k, s in zip(b["k"], b["t"]) for i, o in enumerate(embedded_objects(s, wanted))]
            yield pd.DataFrame(rows, columns=["key", "seq", "json"])

    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("seq", T.IntegerType()), T.StructField("json", T.StringType())])
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("k").isNotNull() & F.col("t").isNotNull())
    return rows.mapInPandas(run, schema)


# ---------------------------------------------------------------- merged schema


@dataclass(frozen=True)
class Node:
    """A place in the merged schema: the kinds seen there and its fields or list entries."""

    path: tuple[str, ...]
    kinds: frozenset[str]
    children: tuple["Node", ...]

    @property
    def is_list(self) -> bool:
        return "list" in self.kinds

    @property
    def is_object(self) -> bool:
        return "object" in self.kinds


#: The step into a list; no field can have this name, as fields are kept behind a dot.
ENTRY = "[]"


def _shapes(value: object, path: tuple[str, ...], out: Counter) -> None:
    if isinstance(value, dict):
        out[path, "object"] += 1
        for k, v in value.items():
            _shapes(v, (*path, "." + k), out)
    elif isinstance(value, list):
        out[path, "list"] += 1
        for v in value:
            _shapes(v, (*path, ENTRY), out)
    else:
        kind = "null" if value is None else {bool: "boolean", int: "bigint", float: "double"}.get(type(value), "string")
        out[path, kind] += 1


def infer_schema(records: DataFrame, column: str = "json") -> Node:
    """The merged schema of all records. What reaches the driver is one row per path and kind, not per record."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for s in b["j"]:
                try:
                    _shapes(json.loads(s), (), seen)
                except (TypeError, ValueError):
                    continue
        yield pd.DataFrame([(json.dumps(p), k, n) for (p, k), n in seen.items()], columns=["path", "kind", "n"])

    counts = records.select(F.col(column).alias("j")).mapInPandas(run, "path string, kind string, n bigint")
    rows = counts.groupBy("path", "kind").agg(F.sum("n").alias("n")).collect()
    kinds: dict[tuple[str, ...], set[str]] = {}
    for r in rows:
        kinds.setdefault(tuple(json.loads(r.path)), set()).add(r.kind)
    below: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for p in sorted(kinds):
        if p:
            below.setdefault(p[:-1], []).append(p)

    def build(p: tuple[str, ...]) -> Node:
        return Node(p, frozenset(kinds.get(p, ())), tuple(build(c) for c in below.get(p, [])))

    return build(())


def _merge(a: Node, b: Node) -> Node:
    """Two nodes that mean the same place: the entries of a list and the lone values in its stead."""
    by = {c.path[-1]: c for c in a.children}
    for c in b.children:
        by[c.path[-1]] = _merge(by[c.path[-1]], c) if c.path[-1] in by else c
    return Node(a.path, a.kinds | b.kinds, tuple(by.values()))


# ---------------------------------------------------------------- flat tables


def _field(v: Column, name: str) -> Column:
    if "'" not in name and "\\" not in name:
        return F.try_variant_get(v, f"$['{name}']", "variant")
    return F.try_element_at(v.try_cast("map<string,variant>"), F.lit(name))


def _entries(v: Column) -> Column:
    """The value as a list: a lone value is a list of one, null and absent ones are no list."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).otherwise(F.coalesce(whole, F.array(v)))


def _columns(node: Node, v: Column, taken: dict[str, int], prefix: str = "") -> list[Column]:
    """The scalar fields of a level; fields of nested objects carry the object's name in front."""
    out = []
    for c in node.children:
        step = c.path[-1]
        if step == ENTRY or c.is_list:
            continue
        name, value = prefix + step[1:], _field(v, step[1:])
        scalars = c.kinds - {"object", "null"}
        if scalars or not c.is_object:
            kind = next(iter(scalars)) if len(scalars) == 1 and not c.is_object else "double" if scalars == {"bigint", "double"} and not c.is_object else "string"
            label = re.sub(r"\W", "_", name)
            taken[label.lower()] = n = taken.get(label.lower(), 0) + 1
            out.append(F.try_variant_get(value, "$", kind).alias(label if n == 1 else f"{label}_{n}"))
        if c.is_object:
            out += _columns(c, value, taken, name + "_")
    return out


def flatten(records: DataFrame, schema: Node | None = None) -> dict[str, DataFrame]:
    """Flat tables from rows ``key, seq, json``: the table ``""`` of records and one for each list path.

    Every table has ``row_key`` and ``key``; a child also has ``parent_key``, ``pos`` (its place in the
    list, from 0), ``positions`` (the places on all levels, outermost first) and ``is_null``. A table's name
    is its path, such as ``testResults[].assertionResults[]``.
    """
    schema = schema or infer_schema(records)
    out: dict[str, DataFrame] = {}
    base = ("row_key", "parent_key", "key", "pos", "positions", "is_null")

    def level(df: DataFrame, node: Node, name: str) -> None:
        taken = {c: 1 for c in base}
        v = F.col("_v")
        keep = [c for c in base if c in df.columns]
        columns = _columns(node, v, taken)
        if name and (node.kinds - {"object", "list", "null"}):
            scalars = node.kinds - {"object", "null", "list"}
            kind = next(iter(scalars)) if len(scalars) == 1 and not node.is_object else "string"
            taken["value"] = n = taken.get("value", 0) + 1
            columns.append(F.try_variant_get(v, "$", kind).alias("value" if n == 1 else f"value_{n}"))
        out[name] = df.select(*keep, *columns)
        lists(df, node, v, name)

    def lists(df: DataFrame, node: Node, v: Column, name: str) -> None:
        for c in node.children:
            if c.path[-1] == ENTRY:  # a list that stands directly in a list
                if node.is_list and name.endswith("[]"):
                    child(df, v, c, Node(c.path, frozenset(), ()), name + "[]")
                continue
            value, label = _field(v, c.path[-1][1:]), (name + "." if name else "") + c.path[-1][1:]
            if c.is_list:
                entry = next((e for e in c.children if e.path[-1] == ENTRY), Node((*c.path, ENTRY), frozenset(), ()))
                lone = Node(c.path, c.kinds - {"list"}, tuple(e for e in c.children if e.path[-1] != ENTRY))
                child(df, value, entry, lone, label + "[]")
            elif c.is_object:
                lists(df, c, value, label)

    def child(df: DataFrame, value: Column, entry: Node, lone: Node, label: str) -> None:
        n, given = 1, label
        while label in out:  # a field ``a.b`` and the field ``b`` of an object ``a`` have one path
            n += 1
            label = f"{given[:-2]}_{n}[]"
        before = F.col("positions") if "positions" in df.columns else F.array().cast("array<int>")
        rows = df.select("key", F.col("row_key").alias("parent_key"), before.alias("_before"), F.posexplode(_entries(value)).alias("pos", "_v"))
        rows = rows.select(
            F.concat_ws("/", "parent_key", F.concat(F.lit(label.rsplit(".", 1)[-1].rstrip("[]")), F.lit(":"), "pos")).alias("row_key"),
            "parent_key", "key", "pos", F.concat("_before", F.array("pos")).alias("positions"),
            (F.col("_v").isNull() | F.is_variant_null("_v")).alias("is_null"), "_v",
        )
        level(rows, _merge(entry, lone), label)

    root = records.select("key", F.concat_ws("#", F.col("key").cast("string"), "seq").alias("row_key"), parsed("json").alias("_v"))
    level(root, schema, "")
    return out


def parsed(json: str) -> Column:
    """A record as a VARIANT: null where it is no JSON; a long one raises, as it may be beyond the size of a VARIANT."""
    return F.when(F.octet_length(json) > LONG, F.parse_json(json)).otherwise(F.try_parse_json(json))


# ---------------------------------------------------------------- runner reports


def latest_reports(reports: DataFrame) -> DataFrame:
    """``report_id, stdout`` of the jest, vitest and pytest reports, the latest delivery of each id.

    Among deliveries at the same time the one with the larger hash of its text stays; null outputs and null
    ids are left out. A null runner is not cargo, so its outputs are looked through.
    """
    rows = reports.where(~F.lower(F.trim("runner")).eqNullSafe("cargo") & F.col("stdout").isNotNull() & F.col("report_id").isNotNull())
    return rows.groupBy("report_id").agg(F.max_by("stdout", F.struct("loaded_at", F.xxhash64("stdout"))).alias("stdout"))


def report_records(spark, sf_dir: str) -> DataFrame:
    """``key, seq, json`` for each complete report in ``runner_reports.stdout``."""
    return find_records(latest_reports(table(spark, sf_dir, "runner_reports")), "report_id", "stdout", ("testResults", "tests"))


FAILURES, FRAMES = "testResults[].assertionResults[].failureMessages[]", "tests[].call.traceback[]"


def report_leaves(tables: dict[str, DataFrame]) -> DataFrame | None:
    """``report_id, outer_pos, inner_pos, leaf_pos`` of all non-null failure messages and traceback frames."""
    parts = []
    if FAILURES in tables:
        parts.append(tables[FAILURES].where("not is_null").select(F.col("key").alias("report_id"), F.col("positions")[0].alias("outer_pos"), F.col("positions")[1].alias("inner_pos"), F.col("positions")[2].alias("leaf_pos")))
    if FRAMES in tables:
        parts.append(tables[FRAMES].where("not is_null").select(F.col("key").alias("report_id"), F.col("positions")[0].alias("outer_pos"), F.lit(-1).alias("inner_pos"), F.col("positions")[1].alias("leaf_pos")))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
