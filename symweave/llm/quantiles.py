"""Exact percentiles per group by distributed multi-select, and summaries of them that can be combined.

All wanted ranks of all groups are searched at once. Every partition is sorted once and kept. In each round
every partition reports, for each range that is still searched, how many of its values lie below, on and
above the pivot, and the medians of the two sides. The side that holds the rank stays, the other is ruled
out, and the weighted median of the partitions' medians of that side is the next pivot, so that each round
drops at least a quarter of what is left. This is repeated until the pivot is the value, for groups of any
size; no group is gathered. Once the ranges hold less than half of the table, only what they hold is written
again. The driver gets at most ``REPORTS`` rows a round: with more ranges than that, they are searched in
blocks, and what a block found is written to the shared folder.

``summaries`` keeps of every slice (say, a day of a group) at most ``size`` values at evenly spaced ranks
with their weights; slices merge by putting their rows together. The rank of a percentile read from merged
slices is off by at most the sum of ``n / (2 * size) + 1`` over the slices of more than ``size`` values; a
smaller slice is its own summary, needs no search and adds no error.

Defined results: nulls and NaN are no values; they are counted in ``n_missing``. Infinities are the largest
and smallest values, -0.0 equals 0.0. The p-quantile of n values is the value of rank ``n - floor(n - p * n)``,
at least 1: always one of the values. Group labels are compared without outer blanks and letter case; a null
label is a group of its own. A group without values has null percentiles. Of re-delivered rows the one with
the largest ``loaded_at`` holds (ties: by a hash of the row). Integers are exact up to 2**53. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from symweave.operators import skew
from symweave.runtime import cut

REPORTS = 1_000_000
_LOW, _HIGH = -(2**63), 2**63 - 1


def to_key(v: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order."""
    bits = (v + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def from_key(k: np.ndarray) -> np.ndarray:
    return np.where(k < 0, k ^ np.int64(2**63 - 1), k).view(np.float64)


def rank_of(q: float, n: int) -> int:
    return max(1, n - math.floor(n - q * n))


def _whole(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """A partition's group numbers and keys, sorted; stored partitions already are."""
    parts = [(b["g"].to_numpy(np.int64), b["k"].to_numpy(np.int64)) for b in batches]
    g = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
    k = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)
    if not ((g[1:] > g[:-1]) | ((g[1:] == g[:-1]) & (k[1:] >= k[:-1]))).all():
        o = np.lexsort((k, g))
        g, k = g[o], k[o]
    return g, k


def _bounds(g: np.ndarray, k: np.ndarray, s: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each open range ``(lo, hi)`` of a group in a sorted partition."""
    lo, hi = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    first, last = np.searchsorted(g, s["g"], "left"), np.searchsorted(g, s["g"], "right")
    for i, (a, b, x, y) in enumerate(zip(first, last, s["lo"], s["hi"])):
        lo[i] = a + np.searchsorted(k[a:b], x, "right") if x > _LOW else a
        hi[i] = a + np.searchsorted(k[a:b], y, "left") if y < _HIGH else b
    return lo, np.maximum(lo, hi)


def _weighted_medians(told: pd.DataFrame, median: str, weight: str, n: int) -> pd.Series:
    """For each of ``n`` ranges ``i`` the weighted median of what the partitions report, 0 where they report none."""
    t = told[told[weight] > 0].sort_values(["i", median])
    share = t.groupby("i")[weight].cumsum() * 2 >= t.groupby("i")[weight].transform("sum")
    return t[share].groupby("i")[median].first().reindex(range(n), fill_value=0).astype(np.int64)


def _first_pivots(values: DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """The weighted medians of the partitions' medians of whole ranges."""
    sent = values.sparkSession.sparkContext.broadcast(ranges[["g", "lo", "hi"]])

    def medians(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, k = _whole(batches)
        a, b = _bounds(g, k, sent.value)
        on = np.flatnonzero(b > a)
        yield pd.DataFrame({"i": on, "m": k[(a[on] + b[on]) // 2] if len(on) else np.empty(0, np.int64), "w": (b - a)[on]})

    told = values.mapInPandas(medians, "i bigint, m bigint, w bigint").toPandas()
    return ranges.assign(pivot=_weighted_medians(told, "m", "w", len(ranges)))


def _narrow(values: DataFrame, state: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    """One round: ``state`` (g, rank, k, lo, hi) with the part of its range that holds the rank, the size n of this part and its pivot.

    ``ranges`` are the different ranges (g, lo, hi, pivot); those of one group are equal or apart. A found value has ``lo = hi``.
    """
    sent = values.sparkSession.sparkContext.broadcast(ranges)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, k = _whole(batches)
        s = sent.value
        a, b = _bounds(g, k, s)
        rows = []
        pivots = s["pivot"].to_numpy()
        for i in np.flatnonzero(b > a):
            x, y, p = a[i], b[i], pivots[i]
            m1, m2 = x + np.searchsorted(k[x:y], p, "left"), x + np.searchsorted(k[x:y], p, "right")
            rows.append((i, m1 - x, m2 - m1, y - m2, k[(x + m1) // 2] if m1 > x else 0, k[(m2 + y) // 2] if y > m2 else 0))
        yield pd.DataFrame(rows, columns=["i", "less", "same", "more", "below", "above"]).astype(np.int64)

    told = values.mapInPandas(count, "i bigint, less bigint, same bigint, more bigint, below bigint, above bigint").toPandas()
    sums = told.groupby("i")[["less", "same", "more"]].sum().reindex(range(len(ranges)), fill_value=0)
    sums["below"], sums["above"] = _weighted_medians(told, "below", "less", len(ranges)), _weighted_medians(told, "above", "more", len(ranges))
    sent.destroy()
    out = state.merge(ranges.assign(i=np.arange(len(ranges))), on=["g", "lo", "hi"]).join(sums, on="i")
    left, right = out["k"] <= out["less"], out["k"] > out["less"] + out["same"]
    here = ~left & ~right
    pivot = out["pivot"]
    last = (left & (out["less"] == 1)) | (right & (out["more"] == 1))  # what is left is the median told
    side = out["below"].where(left, out["above"])
    out["lo"], out["hi"] = out["lo"].where(left, pivot), out["hi"].where(right, pivot)
    out.loc[last, "lo"] = out.loc[last, "hi"] = side[last]
    out["k"] = out["k"].where(~right, out["k"] - out["less"] - out["same"])
    out["n"] = out["less"].where(left, out["more"])
    out["pivot"] = side.where(~here, pivot)
    return out[["g", "rank", "k", "lo", "hi", "n", "pivot"]]


def _inside(values: DataFrame, ranges: pd.DataFrame) -> DataFrame:
    """The values in the ranges, sorted within partitions."""
    sent = values.sparkSession.sparkContext.broadcast(ranges.sort_values(["g", "lo"]))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, k = _whole(batches)
        a, b = _bounds(g, k, sent.value)
        for i in np.flatnonzero(b > a):
            for x in range(a[i], b[i], 50_000):
                y = min(b[i], x + 50_000)
                yield pd.DataFrame({"g": g[x:y], "k": k[x:y]})

    return values.mapInPandas(keep, "g bigint, k bigint")


def multi_select(values: DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The keys of the wanted ranks: ``g, rank, key``.

    ``values`` has ``g, k``; ``wanted`` has ``g, rank, n`` with the size n of each group.
    """
    span = ["g", "lo", "hi"]
    size = int(wanted.drop_duplicates("g")["n"].sum())
    state = wanted.assign(lo=_LOW, hi=_HIGH, k=wanted["rank"]).reset_index(drop=True)
    found = [pd.DataFrame({"g": [], "rank": [], "lo": []}, dtype=np.int64)]
    ranges = _first_pivots(values, state[span].drop_duplicates().reset_index(drop=True)) if len(state) else None
    while len(state):
        told = _narrow(values, state.drop(columns=["n", "pivot"], errors="ignore"), ranges)
        hit = told["lo"] == told["hi"]
        found.append(told.loc[hit, ["g", "rank", "lo"]])
        state = told[~hit].reset_index(drop=True)
        left = state[[*span, "n", "pivot"]].drop_duplicates(span).reset_index(drop=True)
        ranges = left[[*span, "pivot"]]
        if len(left) and left["n"].sum() * 2 < size:
            values = cut(_inside(values, left[span]))
            size = int(left["n"].sum())
    return pd.concat(found).rename(columns={"lo": "key"}).astype(np.int64)


def label(name: Column) -> Column:
    """A group label without outer blanks and letter case."""
    return F.lower(F.regexp_replace(name, r"^\s+|\s+$", ""))


def latest(rollouts: DataFrame, columns: list[str], key: str = "rollout_id", at: str = "loaded_at") -> DataFrame:
    """The columns of the latest delivery of each id; rows without an id are all kept."""
    row = F.struct(*columns)
    with_id = rollouts.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(row, F.struct(at, F.xxhash64(row))).alias("r")).select("r.*")
    return with_id.unionByName(rollouts.where(F.col(key).isNull()).select(*columns))


def _long(rows: DataFrame, groups: dict[str, Column], metrics: list[str]) -> DataFrame:
    """``group columns, metric, v``, one row for each value or missing value."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x")
    return rows.select(*[c.alias(n) for n, c in groups.items()], each).select(*groups, "x.metric", "x.v")


def _prepared(rows: DataFrame, groups: dict[str, Column], metrics: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table ``g, k`` of values by group number, and the numbered groups with their sizes."""
    long = _long(rows, groups, metrics)
    names = [*groups, "metric"]
    valid = F.col("v").isNotNull() & ~F.isnan("v")
    sizes = long.groupBy(*names).agg(F.count_if(valid).alias("n"), F.count_if(~valid).alias("n_missing"))
    sizes = cut(sizes.withColumn("g", F.xxhash64(*names)))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": b["g"], "k": to_key(b["v"].to_numpy(np.float64))})

    values = long.where(valid).select(F.xxhash64(*names).alias("g"), "v").mapInPandas(keyed, "g bigint, k bigint")
    return cut(values.sortWithinPartitions("g", "k")), sizes


def _ranks(sizes: pd.DataFrame, quantiles: list[float]) -> pd.DataFrame:
    rows = [(g, rank_of(q, n), n, q) for g, n in zip(sizes["g"], sizes["n"]) if n for q in quantiles]
    return pd.DataFrame(rows, columns=["g", "rank", "n", "q"]).astype({"g": np.int64, "rank": np.int64, "n": np.int64, "q": float})


def _blocks(values: DataFrame, sizes: DataFrame, per_group: int) -> Iterator[pd.DataFrame]:
    """The groups in blocks, so that a round reports at most ``REPORTS`` rows."""
    most = max(1, REPORTS // max(1, values.rdd.getNumPartitions()) // per_group)
    n = sizes.count()
    blocks = max(1, -(-n // most))
    for b in range(blocks):
        yield sizes.where(F.pmod("g", F.lit(blocks)) == b).select("g", "n").toPandas()


def _stored(parts: Iterator[tuple[list, str]], spark: SparkSession) -> DataFrame | None:
    """What the blocks found, block by block in the shared folder, so that the driver keeps nothing."""
    out, n = None, 0
    for data, columns in parts:
        part = cut(spark.createDataFrame(data, columns))
        out, n = part if out is None else out.unionByName(part), n + 1
        if n % 16 == 0:
            out = cut(out.coalesce(16))
    return out


def percentiles(rows: DataFrame, groups: dict[str, Column], metrics: list[str], quantiles: list[float]) -> DataFrame:
    """``groups, metric, n, n_missing, p..., rank_error`` with one exact column for each quantile."""
    values, sizes = _prepared(rows, groups, metrics)
    names = [f"p{round(q * 100)}" for q in quantiles]

    def parts() -> Iterator[tuple[list, str]]:
        for block in _blocks(values, sizes, len(quantiles)):
            ranks = _ranks(block, quantiles)
            got = multi_select(values, ranks[["g", "rank", "n"]].drop_duplicates())
            wide = ranks.merge(got, on=["g", "rank"])
            wide["v"] = from_key(wide["key"].to_numpy(np.int64))
            yield [(int(g), {names[quantiles.index(q)]: float(v) for q, v in zip(x["q"], x["v"])}) for g, x in wide.groupby("g")], "g bigint, m map<string,double>"

    out = sizes.join(_stored(parts(), rows.sparkSession), "g", "left")
    return out.select(*groups, "metric", "n", "n_missing", *[F.col("m")[c].alias(c) for c in names], F.lit(0).cast("bigint").alias("rank_error"))


def summaries(rows: DataFrame, groups: dict[str, Column], metrics: list[str], size: int = 64) -> DataFrame:
    """``groups, metric, n, value, weight``: at most ``size`` values a slice, each standing for ``weight`` values.

    Slice i of ``size`` equal parts of the sorted values is represented by its middle one.
    """
    values, sizes = _prepared(rows, groups, metrics)

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"g": b["g"], "value": from_key(b["k"].to_numpy(np.int64)), "weight": np.ones(len(b), np.int64)})

    # the largest slices are no summaries of their own; they are left out before the shuffle
    large = [r.g for r in sizes.where(F.col("n") > size).orderBy(F.desc("n"), "g").limit(skew.HOT).collect()]
    rest = values.where(~F.col("g").isin(large)) if large else values
    out = rest.join(sizes.where(F.col("n") <= size).select("g"), "g", "left_semi").mapInPandas(back, "g bigint, value double, weight bigint")

    def parts() -> Iterator[tuple[list, str]]:
        for block in _blocks(values, sizes.where(F.col("n") > size), size) if large else ():
            points = []
            for g, n in zip(block["g"], block["n"]):
                for i in range(size):
                    a, b = i * n // size, (i + 1) * n // size
                    points.append((g, a + (b - a + 1) // 2, n, b - a))
            p = pd.DataFrame(points, columns=["g", "rank", "n", "weight"]).astype(np.int64)
            got = multi_select(values, p[["g", "rank", "n"]]).merge(p[["g", "rank", "weight"]], on=["g", "rank"])
            yield list(zip(map(int, got["g"]), map(float, from_key(got["key"].to_numpy(np.int64))), map(int, got["weight"]))), "g bigint, value double, weight bigint"

    selected = _stored(parts(), rows.sparkSession)
    out = out if selected is None else out.unionByName(selected)
    return sizes.select("g", *groups, "metric", "n").join(out, "g").drop("g")


def merged(summary: DataFrame, by: list[str], quantiles: list[float], size: int = 64) -> DataFrame:
    """Percentiles from any set of summary rows: ``by, metric, n, p..., rank_error``.

    The weights of equal values are added first, so a group sorts no more rows than it has kept values.
    """
    keys = [*by, "metric"]
    parts = summary.select(*[c for c in summary.columns if c not in ("value", "weight")]).distinct()
    off = F.when(F.col("n") > size, F.ceil(F.col("n") / (2 * size)) + 1).otherwise(0)
    counts = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(off).alias("rank_error"))
    values = summary.groupBy(*keys, "value").agg(F.sum("weight").alias("weight"))
    upto = F.sum("weight").over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy("value"))
    total = F.sum("weight").over(Window.partitionBy(*[F.col(k) for k in keys]))
    run = values.withColumn("upto", upto).withColumn("total", total)
    at = {f"p{round(q * 100)}": F.greatest(F.lit(1), F.col("total") - F.floor(F.col("total") - q * F.col("total"))) for q in quantiles}
    picked = run.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") >= r, F.col("value"))).alias(c) for c, r in at.items()])
    joined = counts.alias("c").join(picked.alias("p"), [F.col(f"c.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    return joined.select(*[F.col(f"c.{k}").alias(k) for k in keys], "n", *at, F.col("rank_error").cast("bigint").alias("rank_error"))


METRICS = ["input_tokens", "wall_seconds", "total_cost_usd"]


def rollout_percentiles(rollouts: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)) -> DataFrame:
    """Exact percentiles of the rollouts' metrics per arm."""
    one = latest(rollouts, ["arm", *METRICS])
    return percentiles(one, {"arm": label(F.col("arm"))}, METRICS, list(quantiles))


def rollout_summaries(rollouts: DataFrame, size: int = 64) -> DataFrame:
    """Summaries of the rollouts' metrics per arm and day."""
    one = latest(rollouts, ["arm", "started_at", *METRICS])
    return summaries(one, {"arm": label(F.col("arm")), "day": F.to_date("started_at")}, METRICS, size)
