import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.llm import quantiles as q

SCHEMA = "rollout_id bigint, arm string, started_at timestamp, input_tokens bigint, wall_seconds double, total_cost_usd double, loaded_at timestamp, metric string, n int"
T = dt.datetime(2024, 1, 1)


@given(st.lists(st.floats(allow_nan=False), max_size=30))
def test_keys_keep_the_order(values):
    v = np.array(values, np.float64)
    k = q.to_key(v)
    assert list(np.argsort(k, kind="stable")) == list(np.argsort(v + 0.0, kind="stable")) and np.array_equal(q.from_key(k), v)


def exact(values, p):
    return sorted(values)[q.rank_of(p, len(values)) - 1]


@pytest.mark.parametrize("seed", [1, 7])
def test_multi_select(df, seed):
    r = random.Random(seed)
    groups = {g: [r.choice([r.randint(0, 3), r.randint(-1000, 1000), 5]) for _ in range(n)] for g, n in ((1, 1), (2, 50), (3, 700), (4, 300))}
    rows = [(g, k) for g, ks in groups.items() for k in ks]
    r.shuffle(rows)
    values = df(rows, "g bigint, k bigint").repartition(5)
    ranks = [(g, rank, len(ks)) for g, ks in groups.items() for rank in sorted({1, len(ks), (len(ks) + 1) // 2, max(1, len(ks) // 3)})]
    got = q.multi_select(values, pd.DataFrame(ranks, columns=["g", "rank", "n"]))
    assert {(g, k): v for g, k, v in got[["g", "rank", "key"]].itertuples(index=False)} == {(g, k): sorted(groups[g])[k - 1] for g, k, _ in ranks}


def rows(n=400, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        arm = r.choice(["raw", "raw", " RAW ", "Treatment", None])
        tokens = r.choice([None, r.randint(0, 10), r.randint(0, 10**12)])
        wall = r.choice([None, float("nan"), r.expovariate(1), float("inf"), -0.0, 0.0])
        out.append((i, arm, T + dt.timedelta(days=r.randrange(3)), tokens, wall, r.random(), T, "x", 1))
    return out


def by_arm(data):
    arms = {}
    for x in data:
        arms.setdefault(x[1].strip().lower() if x[1] is not None else None, []).append(x)
    return arms


def test_small_groups_are_selected_in_rounds_too(df, monkeypatch):
    # fails if values are sorted or gathered instead of narrowed down by pivots
    rounds = []
    narrow = q._narrow
    monkeypatch.setattr(q, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    values = df([(1, k) for k in range(100)], "g bigint, k bigint").repartition(3)
    assert q.multi_select(values, pd.DataFrame({"g": [1], "rank": [17], "n": [100]}))["key"].tolist() == [16]
    assert 3 <= len(rounds) <= 20


def test_percentiles(df):
    data = rows()
    again = [(*x[:4], 99.0, *x[5:6], T + dt.timedelta(1), *x[7:]) for x in data[:5]]
    got = {(r.arm, r.metric): r for r in q.rollout_percentiles(df(data + again + data[5:9], SCHEMA), (0.1, 0.5, 0.99)).collect()}
    final = [*again, *data[5:]]
    for arm, xs in by_arm(final).items():
        for metric, c in (("input_tokens", 3), ("wall_seconds", 4), ("total_cost_usd", 5)):
            v = [x[c] for x in xs if x[c] is not None and not math.isnan(x[c])]
            r = got.pop((arm, metric))
            assert (r.n, r.n_missing, r.rank_error) == (len(v), len(xs) - len(v), 0)
            assert [r.p10, r.p50, r.p99] == [exact(v, p) for p in (0.1, 0.5, 0.99)]
    assert not got


def test_groups_without_values_and_empty(df):
    got = q.rollout_percentiles(df([(1, "a", T, None, float("nan"), None, T, "", 1)], SCHEMA), (0.5,)).collect()
    assert {(r.metric, r.n, r.n_missing, r.p50) for r in got} == {(m, 0, 1, None) for m in q.METRICS}
    assert q.rollout_percentiles(df([], SCHEMA)).count() == 0 and q.rollout_summaries(df([], SCHEMA)).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.integers(0, 1000))
def test_combined_summaries_keep_their_bound(spark, seed):
    data = spark.createDataFrame(rows(600, seed), SCHEMA)
    parts = q.rollout_summaries(data, size=8 if seed % 2 else 40)
    assert parts.groupBy("arm", "day", "metric").agg(F.sum("weight").alias("w"), F.max("n").alias("n"), F.count(F.lit(1)).alias("c")).where(f"w != n or c > {8 if seed % 2 else 40}").count() == 0
    arms = by_arm(rows(600, seed))
    for r in q.merged(parts, ["arm"], [0.25, 0.5, 0.9], 8 if seed % 2 else 40).collect():
        c = {"input_tokens": 3, "wall_seconds": 4, "total_cost_usd": 5}[r.metric]
        v = sorted(x[c] for x in arms[r.arm] if x[c] is not None and not math.isnan(x[c]))
        assert r.n == len(v) and r.rank_error <= len(v)
        for p, value in ((0.25, r.p25), (0.5, r.p50), (0.9, r.p90)):
            rank = q.rank_of(p, len(v))
            low, high = np.searchsorted(v, value, "left") + 1, np.searchsorted(v, value, "right")
            assert low - r.rank_error <= rank <= high + r.rank_error


def test_blocks(df, monkeypatch):
    data = df(rows(), SCHEMA)
    want = sorted(map(str, q.rollout_percentiles(data, (0.5,)).collect()))
    monkeypatch.setattr(q, "REPORTS", 8)
    assert sorted(map(str, q.rollout_percentiles(data, (0.5,)).collect())) == want
