import datetime as dt
import math
import random

from symweave.operators.heavy_keys import key_quantiles, key_results

SCHEMA = "edge_id bigint, src_file string, src_name string, src_kind string, dst_file string, dst_name string, dst_kind string, line int, loaded_at timestamp, hi string, n int"
T = dt.datetime(2024, 1, 1)


def edge(i, src, dst, line, at=T):
    return (i, src, "s", "F", dst, "d" if dst else None, "F", line, at, "extra", 1)


def test_all_keys(df):
    rows = [edge(i, f"s{i % 3}.rs", "hot.rs" if i % 2 else f"t{i}.rs", i) for i in range(40)]
    rows += [edge(1, "s1.rs", "./x/../hot.rs", 1, T + dt.timedelta(days=1)), edge(100, "s0.rs", None, None), edge(101, "s0.rs", "hot.rs", None)]
    got = {(r.side, r.file): r for r in key_results(df(rows, SCHEMA)).collect()}
    hot = got["to", "hot.rs"]
    lines = sorted(i for i in range(40) if i % 2)
    assert (hot.degree, hot.partners) == (21, 3)
    assert (hot.line_p50, hot.line_p90) == (lines[9], lines[17])
    assert got["from", "s0.rs"].degree == 16 and math.isclose(hot.share, 21 / 42)
    assert ("to", None) not in got and len(got) == 3 + 1 + 20


def test_heavy_share(df):
    rows = [edge(i, f"s{i}.rs", "hot.rs" if i < 10 else f"t{i}.rs", i) for i in range(100)]
    assert {(r.side, r.file) for r in key_results(df(rows, SCHEMA), min_share=0.1).collect()} == {("to", "hot.rs")}
    assert key_results(df([], SCHEMA), min_share=0.1).count() == 0
    assert key_results(df([], SCHEMA)).count() == 0


def test_share_is_exact(df):
    rows = [edge(i, f"s{i}.rs", "hot.rs" if i < 7 else f"t{i}.rs", i) for i in range(70)]
    assert {r.file for r in key_results(df(rows, SCHEMA), min_share=0.1).collect()} == {"hot.rs"}


def test_latest_delivery_counts(df):
    rows = [edge(1, "a.rs", "old.rs", 5), edge(1, "a.rs", "new.rs", 7, T + dt.timedelta(1)), edge(1, "a.rs", "new.rs", 7, T + dt.timedelta(1)), edge(2, "a.rs", "new.rs", 9, None)]
    got = {r.file: (r.degree, r.line_p50) for r in key_results(df(rows, SCHEMA)).where("side = 'to'").collect()}
    assert got == {"new.rs": (2, 7)}


def test_quantiles_against_sorting(df):
    r = random.Random(4)
    values = {k: [r.choice([r.randint(-5, 5), r.randint(-(10**15), 10**15)]) for _ in range(r.randint(1, 400))] for k in "abc"}
    rows = [(k, v, 3.0) for k, vs in values.items() for v in vs] + [("d", None, 1.0)]
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {(x.k, x.q): x.quantile for x in key_quantiles(df(rows, "k string, x bigint, v double"), ["k"], "x", qs, buckets=4).collect()}
    assert got == {(k, q): sorted(vs)[max(1, math.ceil(q * len(vs))) - 1] for k, vs in values.items() for q in qs}


def test_salted_keys_give_the_same(df, monkeypatch):
    from symweave.operators import heavy_keys

    monkeypatch.setattr(heavy_keys, "WIDE", 10)
    rows = [("a", i) for i in range(500)] + [("b", 1)]
    got = {(x.k, x.q): x.quantile for x in key_quantiles(df(rows, "k string, x bigint"), ["k"], "x", [0.5], buckets=8).collect()}
    assert got == {("a", 0.5): 249, ("b", 0.5): 1}
