from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.operators import graph
from symweave.plans.classify import CAPS, Query, classify, is_path_like, safe_pattern
from symweave.plans.search import Graph, search

SYM = "file string, name string, kind string, line_start int, line_end int, signature string, params array<string>, return_type string, visibility string, body_hash bigint, is_async boolean"
EDG = "src_file string, src_name string, src_kind string, dst_file string, dst_name string, dst_kind string, kind string, line int, confidence string, spec string"


def sym(name, file="a.rs", kind="Function", line=1, vis="Export"):
    return (file, name, kind, line, line + 1, f"{name}(x: i32): i32", ["x: i32"], "i32", vis, 0, False)


def edge(a, b, kind="Calls", line=1, conf="Certain", fa="a.rs", fb="a.rs", ka="Function", kb="Function"):
    return (fa, a, ka, fb, b, kb, kind, line, conf, None)


@pytest.fixture
def chain(df):
    return df([sym(x, line=i) for i, x in enumerate("abcd", 1)], SYM), df([edge("a", "b"), edge("b", "c"), edge("c", "a"), edge("a", None)], EDG)


def start(df, name):
    return df([("a.rs", name, "Function")], "file string, name string, kind string")


def test_paths(df, chain):
    s, e = chain
    path = graph.shortest_path(e, start(df, "a"), graph.to_symbol("c"))
    assert [r.name for r in path.orderBy("step").collect()] == ["a", "b", "c"]
    assert graph.shortest_path(e, start(df, "a"), graph.to_symbol("d")) is None
    assert [r.name for r in graph.shortest_path(e, start(df, "a"), graph.to_symbol("a")).collect()] == ["a"]
    assert graph.shortest_path(e.limit(0), start(df, "a"), graph.to_symbol("b")) is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), max_size=14))
def test_depths_like_a_walk(spark, pairs):
    e = spark.createDataFrame([edge(a, b) for a, b in pairs], EDG)
    got = {r.name: r.depth for r in graph.depths(graph.bfs(e, spark.createDataFrame([("a.rs", "a", "Function")], "file string, name string, kind string"))).collect()}
    want, todo = {"a": 0}, deque("a")
    while todo:
        x = todo.popleft()
        for a, b in pairs:
            if a == x and b not in want:
                want[b] = want[x] + 1
                todo.append(b)
    assert got == want


def test_find(df):
    s = df([sym("process"), sym("proces", line=5), sym("other", line=9)], SYM)
    assert [r.name for r in graph.find_by_name(s, "process").collect()] == ["process"]
    assert sorted(r.name for r in graph.find_by_name(s, "procesx").collect()) == ["proces", "process"]
    assert graph.find_by_name(s, "zzzzzzzz").count() == 0


def test_relaxed_callers(df):
    s = df([sym("m", kind="Method"), sym("f")], SYM)
    e = df([edge("x", "m", kb="Function"), edge("y", "f"), edge("z", "f", kb="Method")], EDG)
    got = {(r.name, r.src_name, r.tier) for r in graph.callers_relaxed(e, s).collect()}
    assert got == {("m", "x", 1), ("f", "y", 0)}


def test_outline_runs(df):
    rows = [sym("new", kind="Method", line=1), sym("run", kind="Method", line=2), sym("go", line=3), sym("_a", line=4, vis="Private"), sym("_b", line=5, vis="Private"), sym("one", kind="Method", line=6), sym("test_a", line=7), sym("test_b", line=8), sym("go", kind="AsyncFunction", line=9), sym("S", kind="Struct", line=10)]
    out = graph.outline(df(rows, SYM)).orderBy("entry").collect()
    assert [(r.label, r.group, r.members) for r in out] == [
        ("impl { (2 methods) }", "method", 2), ("go(x: i32)", "function", 1), ("[helpers] _a, _b", "helper", 2),
        ("one(x: i32)", "function", 1), ("[test] (2 functions)", "test", 2), ("[test] go(x: i32)", "test", 1),
    ]
    assert graph.outline_headers(graph.outline(df(rows, SYM))).first().header == "6 entries (2 functions, 1 method groups, 2 test groups, 1 helper groups)"
    assert graph.outline(df([], SYM)).count() == 0


def test_outline_keeps_members(df):
    rows = [sym(f"n{i}", kind="Method" if i % 5 < 3 else "Function", line=i, vis="Private" if i % 2 else "Export") for i in range(80)]
    assert graph.outline(df(rows, SYM)).agg(F.sum("members")).first()[0] == 80


@pytest.mark.parametrize("text, want", [
    ("callers of foo", Query("callers", "foo")), ("callers of foo with context", Query("callers", "foo", with_context=True)),
    ("what calls foo with context", Query("callers", "foo with context")), (" callees of foo ", Query("callees", "foo")), ("what does foo call", Query("callees", "foo")),
    ("outline of a/b.ts", Query("outline", "a/b.ts")), ("chain from a to b to c", Query("chain", "a", "b to c")), ("where is X", Query("find", "X")),
    ("tests for x", Query("tests", "x")), ("imports of a", Query("imports", "a")), ("importers of a", Query("importers", "a")), ("exports of a", Query("exports", "a")),
    ("libraries", Query("libraries")), ("libraries please", Query("grep", "libraries please")), ("Callers of x", Query("grep", "Callers of x")), ("around x", Query("grep", "around x")),
])
def test_classify(text, want):
    assert classify(text) == want


def test_small_rules():
    assert is_path_like("a/b") and is_path_like("x.TSX") and not is_path_like("name")
    assert safe_pattern("a+") == "a+" and safe_pattern("(") == r"\("


@pytest.fixture
def project(df):
    symbols = [sym("target", "lib/t.py"), sym("caller", "lib/c.py", line=4), sym("far", "lib/f.py")] + [sym(f"many{i:02}", "lib/m.py", line=i) for i in range(60)] + [sym("dup", f"d{i:02}.py", line=i) for i in range(20)]
    edges = [edge("caller", "target", fa="lib/c.py", fb="lib/t.py", line=7), edge("far", "caller", fa="lib/f.py", fb="lib/c.py", line=9)]
    edges += [("tests/t_test.py", "t_test", "Module", "lib/t.py", "", "Module", "Imports", 1, "Certain", None), ("lib/x.py", "x", "Module", "lib/t.py", "", "Module", "Imports", 2, "Certain", None), ("lib/c.py", "c", "Module", "lib/t.py", "", "Module", "Imports", 3, "Certain", None)]
    files = [("lib/c.py", "\n\n\n\n\n\nx = target(\n  1,\n  2)\n")] + [(f"z{i:02}.txt", "needle here\n  needle (#") for i in range(40)]
    libs = [("os", "", "a", 1), ("os", "", "b", 1), ("re", "", "a", 2), ("own", "", "a", 3)]
    return Graph(df(symbols, SYM), df(edges, EDG), df(libs, "library string, symbol string, file string, line int"), df(files, "path string, content string"), ["own"])


def rows(hits):
    return hits.orderBy("rank").collect()


def test_search_callers(project):
    got = rows(search(project, "callers of target with context"))
    assert got[0].signature == "=== 1 caller of target in 1 file ===" and got[0].is_hint
    assert (got[1].file, got[1].line) == ("lib/c.py", 4) and "target(\n  1,\n  2)" in got[1].context and "// args: 1, 2" in got[1].context
    assert [(r.file, r.line) for r in got[2:]] == [("lib/x.py", 2), ("tests/t_test.py", 1)]
    assert "no symbol named" in rows(search(project, "callers of zzzzzzzz"))[0].signature


def test_search_kinds(project):
    assert len(rows(search(project, "find dup"))) == 1 + CAPS["find"]
    assert "5 symbols matching 'dup' across 5 files (e.g. " in rows(search(project, "find dup"))[0].signature
    assert len(rows(search(project, "outline of lib/m.py"))) == 50
    assert [r.file for r in rows(search(project, "callees of caller"))] == ["lib/t.py"]
    assert rows(search(project, "callees of zzzzzzz")) == []
    assert [r.file for r in rows(search(project, "chain from far to target"))] == ["lib/f.py", "lib/c.py", "lib/t.py"]
    assert "no call-graph path" in rows(search(project, "chain from target to far"))[-1].signature
    assert [r.file for r in rows(search(project, "chain from far to lib/c.py"))] == ["lib/f.py", "lib/c.py"]
    assert [r.signature for r in rows(search(project, "libraries"))] == ["os (2 uses)", "re (1 uses)"]
    assert [r.file for r in rows(search(project, "tests for target"))] == ["tests/t_test.py"]
    assert [r.file for r in rows(search(project, "importers of lib/t.py"))] == ["lib/c.py", "lib/x.py", "tests/t_test.py"]
    assert "no internal imports" in rows(search(project, "imports of lib/m.py"))[0].signature
    assert len(rows(search(project, "exports of lib/m.py"))) == 50


def test_importers_are_not_capped(df):
    symbols = df([sym("target", "lib/t.py")], SYM)
    edges = [(f"tests/a{i:02}_test.py", "m", "Module", "lib/t.py", "", "Module", "Imports", 1, "Certain", None) for i in range(60)]
    edges += [("lib/big.py", "m", "Module", f"lib/d{i:02}.py", "", "Module", "Imports", i, "Certain", None) for i in range(60)]
    g = Graph(symbols, df(edges, EDG))
    want = [f"tests/a{i:02}_test.py" for i in range(60)]
    assert [r.file for r in rows(search(g, "callers of target"))[1:]] == want
    assert [r.file for r in rows(search(g, "importers of lib/t.py"))] == want
    assert [r.file for r in rows(search(g, "tests for target"))] == want
    assert [r.line for r in rows(search(g, "imports of lib/big.py"))] == list(range(60))


def test_search_text(project):
    got = rows(search(project, "needle"))
    assert len(got) == 31 and got[0].signature == "=== 30 matches in 15 files ===" and got[1].snippet == "needle here"
    assert len(rows(search(project, "(#"))) == 31
    assert rows(search(project, "find zzzzzzzzzz"))[0].signature == "=== 0 matches in 0 files ==="


def test_walks_have_no_depth_limit(df):
    e = df([edge(f"n{i:02}", f"n{i + 1:02}") for i in range(70)], EDG)
    path = graph.shortest_path(e, start(df, "n00"), graph.to_symbol("n70"))
    assert [r.name for r in path.orderBy("step").collect()] == [f"n{i:02}" for i in range(71)]
