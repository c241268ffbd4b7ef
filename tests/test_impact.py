import pytest
from pyspark.sql import functions as F
from test_graph import EDG, SYM, edge, sym

from symweave.functions.render import clamp, compact, without_return_type
from symweave.operators import impact, incremental


def change(row, **new):
    names = [c.split()[0] for c in SYM.split(", ")]
    d = dict(zip(names, row)) | new
    return tuple(d[n] for n in names)


def test_diff_classes(df):
    old = [sym("same"), sym("gone"), sym("sig"), sym("body"), sym("flip"), sym("null")]
    new = [sym("same"), sym("fresh"), change(sym("sig"), signature="other"), change(sym("body"), body_hash=1), change(sym("flip"), kind="AsyncFunction", is_async=True), change(sym("null"), return_type=None)]
    got = {r.name: r.change_class for r in impact.diff(df(old, SYM), df(new, SYM)).collect()}
    assert got == {"same": "same", "gone": "removed", "fresh": "added", "sig": "modified_sig", "body": "modified_body", "flip": "modified_sig", "null": "modified_sig"}
    assert impact.diff(df([], SYM), df([], SYM)).count() == 0


@pytest.fixture
def cascade(df):
    old = [sym("sig"), sym("flip"), sym("lonely"), sym("gone"), sym("Iface", kind="Interface"), sym("quiet")]
    new = [change(sym("sig"), signature="x"), change(sym("flip"), is_async=True), change(sym("lonely"), is_async=True), change(sym("Iface", kind="Interface"), signature="y"), change(sym("quiet"), signature="z")]
    edges = [edge(f"c{i:02}", "sig") for i in range(13)] + [edge("c00", "sig", line=2), edge("u", "gone"), edge("u", "flip"), edge("Impl", "Iface", kind="Implements", kb="Interface")]
    return impact.diff(df(old, SYM), df(new, SYM)), df(edges, EDG)


def test_warnings(cascade):
    changes, edges = cascade
    got = {(r.kind, r.name): r.body for r in impact.warnings(changes, edges).collect()}
    assert set(got) == {("SIGNATURE", "sig"), ("SIGNATURE", "flip"), ("SIGNATURE", "Iface"), ("ASYNC_CHANGE", "flip"), ("ASYNC_CHANGE", "lonely"), ("ORPHAN", "gone"), ("INTERFACE_BREAK", "Iface")}
    assert "13 callers" in got["SIGNATURE", "sig"] and got["SIGNATURE", "sig"].endswith("(+3 more)")
    assert "1 caller " in got["ASYNC_CHANGE", "flip"] and "0 callers" in got["ASYNC_CHANGE", "lonely"]
    assert impact.warning_summary(impact.warnings(changes, edges)).first().summary == "ASYNC_CHANGE: 2, INTERFACE_BREAK: 1, ORPHAN: 1, SIGNATURE: 3"
    assert impact.warning_summary(impact.warnings(changes, edges).limit(0)).first().summary == "no warnings"


def test_further_warnings(df):
    old, new = df([sym("p"), sym("v")], SYM), df([change(sym("p"), params=["b", "a"]), change(sym("v"), visibility="Private")], SYM)
    old = old.withColumn("params", F.when(F.col("name") == "p", F.array(F.lit("a"), F.lit("b"))).otherwise(F.col("params")))
    c = impact.diff(old, new)
    assert [r.name for r in impact.warn_param_order(c).collect()] == ["p"]
    assert [r.name for r in impact.warn_visibility(c).collect()] == ["v"]
    ring = df([edge("a", "b"), edge("b", "a"), edge("b", "c")], EDG)
    at = lambda n: df([("a.rs", n, "Function")], "file string, name string, kind string")
    assert impact.in_cycle(ring, at("a")) and not impact.in_cycle(ring, at("c"))


def test_reexport_chain(df):
    c = impact.diff(df([sym("gone"), sym("kept", line=9)], SYM), df([sym("kept", line=9)], SYM))
    hop = lambda a, b, fa, fb: edge(a, b, kind="ReExports", fa=fa, fb=fb)
    edges = df([hop("g", "gone", "b.rs", "a.rs"), hop("h", "g", "c.rs", "b.rs"), hop("g", "h", "b.rs", "c.rs"), hop("k", "kept", "b.rs", "a.rs")], EDG)
    assert [r.body for r in impact.warn_reexports(c, edges).collect()] == ["gone is passed on by 2 other names: b.rs:g, c.rs:h"]
    assert impact.warn_reexports(c, edges.limit(0)).count() == 0


def test_context_and_tests(df):
    edges = df([edge(f"c{i}", "t") for i in range(8)] + [("tests/x.py", "x", "Module", "a.rs", "", "Module", "Imports", 1, "Certain", None)], EDG)
    symbols = df([sym(f"c{i}", line=i) for i in range(8)] + [sym("t")], SYM)
    assert impact.context_bundle(df([("a.rs", "t", "Function")], "file string, name string, kind string"), edges, symbols).count() == 5
    assert [r.file for r in impact.test_importers(edges, df([("a.rs",)], "file string")).collect()] == ["tests/x.py"]


def test_clamp_and_signatures(df):
    out = df([("x" * 500,), ("ok",), (None,)], "t string").select(clamp(F.col("t"))).collect()
    assert len(out[0][0]) == 200 and out[0][0].endswith("…") and out[1][0] == "ok" and out[2][0] is None
    assert df([("f(a: i32): i32",)], "t string").select(without_return_type(F.col("t"))).first()[0] == "f(a: i32)"
    assert compact("/// doc\nfn go<T: Into<String>>(a: &'a str, b: Vec<u8>): Vec<T> where T: X") == "go(a: &str, b: Vec<u8>) -> Vec<T>"
    assert compact(None) is None


def test_removed_files_keep_incoming_edges(df):
    s, e = df([sym("a"), sym("b", "b.rs")], SYM), df([edge("a", "b", fb="b.rs"), edge("b", "a", fa="b.rs")], EDG)
    s2, e2, _ = incremental.remove_files(df([("b.rs",)], "file string"), s, e)
    assert [r.name for r in s2.collect()] == ["a"] and [(r.src_name, r.dst_name) for r in e2.collect()] == [("a", "b")]
    assert [r.dst_name for r in incremental.dangling_edges(e2, s2).collect()] == ["b"]
    s3, e3, _ = incremental.upsert_files((s2, e2, s2.limit(0)), (df([sym("b", "b.rs")], SYM), e.limit(0), s2.limit(0)), df([("b.rs",)], "file string"))
    assert incremental.dangling_edges(e3, s3).count() == 0


def test_edits_ago_and_files(df):
    log = df([(1, "f", "a", "F"), (2, "f", "b", "F")], "seq bigint, file string, name string, kind string")
    assert {r.name: r.edits_ago for r in incremental.edits_ago(log).collect()} == {"a": 1, "b": 0}
    old, new = df([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string"), df([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert {r.path: r.change for r in incremental.changed_files(old, new).collect()} == {"a": "same", "b": "changed", "c": "deleted", "d": "added"}
    root = lambda x: incremental.merkle_root(x).first().root
    assert root(old) == root(old.orderBy(F.desc("path"))) != root(new)
    tree = df([("x/a", "1"), ("x/y/b", "2"), ("c", "3")], "path string, content_hash string")
    a = {r.path: r.hash for r in incremental.directory_hashes(tree).collect()}
    b = {r.path: r.hash for r in incremental.directory_hashes(df([("x/a", "1"), ("x/y/b", "9"), ("c", "3")], "path string, content_hash string")).collect()}
    assert set(a) == {"", "x", "x/y"} and all(a[p] != b[p] for p in a)


def test_log_positions(df):
    import datetime as dt

    t = lambda d, s: dt.datetime(2024, 1, d, 0, 0, s)
    log = df([(1, t(1, 1), "f", "a", "F"), (2, t(1, 1), "f", "b", "F"), (3, t(1, 5), "f", "c", "F")], "seq bigint, ts timestamp, file string, name string, kind string")
    more = incremental.append_edits(log, df([(t(2, 2), "f", "e", "F"), (t(2, 1), "f", "d", "F")], "ts timestamp, file string, name string, kind string"))
    assert {r.name: r.seq for r in more.collect()} == {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5}
    assert {r.name: r.calls_ago for r in incremental.calls_ago(more).collect()} == {"a": 3, "b": 3, "c": 2, "d": 1, "e": 0}


def test_status_and_intents(df):
    from symweave.functions import intents
    from symweave.functions.render import status_text
    from symweave.plans.classify import query_path

    s = incremental.status(df([("a", 1)], "n string, i int"), df([], "n string"), df([("x/a.rs",), ("b.PY",)], "file string"), df([], "n string"))
    assert s.select(status_text()).first()[0].split("\n")[3:] == ["languages: py, rs", "edits: 0", "last test run: no test run yet"]
    c = df([("rg 'fn main' src",), ("cat x",), ("cargo test -q",), ("src/a.tsx",), (None,)], "c string")
    got = [tuple(r) for r in c.select(intents.is_structural_command(F.col("c")), intents.is_test_run(F.col("c")), intents.is_source_file(F.col("c"))).collect()]
    assert got == [(True, False, False), (False, False, False), (False, True, False), (False, False, True), (None, None, None)]
    assert query_path("/r", "/r/a/../b.py") == "b.py" and query_path("/r", "a\\b.py") == "a/b.py"
