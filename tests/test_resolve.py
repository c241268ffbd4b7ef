from pyspark.sql import functions as F
from test_graph import EDG, SYM, edge, sym

from symweave.operators import resolve
from symweave.sources.index import language_of, resolve_all


def candidates(df, expr, src, spec):
    return df([(src, spec)], "src string, spec string").select(expr).first()[0]


def test_script_candidates(df):
    c = candidates(df, resolve.script_candidates(F.col("src"), F.col("spec")), "src/a/x.ts", "../user.service")
    assert c[:3] == ["src/user.service", "src/user.service.ts", "src/user.service.tsx"] and "src/user.service/index.ts" in c and "src/user.ts" not in c
    c = candidates(df, resolve.script_candidates(F.col("src"), F.col("spec")), "x.ts", "./b.js")
    assert c[0] == "b.js" and "b.ts" in c
    assert candidates(df, resolve.script_candidates(F.col("src"), F.col("spec")), "x.ts", "react") == []


def test_python_candidates(df):
    f = lambda src, spec: candidates(df, resolve.python_candidates(F.col("src"), F.col("spec")), src, spec)
    assert f("p/q/a.py", ".b.c") == ["p/q/b/c.py", "p/q/b/c/__init__.py"]
    assert f("p/q/a.py", "...b") == ["b.py", "b/__init__.py"]
    assert f("p/q/a.py", ".....b") == ["b.py", "b/__init__.py"]
    assert f("a.py", "x.y") == ["src/x/y.py", "src/x/y/__init__.py", "x/y.py", "x/y/__init__.py"]


def test_rust_candidates(df):
    f = lambda spec: candidates(df, resolve.rust_candidates(F.col("spec")), "src/lib.rs", spec)
    assert f("crate::a::b") == ["src/a/b.rs", "src/a/b/mod.rs", "src/a.rs", "src/a/mod.rs"]
    assert f("serde::Value") == [] and f("super::x")[0] == "src/x.rs"


def test_alias_rules(df):
    i = df([(1, "@u/x"), (2, "exact"), (3, "other")], "import_id bigint, spec string")
    rules = df([("@", True, ["any/*"]), ("@u/", True, ["src/u/*", "lib/*"]), ("exact", False, ["src/e"])], "prefix string, wildcard boolean, targets array<string>")
    assert {r.import_id: r.mapped for r in resolve.alias_bases(i, rules).collect()} == {1: ["src/u/x", "lib/x", "any/u/x"], 2: ["src/e"]}


def imp(src, spec, fb=None, conf="Unresolved"):
    return (src, "m", "Module", fb or spec, "", "Module", "Imports", 1, conf, spec)


def test_calls(df):
    symbols = df([sym("far", "b.py"), sym("twice", "b.py"), sym("twice", "c.py"), sym("own"), sym("cls", kind="Class")], SYM)
    call = lambda name: edge("f", name, conf="Unresolved")
    edges = df([imp("a.rs", "b", "b.py", "Certain"), imp("a.rs", "c", "c.py", "Certain"), call("far"), call("twice"), call("own"), call("cls"), call("none"), (*call("far")[:8], None, None)], EDG)
    got = {(r.dst_name, r.dst_file, r.dst_kind, r.confidence) for r in resolve.resolve_calls(edges, symbols).where("kind = 'Calls'").collect()}
    assert got == {("far", "b.py", "Function", "Inferred"), ("twice", "a.rs", "Function", "Unresolved"), ("own", "a.rs", "Function", "Unresolved"), ("cls", "a.rs", "Class", "Inferred"), ("none", "a.rs", "Function", "Unresolved"), ("far", "a.rs", "Function", None)}
    assert resolve.resolve_calls(edges, symbols).count() == edges.count()


def test_resolution_is_idempotent(df):
    files = df([("a.py",), ("b.py",), ("c.ts",), ("d.ts",)], "path string")
    symbols = df([sym("far", "b.py"), sym("g", "d.ts")], SYM)
    edges = df([imp("a.py", "b"), imp("a.py", "os"), imp("c.ts", "./d"), edge("f", "far", conf="Unresolved", fa="a.py", fb="a.py"), edge("h", "g", conf="Unresolved", fa="c.ts", fb="c.ts")], EDG)
    libs = df([("b", "", "a.py", 1), ("os", "", "a.py", 1)], "library string, symbol string, file string, line int")
    e1, l1 = resolve_all(symbols, edges, libs, files)
    e2, l2 = resolve_all(symbols, e1, l1, files)
    key = lambda x: sorted(str(sorted(r.asDict().items())) for r in x.collect())
    assert key(e1) == key(e2) and key(l1) == key(l2) and [r.library for r in l1.collect()] == ["os"]
    assert {(r.src_file, r.dst_file) for r in e1.where("confidence != 'Unresolved'").collect()} == {("a.py", "b.py"), ("c.ts", "d.ts")}
    assert resolve_all(symbols, edges.limit(0), libs, files.limit(0))[0].count() == 0


def test_library_heads(df):
    rows = df([("@a/b/c", "typescript"), ("x/y", "javascript"), ("p.q", "python"), ("r::s", "rust")], "s string, l string")
    assert [r[0] for r in rows.select(resolve.library_head(F.col("s"), F.col("l"))).collect()] == ["@a/b", "x", "p", "r"]
    assert df([("a/b.PY",)], "p string").select(language_of("p")).first()[0] == "python"
