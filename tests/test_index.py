import os

import pytest

from symweave.operators import textscan
from symweave.plans import eval_queries
from symweave.sources import edit, index, scan
from symweave.sources.extract import detect_language, extract
from symweave.streaming import pipeline

TREE = {
    "src/handler.ts": 'import { helper } from "./utils/helper";\n\nexport async function processRequest(req: Request): Promise<void> {\n  helper(req);\n}\n',
    "src/utils/helper.ts": "export function helper(_req: unknown): void {}\n",
    "src/lib.rs": "mod util;\nuse util::x;\nuse serde::Value;\npub fn start() -> i32 {\n    helper()\n}\n\nfn helper() -> i32 {\n    0\n}\n",
    "src/util.rs": "pub fn x() {}\n",
    "src/worker.py": "from utils.auth import verify\nimport numpy as np\n\ndef run():\n    return verify()\n",
    "src/utils/auth.py": "def verify():\n    return True\n",
    "src/utils/__init__.py": "",
    "ignored/x.py": "def no(): pass\n",
    ".gitignore": "ignored/\n",
    "tsconfig.json": '{\n  // aliases\n  "compilerOptions": {"baseUrl": ".", "paths": {"@u/*": ["src/utils/*"]}},\n}',
    "src/alias.ts": 'import { helper } from "@u/helper";\nimport x from "react";\nexport function go() { helper(1); }\n',
}


@pytest.fixture
def tree(tmp_path):
    for p, text in TREE.items():
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text(text)
    return tmp_path


def content(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def same(a, b):
    return all(content(getattr(a, n)) == content(getattr(b, n)) for n in ("symbols", "edges", "library_imports"))


def test_cold_index(spark, tree):
    ix = index.cold_index(spark, str(tree))
    names = {(r.file, r.name, r.kind) for r in ix.symbols.collect()}
    assert {("src/handler.ts", "processRequest", "AsyncFunction"), ("src/lib.rs", "helper", "Function"), ("src/worker.py", "run", "Function")} <= names
    assert not any(f.startswith("ignored") for f, _, _ in names)
    edges = {(r.src_file, r.src_name, r.dst_file, r.dst_name, r.kind, r.confidence) for r in ix.edges.collect()}
    assert ("src/handler.ts", "handler", "src/utils/helper.ts", "", "Imports", "Certain") in edges
    assert ("src/handler.ts", "processRequest", "src/utils/helper.ts", "helper", "Calls", "Inferred") in edges
    assert ("src/lib.rs", "start", "src/lib.rs", "helper", "Calls", "Unresolved") in edges
    assert ("src/worker.py", "worker", "src/utils/auth.py", "", "Imports", "Certain") in edges
    assert ("src/worker.py", "run", "src/utils/auth.py", "verify", "Calls", "Inferred") in edges
    assert ("src/lib.rs", "lib", "src/util.rs", "", "Imports", "Certain") in edges
    assert ("src/alias.ts", "go", "src/utils/helper.ts", "helper", "Calls", "Inferred") in edges
    assert sorted((r.library, r.file) for r in ix.library_imports.collect()) == [("numpy", "src/worker.py"), ("react", "src/alias.ts"), ("serde", "src/lib.rs")]


def test_warm_start_is_cold(spark, tree, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "graph")
    first = index.warm_start(spark, str(tree), store)
    assert same(first, index.cold_index(spark, str(tree)))
    again = index.warm_start(spark, str(tree), store)
    assert same(first, again)
    (tree / "src/utils/auth.py").unlink()
    (tree / "src/util.rs").unlink()
    (tree / "src/worker.py").write_text("from utils.auth import verify\n\ndef run(x):\n    return verify()\n")
    (tree / "src/new.py").write_text("def fresh(): pass\n")
    renewed = index.warm_start(spark, str(tree), store)
    assert same(renewed, index.cold_index(spark, str(tree)))
    assert {("utils", "src/worker.py"), ("util", "src/lib.rs")} <= {(r.library, r.file) for r in renewed.library_imports.collect()}


def test_a_renewal_writes_a_bounded_share_and_old_versions_go(spark, tree, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("store") / "graph")
    for i in range(40):
        (tree / f"src/m{i}.py").write_text(f"def f{i}(): pass\n")
    index.warm_start(spark, str(tree), store)
    versions = []
    for i in range(3):
        (tree / "src/m7.py").write_text(f"def f7(x{i}): pass\n")
        index.warm_start(spark, str(tree), store)
        versions.append({x for x in os.listdir(store) if x not in ("current", "next")})
        newest = max(versions[-1], key=lambda v: os.path.getmtime(f"{store}/{v}"))
        assert len([x for x in os.listdir(f"{store}/{newest}/files") if x.startswith("bucket=")]) == 1
    assert len(versions[-1]) == 3  # the first, which still holds most buckets, the last, and the one before
    assert same(index.load(spark, store), index.cold_index(spark, str(tree)))


def test_large_and_other_files(spark, tmp_path):
    (tmp_path / "big.py").write_text("def first(): pass\n" + "# filler line\n" * 160_000 + "def last(): first()\n")
    (tmp_path / "notes.md").write_text("one needle here\n")
    (tmp_path / "image.bin").write_bytes(b"needle\0\xff")
    ix = index.cold_index(spark, str(tmp_path))
    assert {r.name for r in ix.symbols.collect()} == {"first", "last"}
    assert {(r.file, r.line) for r in textscan.grep(ix.files, "needle|def last").collect()} == {("big.py", 160_002), ("notes.md", 1)}
    before = {r.path: r.content_hash for r in scan.hash_files(spark, str(tmp_path)).collect()}
    assert before == {r.path: r.content_hash for r in ix.files.collect()}
    with open(tmp_path / "big.py", "a") as f:
        f.write("#\n")
    after = {r.path: r.content_hash for r in scan.hash_files(spark, str(tmp_path)).collect()}
    assert {p for p in after if after[p] != before[p]} == {"big.py"}


def test_ignore_files_of_inner_folders(tmp_path, df):
    for p in ("a/x.py", "a/y.py", "a/gen/z.py", "b/x.py", "b/keep.py", "c/skip.py", ".hidden/h.py"):
        os.makedirs(tmp_path / os.path.dirname(p), exist_ok=True)
        (tmp_path / p).write_text("")
    (tmp_path / ".gitignore").write_text("x.py\nskip.py\n")
    (tmp_path / "a/.gitignore").write_text("/gen/\n!x.py\n")
    (tmp_path / "b/.ignore").write_text("*\n!keep.py\n")
    assert scan.walk(str(tmp_path)) == ["a/x.py", "a/y.py", "b/keep.py"]
    events = df([("a/y.py",), ("d/x.py",), ("../o.py",), (".git/o.py",), ("n.md",), (None,)], "path string")
    rules = scan.load_ignore(str(tmp_path))
    assert sorted(r.path for r in scan.relevant(events, rules).collect()) == ["a/y.py", "n.md"]
    assert [r.path for r in scan.relevant(events, rules, parseable_only=True).collect()] == ["a/y.py"]


def test_hashes_of_deep_folders(df):
    from symweave.operators.incremental import directory_hashes

    deep = "/".join(f"d{i}" for i in range(80))
    one, two = ({r.path: r.hash for r in directory_hashes(df([(f"{deep}/f.py", h), ("g.py", "h")], "path string, content_hash string")).collect()} for h in ("h1", "h2"))
    assert len(one) == 81 and all(one[p] != two[p] for p in one)


def test_patterns_that_look_beyond_a_line(df):
    files = df([("a", "one\ntwo\n")], "path string, content string")
    for pattern, lines in ((r"\Atwo", [2]), (r"one\z", [1]), (r"(?<!\n)two", [2]), (r"^t", [2]), (r"(?-m)^two", [2])):
        assert [r.line for r in textscan.grep(files, pattern).collect()] == lines


def test_change_and_cascade(spark, tree):
    ix = index.cold_index(spark, str(tree))
    out = edit.apply_change(spark, str(tree), ix, "src/utils/auth.py", [edit.Change("def verify():", "def verify(token):")])
    assert out.status == "APPLIED" and out.summary == "SIGNATURE: 1" and "src/worker.py:run" in out.warnings.first().body
    assert "+def verify(token):" in out.snippet
    assert same(out.index, index.cold_index(spark, str(tree)))
    gone = edit.apply_change(spark, str(tree), out.index, "src/utils/auth.py", delete=True)
    assert gone.status == "DELETED" and gone.summary == "ORPHAN: 1"
    made = edit.apply_change(spark, str(tree), gone.index, "src/fresh.py", create="def f(): pass\n")
    assert made.status == "CREATED" and made.summary == "no warnings"
    assert edit.apply_change(spark, str(tree), made.index, "src/fresh.py", [edit.Change("def f", "def f")]).status == "NO_OP"


def test_all_tests_of_a_change(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/auth.py").write_text("def verify():\n    pass\n")
    for i in range(55):
        (tmp_path / f"src/test_{i:02}.py").write_text("from .auth import verify\n")
    out = edit.apply_change(spark, str(tmp_path), index.cold_index(spark, str(tmp_path)), "src/auth.py", [edit.Change("verify()", "verify(x)")])
    assert out.tests == [f"src/test_{i:02}.py" for i in range(55)]


def test_edit_errors():
    with pytest.raises(edit.EditError, match="closest is line 2 .*90 %"):
        edit.apply_edits("a\nhello worl\n", [edit.Change("hello word", "x")])
    with pytest.raises(edit.EditError, match="2 times, on lines 1, 3"):
        edit.apply_edits("x\ny\nx", [edit.Change("x", "z")])


def test_stream_equals_batch(spark, tree, tmp_path_factory):
    store = str(tmp_path_factory.mktemp("s") / "graph")
    index.save(index.cold_index(spark, str(tree)), store)
    source, check = str(tmp_path_factory.mktemp("events")), str(tmp_path_factory.mktemp("check"))
    changed = "from utils.auth import verify\n\ndef run(a):\n    return verify()\n\ndef more():\n    run(1)\n"
    rows = [("src/worker.py", "upsert", "2024-01-01 00:00:01", "broken ("), ("src/worker.py", "upsert", "2024-01-01 00:00:02", changed), ("src/util.rs", "delete", "2024-01-01 00:00:03", None)]
    spark.createDataFrame(rows, "path string, op string, ts string, content string").selectExpr("path", "op", "timestamp(ts) ts", "content").write.mode("append").parquet(source)
    pipeline.maintain(spark.readStream.schema(pipeline.EVENTS).parquet(source), store, check, rules=scan.load_alias_rules(str(tree))).awaitTermination()
    (tree / "src/worker.py").write_text(changed)
    (tree / "src/util.rs").unlink()
    assert same(index.load(spark, store), index.cold_index(spark, str(tree)))
    spark.createDataFrame(rows[1:2], "path string, op string, ts string, content string").selectExpr("path", "op", "timestamp(ts) ts", "content").write.mode("append").parquet(source)
    pipeline.maintain(spark.readStream.schema(pipeline.EVENTS).parquet(source), store, check, rules=scan.load_alias_rules(str(tree))).awaitTermination()
    assert same(index.load(spark, store), index.cold_index(spark, str(tree)))


def test_streamed_edit_positions(spark, tmp_path_factory):
    source, check = str(tmp_path_factory.mktemp("log")), str(tmp_path_factory.mktemp("c"))
    schema = "seq bigint, file string, name string, kind string"
    spark.createDataFrame([(1, "f", "a", "F"), (2, "f", "b", "F"), (3, "f", "a", "F")], schema).write.mode("append").parquet(source)
    got = {}
    pipeline.run_available(pipeline.edit_positions(spark.readStream.schema(schema).parquet(source)), lambda b, _: got.update({r.name: r.seq for r in b.collect()}), check, "update")
    assert got == {"a": 3, "b": 2}


def test_ignore_rules():
    i = scan.Ignore("*.log\n!keep.log\n/build\ndocs/**/x\ndir/\n")
    assert i.match("a/b.log", False) and not i.match("keep.log", False) and i.match("build", True) and not i.match("a/build", True)
    assert i.match("docs/a/b/x", False) and i.match("a/dir", True) and not i.match("a/dir", False)
    assert scan.is_relevant("/r/a.py", "/r", i) and not scan.is_relevant("/r/dir/a.py", "/r", i) and not scan.is_relevant("/r/a.txt", "/r", i) and not scan.is_relevant("/x/a.py", "/r", i)


def test_small_sources(tmp_path):
    assert [detect_language(x) for x in ("a.tsx", "b.mjs", "c.pyi", "d.rs", "e.go", "F.PY")] == ["typescript", "javascript", "python", "rust", None, "python"]
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "my-crate"\n')
    assert scan.read_crate_name(str(tmp_path)) == "my-crate" and scan.read_crate_name(str(tmp_path / "no")) is None
    assert scan.load_config(str(tmp_path)).watcher_debounce_ms == 100
    (tmp_path / "a.txt").write_text("x" * 60000)
    assert scan.read_text(str(tmp_path / "a.txt")).endswith("[... 10000 more characters]")
    assert scan.native_grep(str(tmp_path), "(") .startswith("invalid pattern")
    assert scan.native_grep(str(tmp_path), "my-crate") == [("Cargo.toml", 2, 'name = "my-crate"')]


def test_rust_extraction():
    src = 'use my_crate::a::B;\npub(crate) async fn go<T: X>(a: &\'a str, b: T) -> Result<(), E> where T: Y {\n  let s = r#"fn no() {"#; foo::bar(a); x.m::<u8>(1); println!("hi"); go2(1)\n}\nfn go2(n: i32) {}\nimpl S { fn new() -> Self { S::make() } fn n(&self) { fn inner() {} helper() } }\ntrait T { fn t(&self); }\n'
    x = extract("src/lib.rs", src, "my-crate")
    got = {(s["name"], s["kind"], s["visibility"], s["is_async"]) for s in x.symbols}
    assert got == {("go", "AsyncFunction", "Public", True), ("go2", "Function", "Private", False), ("new", "Method", "Private", False), ("n", "Method", "Private", False), ("inner", "Function", "Private", False), ("T", "Trait", "Private", False)}
    assert {(e["src_name"], e["dst_name"]) for e in x.edges if e["kind"] == "Calls"} == {("go", "bar"), ("go", "m"), ("go", "go2"), ("new", "make"), ("n", "helper")}
    assert [e["spec"] for e in x.edges if e["kind"] == "Imports"] == ["crate::a::B"]


def test_script_extraction():
    src = "import a, {b} from '@s/p/q';\nimport './side';\nexport class C<T> {\n  async load<T>(id: number): Promise<T> { return get(id); }\n}\nconst F = async (x: number) => { hidden(x); };\nfunction g() { const h = () => inner(); return `t ${tpl(1)}`; }\ninterface I { a: string }\ntype A = { k: string };\n// function no() {}\n"
    x = extract("a.ts", src)
    assert {(s["name"], s["kind"]) for s in x.symbols} == {("C", "Class"), ("load", "Method"), ("F", "AsyncFunction"), ("g", "Function"), ("h", "Function"), ("I", "Interface"), ("A", "TypeAlias")}
    assert {(e["src_name"], e["dst_name"]) for e in x.edges if e["kind"] == "Calls"} == {("load", "get"), ("g", "inner"), ("g", "tpl")}
    assert [e["spec"] for e in x.edges if e["kind"] == "Imports"] == ["@s/p/q", "./side"] and x.imports == [{"library": "@s/p", "symbol": "", "line": 1}]
    jsx = extract("a.jsx", "const a = require('./x');\nfunction V() { return <Ui.Card x={h()} />; }\n")
    assert {(e["src_name"], e["dst_name"]) for e in jsx.edges if e["kind"] == "Calls"} == {("V", "Card"), ("V", "h")} and jsx.edges[0]["spec"] == "./x"


def test_python_extraction_and_broken_files():
    src = "import os.path\nfrom . import z\nfrom ..p import q\nclass A:\n    def __init__(self): self.m()\n    async def m(self, a: int = 1, *b) -> int:\n        return os.path.join(foo(a), foo(2))\ndef _p(): pass\n"
    x = extract("p/a.py", src)
    assert {(s["name"], s["kind"], s["visibility"]) for s in x.symbols} == {("A", "Class", "Export"), ("__init__", "Method", "Export"), ("m", "Method", "Export"), ("_p", "Function", "Private")}
    assert [e["spec"] for e in x.edges if e["kind"] == "Imports"] == ["os.path", "..p"]
    assert [i["library"] for i in x.imports] == ["os", ".", "p"]
    assert {(e["src_name"], e["dst_name"]) for e in x.edges if e["kind"] == "Calls"} == {("__init__", "m"), ("m", "join"), ("m", "foo")}
    broken = extract("p/a.py", src + "def broken(:\n  foo()\n")
    assert broken.partial and {"A", "m", "_p", "broken"} <= {s["name"] for s in broken.symbols}
    assert extract("a.rs", "fn a() {}\nfn b( {\nfn c() {}\n").partial
    assert extract("empty.ts", "").symbols == []


def test_text_operators(df):
    files = df([("a", "one\nTWO two\n"), ("b", None), ("c", ""), ("d", "two\r\nx\n\n")], "path string, content string")
    assert {(r.file, r.line, r.text) for r in textscan.lines(files).collect()} == {("a", 1, "one"), ("a", 2, "TWO two"), ("c", 1, ""), ("d", 1, "two"), ("d", 2, "x"), ("d", 3, "")}
    assert [(r.file, r.line) for r in textscan.grep(files, "two$").orderBy("file").collect()] == [("a", 2), ("d", 1)]
    many = df([("a", "x\nyx\nx y\nx")], "path string, content string")
    assert sorted(r.line for r in textscan.match_lines(many, "x\n").collect()) == [1, 2]
    assert sorted(r.line for r in textscan.match_lines(many, "x").collect()) == [1, 2, 3, 4]
    assert textscan.closest_line(many, "x z").first().line == 3
    from pyspark.sql import functions as F

    h = [r[0] for r in df([("a = 1  # c\n\n b()",), ("/* x */ a = 1\nb()",), ("a = 2\nb()",)], "s string").select(textscan.body_hash(F.col("s"))).collect()]
    assert h[0] == h[1] != h[2]
    assert df([("(a: A<B, C>, , d)",)], "s string").select(textscan.split_params(F.col("s"))).first()[0] == ["a: A<B", "C>", "d"]
    assert textscan.call_arguments("x = f(\n 1, g(2))", 1, "f") == "1, g(2)" and textscan.call_arguments("f()", 1, "f") is None and textscan.call_arguments(None, 1, "f") is None


def test_enclosing_statements():
    from symweave.sources.statements import enclosing_statement as around

    py = "def a():\n    x = f(\n        g(1),\n    )\n    if h(x):\n        return k(x)\n    for y in many(x): pass\n"
    assert around("m.py", py, 3) == around("m.py", py, 2) == "x = f(\n        g(1),\n    )"
    assert around("m.py", py, 5) == "if h(x):\n        return k(x)" and around("m.py", py, 6) == "return k(x)"
    assert around("m.py", py, 7) == "        return k(x)\n    for y in many(x): pass\n"  # no statement of the kinds: the lines around
    assert around("m.py", "def (:\n f(1)\n", 2) == "def (:\n f(1)\n" and around("m.py", None, 1) is None and around("m.py", "f()", 9) is None
    rs = "fn a() {\n    let t = \"; } (\"; // ( no\n    let x = make(\n        Some(1),\n    )\n    .finish();\n    if check(x) {\n        go(x);\n    }\n    last(x)\n}\n"
    assert around("m.rs", rs, 4) == "let x = make(\n        Some(1),\n    )\n    .finish();"
    assert around("m.rs", rs, 7) == "if check(x) {\n        go(x);\n    }" and around("m.rs", rs, 8) == "go(x);" and around("m.rs", rs, 10) == "last(x)"
    ts = "export function a() {\n  const r = send({\n    id: next(),\n    to: 1,\n  })\n  log(r)\n  return wrap(`${x(}`)\n}\n"
    assert around("m.ts", ts, 3) == around("m.ts", ts, 2) == "const r = send({\n    id: next(),\n    to: 1,\n  })"
    assert around("m.ts", ts, 6) == "log(r)"
    long = "f(\n" + "  1,\n" * 40 + ");\n"
    assert around("m.ts", long, 1).count("\n") == 19 and around("m.txt", "a\nb\nc", 2) == "a\nb\nc"


def test_each_language_of_a_document_is_a_file(df, spark, tmp_path):
    code = "Said.\n\nclass Early {\n}\n\nexport function a(x: string) {\n  return b(x);\n}\n\n/// Note.\npub\u2009fn c(x: &str) -> usize {\n    1\n}\n\nfunction b(y) {\n  return y;\n}\n\ndef d(z):\n    return z"
    df([(1, code), (2, "No code here."), (3, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    files = {r.path: r.content for r in eval_queries.code_files(spark, str(tmp_path)).collect()}
    assert set(files) == {"code/d1.ts", "code/d1.rs", "code/d1.py"}
    assert "fn c" not in files["code/d1.ts"] and "function" not in files["code/d1.rs"] and files["code/d1.py"].strip() == "def d(z):\n    return z"
    found = {(r.file[8:], r.name, r.line_start) for r in eval_queries.extract_symbols(spark, str(tmp_path)).collect()}
    assert {("ts", "Early", 1), ("ts", "a", 4), ("ts", "b", 13), ("rs", "c", 9), ("py", "d", 17)} <= {(f.lstrip("."), n, x) for f, n, x in found}
    assert len([n for _, n, _ in found if n in "abcd"]) == 4
    calls = {(r.src_name, r.dst_name) for r in eval_queries.extract_calls(spark, str(tmp_path)).collect()}
    assert ("a", "b") in calls
