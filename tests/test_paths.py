import posixpath

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symweave.functions import paths


def col(df, expr, values):
    return [r[0] for r in df([(i, v) for i, v in enumerate(values)], "i int, p string").orderBy("i").select(expr(F.col("p"))).collect()]


def expected(p):
    if p is None or p == "":
        return p
    out = posixpath.normpath(p.replace("\\", "/"))
    out = "/" + out.lstrip("/") if out.startswith("/") else out
    return "" if out == "." else out


def test_normalize_cases(df):
    given_ = ["a/b.rs", "a\\b.rs", "./a//b.rs", "a/x/../b.rs", "../a", "a/../../b", "/..//a/", "", None, "a/./b", ".hidden/x", "a/.b", "a/b/", "/"]
    assert col(df, paths.normalize_path, given_) == [expected(p) for p in given_]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab./\\", max_size=12), min_size=1, max_size=40))
def test_normalize_like_reference_rule(spark, values):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert col(frame, paths.normalize_path, values) == [expected(p) for p in values]


def test_parts(df):
    assert col(df, paths.stem, ["a/b.test.ts", ".env", "x", None]) == ["b.test", ".env", "x", None]
    assert col(df, paths.extension, ["a/B.TS", ".env", "x"]) == ["ts", "", ""]
    assert col(df, paths.is_test_path, ["a/tests/b", "a/b.spec.ts", "test_x.py", "a/x_test.go", "attest/x", "latest.py"]) == [True, True, True, True, False, False]
    assert col(df, lambda c: paths.has_suffix(c, "b/c.rs"), ["a/b/c.rs", "ab/c.rs", "b/c.rs"]) == [True, False, True]
    assert col(df, lambda c: paths.relative_to(c, "/r"), ["/r/a", "/ra", "x"]) == ["a", "/ra", "x"]
