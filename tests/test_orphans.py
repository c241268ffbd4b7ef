import datetime as dt

from pyspark.sql import functions as F

from symweave.operators.orphans import ForeignKey, Relation, cascade, resolved

T = lambda d: dt.datetime(2024, 1, d)


def test_cascade_over_levels_and_cycles(df):
    files = df([("f1",)], "file string")
    symbols = df([("f1", "a"), ("f2", "b"), (None, "c")], "file string, name string")
    edges = df([(1, "a"), (2, "b"), (3, "x"), (4, None), (3, "x")], "id bigint, to string")
    notes = df([(10, 3, None), (11, 2, None), (12, 1, None), (13, 99, None), (14, 1, 15), (15, 1, 14), (16, 1, 13)], "note bigint, edge bigint, parent bigint")
    rel = {"files": Relation(files, ("file",)), "symbols": Relation(symbols, ("name",)), "edges": Relation(edges, ("id",)), "notes": Relation(notes, ("note",))}
    keys = [
        ForeignKey("k1", "symbols", "files", ("file",), ("file",)),
        ForeignKey("k2", "edges", "symbols", ("to",), ("name",)),
        ForeignKey("k3", "notes", "edges", (F.col("edge").cast("string"),), (F.col("id").cast("string"),)),
        ForeignKey("k4", "notes", "notes", (F.col("parent").cast("string"),), (F.col("note").cast("string"),)),
    ]
    out = cascade(rel, keys)
    got = {(r.id, r.status, r.depth) for r in out["edges"].collect()}
    assert got == {(2, "inherited", 1), (3, "direct", 0)}
    assert {(r.name, r.status) for r in out["symbols"].collect()} == {("b", "direct")}
    notes_ = {r.note: (r.status, r.depth) for r in out["notes"].collect()}
    assert notes_ == {10: ("inherited", 1), 11: ("inherited", 2), 13: ("direct", 0), 16: ("inherited", 1)}


def test_time_of_reference(df):
    lives = df([("a", T(1), T(5)), ("a", T(8), None), ("b", None, None), ("a", T(1), T(5))], "k string, f timestamp, t timestamp")
    refs = df([(1, "a", T(1)), (2, "a", T(5)), (3, "a", T(9)), (4, "b", T(1)), (5, "c", T(1)), (6, None, T(1)), (7, "a", None)], "id bigint, k string, at timestamp")
    keys = [ForeignKey("k", "refs", "lives", ("k",), ("k",), at="at", valid_from="f", valid_to="t")]
    out = cascade({"refs": Relation(refs, ("id",)), "lives": Relation(lives, ("k", "f"))}, keys)["refs"]
    assert {r.id for r in out.where("status = 'direct'").collect()} == {2, 5}


def test_empty_tables_and_extra_columns(df):
    refs = df([(1, "a", "x"), (1, "a", "x")], "id bigint, k string, _salt string")
    none = df([], "k string, fk string")
    keys = [ForeignKey("k", "refs", "p", ("k",), ("k",))]
    assert [r.id for r in cascade({"refs": Relation(refs, ("id",)), "p": Relation(none, ("k",))}, keys)["refs"].collect()] == [1]
    assert cascade({"refs": Relation(refs.limit(0), ("id",)), "p": Relation(none, ("k",))}, keys)["refs"].count() == 0


def test_hot_key_is_salted_and_exact(df, spark):
    refs = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    parents = df([("hot",)], "k string").unionByName(spark.range(1000).select(F.col("id").cast("string").alias("k")))
    out = cascade({"r": Relation(refs, ("id",)), "p": Relation(parents, ("k",))}, [ForeignKey("k", "r", "p", ("k",), ("k",))])["r"]
    assert {r.id for r in out.collect()} == {i for i in range(1000, 3000) if i % 3}


def test_key_parts_do_not_run_together(df):
    refs = df([(1, "ab", "c")], "id bigint, a string, b string")
    parents = df([("a", "bc")], "a string, b string")
    out = cascade({"r": Relation(refs, ("id",)), "p": Relation(parents, ("a", "b"))}, [ForeignKey("k", "r", "p", ("a", "b"), ("a", "b"))])["r"]
    assert out.count() == 1


def test_confidence_spelling(df):
    rows = df([("Certain",), (" INFERRED ",), ("unresolved",), (None,), ("",)], "c string")
    assert [r[0] for r in rows.select(resolved(F.col("c"))).collect()] == [True, True, False, None, False]
