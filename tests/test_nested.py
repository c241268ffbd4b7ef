import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.operators import nested

WANTED = ("testResults", "tests")
JEST = {"numTotalTests": 1, "testResults": [{"name": "a", "assertionResults": [{"status": "failed", "location": {"line": 3}, "failureMessages": ["m", None]}]}]}


def test_embedded_objects():
    text = json.dumps(JEST)
    assert nested.embedded_objects(text, WANTED) == [JEST]
    assert nested.embedded_objects("> run\n{ odd\n" + text + "\nDone", WANTED) == [JEST]
    assert nested.embedded_objects(json.dumps(text), WANTED) == [JEST]
    assert nested.embedded_objects(json.dumps({"exit": 1, "report": JEST}), WANTED) == [JEST]
    assert nested.embedded_objects('log: "' + text.replace('"', '\\"') + '" end', WANTED) == [JEST]
    assert nested.embedded_objects(text + "\n" + text, WANTED) == [JEST, JEST]
    for cut in range(1, len(text)):
        assert nested.embedded_objects(text[:cut], WANTED) == []
    assert nested.embedded_objects(None, WANTED) == [] and nested.embedded_objects("", WANTED) == []


def test_long_broken_text_is_quick():
    text = '{"testResults":[' + '{"name":"x","assertionResults":[{"a":1}]},' * 30000
    assert nested.embedded_objects(text, WANTED) == []


def records(df, values):
    return nested.find_records(df([(i, v) for i, v in enumerate(values)], "id bigint, t string"), "id", "t", WANTED)


def leaves(df, values):
    out = nested.report_leaves(nested.flatten(records(df, values)))
    return set() if out is None else {tuple(r) for r in out.collect()}


def test_lone_values_nulls_and_changing_types(df):
    a = {"testResults": {"assertionResults": {"failureMessages": "only"}}}
    b = {"testResults": [None, {"assertionResults": [5, {"failureMessages": [None, "x", {"deep": 1}]}]}, "odd"]}
    c = {"tests": [{"call": {"traceback": [{"path": "p"}, None, {"path": "q"}]}}, {"call": None}, {"call": {"traceback": {"path": "r"}}}]}
    d = {"tests": "none"}
    got = leaves(df, [json.dumps(x) for x in (a, b, c, d)] + [None, "", "{}"])
    assert got == {(0, 0, 0, 0), (1, 1, 1, 1), (1, 1, 1, 2), (2, 0, -1, 0), (2, 0, -1, 2), (2, 2, -1, 0)}


def test_odd_numbers_and_characters(df):
    texts = ['{"tests": [{"duration": NaN, "call": {"traceback": [{"path": "p", "lineno": 123456789012345678901234567890, "x": 1e999}]}}]}', '{"tests": [{"call": {"traceback": ["\\u00e9\\ud83d\\ude00 \u00e9", ""]}}]}']
    assert leaves(df, texts) == {(0, 0, -1, 0), (1, 0, -1, 0), (1, 0, -1, 1)}


def test_no_reports(df):
    assert leaves(df, [None, "x"]) == set()
    assert leaves(df, []) == set()


def test_parents_and_names(df):
    value = {"tests": [{"a.b": 1, "a_b": "t", "A_B": 2, "key": 3, "call": {"traceback": [{"path": "p", "lineno": 4}]}}]}
    tables = nested.flatten(records(df, [json.dumps(value)]))
    tests, frames = tables["tests[]"], tables["tests[].call.traceback[]"]
    assert len(set(map(str.lower, tests.columns))) == len(tests.columns)
    row = tests.first().asDict()
    assert sorted(str(row[c]) for c in row if c.lower().startswith("a_b")) == ["1", "2", "t"] and row["key_2"] == 3
    f = frames.first()
    assert f.parent_key == row["row_key"] and (f.path, f.lineno, f.pos) == ("p", 4, 0)


json_values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=3), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["assertionResults", "failureMessages", "call", "traceback", "z"]), x, max_size=3), max_leaves=12)


def brute(values):
    as_list = lambda v: [] if v is None else v if isinstance(v, list) else [v]
    get = lambda o, k: o.get(k) if isinstance(o, dict) else None
    out = set()
    for i, v in enumerate(values):
        for a, x in enumerate(as_list(v.get("testResults"))):
            for b, y in enumerate(as_list(get(x, "assertionResults"))):
                out |= {(i, a, b, c) for c, z in enumerate(as_list(get(y, "failureMessages"))) if z is not None}
        for a, x in enumerate(as_list(v.get("tests"))):
            out |= {(i, a, -1, c) for c, z in enumerate(as_list(get(get(x, "call"), "traceback"))) if z is not None}
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.fixed_dictionaries({"testResults": json_values, "tests": json_values}), min_size=1, max_size=5))
def test_leaves_against_a_walk(spark, values):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert leaves(frame, [json.dumps(v) for v in values]) == brute(values)


def test_reports_below_a_count_of_tests():
    assert nested.embedded_objects(json.dumps({"tests": 12, "report": JEST}), WANTED) == [JEST]
    assert nested.embedded_objects(json.dumps({"testResults": json.dumps(JEST)}), WANTED) == [JEST]
    assert nested.embedded_objects(json.dumps({"tests": 12}), WANTED) == [{"tests": 12}]
    assert nested.embedded_objects(json.dumps({"tests": None, "x": {"y": 1}}), WANTED) == [{"tests": None, "x": {"y": 1}}]


def test_null_runner_is_kept(df):
    rows = [(1, None, json.dumps(JEST), 1), (2, " Cargo", "x", 1), (3, "jest", "x", 1)]
    reports = df(rows, "report_id bigint, runner string, stdout string, loaded_at int")
    assert {r.report_id for r in nested.latest_reports(reports).collect()} == {1, 3}


def test_long_records_that_do_not_parse_raise(df, monkeypatch):
    rows = df([('{"a": 1}',), ('{"a": ',)], "json string")
    assert rows.where(nested.parsed("json").isNull()).count() == 1
    monkeypatch.setattr(nested, "LONG", 4)
    with pytest.raises(Exception, match="MALFORMED_RECORD|VARIANT"):
        rows.select(nested.parsed("json").cast("string")).collect()


def test_paths_that_read_alike_have_tables_of_their_own(df):
    records = df([(1, 0, '{"a.b": [1, 2], "a": {"b": [3]}}')], "key bigint, seq int, json string")
    tables = nested.flatten(records)
    assert sorted(tables) == ["", "a.b[]", "a.b_2[]"]
    assert sorted(sorted(r.value for r in t.collect()) for name, t in tables.items() if name) == [[1, 2], [3]]


def test_too_deep_objects_are_told():
    with pytest.raises(ValueError, match="nested deeper"):
        nested.embedded_objects('{"tests": ' * 200_000, ("tests",))
