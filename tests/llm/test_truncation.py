import datetime as dt

import pytest

from symweave.llm import truncation
from symweave.llm.truncation import inspect, judged, shares

SCHEMA = "rollout_id bigint, run_label string, final_answer string, loaded_at timestamp, why string"
T = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("text, why", [
    ("All is well.", ""), ("Is it?", ""), ("Stop!)", ""), ("It is `x`.", ""), ("Done here.\n\nDONE", ""), ("no end at all\n\nDONE", ""), ("see **DONE**\nDONE.", ""),
    ("The parser rea", "no terminator"), ("The parser reads the", "no terminator"), ("Look at `src/parse/inde", "code span"), ("Ends in `src/a.", "code span"),
    ("```\nlet x = 1;\n```", ""), ("```\nlet x = 1;", "fence"), ("~~~\ncode.\n", "fence"), ("| a | b |\n|---|---|\n| 1 | 2 |", ""), ("| a | b |\n|---|---|\n| 1 | sr", "table row"), ("| a | b |\n|---|---|\n| 1 |", "table row"),
    ("1. one.\n2. ", "list entry"), ("1. one.\n2.", "list entry"), ("The cache is re...", "mark"), ("The cache is re…", "mark"), ("The cache\n[…truncated]", "mark"), ("It was [cut]", "mark"),
    ("A partial \\u00", "broken sequence"), ("A caf�", "broken sequence"), ("Some **bold", "markup"), ("(an open bracket", "bracket"), ('He said "no', "bracket"),
])
def test_automaton(text, why):
    assert inspect(text)[0] == why


@pytest.mark.parametrize("text, why", [
    ("It failed (see below. The rest works.", "bracket"), ('He said "it works. It does.', "bracket"), ("Note (the first.\n\nThe second.", "bracket"), ("Of [these:\n\n| a |\n|---|\n| 1 |", "bracket"),
    ("Fine (see `(`). It works.", ""), ('A 5" pipe fits.', ""), ("```\nf((\n```\n\nIt works.", ""), ("One ` tick.\n\nThen (`x`) works.", ""), ("See (a.\n\nThen b).", ""),
])
def test_what_is_open_before_a_whole_sentence(text, why):
    assert inspect(text)[0] == why


def run(df, rows):
    data = [(i, src, text, T, "x") for i, (src, text) in enumerate(rows)]
    return {r.rollout_id: r.why for r in judged(df(data, SCHEMA)).where("truncated").collect()}


def test_baseline_of_proper_ends(df):
    rows = [("s", "No callers found\n\nDONE")] * 2 + [("s", "See `a`, `b`, …\n\nDONE")] * 3
    rows += [("s", "No callers found"), ("s", "No callers fou"), ("s", "See `x`, `y`, …"), ("s", "See `x` and …"), ("s", "rare ending")]
    assert run(df, rows) == {6: "no terminator", 8: "mark", 9: "no terminator"}


def test_proper_ends_are_a_share_of_the_source(df, monkeypatch):
    rows = [("s", "Well.\n\nDONE")] * 10 + [("s", "No callers found\n\nDONE")] * 2 + [("s", "No callers found")]
    assert run(df, rows) == {}
    monkeypatch.setattr(truncation, "SUPPORT_SHARE", 0.2)
    assert run(df, rows) == {12: "no terminator"}


def test_blank_ends(df):
    rows = [("s", f"Sentence {i}.") for i in range(60)] + [("s", "Sentence. "), ("s", "Ends well.\n\nDONE\n")]
    assert run(df, rows) == {60: "blank end"}
    assert run(df, [("s", f"Sentence {i}.\n") for i in range(9)]) == {}


def test_each_source_has_its_baseline(df):
    rows = [("lines", f"Sentence {i}.\n") for i in range(9)] + [("rare", f"Sentence {i}.") for i in range(60)] + [("rare", "Sentence. ")]
    assert run(df, rows) == {69: "blank end"}
    rows = [("a", "No callers found\n\nDONE")] * 2 + [("b", "Well.\n\nDONE")] + [(s, "No callers found") for s in ("a", "b", "c", None)]
    assert run(df, rows) == {4: "no terminator"}


def test_field_limits(df):
    body = "word " * 200
    rows = [("a", (body + "x" * i)[: 300 + i % 7] + ".") for i in range(10)]
    rows += [("lim", ("y" * i + body)[:400]) for i in range(1, 9)] + [("lim", ("q " * 300)[:399] + "."), ("a", ("q " * 300)[:399] + ".")]
    got = run(df, rows)
    assert got[18] == "field limit" and 19 not in got and set(got) == set(range(10, 19))


def test_limits_in_bytes(df):
    rows = [("lim", "é" * i + "w" * (500 - 2 * i)) for i in range(6)] + [("lim", "é" * 10 + "w" * 479 + ".")]
    assert set(run(df, rows)) == set(range(7))


def test_nulls_copies_and_deliveries(df):
    rows = [(1, "s", None, T, ""), (2, "s", "", T, ""), (3, "s", " \n", T, ""), (4, None, "cut he", T, ""), (4, None, "cut he", T, ""), (5, "s", "cut he", T, ""), (5, "s", "Now whole.", T + dt.timedelta(1), ""), (None, "s", "cut he", T, ""), (6, "s", "a " * 200_000 + "cu", T, "")]
    data = df(rows, SCHEMA)
    assert {r.rollout_id for r in judged(data).where("truncated").collect()} == {4, 6}
    got = {r.run_label: (r.texts, r.truncated, r.share) for r in shares(data).collect()}
    assert got == {None: (1, 1, 1.0), "s": (2, 1, 0.5)}
    assert judged(data.limit(0)).count() == 0 and shares(data.limit(0)).count() == 0


def test_closing_word_is_configured():
    assert truncation.CLOSING == "DONE"
