import itertools
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm.canonical import Model, classes, count_bigrams, forms, look_alike_pairs
from symweave.llm.forms import LOOK_ALIKES, compatible, skeleton

SCHEMA = "doc_id bigint, text string, k string, form string"


def test_same_look():
    same = ["café fi x", "café ﬁ x", "cаfé​ fi x", "ｃafé fi x", "\U0001d68café f­i　x"]
    assert len({skeleton(s) for s in same}) == 1
    different = ["cafe fi x", "café fi  x", "cafè fi x", "Café fi x", "café f1 x", "café fi x²", "café fi x2", "café\nfi x"]
    assert len({skeleton(s) for s in [same[0], *different]}) == len(different) + 1


def test_compatible_keeps_what_shows():
    assert compatible("x² ½ ①") == "x² ½ ①"
    assert compatible("a\r\nb\rc d") == "a\nb\nc\nd"
    assert compatible("﻿‍­͏") == ""


def test_tables_are_consistent():
    others = [c for v in LOOK_ALIKES.values() for c in v]
    assert len(others) == len(set(others)) and not any(c.isascii() for c in others)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcoepxAB аоеджёé́​ ﬁａ", max_size=20))
def test_forms_are_stable(text):
    s = skeleton(text)
    assert skeleton(s) == s == skeleton(unicodedata.normalize("NFD", text))
    m = Model({("^", "a"): 3, ("^", "д"): 2, ("д", "а"): 5})
    f = m.form(text)
    assert skeleton(f) == s and m.form(f) == f


def test_words_of_one_script(df):
    russian = "проверка дома и графа"
    docs = df([(1, russian, "", ""), (2, "cache the code once more", "", "")], SCHEMA)
    m = Model(count_bigrams(docs))
    mixed = russian.replace("о", "o").replace("а", "a")
    assert m.form(mixed) == m.form(russian) == russian
    assert m.form("сасһе the") == "cache the"


def test_the_lattice_decides_the_spelling(df):
    # fails if the form is the Latin shape of each letter or the text as it stands
    russian, english = "проверка дома и графа", "cache the code once more"
    m = Model(count_bigrams(df([(i, t, "", "") for i, t in enumerate([russian, english] * 3)], SCHEMA)))
    assert m.form(f"{russian} of cаche") == f"{russian} of cache" == m.form(f"{russian.replace('о', 'o')} of саche")
    assert m.form(russian) != skeleton(russian)


def test_copies_of_a_frequent_look_are_paired_once(df):
    rows = [(i, "plate", "", "") for i in range(200)] + [(1000, "plаte", "", ""), (1001, "рlаte", "", ""), (1002, "plate ", "", "")]
    got = sorted(tuple(r) for r in look_alike_pairs(df(rows, SCHEMA)).collect())
    assert got == sorted([(i, j) for i in range(200) for j in (1000, 1001)] + [(1000, 1001)])


def test_pairs(df):
    rows = [(1, "same text", "", ""), (2, "sаme text", "", ""), (3, "same text", "", ""), (4, "same text", "", ""), (5, "same test", "", ""), (6, None, "", ""), (7, "", "", ""), (8, "​", "", ""), (None, "same texт", "", ""), (9, "x" * 100_000, "", ""), (10, "ｘ" + "x" * 99_999, "", "")]
    docs = df(rows, SCHEMA)
    got = {tuple(r) for r in look_alike_pairs(docs).collect()}
    look = {i: skeleton(t) for i, t, *_ in rows if t is not None and i is not None}
    text = {i: t for i, t, *_ in rows}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(look), 2) if look[a] == look[b] and text[a] != text[b]}
    assert {(r.doc_id, r.class_id, r.variants) for r in classes(docs).where("doc_id in (1, 4)").collect()} == {(1, 1, 3), (4, 1, 3)}
    assert {r.doc_id: r.form for r in forms(docs).where("doc_id in (6, 7, 8)").collect()} == {6: None, 7: "", 8: ""}
    assert look_alike_pairs(docs.limit(0)).count() == 0
