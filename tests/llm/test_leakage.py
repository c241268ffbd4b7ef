import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm import leakage
from symweave.llm.fmindex import FMIndex, suffix_array


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.integers(1, 5))
def test_index_against_a_scan(values, sample):
    seq = np.array(values, np.int64)
    assert list(suffix_array(seq)) == sorted(range(len(seq)), key=lambda i: values[i:])
    index = FMIndex(seq, 4, sample)
    for n in (1, 2, 3):
        patterns = np.array([[(i // 4**j) % 4 + 1 for j in range(n)] for i in range(4**n)], np.int64)
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns.tolist(), lo, hi):
            want = [i for i in range(len(values) - n + 1) if values[i : i + n] == p]
            assert sorted(index.locate(np.arange(a, max(a, b)))) == want


R = random.Random(1)
VOCABULARY = [f"{a}{b}" for a in ("rel", "mon", "tav", "zed", "qui", "bor", "nal") for b in ("ic", "ado", "uth", "emp", "ix", "ora", "yle", "und")]
TAIL = "Answer in ten lines and finish with the word DONE."


def sentence(n):
    return " ".join(R.choice(VOCABULARY) + str(R.randint(0, 999)) for _ in range(n)).capitalize() + "."


ITEMS = [(i, f"{sentence(30)} {sentence(30)} {TAIL}") for i in range(8)]


def own(i):
    return ITEMS[i][1].removesuffix(TAIL).split()


def found(df, texts):
    docs = df([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, words string")
    items = df([(i, t, "y") for i, t in ITEMS], "item_id bigint, item_text string, text string")
    return {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()}


def replaced(words, at):
    return [("other" if i in at else w) for i, w in enumerate(words)]


def test_passages(df):
    w = own(0)
    texts = [
        "before " + " ".join(w[3:27]) + " after",  # 0: exactly 24 words
        " ".join(w[3:26]),  # 1: an echo of 23
        " ".join(replaced(w[:40], {5, 13, 21, 29, 35})).upper(),  # 2: one in eight replaced, other case
        " ".join(replaced(w[:24], {4, 10, 16})),  # 3: three of 24
        " ".join(w[:13] + ["something", "else", "stands", "here"] + w[13:26]),  # 4: an insertion
        "\n".join("// **" + x + "**" for x in w[:30]),  # 5: layout and markup
        " ".join(w[:30]).replace("a", "а").replace("e", "ｅ"),  # 6: other character forms
        " ".join(replaced(w[:30], set(range(0, 30, 3)))),  # 7: merely built alike
        TAIL * 3,  # 8: the standing instruction
        " ".join(w[13:26] + w[:13]),  # 9: pieces in another order
        None, "", "x",
        "pad " * 50_000 + " ".join(w[:30]),  # 13: far into a very long text
        " ".join(w[:30]), " ".join(w[:30]),  # 14, 15: copies
    ]
    assert found(df, texts) == {(i, 0) for i in (0, 2, 3, 4, 5, 6, 13, 14, 15)}


def test_a_word_of_two_parts_is_one_word(df):
    plain = [f"{VOCABULARY[i % 56]}{i}" for i in range(60)]
    for i in (12, 19, 40):
        plain[i] = f"muster_lot{i}"
    items = df([(1, " ".join(plain) + ".")], "item_id bigint, item_text string")
    texts = [
        " ".join(replaced(plain[:24], {12})),  # 0: by a word of one part
        " ".join(plain[:6] + ["and", "so", "on"] + replaced(plain[6:24], {6})),  # 1: and an insertion
        " ".join("other_long-word" if i == 5 else w for i, w in enumerate(plain[30:54])),  # 2: by one of more parts
        " ".join("a" if i in (12, 19) else w for i, w in enumerate(plain[:24])),  # 3: two of them
        " ".join(replaced(plain[:23], {12})),  # 4: an echo of 23
        " ".join(replaced(plain[:24], {3, 7, 12, 19})),  # 5: four of 24
        "in " + " ".join(plain[:12]) + " two whole sentences of other words then " + " ".join(plain[13:24]),  # 6: no word in its place
        " ".join(plain[:24]).replace("_", " "),  # 7: other spacing
        " ".join("x_y" if i in (6, 12, 19) else w for i, w in enumerate(plain[:24])),  # 8: by as many parts
        " ".join("-".join("abcdefghijklm") if i == 12 else w for i, w in enumerate(plain[:24])),  # 9: by one of very many
        "/".join("one-two-three" if i in (5, 12, 19) else w for i, w in enumerate(plain[:24])),  # 10: without blanks
    ]
    docs = df(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id for r in leakage.leaks(docs, items).collect()} == {0, 1, 2, 3, 7, 8, 9, 10}


def test_random_passages_against_the_rule(df):
    texts, want = [], set()
    for n in range(60):
        i, size = R.randrange(8), R.randrange(14, 50)
        a = R.randrange(0, 60 - size)
        part = own(i)[a : a + size]
        gaps = {k for k in range(3, size - 3) if k % 8 == 4 and R.random() < 0.8}
        texts.append(f"{sentence(20)} {' '.join(replaced(part, gaps))} {sentence(20)}")
        if size >= 24 and len(gaps) * 8 <= size:
            want.add((n, i))
    got = found(df, texts)
    assert want <= got
    assert all(len(texts[d].split()) >= 64 for d, _ in got)


def test_blocks_and_shards_do_not_matter(df, monkeypatch):
    texts = [" ".join(own(i)[:30]) for i in range(8)] * 3
    whole = found(df, texts)
    for block in (100, 3, 1):
        monkeypatch.setattr(leakage, "BLOCK", block)
        assert found(df, texts) == whole
    items = leakage.Items(ITEMS)
    words = [leakage.words(t) for t in texts]
    one = {(d, items.ids[i]) for d, i, _ in leakage.search_shard(words, items)}
    two = {(d + k, items.ids[i]) for k in range(0, 24, 5) for d, i, _ in leakage.search_shard(words[k : k + 5], items)}
    assert one == two == whole


def test_common_phrases_are_expanded_for_some_documents_at_a_time(df, monkeypatch):
    shared = " ".join(f"common{i}" for i in range(6))
    items = [(i, f"{shared} {' '.join(own(i)[:30])}") for i in range(8)]
    texts = [[*leakage.words(shared)] * 5 + leakage.words(" ".join(own(i % 8)[:30])) for i in range(40)]
    whole = leakage.search_shard(texts, leakage.Items(items))
    assert {(d, i) for d, i, _ in whole} == {(d, d % 8) for d in range(40)}
    for n in (1, 50, 400):
        monkeypatch.setattr(leakage, "EXPANDED", n)
        assert leakage.search_shard(texts, leakage.Items(items)) == whole


def test_hopeless_pairs_are_not_aligned():
    # five runs at most; those not seen have three words
    assert leakage._promising([(0, 0, 9)], 24, 8, 4)
    assert not leakage._promising([(0, 0, 8)], 24, 8, 4)
    assert not leakage._promising([(0, 0, 5), (6, 6, 4), (11, 11, 4)], 24, 8, 4)
    assert leakage._promising([(0, 0, 6), (7, 7, 5), (13, 13, 4)], 24, 8, 4)
    assert not leakage._promising([(0, 50, 6), (7, 20, 5), (13, 3, 4)], 24, 8, 4)  # in another order


def test_an_item_with_two_texts_counts_with_both(df):
    items = df([(1, ITEMS[0][1]), (1, ITEMS[1][1])], "item_id bigint, item_text string")
    docs = df([(1, " ".join(own(0)[:30])), (2, " ".join(own(1)[:30]))], "doc_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(1, 1), (2, 1)}


def test_standing_instructions_are_counted_over_all_blocks(df, monkeypatch):
    standing = " ".join(f"rule{i}" for i in range(30)) + "."
    items = df([(i, f"{ITEMS[i][1]} {standing}") for i in range(8)], "item_id bigint, item_text string")
    docs = df([(1, standing), (2, " ".join(own(3)[:30]))], "doc_id bigint, text string")
    for block in (100, 2):
        monkeypatch.setattr(leakage, "BLOCK", block)
        assert {(r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()} == {(2, 3)}


def test_empty_tables(df):
    assert found(df, []) == set()
    docs = df([(1, "text")], "doc_id bigint, text string")
    assert leakage.leaks(docs, df([], "item_id bigint, item_text string")).count() == 0
    assert leakage.leaks(docs, df([(1, None), (2, "")], "item_id bigint, item_text string")).count() == 0
