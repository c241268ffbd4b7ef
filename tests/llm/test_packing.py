from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from symweave.llm.packing import classes, encoding, fill, layout, pack

SCHEMA = "doc_id bigint, text string, container string, k int"


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 40), st.booleans(), st.data())
def test_pack(capacity, top_up, data):
    sizes = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    placed = pack(sizes, capacity, top_up)
    assert sorted(p[0] for p in placed) == list(range(len(sizes)))
    boxes = defaultdict(list)
    for item, box, own, position, offset in placed:
        boxes[box].append((position, offset, sizes[item], own))
    assert sorted(boxes) == list(range(len(boxes)))
    short = []
    for box in boxes.values():
        at = 0
        for n, (position, offset, size, _) in enumerate(box):
            assert (position, offset) == (n, at)
            at += size
        assert at <= capacity
        # i texts of the class come first, then higher classes only
        (i,) = {own for *_, own in box}
        kinds = [capacity // size for _, _, size, _ in box]
        count = sum(k == i for k in kinds)
        assert kinds[:count] == [i] * count and all(k > i for k in kinds[count:]) and (top_up or count == len(kinds))
        if count < i:
            short.append(i)
    assert len(short) == len(set(short))
    if top_up:
        assert sum(2 * sum(x[2] for x in b) < capacity for b in boxes.values()) <= 1


def test_a_class_is_filled_by_count_not_by_fit():
    # best fit would put 6 with 4 and 5 with 5; class 1 takes one text and what is left of its room, class 2 takes two
    assert [(p[1], p[2]) for p in sorted(pack([6, 4, 4, 5], 10))] == [(0, 1), (0, 1), (1, 2), (1, 2)]
    assert [(p[1], p[2]) for p in sorted(pack([6, 4, 4, 5], 10, top_up=False))] == [(0, 1), (1, 2), (2, 2), (1, 2)]


def test_layout(df):
    words = "alpha beta gamma delta "
    texts = [words * n for n in (1, 5, 60, 3, 3, 700, 2, 40)] + [None, "", words * 3, "😀 naïve"]
    docs = df([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "no id", "x", 1)], SCHEMA).coalesce(2)
    out = layout(docs, capacity=128)
    rows = out.collect()
    enc = encoding().encode_ordinary
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.doc_id] += r.tokens
    assert dict(tokens) == {i: len(enc(t)) if t else 0 for i, t in [*enumerate(texts), (None, "no id")] if t is not None}
    boxes = defaultdict(list)
    for r in rows:
        boxes[r.container].append(r)
    for box in boxes.values():
        box.sort(key=lambda r: r.position)
        assert [r.position for r in box] == list(range(len(box))) and sum(r.tokens for r in box) <= 128
        assert all(a.offset + a.tokens == b.offset for a, b in zip(box, box[1:]) if b.tokens)
    for i, t in enumerate(texts):
        n = len(enc(t)) if t else 0
        pieces = sorted(r.piece for r in rows if r.doc_id == i)
        assert pieces == (list(range(max(1, -(-n // 128)))) if t is not None else [])
    f = fill(out, 128).first()
    by_class = {r.container_class: r for r in classes(out, 128).collect()}
    assert sum(r.own_texts + r.texts_on_top for r in by_class.values()) == sum(r.tokens > 0 for r in rows)
    assert all(0 < r.used_by_class <= r.used <= 1 and r.own_texts <= i * r.containers for i, r in by_class.items())
    assert f.texts == 12 and f.tokens == sum(tokens.values()) and f.used > 0.8


def test_empty(df):
    assert layout(df([], SCHEMA)).count() == 0
    f = fill(layout(df([], SCHEMA))).first()
    assert (f.containers, f.tokens) == (0, 0)


def test_only_empty_texts(df):
    rows = layout(df([(1, "", "", 1), (2, "", "", 1)], SCHEMA).coalesce(1)).collect()
    assert [(r.doc_id, r.position, r.tokens) for r in rows] == [(1, 0, 0), (2, 1, 0)]


@pytest.mark.parametrize("capacity", [1, 7])
def test_tiny_containers(df, capacity):
    out = layout(df([(1, "one two three four five six seven eight nine", "", 1)], SCHEMA), capacity=capacity)
    assert out.agg({"tokens": "max"}).first()[0] <= capacity
