import datetime as dt
import random

import numpy as np
import pytest

from symweave.llm import consensus

SCHEMA = "verdict_id bigint, loaded_at timestamp, per_judge array<struct<judge_idx:int,a_is_raw:boolean,scored:map<string,struct<pick:string,reason:string>>>>, label string"
T = dt.datetime(2024, 1, 1)


def vote(judge, pick, first=True, axis="correctness"):
    return (judge, first, {axis: (pick, None), "substance": ("tie", None)} if pick is not None else None)


def test_reading(df):
    rows = [
        (1, T, [vote(0, "raw"), vote(1, " TREATMENT"), vote(2, "A", True), vote(3, "A", False), vote(4, "b", True), vote(5, "Tie"), vote(6, "?"), vote(7, None), (8, True, {"substance": ("raw", None)}), (9, None, {"correctness": ("A", None)}), (10, True, {"correctness": None}), None], ""),
        (2, T, [vote(0, "raw")], ""), (2, T + dt.timedelta(1), [vote(0, "tie"), vote(1, "raw")], ""), (2, T, [vote(1, "raw")], ""), (3, T, None, ""), (None, T, [vote(0, "raw")], ""), (4, T, [vote(None, "raw"), vote(None, "raw")], ""),
    ]
    got = sorted((r.verdict_id, r.judge, consensus.LABELS[r.pick]) for r in consensus.picks(df(rows, SCHEMA)).collect())
    assert got == [(1, 0, "raw"), (1, 1, "treatment"), (1, 2, "raw"), (1, 3, "treatment"), (1, 4, "treatment"), (1, 5, "tie"), (2, 0, "tie"), (2, 1, "raw"), (4, -1, "raw")]


def panel(n, seed=3):
    """Good judges, one who always turns the answer round, some who pick the first place or a draw."""
    r = random.Random(seed)
    truth, rows = {}, []
    for i in range(n):
        z = r.choices(["raw", "treatment", "tie"], [4, 4, 2])[0]
        truth[i] = z
        votes = []
        for j in r.sample(range(9), 5):
            first = r.random() < 0.5
            right = {0: 0.9, 1: 0.9, 2: 0.8, 3: 0.8, 4: 0.12, 5: 0.35, 6: 0.35, 7: 0.35, 8: 0.4}[j]
            if r.random() < right:
                p = z
            elif j == 4:
                p = {"raw": "treatment", "treatment": "raw", "tie": r.choice(["raw", "treatment"])}[z]
            elif j in (5, 6):
                p = "raw" if first else "treatment"
            elif j in (7, 8):
                p = "tie"
            else:
                p = r.choice([x for x in consensus.LABELS if x != z])
            votes.append(vote(j, p, first))
        rows.append((i, T, votes, ""))
    return truth, rows


def test_beats_the_majority(df):
    truth, rows = panel(600)
    data = df(rows, SCHEMA)
    got = {r.verdict_id: r for r in consensus.item_labels(data).collect()}
    right = np.mean([got[i].label == z for i, z in truth.items()])
    plain = np.mean([max(consensus.LABELS, key=[v[2]["correctness"][0] for v in rows[i][2]].count) == z for i, z in truth.items()])
    assert right > plain + 0.05 and right > 0.85
    judges = {r.judge_idx: r for r in consensus.judge_reliability(data).collect()}
    assert min(judges[j].reliability for j in range(4)) > max(judges[j].reliability for j in range(4, 9))
    assert judges[5].first_place > 1 and judges[4].flip > judges[4].skill and judges[7].draw > 1
    assert all(r.n_picks == 5 and 0 < r.probability <= 1 and r.difficulty > 0 for r in got.values())


def test_panels_of_any_size_take_the_same_steps(df, monkeypatch):
    rows = consensus.picks(df(panel(60, 5)[1], SCHEMA))
    monkeypatch.setattr(consensus, "PASSES", 2)
    with pytest.warns(RuntimeWarning):
        bounded, one = consensus.fit(rows)
    monkeypatch.setattr(consensus, "PANEL", 3)
    with pytest.warns(RuntimeWarning):
        joined, two = consensus.fit(rows)
    weights = {r.judge: r.w for r in joined.table.collect()}
    # after two passes the first way returns the point before its extrapolation
    assert sorted(weights) == bounded.judges.tolist() and np.allclose([weights[j] for j in bounded.judges], bounded.weights)
    assert np.allclose(bounded.labels, joined.labels)
    one, two = ({r.verdict_id: r.x for r in x.collect()} for x in (one, two))
    assert sorted(one) == sorted(two) and all(np.allclose(x, two[i]) for i, x in one.items())


def test_settled_labels_stay_and_unsettled_ones_are_told(df, monkeypatch):
    rows = consensus.picks(df(panel(200)[1], SCHEMA))
    fitted, _ = consensus.fit(rows)
    assert fitted.converged and fitted.passes < 60
    monkeypatch.setattr(consensus, "STEADY", 1e-6)
    finer, _ = consensus.fit(rows)
    assert finer.converged and np.abs(finer.weights - fitted.weights).max() < 0.01
    monkeypatch.setattr(consensus, "PASSES", 2)
    with pytest.warns(RuntimeWarning, match="still move"):
        assert not consensus.fit(rows)[0].converged


def test_agreement_and_ties(df):
    rows = [(1, T, [vote(j, "raw") for j in range(4)], ""), (2, T, [vote(0, "raw"), vote(1, "treatment")], ""), (3, T, [vote(0, "tie")], "")]
    got = {r.verdict_id: r for r in consensus.item_labels(df(rows, SCHEMA)).collect()}
    assert got[1].agreement == 1.0 and got[2].agreement < 0 and got[3].agreement is None
    assert got[1].label == "raw" and got[3].label == "tie"


def test_empty(df):
    none = df([], SCHEMA)
    assert consensus.item_labels(none).count() == 0 and consensus.judge_reliability(none).count() == 0
    unread = df([(1, T, [vote(0, "?")], "")], SCHEMA)
    assert consensus.item_labels(unread).count() == 0
