"""Consensus labels from annotators that disagree, with agreement and reliability.

The model has an ability for each annotator and a difficulty for each item (the scale ``1/beta``):

    P(pick c | truth z) ~ exp(beta_i * (skill_j [c = z] + flip_j [c is the other answer] + tie_j [c = z = tie])
                              + place_j [c stands first] + draw_j [c = tie])

``skill`` applies where the truth is an answer. ``flip`` lets an annotator be systematically wrong, which is
information too; ``place`` and ``draw`` take up habits that say nothing about the item, such as picking
whatever stands first. ``log beta`` has a normal prior, which fixes the scale of the abilities; it is summed
over the nodes of a quadrature. Expectation-maximisation: given the annotators, every item has a posterior
over its label and its difficulty; given these, steps along the gradient of the expected log posterior,
scaled by its curvature, move the annotators. Every two passes the way is extrapolated (and the step taken
back if it lowers the posterior), until no annotator's parameter moves by more than ``STEADY``.

A pass is one job over the items: the map tasks add up, for each annotator, the expected number of picks per
label, difficulty, place and pick (90 numbers); these meet by annotator, where they are summed and the
annotator is moved. Nothing is kept per item between passes, so a lost executor costs only its part of one pass. Up to
``PANEL`` annotators, the tasks get all parameters with the pass. Beyond, parameters, picks and posteriors
meet by joins, with frequent annotators and items split; the labels are the same.

Defined results: picks in any letter case and with blanks around count; ``A`` and ``B`` name an answer by its
place. Anything else, and a null, is unreadable. Items without a readable pick give no row. An annotator
that repeats on an item counts once, with the delivery of the largest ``loaded_at`` (ties: the smaller pick).
A null annotator is an annotator of its own (-1). Labels with equal posterior: ``raw``, then ``treatment``,
then ``tie``. An item with a single pick has no agreement (null). An empty table gives no rows. A model that has
not come to rest after ``PASSES`` passes is used as it is, with a warning and ``converged`` false.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symweave.operators import skew
from symweave.runtime import cut

LABELS = ("raw", "treatment", "tie")
#: Spread of log beta, and the nodes and weights of the quadrature over its normal prior.
SPREAD = 0.4
_NODES, _WEIGHTS = np.polynomial.hermite_e.hermegauss(5)
GRID, SCALES = np.exp(SPREAD * _NODES), _WEIGHTS / _WEIGHTS.sum()
#: So many annotators travel to the tasks as five numbers each; a task then adds up 90 numbers for each of them (36 MB).
PANEL = 50_000
PASSES, STEADY = 500, 1e-4
_FEATURES = 5
_PRIOR_MEAN = np.array([2.0, 0.0, 1.0, 0.0, 0.0])
_PRIOR_WEIGHT = np.array([0.3, 0.5, 0.3, 0.5, 0.5])
_CELLS = 3 * len(GRID)  # labels and difficulties
_COUNTS = _CELLS * 6
#: The number under which a pass reports its sums over items.
_STATS = -(2**31)


def picks(verdicts: DataFrame, axis: str = "correctness") -> DataFrame:
    """``verdict_id, judge, pick (0 raw, 1 treatment, 2 tie), a_is_raw``: one row per item and annotator."""
    rows = verdicts.select("verdict_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("at"), F.explode("per_judge").alias("e"))
    entry = F.filter(F.map_entries("e.scored"), lambda x: F.lower(F.trim(x["key"])) == axis)
    rows = rows.where(F.col("verdict_id").isNotNull() & F.col("e.scored").isNotNull()).select("verdict_id", "at", F.coalesce("e.judge_idx", F.lit(-1)).alias("judge"), F.col("e.a_is_raw").alias("a_is_raw"), F.lower(F.trim(F.try_element_at(entry, F.lit(1))["value"]["pick"])).alias("said"))
    first = F.when(F.col("said").isin("a", "b"), F.when((F.col("said") == "a") == F.col("a_is_raw"), 0).otherwise(1))
    first = F.when(F.col("said").isin("a", "b") & F.col("a_is_raw").isNull(), F.lit(None)).otherwise(first)
    pick = F.when(F.col("said") == "raw", 0).when(F.col("said") == "treatment", 1).when(F.col("said") == "tie", 2).otherwise(first)
    read = rows.select("verdict_id", "at", "judge", pick.alias("pick"), F.coalesce("a_is_raw", F.lit(True)).alias("a_is_raw")).where(F.col("pick").isNotNull())
    one = read.groupBy("verdict_id", "judge").agg(F.max_by(F.struct("pick", "a_is_raw"), F.struct(F.coalesce("at", F.lit(-(2**62))), -F.col("pick"), "a_is_raw")).alias("r"))
    return one.select("verdict_id", "judge", "r.*")


def _features() -> np.ndarray:
    """The features of every ``(truth, beta, a_is_raw, pick)``."""
    x = np.zeros((3, len(GRID), 2, 3, _FEATURES))
    for z in range(3):
        for b, beta in enumerate(GRID):
            for raw_first in range(2):
                for c in range(3):
                    x[z, b, raw_first, c] = (
                        beta * (c == z != 2),
                        beta * (z != 2 and c == 1 - z),
                        beta * (c == z == 2),
                        float(c != 2 and (c == 0) == bool(raw_first)),
                        float(c == 2),
                    )
    return x


_X = _features()


def _utility(weights: np.ndarray) -> np.ndarray:
    return (weights @ _X.reshape(-1, _FEATURES).T).reshape(-1, *_X.shape[:-1])


def log_likelihood(weights: np.ndarray) -> np.ndarray:
    """log P(pick | truth, beta, a_is_raw) for every annotator."""
    u = _utility(weights)
    return u - np.logaddexp.reduce(u, axis=-1, keepdims=True)


def _by_code(weights: np.ndarray) -> np.ndarray:
    """``annotator, pick * 2 + a_is_raw, label and difficulty``: the log likelihood of a vote."""
    return log_likelihood(weights).transpose(0, 4, 3, 1, 2).reshape(len(weights), 6, _CELLS)


def posterior(sums: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label, beta) of items from the sums of their votes' log likelihoods, and each item's log evidence."""
    joint = sums + (np.log(labels)[:, None] + np.log(SCALES)[None, :]).ravel()
    top = joint.max(axis=1, keepdims=True)
    p = np.exp(joint - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, (top + np.log(total))[:, 0]


def maximise(weights: np.ndarray, counts: np.ndarray, steps: int = 4) -> np.ndarray:
    """Steps along the gradient of each annotator's expected log posterior, scaled by its curvature."""
    w = weights.copy()
    counts = counts.reshape(-1, 6, 3, len(GRID)).transpose(0, 2, 3, 1).reshape(-1, 3, len(GRID), 3, 2).swapaxes(3, 4)
    total = counts.sum(axis=-1, keepdims=True)
    for _ in range(steps):
        p = np.exp(log_likelihood(w))
        gradient = np.einsum("jzbrc,zbrcf->jf", counts - total * p, _X) - _PRIOR_WEIGHT * (w - _PRIOR_MEAN)
        mean = np.einsum("jzbrc,zbrcf->jzbrf", p, _X)
        second = np.einsum("jzbrc,zbrcf,zbrcg->jfg", total * p, _X, _X, optimize=True) - np.einsum("jzbr,jzbrf,jzbrg->jfg", total[..., 0], mean, mean, optimize=True)
        second += np.diag(_PRIOR_WEIGHT)
        move = np.linalg.solve(second, gradient[..., None])[..., 0]
        size = np.abs(move).max(axis=1, keepdims=True)
        w += move * np.minimum(1.0, 1.0 / np.maximum(size, 1e-9))
    return w


def log_prior(weights: np.ndarray) -> float:
    return -0.5 * float((_PRIOR_WEIGHT * (weights - _PRIOR_MEAN) ** 2).sum())


@dataclass
class Panel:
    """The annotators' parameters and the shares of the labels. Beyond ``PANEL`` annotators the parameters are a table."""

    labels: np.ndarray
    judges: np.ndarray | None = None
    weights: np.ndarray | None = None
    table: DataFrame | None = None  # judge, w
    converged: bool = False
    passes: int = 0


# ---------------------------------------------------------------- a pass over the items


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, by: str, width: int) -> DataFrame:
    """The arrays ``x`` of ``width`` numbers added up for each ``by``."""
    return rows.groupBy(by).agg(*[F.sum(F.col("x")[i]).alias(f"x{i}") for i in range(width)]).select(by, F.array(*[f"x{i}" for i in range(width)]).alias("x"))


def _told(post: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """What a task says of its items: the expected labels and the evidence."""
    out = np.zeros(_COUNTS)
    out[:3] = post.reshape(-1, 3, len(GRID)).sum(axis=(0, 2))
    out[3] = evidence.sum()
    return out


def grouped(rows: DataFrame) -> DataFrame:
    """One row for each item: its votes as ``j * 6 + pick * 2 + a_is_raw``, at most one per annotator of a bounded panel."""
    vote = F.col("j") * 6 + F.col("code")
    return rows.groupBy("verdict_id").agg(F.collect_list(vote.cast("bigint")).alias("votes"))


def _item_sums(batch: pa.RecordBatch, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The votes of a batch, the item of each, and the items' sums of log likelihoods."""
    votes = batch.column("votes")
    length = votes.value_lengths().to_numpy()
    flat = votes.flatten().to_numpy()
    starts = np.concatenate(([0], np.cumsum(length)[:-1]))
    return flat, np.repeat(np.arange(len(length)), length), np.add.reduceat(table[flat], starts, axis=0)


def _pass(items: DataFrame, panel: Panel) -> tuple[np.ndarray, np.ndarray, float]:
    """The next weights and label shares, and the log posterior of the panel given."""
    sent = items.sparkSession.sparkContext.broadcast((panel.weights, panel.labels))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, labels = sent.value
        table = _by_code(weights).reshape(-1, _CELLS)
        counts, stats = np.zeros_like(table), np.zeros(_COUNTS)
        for b in batches:
            if not b.num_rows:
                continue
            flat, item, sums = _item_sums(b, table)
            post, evidence = posterior(sums, labels)
            for c in range(_CELLS):
                counts[:, c] += np.bincount(flat, post[item, c], len(table))
            stats += _told(post, evidence)
        counts = counts.reshape(len(weights), _COUNTS)
        seen = np.flatnonzero(counts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, _STATS).astype(np.int32)), _lists(np.vstack([counts[seen], stats]))], ["j", "x"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = sent.value
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for j, x in zip(b.column("j").to_pylist(), _matrix(b.column("x"), _COUNTS)):
                total[j] = total[j] + x if j in total else x
        j, x = np.array(list(total), np.int32), np.array(list(total.values())).reshape(-1, _COUNTS)
        new = x[:, :_FEATURES].copy()
        on = j != _STATS
        if on.any():
            new[on] = maximise(weights[j[on]], x[on])
        yield pa.RecordBatch.from_arrays([pa.array(j), _lists(new)], ["j", "w"])

    told = items.mapInArrow(expect, "j int, x array<double>").repartition(1 + len(panel.judges) // 5_000, "j")
    moved = told.mapInArrow(move, "j int, w array<double>").collect()
    sent.destroy()
    weights = np.tile(_PRIOR_MEAN, (len(panel.judges), 1))  # an annotator without picks is at its prior
    labels, evidence = panel.labels, 0.0
    for r in moved:
        if r.j == _STATS:
            labels, evidence = (np.array(r.w[:3]) + 1.0) / (sum(r.w[:3]) + 3.0), r.w[3]
        else:
            weights[r.j] = r.w
    return weights, labels, evidence + log_prior(panel.weights) + float(np.log(panel.labels).sum())


def _settle(items: DataFrame, panel: Panel) -> Panel:
    """Passes with squared extrapolation until nothing moves."""
    def flat(weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return np.concatenate([weights.ravel(), np.log(labels)])

    def point(x: np.ndarray) -> Panel:
        labels = np.exp(x[-3:])
        return replace(panel, weights=x[:-3].reshape(-1, _FEATURES), labels=labels / labels.sum())

    here, sure, height = flat(panel.weights, panel.labels), None, -np.inf
    passes = 0
    while passes < PASSES:
        weights, labels, now = _pass(items, point(here))
        passes += 1
        if sure is not None and now < height - 1e-9 * abs(height):  # extrapolated too far: back to the last step
            here, sure = sure, None
            continue
        height = now
        one = flat(weights, labels)
        first = one - here
        if np.abs(first).max() <= STEADY:
            return replace(point(one), converged=True, passes=passes)
        weights, labels, height = _pass(items, point(one))
        passes += 1
        two = flat(weights, labels)
        second = two - one
        if np.abs(second).max() <= STEADY:
            return replace(point(two), converged=True, passes=passes)
        far = max(1.0, min(16.0, np.linalg.norm(first) / max(np.linalg.norm(second - first), 1e-300)))
        here, sure = here + 2 * far * first + far * far * (second - first), two
    return replace(point(here if sure is None else sure), passes=passes)


# ---------------------------------------------------------------- panels of any size


def _votes_sum(votes: DataFrame, weights: DataFrame) -> DataFrame:
    """``verdict_id, x``: each item's sum of its votes' log likelihoods, from votes and parameters that meet by a join."""

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                table = _by_code(_matrix(b.column("w"), _FEATURES))
                yield pa.RecordBatch.from_arrays([b.column("verdict_id"), _lists(table[np.arange(b.num_rows), b.column("code").to_numpy()])], ["verdict_id", "x"])

    met = skew.joined(votes, weights, ["judge"], "verdict_id").select("verdict_id", "code", "w")
    return _sums(met.mapInArrow(likely, "verdict_id bigint, x array<double>"), "verdict_id", _CELLS)


def _posteriors(sums: DataFrame, labels: np.ndarray) -> DataFrame:
    """``verdict_id, x, evidence`` with the posterior x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                post, evidence = posterior(_matrix(b.column("x"), _CELLS), labels)
                yield pa.RecordBatch.from_arrays([b.column("verdict_id"), _lists(post), pa.array(evidence)], ["verdict_id", "x", "evidence"])

    return sums.mapInArrow(run, "verdict_id bigint, x array<double>, evidence double")


def _settle_joined(votes: DataFrame, panel: Panel) -> Panel:
    """Plain passes in which no task gets all annotators."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                judges, j = np.unique(b.column("judge").to_numpy(), return_inverse=True)
                counts = np.zeros((len(judges) * 6, _CELLS))
                np.add.at(counts, j * 6 + b.column("code").to_numpy(), _matrix(b.column("x"), _CELLS))
                yield pa.RecordBatch.from_arrays([pa.array(judges.astype(np.int32)), _lists(counts.reshape(-1, _COUNTS))], ["judge", "x"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                old = _matrix(b.column("w"), _FEATURES)
                new = maximise(old, _matrix(b.column("x"), _COUNTS))
                yield pa.RecordBatch.from_arrays([b.column("judge"), _lists(new), pa.array(np.abs(new - old).max(axis=1))], ["judge", "w", "moved"])

    weights, labels = panel.table, panel.labels
    for n in range(1, PASSES + 1):
        post = cut(_posteriors(_votes_sum(votes, weights), labels))
        counts = _sums(skew.joined(votes, post.select("verdict_id", "x"), ["verdict_id"], "judge").select("judge", "code", "x").mapInArrow(count, "judge int, x array<double>"), "judge", _COUNTS)
        told = cut(counts.join(weights, "judge").mapInArrow(move, "judge int, w array<double>, moved double"))
        moved = told.agg(F.max("moved")).first()[0] or 0.0
        size = len(GRID)
        shares = post.agg(*[F.sum(sum((F.col("x")[z * size + b] for b in range(1, size)), F.col("x")[z * size])) for z in range(3)]).first()
        labels = (np.array([x or 0.0 for x in shares]) + 1.0) / (sum(x or 0.0 for x in shares) + 3.0)
        weights = told.select("judge", "w")
        if moved <= STEADY:
            return replace(panel, table=weights, labels=labels, converged=True, passes=n)
    return replace(panel, table=weights, labels=labels, passes=PASSES)


# ---------------------------------------------------------------- results


def fit(rows: DataFrame) -> tuple[Panel, DataFrame]:
    """The fitted panel, and ``verdict_id, x``: each item's sum of log likelihoods under it."""
    spark = rows.sparkSession
    votes = cut(rows.select("verdict_id", "judge", (F.col("pick") * 2 + F.col("a_is_raw").cast("int")).alias("code")))
    known = [r.judge for r in votes.select("judge").distinct().orderBy("judge").limit(PANEL + 1).collect()]
    labels = np.full(3, 1 / 3)
    if len(known) > PANEL:
        start = F.array(*map(F.lit, _PRIOR_MEAN.tolist()))
        panel = _settle_joined(votes, Panel(labels, table=votes.select("judge").distinct().select("judge", start.alias("w"))))
        sums = _votes_sum(votes, panel.table)
    else:
        numbers = spark.createDataFrame([(int(j), i) for i, j in enumerate(known)], "judge int, j int")
        items = cut(grouped(votes.join(F.broadcast(numbers), "judge")))
        panel = Panel(labels, np.array(known, np.int64), np.tile(_PRIOR_MEAN, (len(known), 1)), converged=not known)
        panel = _settle(items, panel) if known else panel
        weights = panel.weights

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _by_code(weights).reshape(-1, _CELLS)
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("verdict_id"), _lists(_item_sums(b, table)[2])], ["verdict_id", "x"])

        sums = items.mapInArrow(add, "verdict_id bigint, x array<double>")
    if not panel.converged:
        warnings.warn(f"the annotators' parameters still move after {panel.passes} passes", RuntimeWarning, stacklevel=2)
    return panel, sums


def item_labels(verdicts: DataFrame, axis: str = "correctness") -> DataFrame:
    """``verdict_id, label, probability, difficulty, n_picks, agreement`` for each item.

    ``agreement`` is the share of agreeing pairs of picks, corrected for chance by the overall shares of
    the picks: 1 for full agreement, 0 for what chance gives.
    """
    rows = picks(verdicts, axis)
    panel, sums = fit(rows)
    labels = panel.labels

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            post = posterior(_matrix(b.column("x"), _CELLS), labels)[0].reshape(-1, 3, len(GRID))
            by = post.sum(axis=2)
            best = (by >= by.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("verdict_id"), pa.array(np.array(LABELS)[best].tolist()), pa.array(by[np.arange(len(by)), best]), pa.array(1 / (post.sum(axis=1) @ GRID))],
                ["verdict_id", "label", "probability", "difficulty"],
            )

    found = sums.mapInArrow(label, "verdict_id bigint, label string, probability double, difficulty double")
    each = rows.groupBy("verdict_id").agg(F.count(F.lit(1)).cast("int").alias("n_picks"), *[F.count_if(F.col("pick") == c).alias(f"c{c}") for c in range(3)])
    shares = {r.pick: r.n for r in rows.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(shares.values()))
    chance = sum((n / total) ** 2 for n in shares.values())
    n = F.col("n_picks").cast("double")
    pairs = sum((F.col(f"c{c}") * (F.col(f"c{c}") - 1) for c in range(1, 3)), F.col("c0") * (F.col("c0") - 1)) / (n * (n - 1))
    agreement = F.when(n > 1, (pairs - chance) / (1 - chance) if chance < 1 else F.lit(1.0))
    return found.join(each, "verdict_id").select("verdict_id", "label", "probability", "difficulty", "n_picks", agreement.alias("agreement"))


def judge_reliability(verdicts: DataFrame, axis: str = "correctness") -> DataFrame:
    """``judge_idx, n_picks, reliability, skill, flip, tie_skill, first_place, draw, converged`` for each annotator.

    ``reliability`` is the probability of the right pick on an item of usual difficulty, over the labels'
    shares and both orders of the answers.
    """
    rows = picks(verdicts, axis)
    panel, _ = fit(rows)
    spark, labels = verdicts.sparkSession, panel.labels
    weights = panel.table
    if weights is None:
        weights = spark.createDataFrame([(int(j), list(map(float, w))) for j, w in zip(panel.judges, panel.weights)], "judge int, w array<double>")

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                w = np.vstack(b["w"])
                right = np.einsum("jzbrz,z,b->j", np.exp(log_likelihood(w)), labels, SCALES) / 2
                yield pd.DataFrame({"judge": b["judge"], "reliability": right, **dict(zip(("skill", "flip", "tie_skill", "first_place", "draw"), w.T))})

    counts = rows.groupBy("judge").agg(F.count(F.lit(1)).alias("n_picks"))
    rated = weights.mapInPandas(rate, "judge int, reliability double, skill double, flip double, tie_skill double, first_place double, draw double")
    out = rated.join(counts, "judge")
    return out.select(F.col("judge").alias("judge_idx"), "n_picks", "reliability", "skill", "flip", "tie_skill", "first_place", "draw", F.lit(panel.converged).alias("converged"))
