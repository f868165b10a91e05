"""Whitening and hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from codeloom.llm import hard_negatives, whitening


@pytest.fixture()
def table(spark):
    def build(rows):
        frame = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<double>, label int")
        return frame.selectExpr("*", "cast(1 as int) as x", "'a' as `LEAF`", "cast(2 as long) as i", "3 as n", "0.5 as score", "1 as `_u`")

    return build


def gauss(n, width, seed=1, labels=10):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) + (0.2 if j < 2 else 0) for j in range(width)], rng.randrange(labels)) for i in range(n)]


ODD = [(9001, None, 1), (9002, [], 1), (9003, [1.0, None], 2), (9004, [float("nan"), 1.0], 2), (9005, [float("inf"), 1.0], None), (9006, [0.5], 3), (None, None, None)]


def fitted(rows, width):
    good = [(i, v) for i, v, _ in rows if v and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    return [i for i, _ in good], np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good], dtype=np.int64)


@pytest.mark.parametrize("n, width", [(300, 12), (90, 40)])
def test_whitened_axes(table, n, width):
    rows = gauss(n, width) + ODD + [(7, [0.25] * width, 0), (None, [0.5] * width, 0)]
    ids, x = fitted(rows, width)
    got = whitening.whiten(table(rows)).collect()
    used = min(width, 32)
    assert len(got) == len(ids) * used and {r.n for r in got} == {len(ids)}
    v = np.cov(x.T, bias=True)
    e = np.linalg.eigvalsh(v)[::-1]
    share = {r.component: r.explained for r in got}
    assert np.allclose([share[c + 1] for c in range(used)], e[:used] / e.sum(), rtol=1e-9)
    sums = x.sum(axis=0)
    wanted = sorted((i if i is not None else -1, int(((len(x) * r - sums) ** 2).sum())) for i, r in zip(ids, x))
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got if r.component == 1) == wanted
    cells = {(r.vec_id, r.component, r.deviation): r.whitened for r in got}
    white = np.array([[cells[i, c + 1, int(((len(x) * r - sums) ** 2).sum())] for c in range(used)] for i, r in zip(ids, x)])
    error = np.abs(white.T @ white / len(x) - np.eye(used)).max()
    assert error < 1e-9 and max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1
    # Each component is an eigenvector: projecting back by least squares gives an axis that the covariance only stretches.
    axes = np.linalg.lstsq(x - x.mean(axis=0), white * np.sqrt(e[:used]), rcond=None)[0]
    assert np.abs(v @ axes - axes * e[:used]).max() < 1e-8 * e[0]


def test_no_spread(table):
    assert whitening.whiten(table([])).collect() == []
    assert whitening.whiten(table(ODD[:5])).collect() == []
    assert whitening.whiten(table([(i, [0.5, 0.25], 1) for i in range(20)])).collect() == []
    # A constant dimension has no component of its own.
    rows = [(i, [i / 7, 0.5, (i * i % 11) / 5], 0) for i in range(30)]
    assert {r.component for r in whitening.whiten(table(rows)).collect()} == {1, 2}


def test_commonest_length_and_huge_entries(table):
    rows = gauss(40, 3) + [(100 + i, [float(i), -float(i * i)], 1) for i in range(8)] + [(300, [1e300, 0.0, 0.0], 1)]
    got = whitening.whiten(table(rows)).collect()
    assert {r.vec_id for r in got} == set(range(40))
    big = [(i, [1e12 * (i % 5), float(i), 1.0], 1) for i in range(20)]
    assert {r.deviation for r in whitening.whiten(table(big)).collect()} == {None, 0} or any(r.deviation is None for r in whitening.whiten(table(big)).collect())


@pytest.mark.parametrize("spectrum", [[1.0] * 12, [3.0] * 5 + [1.0] * 7, list(10.0 ** np.linspace(-10, 4, 12)), [0.0] * 6 + [2.0] * 6, [1 + 1e-9 * i for i in range(12)], [0.0] * 4, [5.0]])
def test_divide_and_conquer(spectrum):
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    a = q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, axes = whitening.eigen(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * max(spectrum)
    assert np.abs(axes.T @ axes - np.eye(len(a))).max() < 1e-13 and np.abs(a @ axes - axes * values).max() <= 1e-13 * max(spectrum)


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
    signs = np.array([1, 1, 1, 1, -1, -1, -1, -1, -1.0])
    a = q @ np.diag(signs * 10.0 ** rng.uniform(-6, 2, 9)) @ q.T
    assert np.abs(whitening.polar_factor((a + a.T) / 2) - q @ np.diag(signs) @ q.T).max() < 1e-8


def brute_negatives(rows, anchors, k=5, m=5, a=80, b=100):
    """All rows against all anchors."""
    out = []
    for i, own, q in anchors:
        scores = [(sum(x * y for x, y in zip(q, v)), j, label) for j, label, v in rows if j != i and len(v) == len(q)]
        scores.sort(key=lambda s: (-s[0], s[1]))
        for score, j, _ in [s for s in scores if s[2] == own][:k]:
            fits = [s for s in scores if s[2] != own and a * score <= b * s[0] <= b * score]
            out += [(i, j, rank, n, score, ns) for rank, (ns, n, _) in enumerate(fits[:m], 1)]
    return sorted(out)


def mined(frame, every, **options):
    rows = hard_negatives.labelled(frame)
    got = hard_negatives.mine(rows, rows.filter(f"vec_id % {every} = 0"), **options).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def whole(rows):
    good = [(i, label, [math.floor(256 * c) for c in v]) for i, v, label in rows if i is not None and label is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    return good


def clustered(n, width, centres, seed=3, spread=0.03):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.6) for _ in range(width)] for _ in range(centres)]
    return [(i, [c + rng.gauss(0, spread) for c in middles[i % centres]], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("rows", [gauss(400, 8), clustered(600, 6, 9), clustered(300, 3, 2) + gauss(60, 8)], ids=["spread", "clusters", "lengths"])
def test_hard_negatives_against_all_pairs(table, rows):
    rows = rows + ODD + [(5000 + i, rows[4][1], i % 3) for i in range(60)] + [(40, rows[7][1], 1), (None, rows[7][1], 1)]
    every = whole(rows)
    anchors = {}
    for i, label, v in every:
        if i % 20 == 0:
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    assert mined(table(rows), 20) == brute_negatives(every, [(i, *a) for i, a in sorted(anchors.items())])


def test_small_blocks_and_other_windows(table, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 7)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(hard_negatives, "SAMPLE", 50)
    rows = clustered(150, 4, 3)
    every = whole(rows)
    anchors = [r for r in every if r[0] % 10 == 0]
    assert mined(table(rows), 10, positives=2, negatives=3, low=(1, 2)) == brute_negatives(every, anchors, 2, 3, 1, 2)
    # More negatives than there are: all of them.
    assert mined(table(rows[:30]), 10, negatives=100, low=(0, 1)) == brute_negatives(every[:30], [r for r in every[:30] if r[0] % 10 == 0], 5, 100, 0, 1)


def test_no_anchor_no_label_no_window(table):
    assert mined(table([]), 1) == [] and mined(table(ODD), 1) == []
    # One label only, and positives with scores below zero.
    assert mined(table([(i, [0.5, i / 10], 1) for i in range(9)]), 1) == []
    assert mined(table([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]), 1) == brute_negatives(whole([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]), whole([(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]))


def test_siblings_are_eliminated_and_nothing_is_lost():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 3, (200, 5)) for c in rng.normal(0, 200, (12, 5))]).astype(np.int64)
    tree = hard_negatives.Tree(x[::3], float((x.astype(float) ** 2).sum(axis=1).max()))
    leaf, seen = tree.place(x)
    for at, low, high in seen:
        tree.nodes[at].low, tree.nodes[at].high = np.minimum(tree.nodes[at].low, low), np.maximum(tree.nodes[at].high, high)
    q = x[::40]
    scores = q @ x.T
    hi = np.sort(scores, axis=1)[:, -3]
    lo = np.sort(scores, axis=1)[:, -30]
    edge = (q.astype(float) ** 2).sum(axis=1) + tree.reach2
    needed, _ = tree.asks(q, np.sqrt(edge - 2 * hi)[:, None], np.sqrt(edge - 2 * lo)[:, None])
    for i in range(len(q)):
        within = (scores[i] >= lo[i]) & (scores[i] <= hi[i])
        assert needed[i][leaf[within]].all()
    assert needed.mean() < 0.3 and tree.leaves > 20
