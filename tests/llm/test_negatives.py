"""Hard negatives against all scores, and on the edges of their input."""

import math

import numpy as np

from assetspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score double, t string"
FLOAT_MAX = 3.4028234663852886e38


def clamp(x):
    return min(max(x, -(1 << 63)), (1 << 63) - 1)


def truth(rows, k=5):
    """rows (vec_id, embedding, label) -> the result's rows, by all pairs."""
    held = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            held.append((i, [clamp(math.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for a, (i, v, label) in enumerate(held):
        if i % 100:
            continue
        scored = sorted((-clamp(sum(x * y for x, y in zip(v, w, strict=False))), j, c, other) for c, (j, w, other) in enumerate(held) if c != a)
        for s, j, _, _ in [x for x in scored if x[3] == label][:k]:
            inside = [(t, m) for t, m, _, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s][:k]
            out += [(i, j, rank + 1, m, -s, -t) for rank, (t, m) in enumerate(inside)]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(i, v, label, "clash", 1.0, None) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(frame).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def test_random_rows_in_many_blocks(spark, monkeypatch):
    """Blocks of 64 rows and norms far apart; a third of all rows share one vector."""
    monkeypatch.setattr(negatives, "BLOCK", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "ROUTES", 100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)) * np.exp(rng.normal(size=(1500, 1)))
    x[:500] = x[0]
    order = rng.permutation(1500)
    rows = [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in order]
    got = mined(spark, rows)
    assert got == truth(rows) and len(got) > 100


def test_odd_rows(spark):
    v, w = [0.5, 0.25, -1.0], [0.5, 0.25]
    rows = [(100, v, 1), (100, v, 1), (101, v, 1), (102, w, 2), (102, w, 2), (103, [], 1), (104, v, 3), (200, [], 1), (300, None, 1), (400, v, None), (None, v, 1), (500, [float("nan")], 1), (600, [float("inf")], 1),
            (700, v, 9), (701, [None, 1.0], 0), (800, [FLOAT_MAX, -FLOAT_MAX], 4), (801, [FLOAT_MAX, 1.0], 4), (802, [FLOAT_MAX, 0.0], 5), (803, [0.0, 0.0, 0.0], 6), (-100, [-0.5, -0.25, 1.0], 1), (7, v, 0), (14, [0.4, 0.2, -0.9], 0)]
    assert mined(spark, rows) == truth(rows)
    assert mined(spark, []) == [] and mined(spark, [(100, v, 1)]) == [] and mined(spark, [(100, v, 1), (101, v, 2)]) == []


def test_no_pair_is_lost_at_any_threshold():
    """What candidates() passes over is under the threshold, and at high thresholds most of it is."""
    rng = np.random.default_rng(6)
    cut = negatives.slices(24)
    weight = np.linspace(3, 0.1, 24)
    x, q = (np.rint(rng.normal(size=(n, 24)) * weight * 100) for n in (400, 30))
    xs, qs = negatives.suffix_norms(x, cut), negatives.suffix_norms(q, cut)
    scores = q @ x.T
    for share in (-1, 0, 0.5, 0.9, 0.99):
        t = np.quantile(scores, max(share, 0), axis=1) if share >= 0 else np.full(30, -np.inf)
        passed = np.zeros(scores.shape, bool)
        for i, at in negatives.candidates(q, qs, t, x, xs, cut):
            passed[i, at] = True
        assert passed[scores >= t[:, None]].all()
        if share == 0.99:
            assert passed.mean() < 0.1
