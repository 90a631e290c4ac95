import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinity.llm import negatives

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """All pairs, in whole numbers."""
    kept = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        whole = [math.floor(256 * float(np.float32(v))) for v in x]
        if i not in kept or (label, whole) < kept[i]:
            kept[i] = (label, whole)
    out = []
    for a, (label, x) in kept.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own == label) for i, (own, y) in kept.items() if i != a)
        for score, i, _ in [s for s in scored if s[2]][:positives]:
            fits = [(n, -s) for s, n, same in scored if not same and low * -score <= 100 * -s <= high * -score]
            out += [(a, i, rank, n, -score, s) for rank, (n, s) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def found(spark, rows, every, **options):
    df = spark.createDataFrame(rows, VECTORS)
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def grouped(seed, count, dim=12, groups=6, spread=0.15):
    """Vectors around few directions, of different length, labels partly by direction."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(groups, dim))
    own = draw.integers(groups, size=count)
    x = (centres[own] + spread * draw.normal(size=(count, dim))) * draw.uniform(0.2, 2, size=(count, 1)) / dim**0.5
    label = np.where(draw.random(count) < 0.5, own, draw.integers(groups, size=count)) % 4
    return [(int(i), [float(np.float32(v)) for v in x[i]], int(label[i])) for i in range(count)]


@pytest.mark.parametrize("blocks", [False, True])
def test_against_all_pairs(spark, monkeypatch, blocks):
    if blocks:  # several clusters, blocks of anchors and of lists, and lists with a rest
        monkeypatch.setattr(negatives, "CLUSTER_ANCHORS", 20)
        monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 7)
        monkeypatch.setattr(negatives, "BLOCK_BYTES", 8 * 12 * 600)
        monkeypatch.setattr(negatives, "HEAD_LEAST", 40)
        monkeypatch.setattr(negatives, "SAMPLE", 500)
    rows = grouped(3, 2500)
    assert found(spark, rows, 25) == brute(rows, lambda i: i % 25 == 0)


def test_nulls_ties_repeats_and_lengths(spark):
    draw = np.random.default_rng(5)
    rows = [(k, [float(v) for v in draw.integers(-2, 3, size=4)], k % 3) for k in range(300)]
    rows += [(300 + k, [0.0] * 4, 1) for k in range(12)] + [(320 + k, [1.0, 1.0], 2) for k in range(8)]
    rows += [(330, [], 1), (331, [1.0, 2.0, 1.0, 0.0, 5.0], 0), (None, [1.0] * 4, 1), (340, None, 1), (350, [1.0] * 4, None)]
    rows += [(360, [1.0, None, 0.0, 0.0], 1), (370, [math.nan] * 4, 1), (380, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [rows[10], rows[20], (30, [2.0] * 4, 2), (30, [2.0] * 4, 0), (7, [9.0] * 4, 1)]
    assert found(spark, rows, 10) == brute(rows, lambda i: i % 10 == 0)
    assert found(spark, rows, 10, positives=2, negatives=3, low=10, high=100) == brute(
        rows, lambda i: i % 10 == 0, 2, 3, 10, 100)


def test_large_components_stay_exact(spark):
    draw = np.random.default_rng(6)
    rows = [(k, [float(np.float32(v)) for v in draw.normal(size=3) * 1e6], k % 2) for k in range(60)]
    assert max(abs(r[4]) for r in brute(rows, lambda i: i % 5 == 0)) > 1 << 53
    assert found(spark, rows, 5) == brute(rows, lambda i: i % 5 == 0)


def test_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], 10) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 1)], 10) == []
    rows = grouped(7, 200)
    clash = spark.createDataFrame(rows, VECTORS).withColumns({n: F.lit(1) for n in (
        "x", "cluster", "bound", "norm", "asked", "request", "score", "rank", "anchor_id", "list_block")})
    got = negatives.hard_negatives(clash, F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_end_walks_early():
    rows = grouped(8, 3000, spread=0.05)
    x = np.array([[math.floor(256 * v) for v in r[1]] for r in rows], float)
    anchors = x[:300]
    placed = negatives.Clusters(negatives._place(anchors, 6), np.zeros(1), np.zeros(1))
    angles = placed.angles(anchors)
    own = angles.argmin(axis=1)
    widest = np.array([angles[own == c, c].max(initial=0) for c in range(6)]) + 1e-7
    clusters = negatives.Clusters(placed.centres, widest, np.zeros(6))
    bounds = clusters.bounds(x)[:, own].T * np.linalg.norm(anchors, axis=1)[:, None]
    scores = anchors @ x.T
    assert (scores <= bounds * negatives.SLACK + negatives.LITTLE).all()
    tenth = np.sort(scores, axis=1)[:, -10]
    assert (bounds >= tenth[:, None]).mean() < 0.4


def test_best():
    r, s, i, k = negatives.best(np.array([1, 0, 1, 1]), np.array([5, 2, 7, 7]), np.array([1, 2, 9, 3]), 2)
    assert (r.tolist(), s.tolist(), i.tolist(), k.tolist()) == ([0, 1, 1], [2, 7, 7], [2, 3, 9], [0, 0, 1])
