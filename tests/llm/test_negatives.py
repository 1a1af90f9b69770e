"""Hard negatives against plain search: ties, repeats, nulls, odd vectors, several dimensions, few and no rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborlens.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, slot int, uid string, high long, found long, score long"


def plain(rows, positives=5, wanted=5, low=80, high=100, every=10):
    good = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        good[(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))] = None
    out = []
    for i, label, v in good:
        if i % every:
            continue
        met = [
            (-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i and len(w) == len(v)
        ]
        met.sort()
        for p, j, _ in [m for m in met if m[2] == label][:positives]:
            fits = [(k, s) for s, k, other in met if other != label and low * -p <= 100 * -s <= high * -p]
            out += [(i, j, r + 1, k, -p, -s) for r, (k, s) in enumerate(fits[:wanted])]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    frame = spark.createDataFrame([(*r, 1, "u", 2, 3, 4) for r in rows], SCHEMA)
    found = negatives.hard_negatives(frame, F.expr(f"id % {every} = 0"), **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(n, dims=24, labels=4, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, [float(x) for x in np.float32(rng.normal(size=dims) + centres[rng.integers(6)])], int(rng.integers(labels))) for i in range(n)]


def test_against_plain_search(spark):
    rows = vectors(300)
    found = mined(spark, rows)
    assert found and found == plain(rows)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = vectors(80, dims=6, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [(90, None, 1), (91, [], 1), (100, [], 0), (92, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (93, [nan] * 6, 0), (94, [inf] * 6, 0)]
    rows += [(110, [0.0] * 6, 1), (120, [1.0, 2.0], 0), (121, [1.0, 2.5], 0), (122, [1.0, 2.2], 1), (None, [1.0] * 6, 1), (130, [1.0] * 6, None)]
    # Ties and copies: the same vector under many ids and both labels, whole rows twice, an id with two vectors.
    rows += [(140 + k, [1.0, 1.0, 0.0, 0.0, 0.0, 0.5], k % 2) for k in range(40)]
    rows += rows[:20] + [(10, [float(rng.random()) for _ in range(6)], 1), (10, [3.0] * 6, 0)]
    assert mined(spark, rows) == plain(rows)


def test_many_units_and_other_windows(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SLOT_ROWS", 2)
    monkeypatch.setattr(negatives, "GROUP_ANCHORS", 3)
    rows = vectors(200, dims=10, labels=3)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=95) == plain(rows, 2, 3, 50, 95)


def test_tile_join_prunes_and_loses_nothing():
    rng = np.random.default_rng(1)
    rows = np.floor(256 * rng.normal(size=(500, 40)) * rng.random(40) ** 4)
    anchors = np.floor(256 * rng.normal(size=(30, 40)) * rng.random(40))
    scores = anchors @ rows.T
    tile = negatives.Tile(rows)
    for share in (0.0, 0.5, 0.9, 0.999, 1.0):
        least = np.floor(np.quantile(scores, share, axis=1)).astype(np.int64)
        i, j, score = tile.join(anchors, least)
        assert sorted(zip(i, j, score, strict=True)) == sorted((a, b, scores[a, b]) for a, b in zip(*np.nonzero(scores >= least[:, None]), strict=True))


def test_long_numbers_stay_exact(spark):
    big = 2.0**21
    rows = [(0, [big, 1.0], 0), (1, [big, 2.0], 0), (2, [big, 1.5], 1), (3, [big, 1.00390625], 1), (4, [1e300, 1.0], 1)]
    rows = [(i, [float(np.float32(x)) for x in v], label) if i < 4 else (i, [3e38, 1.0], label) for i, v, label in rows]
    assert mined(spark, rows) == plain(rows[:4])


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 0)], [(0, [1.0], 0), (1, [1.0], 0)], [(0, [1.0], 0), (1, [1.0], 1)]])
def test_few_rows(spark, rows):
    assert mined(spark, rows) == []
