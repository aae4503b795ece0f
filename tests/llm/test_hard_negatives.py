"""Hard negatives against a plain double loop, with ties, odd rows and vectors of several lengths."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from folio.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, other string, score int"


def table(spark, given):
    return spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in given], SCHEMA)


def cut(score):
    return max(-(2**63), min(2**63 - 1, score))


def brute(given, step, positives=5, negatives=3):
    whole = lambda v: [math.floor(Fraction(float(np.float32(x))) * 256) for x in v]
    sound = [
        (i, label, whole(v)) for i, v, label in given
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, label, v in sound:
        if a % step:
            continue
        others = sorted((-cut(sum(x * y for x, y in zip(v, w))), i, k) for i, k, w in sound if i != a and len(w) == len(v))
        for negated, p, _ in [o for o in others if o[2] == label][:positives]:
            score = -negated
            inside = [o for o in others if o[2] != label and 50 * score <= -100 * o[0] <= 95 * score]
            out += [(a, p, r, n, score, -s) for r, (s, n, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def mined(df, **how):
    found = hard_negatives.mine(df, **how)
    return sorted(map(tuple, found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(seed, n, dims, labels=3, near=0.6):
    rng = random.Random(seed)
    center = [rng.gauss(0, near) for _ in range(dims)]
    return [(i, [c + rng.gauss(0, 0.3) for c in center], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 7, 40])
def test_equals_a_double_loop(spark, dims):
    given = vectors(dims, 400, dims)
    want = brute(given, 10)
    assert want or dims == 1
    assert mined(table(spark, given).repartition(3), anchor_step=10, block_rows=64, anchors=7) == want


def test_ties_and_repeated_rows(spark):
    rng = random.Random(2)
    given = [(i % 150, [rng.choice([0.5, 1.0]) for _ in range(4)], i % 2) for i in range(300)]
    given += given[:40]
    assert mined(table(spark, given), anchor_step=10, block_rows=50, anchors=4) == brute(given, 10)


def test_one_vector_holds_a_third_of_all_rows(spark):
    given = [(i, [0.5, 0.25], i % 2) if i % 3 == 0 else r for i, r in enumerate(vectors(5, 600, 2))]
    assert mined(table(spark, given), anchor_step=30, block_rows=32, anchors=4) == brute(given, 30)


def test_odd_rows(spark):
    given = [
        *vectors(3, 60, 6), (None, [1.0] * 6, 1), (60, None, 1), (70, [1.0] * 6, None), (80, [None] * 6, 0), (90, [float("nan")] * 6, 0),
        (100, [float("inf")] * 6, 0), (110, [], 0), (111, [], 0), (112, [], 1), (120, [1.0] * 5, 0), (121, [1.0] * 5, 0), (122, [0.75] * 5, 1),
        (130, [2e30, 1.0], 0), (131, [1e30, 1.0], 0), (132, [8e29, 1.0], 1), (140, [1e4, 1.0], 0), (141, [1e9, 1.0], 0), (142, [6e8, 1.0], 1), (143, [8e3, 1.0], 0), (-50, [0.3] * 6, 1),
    ]
    assert mined(table(spark, given), anchor_step=10, block_rows=16, anchors=3) == brute(given, 10)
    assert mined(table(spark, given[:0])) == [] and mined(table(spark, given[60:61])) == []


def test_the_bitmap_shrinks_before_all_dimensions_are_read(spark):
    rng = np.random.default_rng(1)
    block = hard_negatives.Block({"ids": np.arange(2000), "labels": np.zeros(2000, int), "vectors": rng.integers(-9, 9, (2000, 64)).astype(float)})
    sizes = []

    def passes(least, greatest):
        sizes.append(len(least))
        return greatest >= np.sort(least)[-3]

    anchor = np.array([60.0] * 8 + [1.0] * 56)
    found, scores = block.scan(anchor, np.arange(2000), passes)
    want = anchor @ block.columns
    assert set(np.argsort(-want)[:3]) <= set(found) and (scores == want[found]).all()
    assert sizes[0] == 2000 and sizes[1] < 400
