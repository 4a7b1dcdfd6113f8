"""Distances to openings and outlines of masks against plain loops and known figures."""

import math

import numpy as np
import pytest

from shutterlake.operators import borders


def rows(spark, masks):
    px = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(px * 2, "photo_id int, y int, x int").repartition(3)


def steps(dy, dx):
    low, high = sorted((abs(int(dy)), abs(int(dx))))
    return (high - low) * borders.STEP + low * borders.CORNER


@pytest.mark.parametrize("exact", [False, True])
def test_strips_end_where_the_opening_is_too_far(spark, exact):
    r = np.random.default_rng(4)
    shapes = {1: (40, 60), 2: (30, 300), 3: (20, 900), 4: (25, 40), 5: (25, 40)}
    openings = {k: r.random(s) < 0.002 * k for k, s in shapes.items()}
    strips = {k: r.random(s) < 0.3 for k, s in shapes.items()}
    openings[4][:] = False
    strips[5][:] = False
    strips[5][3, 7] = openings[5][20, 30] = openings[5][20, 31] = True
    sizes = spark.createDataFrame([(k, *s) for k, s in shapes.items()], "photo_id int, h int, w int")
    out = borders.within_reach(rows(spark, strips), rows(spark, openings), sizes, least_opening=2, exact=exact)
    want = set()
    for k, (_, w) in shapes.items():
        reach = max(8, int(w * 0.015))
        held = list(zip(*np.nonzero(openings[k]), strict=True))
        for y, x in zip(*np.nonzero(strips[k]), strict=True):
            near = any((y - a) ** 2 + (x - b) ** 2 <= reach**2 if exact else steps(y - a, x - b) <= reach << 16 for a, b in held)
            if near or len(held) < 2 or strips[k].sum() < 50:
                want.add((k, int(y), int(x)))
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert 0 < len(want) < sum(int(m.sum()) for m in strips.values())


def test_outlines_of_known_shapes(spark):
    y, x = np.mgrid[:40, :40]
    ring = np.zeros((40, 40), bool)
    ring[5:20, 5:25] = True
    ring[8:15, 8:20] = False
    ring[10:12, 10:14] = True
    line = np.zeros((40, 40), bool)
    line[3, 4:14] = True
    line[20, 20] = True
    corner = np.zeros((40, 40), bool)
    corner[[0, 1, 1], [0, 0, 1]] = True
    pair = np.zeros((40, 40), bool)
    pair[[39, 38], [39, 38]] = True
    masks = {1: abs(y - 20) + abs(x - 20) <= 9, 2: ring, 3: line, 4: corner, 5: pair, 6: np.ones((40, 40), bool)}
    sizes = spark.createDataFrame([(k, 40, 40) for k in masks], "photo_id int, h int, w int")
    got = dict(map(tuple, borders.outlines(rows(spark, masks), sizes).collect()))
    root = math.sqrt(2)
    assert got == pytest.approx({1: 36 * root, 2: 2 * (14 + 19), 3: 18, 4: 2 + root, 5: 2 * root, 6: 4 * 39})
    scores = dict(map(tuple, borders.smoothness(rows(spark, masks), sizes).select("photo_id", "score").collect()))
    area = {k: int(m.sum()) for k, m in masks.items()}
    assert scores == pytest.approx({k: 1.0 if area[k] < 100 else min(1.0, max(0.0, 1 - (got[k] ** 2 / (4 * math.pi * area[k]) - 2) / 20)) for k in masks})


def test_no_masks(spark):
    none = rows(spark, {})
    sizes = spark.createDataFrame([(1, 5, 5)], "photo_id int, h int, w int")
    assert borders.within_reach(none, none, sizes).count() == borders.smoothness(none, sizes).count() == 0
