"""Edges and lines against plain loops and drawn lines."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import edges, regions


def plain_edges(img, low, high):
    v = np.pad(img.astype(int), 1, mode="edge")
    h, w = img.shape
    gx, gy = np.zeros((h, w), int), np.zeros((h, w), int)
    for y in range(h):
        for x in range(w):
            p = v[y : y + 3, x : x + 3]
            gx[y, x] = (p[:, 2] - p[:, 0]) @ [1, 2, 1]
            gy[y, x] = (p[2] - p[0]) @ [1, 2, 1]
    m = abs(gx) + abs(gy)
    at = lambda y, x: m[y, x] if 0 <= y < h and 0 <= x < w else 0
    ridge = np.zeros((h, w), bool)
    for y in range(h):
        for x in range(w):
            a, b = abs(gx[y, x]), abs(gy[y, x])
            if m[y, x] <= low:
                continue
            if b * 32768 < a * 13573:
                ridge[y, x] = m[y, x] > at(y, x - 1) and m[y, x] >= at(y, x + 1)
            elif b * 32768 > a * (13573 + 65536):
                ridge[y, x] = m[y, x] > at(y - 1, x) and m[y, x] >= at(y + 1, x)
            else:
                s = -1 if (gx[y, x] < 0) != (gy[y, x] < 0) else 1
                ridge[y, x] = m[y, x] > at(y - 1, x - s) and m[y, x] > at(y + 1, x + s)
    kept = {(y, x) for y, x in zip(*np.nonzero(ridge & (m > high)), strict=True)}
    todo = list(kept)
    while todo:
        y, x = todo.pop()
        for v2 in range(y - 1, y + 2):
            for u2 in range(x - 1, x + 2):
                if 0 <= v2 < h and 0 <= u2 < w and ridge[v2, u2] and (v2, u2) not in kept:
                    kept.add((v2, u2))
                    todo.append((v2, u2))
    return kept


def pixel_rows(spark, photos):
    rows = [(k, y, x, int(img[y, x])) for k, img in photos.items() for y in range(img.shape[0]) for x in range(img.shape[1])]
    return spark.createDataFrame(rows, "photo_id int, y int, x int, v int").repartition(4)


def drawn(h, w, degrees, x0):
    """A dark photo with a light half plane whose border leans so many degrees off the vertical."""
    y, x = np.mgrid[0:h, 0:w]
    return np.where(x - x0 > np.tan(np.radians(degrees)) * y, 210, 20)


def test_edges_are_those_of_a_plain_loop(spark):
    r = np.random.default_rng(3)
    soft = np.cumsum(np.cumsum(r.normal(size=(40, 60)), 0), 1)
    photos = {1: r.integers(0, 256, (25, 33)), 2: np.interp(soft, (soft.min(), soft.max()), (0, 255)).astype(int), 3: drawn(50, 40, 10, 12), 4: np.full((9, 9), 77), 5: drawn(30, 30, 45, 3)}
    for low, high in ((80, 200), (20, 60)):
        got = {}
        for row in edges.edges(pixel_rows(spark, photos), F.col("v"), low, high).collect():
            got.setdefault(row["photo_id"], set()).add((row["y"], row["x"]))
        assert got == {k: e for k, img in photos.items() if (e := plain_edges(img, low, high))}


def test_drawn_lines_come_back(spark):
    tilts = {1: 0.0, 2: 3.0, 3: -7.0, 4: 11.0, 5: -25.0}
    photos = {k: drawn(150, 160, d, 80 if d < 15 else 20) for k, d in tilts.items()}
    photos[6] = np.full((150, 160), 90)
    photos[7] = drawn(150, 160, 4.0, 60)
    photos[7][60:95] = 20  # a gap cuts the line in two
    found = {}
    for row in edges.lines(edges.edges(pixel_rows(spark, photos), F.col("v"), 80, 200), votes_least=45, length=40, gap=15).collect():
        found.setdefault(row["photo_id"], []).append((row["x1"], row["y1"], row["x2"], row["y2"]))
    lean = lambda s: math.degrees(math.atan2(s[2] - s[0], s[3] - s[1])) if s[3] >= s[1] else math.degrees(math.atan2(s[0] - s[2], s[1] - s[3]))
    assert 6 not in found
    for k, d in tilts.items():
        assert found[k] and all(abs(lean(s) - d) < 1 for s in found[k]), (k, found[k])
        assert any(math.hypot(s[2] - s[0], s[3] - s[1]) > 120 for s in found[k])
    upright = [s for s in found[7] if abs(lean(s)) < 45]
    assert len(upright) == 2 and all(abs(lean(s) - 4) < 1.5 for s in upright)


def test_votes_and_peaks_by_a_plain_count(spark):
    r = np.random.default_rng(1)
    points = sorted({(int(y), int(x)) for y, x in r.integers(0, 30, (120, 2))})
    frame = spark.createDataFrame([(1, y, x) for y, x in points], "photo_id int, y int, x int")
    counted = edges.votes(frame, 36)
    want = {}
    for y, x in points:
        for a in range(36):
            t = a * math.pi / 36
            key = (a, int(np.rint(round(x * math.cos(t) + y * math.sin(t), 9))))
            want[key] = want.get(key, 0) + 1
    assert {(r_["angle"], r_["offset"]): r_["n"] for r_ in counted.collect()} == want
    best = {}
    for (a, o), n in want.items():
        if n >= 5:
            around = [((b % 36), -p if not 0 <= b < 36 else p) for b in range(a - 2, a + 3) for p in range(o - 1, o + 2)]
            rivals = [(want[k], -k[0], -k[1]) for k in around if want.get(k, 0) >= 5]
            if max(rivals) == (n, -a, -o):
                best[a, o] = n
    assert {(r_["angle"], r_["offset"]): r_["n"] for r_ in edges.peaks(counted, 5, 36, angle_reach=2, offset_reach=1).collect()} == best


def test_scores_of_verticals_from_pixels(spark):
    from shutterlake import catalog

    leans = {r["s_suppkey"]: math.floor(r["s_acctbal"]) % 13 - 6 for r in spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").collect()}
    rows = {r["photo_id"]: r for r in catalog.queries()["photo_verticals"](spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(leans)
    for k, d in leans.items():
        assert rows[k]["n_lines"] > 0 and rows[k]["deviation"] == pytest.approx(abs(math.degrees(math.atan(d / 72))), abs=1)


def test_alignment_of_a_border(spark):
    img = drawn(60, 60, 0, 29)
    rows, sizes = pixel_rows(spark, {1: img, 2: img}), spark.createDataFrame([(1, 60, 60), (2, 60, 60)], "photo_id int, h int, w int")
    found = edges.edges(rows, F.col("v"), 80, 200)
    mask = rows.where("(photo_id = 1 and x >= 30) or (photo_id = 2 and x >= 45)")
    scores = {r["photo_id"]: r["score"] for r in edges.alignment(mask, found, sizes).collect()}
    assert scores == {1: 1.0, 2: 0.0}


def test_no_pixels(spark):
    none = spark.createDataFrame([], "photo_id int, y int, x int, v int")
    assert edges.edges(none, F.col("v"), 1, 2).collect() == [] and edges.lines(none).collect() == []
    assert regions.vertical_scores(edges.lines(none), spark.createDataFrame([(1, "interior")], "photo_id int, scene string")).first()["n_lines"] == 0


def test_votes_are_never_rows(spark):
    """Edge pixels go to their photo's task once; nothing else is shuffled and no row becomes several."""
    found = spark.createDataFrame([(1, y, 5) for y in range(40)] + [(2, 3, 3)], "photo_id int, y int, x int")
    cut = edges.lines(found, votes_least=30, length=20, gap=3)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and plan.count("Exchange") == 1
    assert cut.collect() == [(1, 5, 0, 5, 39)]
