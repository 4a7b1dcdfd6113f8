"""Connected parts and holes against a flood fill."""

import numpy as np
import pytest

from shutterlake.operators import parts


def flood(grid, reach):
    """Sets of pixels that hang together."""
    h, w = grid.shape
    seen, found = np.zeros_like(grid, bool), []
    for y0, x0 in zip(*np.nonzero(grid), strict=True):
        if seen[y0, x0]:
            continue
        todo, part = [(int(y0), int(x0))], []
        seen[y0, x0] = True
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    v, u = y + dy, x + dx
                    if (reach or abs(dy) + abs(dx) == 1) and 0 <= v < h and 0 <= u < w and grid[v, u] and not seen[v, u]:
                        seen[v, u] = True
                        todo.append((v, u))
        found.append(part)
    return found


def snake(h, w):
    g = np.zeros((h, w), bool)
    g[::2] = True
    for k, y in enumerate(range(1, h - 1, 2)):
        g[y, w - 1 if k % 2 == 0 else 0] = True
    return g


def rings(n):
    g = np.zeros((n, n), bool)
    for k in range(1, n // 2, 2):
        g[k, k : n - k] = g[n - 1 - k, k : n - k] = True
        g[k : n - k, k] = g[k : n - k, n - 1 - k] = True
    return g


@pytest.fixture(scope="module")
def grids():
    r = np.random.default_rng(8)
    made = {1: snake(41, 300), 2: rings(30), 3: np.zeros((9, 9), bool), 4: np.ones((20, 30), bool), 5: np.eye(25, dtype=bool), 6: np.eye(12, dtype=bool)[::-1]}
    made |= {10 + k: r.random((40, 270)) < d for k, d in enumerate((0.1, 0.35, 0.5, 0.62, 0.9))}
    return made


def pixels(spark, grids):
    rows = [(k, int(y), int(x), "extra") for k, g in grids.items() for y, x in zip(*np.nonzero(g), strict=True)]
    return spark.createDataFrame(rows + rows[:50], "photo_id int, y int, x int, part string").repartition(5)


@pytest.mark.parametrize("reach", [0, 1])
def test_parts_are_those_of_a_flood_fill(spark, grids, reach):
    got = sorted(map(tuple, parts.parts(pixels(spark, grids), reach).collect()))
    want = []
    for k, g in grids.items():
        for p in flood(g, reach):
            (y, x), ys, xs = min(p), [q[0] for q in p], [q[1] for q in p]
            want.append((k, (y << parts.BITS) + x, len(p), min(ys), min(xs), max(ys), max(xs)))
    assert got == sorted(want)


def test_holes_reach_no_border(spark, grids):
    sizes = spark.createDataFrame([(k, *g.shape) for k, g in grids.items()], "photo_id int, h int, w int")
    got = sorted((r["photo_id"], r["area"]) for r in parts.holes(pixels(spark, grids), sizes).collect())
    want, filled = [], {}
    for k, g in grids.items():
        if g.any():
            inner = [p for p in flood(~g, 0) if not any(y in (0, g.shape[0] - 1) or x in (0, g.shape[1] - 1) for y, x in p)]
            want += [(k, len(p)) for p in inner]
            filled[k] = (int(g.sum()), sum(map(len, inner)))
    assert got == sorted(want)
    scores = {r["photo_id"]: (r["n"], r["hole"], r["score"]) for r in parts.hole_scores(pixels(spark, grids), sizes).collect()}
    assert scores == {k: (n, h, 1.0 if n < 100 else n / (n + h)) for k, (n, h) in filled.items()}


def test_no_pixels(spark, grids):
    none = pixels(spark, {3: grids[3], 5: grids[5]}).limit(0)
    assert parts.parts(none).collect() == [] and parts.holes(none, spark.createDataFrame([(1, 2, 2)], "photo_id int, h int, w int")).collect() == []


def test_long_chains_take_few_rounds(spark):
    links = spark.createDataFrame([(1, k, k + 1) for k in range(3000)] + [(2, 3000 - k, 2999 - k) for k in range(0, 3000, 2)], "photo_id int, a long, b long")
    roots = parts.contracted(links)
    assert {(r["photo_id"], r["root"]) for r in roots.where("photo_id = 1").collect()} == {(1, 0)}
    assert all(r["root"] == (r["id"] - 1 if r["id"] % 2 == 0 else r["id"]) for r in roots.where("photo_id = 2").collect())
