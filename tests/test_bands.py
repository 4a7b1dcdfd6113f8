"""Masks that reach over bands of lines, and photos with their marks in one task."""

import numpy as np
import pytest
from test_catalog import DATA

from shutterlake import catalog
from shutterlake.operators import parts


def flooded(mask, reach):
    """Least (y, x) of each pixel's part, by walking."""
    label, steps = {}, [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy or dx) and (reach or not (dy and dx))]
    for start in zip(*np.nonzero(mask), strict=True):
        todo = [start] if start not in label else []
        while todo:
            p = todo.pop()
            if p not in label:
                label[p] = start
                todo += [q for dy, dx in steps if 0 <= (q := (p[0] + dy, p[1] + dx))[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]]
    return label


@pytest.mark.parametrize("reach", [0, 1])
def test_parts_go_on_from_band_to_band(spark, reach):
    r = np.random.default_rng(8)
    masks = {1: r.random((3 * parts.BAND + 5, 40)) < 0.55, 2: np.zeros((2 * parts.BAND + 2, 9), bool)}
    masks[2][:, 0] = masks[2][:, 4] = masks[2][parts.BAND, :5] = masks[2][-1, 4:] = masks[2][parts.BAND - 1, 8] = True
    px = [(k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    got = {(p.photo_id, p.part >> parts.BITS, p.part % (1 << parts.BITS)): p.area for p in parts.parts(spark.createDataFrame(px, "photo_id int, y int, x int"), reach).collect()}
    want = {}
    for k, m in masks.items():
        for y, x in flooded(m, reach).values():
            want[k, int(y), int(x)] = want.get((k, int(y), int(x)), 0) + 1
    assert got == want


def test_a_band_leaves_no_links(spark, monkeypatch):
    """Masks within a band need no round of contraction."""
    asked = []
    monkeypatch.setattr(parts, "contracted", lambda links, by: asked.append(links.count()))
    assert catalog.queries()["mask_parts"](spark, DATA).count() > 0
    assert asked == [0]


@pytest.mark.parametrize("name", ["photo_hash"])
def test_photos_share_a_task_with_their_marks(spark, name):
    plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    pixels = [line for line in plan.splitlines() if "Exchange" in line and ("place" in line or " y#" in line)]
    assert not pixels and "BroadcastExchange" not in plan
