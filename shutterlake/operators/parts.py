"""Connected parts and holes of masks, from runs of pixels.

A mask is rows (photo_id, y, x).  Pixels of a line become runs; a run meets those of
the line above that it touches.  Bands of lines are labelled each in a task; only links
that lead from band to band are left, and parts are found by contracting these: each round
hooks every run to its least neighbour, doubles the hooks until they end and keeps
only the links between the ends, at most half as many.  All photos are worked on at once; a photo's lines may lie in many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.session import settled

#: A run's id is its first pixel: the line, shifted by so many bits, and the column.
BITS = 24
#: Columns of a bucket within which runs of two lines are joined.
BUCKET = 128
#: Lines of a band that is labelled in one task.
BAND = 64


def runs(mask: DataFrame, by: str = "photo_id") -> DataFrame:
    """``by, y, x0, x1``: stretches of neighbouring pixels of a line. Repeated pixels count once."""
    line = Window.partitionBy(by, "y").orderBy("x")
    placed = mask.select(by, "y", "x").repartition(by, "y").distinct().withColumn("_g", F.col("x") - F.row_number().over(line))
    return placed.groupBy(by, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def gaps(found: DataFrame, sizes: DataFrame, by: str = "photo_id") -> DataFrame:
    """``by, y, x0, x1``: the runs of what is not in the mask; ``sizes`` has ``by, h, w``."""
    line = Window.partitionBy(by, "y").orderBy("x0")
    lines = sizes.select(by, "w", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    rows = lines.join(found, [by, "y"], "left").withColumn("_next", F.lead("x0").over(line)).withColumn("_first", F.row_number().over(line) == 1)
    before = F.struct(F.lit(0).alias("x0"), (F.coalesce("x0", "w") - 1).alias("x1"), F.col("_first").alias("ok"))
    after = F.struct((F.col("x1") + 1).alias("x0"), (F.coalesce("_next", "w") - 1).alias("x1"), F.col("x1").isNotNull().alias("ok"))
    return rows.select(by, "y", F.explode(F.array(before, after)).alias("_s")).where("_s.ok and _s.x0 <= _s.x1").select(by, "y", F.col("_s.x0").alias("x0"), F.col("_s.x1").alias("x1"))


def run_id() -> Column:
    return F.shiftleft(F.col("y").cast("long"), BITS) + F.col("x0")


def touching(found: DataFrame, reach: int, by: str = "photo_id", name: Column | None = None) -> DataFrame:
    """``by, a, b``: ids of runs of neighbouring lines that touch, or what ``name`` calls them; ``reach`` 1 counts corners, 0 doesn't."""
    cells = F.explode(F.sequence(F.floor(F.greatest(F.col("x0") - reach, F.lit(0)) / BUCKET), F.floor((F.col("x1") + reach) / BUCKET))).alias("_cell")
    rows = found.select(by, "y", "x0", "x1", (run_id() if name is None else name).alias("_id"), cells)
    low = rows.select(by, F.col("y").alias("_y"), F.col("x0").alias("_from"), F.col("x1").alias("_to"), F.col("_id").alias("a"), "_cell").withColumn("y", F.col("_y") + 1)
    start = F.greatest(F.col("_from") - reach, F.col("x0"))
    # Of the cells that both lie in, the one where they begin to touch.
    meets = (start <= F.least(F.col("_to") + reach, F.col("x1"))) & (F.floor(start / BUCKET) == F.col("_cell"))
    return rows.join(low, [by, "y", "_cell"]).where(meets).select(by, "a", F.col("_id").alias("b"))


def contracted(links: DataFrame, by: str = "photo_id") -> DataFrame | None:
    """``by, id, root``: the least id that links lead to, for each id with a link; None without links.

    Ids are compared within ``by``.  ``links``: by, a, b.
    """
    maps = []
    links = settled(links.where("a <> b").distinct())
    while not links.isEmpty():
        both = links.unionByName(links.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = settled(both.groupBy(by, F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
        while not (longer := _followed(hooks, hooks, by)).where("_moved").isEmpty():
            hooks = settled(longer.drop("_moved"))
        maps.append(hooks)
        ends = lambda c, hooks=hooks: hooks.select(by, F.col("id").alias(c), F.col("root").alias(f"_{c}"))
        left = links.join(ends("a"), [by, "a"]).join(ends("b"), [by, "b"]).where("_a <> _b")
        links = settled(left.select(by, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    found = None
    for hooks in reversed(maps):
        found = hooks if found is None else _followed(hooks, found, by).drop("_moved")
    return found


def _followed(hooks: DataFrame, onward: DataFrame, by: str) -> DataFrame:
    on = onward.select(by, F.col("id").alias("root"), F.col("root").alias("_next"))
    moved = F.coalesce(F.col("_next") != F.col("root"), F.lit(False)).alias("_moved")
    return hooks.join(on, [by, "root"], "left").select(by, "id", F.coalesce("_next", "root").alias("root"), moved)


def labelled(found: DataFrame, reach: int = 1, by: str = "photo_id") -> DataFrame:
    """Runs with their ``part``: the id of its first run (line, then column)."""
    kinds = dict(found.dtypes)
    runs_of = found.select(by, "y", "x0", "x1", F.floor(F.col("y") / BAND).alias("_band"))
    schema = ", ".join(f"{c} {kinds[c]}" for c in (by, "y", "x0", "x1")) + ", id long"
    rows = settled(runs_of.groupBy(by, "_band").applyInArrow(lambda band: _labelled_band(band, reach), schema), "bands")
    last, first = F.col("y") % BAND == BAND - 1, F.col("y") % BAND == 0
    # Between two lines of a band nothing is left to link: of the pairs that touch, those from a last line to a first one are.
    links = touching(rows.where(last | first), reach, by, F.struct("id", first.alias("first")))
    links = links.where("b.first and not a.first").select(by, F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    roots = contracted(links, by)
    if roots is None:
        return rows.withColumnRenamed("id", "part")
    return rows.join(roots, [by, "id"], "left").withColumn("part", F.coalesce("root", "id")).drop("id", "root")


def _labelled_band(band: pa.Table, reach: int) -> pa.Table:
    """Runs of a band with ``id``: that of the first run they hang together with."""
    band = band.drop_columns("_band").sort_by([("y", "ascending"), ("x0", "ascending")])
    y, x0, x1 = (band.column(c).to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
    # Lines one behind the other: a run's partners on the next line are neighbours there.
    width = x1.max() + 2 * reach + 3
    begin, behind = (y + 1) * width + x0 - reach, (y + 1) * width + x1 + reach
    low, high = np.searchsorted(y * width + x1, begin), np.searchsorted(y * width + x0, behind, "right")
    n = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    label = np.arange(len(y))
    while True:
        # Roots hook to the least root they touch, then all follow their roots.
        least, hooked = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(hooked, label[a], least)
        np.minimum.at(hooked, label[b], least)
        while not np.array_equal(onward := hooked[hooked], hooked):
            hooked = onward
        if np.array_equal(hooked, label):
            return band.append_column("id", pa.array((y[label] << BITS) + x0[label]))
        label = hooked


def parts(mask: DataFrame, reach: int = 1, by: str = "photo_id") -> DataFrame:
    """``by, part, area, y0, x0, y1, x1`` of each connected part of a mask; corners connect unless ``reach`` is 0. No pixels give none."""
    rows = labelled(runs(mask, by), reach, by)
    return rows.groupBy(by, "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("y").alias("y0"), F.min("x0").alias("x0"), F.max("y").alias("y1"), F.max("x1").alias("x1"))


def holes(mask: DataFrame, sizes: DataFrame, by: str = "photo_id") -> DataFrame:
    """``by, part, area`` of each hole: a part of the rest, without corners, that reaches no border. ``sizes``: by, h, w."""
    rest = labelled(gaps(runs(mask, by), sizes.join(mask.select(by).distinct(), by, "left_semi"), by), 0, by)
    outer = (F.col("y") == 0) | (F.col("x0") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x1") == F.col("w") - 1)
    return rest.join(sizes.select(by, "h", "w"), by).groupBy(by, "part").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.max(outer).alias("_outer")).where(~F.col("_outer")).drop("_outer")


def hole_scores(mask: DataFrame, sizes: DataFrame, *, least: int = 100, by: str = "photo_id") -> DataFrame:
    """``by, n, hole, score``: pixels of a mask and of its holes, and the mask's share of both; 1 for masks of fewer than ``least`` pixels."""
    n = mask.select(by, "y", "x").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    h = holes(mask, sizes, by).groupBy(by).agg(F.sum("area").alias("hole"))
    rows = n.join(h, by, "left").withColumn("hole", F.coalesce("hole", F.lit(0)))
    return rows.withColumn("score", F.when(F.col("n") < least, 1.0).otherwise(F.col("n") / (F.col("n") + F.col("hole"))))
