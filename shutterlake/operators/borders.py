"""How far strips lie from an opening, and how long a mask's outline is, from runs and counts of pixels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators import parts
from shutterlake.session import settled

#: Fixed values, in 2**-16: a step along a line or column and one to a corner (0.955 and 1.3693), by which distances are usually taken from 3 x 3 pixels.
STEP, CORNER = 62587, 89738


def half_width(dy: Column, reach: Column, exact: bool = False) -> Column:
    """The most columns aside at which a pixel ``dy`` lines off is within ``reach``; null if none is. ``exact``: straight-line distance instead of steps."""
    if exact:
        return F.when(F.abs(dy) <= reach, F.floor(F.sqrt(reach * reach - dy * dy)))
    lines, left = F.abs(dy), F.shiftleft(reach.cast("long"), 16)
    beyond = lines + F.floor((left - lines * CORNER) / STEP)
    return F.when(left >= lines * CORNER, beyond).when(left >= lines * STEP, F.floor((left - lines * STEP) / (CORNER - STEP)))


def merged(intervals: DataFrame, by: str = "photo_id") -> DataFrame:
    """``by, y, x0, x1``: intervals of a line without overlaps."""
    line = Window.partitionBy(by, "y").orderBy("x0", "x1")
    rows = intervals.withColumn("_far", F.max("x1").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_g", F.sum(F.when(F.col("x0") > F.col("_far") + 1, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(by, "y", "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _cells(intervals: DataFrame, by: str) -> DataFrame:
    """Intervals cut at every ``parts.BUCKET`` columns, so that those of a line meet in one bucket only."""
    wide = intervals.select(by, "y", "x0", "x1", F.explode(F.sequence(F.floor(F.col("x0") / parts.BUCKET), F.floor(F.col("x1") / parts.BUCKET))).alias("_cell"))
    low = F.col("_cell") * parts.BUCKET
    return wide.select(by, "y", "_cell", F.greatest("x0", low).cast("int").alias("x0"), F.least(F.col("x1"), low + parts.BUCKET - 1).cast("int").alias("x1"))


def within_reach(strip: DataFrame, opening: DataFrame, sizes: DataFrame, *, share: float = 0.015, floor: int = 8, least_opening: int = 100, least_strip: int = 50, exact: bool = False, by: str = "photo_id") -> DataFrame:
    """Pixels of a strip (``by, y, x``) not farther than ``max(floor, share of the width)`` from the opening's nearest pixel.

    A photo whose opening has fewer than ``least_opening`` pixels, or whose strip fewer
    than ``least_strip``, keeps all of its strip.  ``sizes``: by, h, w; photos without a size
    have no pixels.  Repeated pixels count once.  Each run of the opening reaches an
    interval of each line near it, so no pixel meets a pixel.
    """
    pixels = strip.select(by, "y", "x").distinct()
    n = pixels.groupBy(by).agg(F.count(F.lit(1)).alias("_strip"))
    found = settled(parts.runs(opening, by), "openings")
    wide = found.groupBy(by).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_opening"))
    judged = n.join(wide, by, "left").withColumn("_cut", (F.coalesce("_opening", F.lit(0)) >= least_opening) & (F.col("_strip") >= least_strip))
    photos = settled(judged.join(sizes.select(by, F.col("w").alias("_w")), by).select(by, "_w", "_cut"), "photos")
    reach = F.greatest(F.lit(floor), F.floor(F.col("_w") * share).cast("int"))
    grown = found.join(photos.where("_cut"), by).withColumn("_reach", reach).withColumn("_dy", F.explode(F.sequence(-F.col("_reach"), F.col("_reach"))))
    aside = half_width(F.col("_dy"), F.col("_reach"), exact)
    grown = grown.withColumn("_k", aside).where("_k is not null").select(by, (F.col("y") + F.col("_dy")).alias("y"), F.greatest(F.col("x0") - F.col("_k"), F.lit(0)).alias("x0"), F.least(F.col("x1") + F.col("_k"), F.col("_w") - 1).alias("x1"))
    near = _cells(merged(grown.where("x0 <= x1"), by), by).select(by, "y", "_cell", F.col("x0").alias("_from"), F.col("x1").alias("_to"))
    kept = _cells(parts.runs(pixels.join(photos.where("_cut"), by, "left_semi"), by), by).join(near, [by, "y", "_cell"])
    kept = kept.select(by, "y", F.greatest("x0", "_from").alias("x0"), F.least("x1", "_to").alias("x1")).where("x0 <= x1")
    return kept.select(by, "y", F.explode(F.sequence("x0", "x1")).alias("x")).unionByName(pixels.join(photos.where("not _cut"), by, "left_semi"))


def outlines(mask: DataFrame, sizes: DataFrame, by: str = "photo_id") -> DataFrame:
    """``by, length``: the length of all outer outlines, through the middles of border pixels, corners joined; 0 for single pixels.

    Holes and what lies in them don't count.  Of each 2 x 2 pixels, two neighbours are a step,
    three a corner cut, two at opposite corners one there and one back.
    """
    pixels = mask.select(by, "y", "x").distinct()
    found = parts.runs(pixels, by)
    rest = settled(parts.labelled(parts.gaps(found, sizes.join(pixels.select(by).distinct(), by, "left_semi"), by), 0, by), "gaps")
    border = (F.col("y") == 0) | (F.col("x0") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x1") == F.col("w") - 1)
    outside = rest.join(sizes.select(by, "h", "w"), by).where(border).select(by, "part").distinct()
    holes = rest.join(outside, [by, "part"], "left_anti").select(by, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    full = pixels.select(by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).unionByName(holes.select(by, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")))
    corners = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << (dy * 2 + dx)).alias("bit")) for dy in (0, 1) for dx in (0, 1)])).alias("_o")
    squares = full.select(by, "y", "x", corners).groupBy(by, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x")).agg(F.sum("_o.bit").alias("_q"))
    q = F.col("_q")
    steps, cut, across = q.isin(3, 5, 10, 12), q.isin(7, 11, 13, 14), q.isin(6, 9)
    counted = squares.groupBy(by).agg(F.count_if(steps).alias("_s"), (F.count_if(cut) + 2 * F.count_if(across)).alias("_c"))
    return counted.select(by, (F.col("_s") + F.col("_c") * math.sqrt(2)).alias("length"))


def smoothness(mask: DataFrame, sizes: DataFrame, *, least: int = 100, by: str = "photo_id") -> DataFrame:
    """``by, length, score`` from 0 to 1: how near outlines come to the shortest around the mask's pixels; 1 for masks of fewer than ``least``."""
    n = mask.select(by, "y", "x").distinct().groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    ratio = F.col("length") * F.col("length") / (4 * math.pi * F.col("_n"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (ratio - 2) / 20))
    return n.join(outlines(mask, sizes, by), by, "left").select(by, "length", F.when(F.col("_n") < least, 1.0).otherwise(score).alias("score"))
