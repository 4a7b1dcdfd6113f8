"""Edges with hysteresis and straight lines by votes, from pixel rows (photo_id, y, x).

Gradients and ridges are windows over lines and columns of pixels.  Weak edges are kept
where strong ones reach them, which is a question of connected parts.  A photo's edge pixels
go to one task, where they vote for the angle and offset of lines; peaks are looked for again
among the pixels, and gaps cut them into segments.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators import parts
from shutterlake.session import settled

#: Tangents of 22.5 and 67.5 degrees in 2**-15, between which a gradient is diagonal.
LOW_SLOPE, HIGH_SLOPE = 13573, 13573 + (1 << 16)
#: Pixels or lines of a photo that are worked on at once.
SLICE = 1 << 12
#: Angles and offsets around a line within which no other has more votes.
ANGLE_REACH, OFFSET_REACH = 8, 6


def _along(c: str):
    """Pixels of a line (x) or of a column (y) in order."""
    return Window.partitionBy("photo_id", "y" if c == "x" else "x").orderBy(c)


def _around(c: str, along: str, outside: Column | None = None) -> tuple[Column, Column]:
    """Values before and after; beyond the border the pixel's own, or ``outside``."""
    other, w = F.col(c) if outside is None else outside, _along(along)
    return F.coalesce(F.lag(c).over(w), other), F.coalesce(F.lead(c).over(w), other)


def gradients(pixels: DataFrame, value: Column) -> DataFrame:
    """``photo_id, y, x, gx, gy, size``: differences of 3 x 3 pixels (1, 2, 1 across) and the sum of their sizes. Photos are whole rectangles."""
    rows = pixels.select("photo_id", "y", "x", value.cast("long").alias("_v"))
    before, after = _around("_v", "x")
    rows = rows.withColumn("_d", after - before).withColumn("_s", before + 2 * F.col("_v") + after)
    (d0, d1), (s0, s1) = _around("_d", "y"), _around("_s", "y")
    rows = rows.withColumn("gx", d0 + 2 * F.col("_d") + d1).withColumn("gy", s1 - s0)
    return rows.select("photo_id", "y", "x", "gx", "gy", (F.abs("gx") + F.abs("gy")).alias("size"))


def ridges(slopes: DataFrame, least: float) -> DataFrame:
    """``photo_id, y, x, size`` of pixels above ``least`` that are largest along their gradient."""
    zero = F.lit(0).cast("long")
    left, right = _around("size", "x", zero)
    rows = slopes.withColumn("_l", left).withColumn("_r", right)
    (u, d), (ul, dl), (ur, dr) = (_around(c, "y", zero) for c in ("size", "_l", "_r"))
    rows = rows.withColumns({"_u": u, "_d": d, "_ul": ul, "_dl": dl, "_ur": ur, "_dr": dr})
    m, gx, gy = F.col("size"), F.abs("gx"), F.abs("gy")
    flat, steep = gy * 32768 < gx * LOW_SLOPE, gy * 32768 > gx * HIGH_SLOPE
    falling = (F.col("gx") < 0) != (F.col("gy") < 0)
    top = F.when(flat, (m > F.col("_l")) & (m >= F.col("_r"))).when(steep, (m > F.col("_u")) & (m >= F.col("_d")))
    top = top.when(falling, (m > F.col("_ur")) & (m > F.col("_dl"))).otherwise((m > F.col("_ul")) & (m > F.col("_dr")))
    return rows.where((m > least) & top).select("photo_id", "y", "x", "size")


def edges(pixels: DataFrame, value: Column, low: float, high: float) -> DataFrame:
    """``photo_id, y, x`` of edge pixels: ridges above ``high``, and those above ``low`` that hang together with one, corners included."""
    found = settled(ridges(gradients(pixels, value), low), "ridges")
    runs = settled(parts.labelled(parts.runs(found), 1), "runs")
    strong = found.where(F.col("size") > high).select("photo_id", "y", F.col("x").alias("_x"))
    kept = runs.join(strong.hint("merge"), ["photo_id", "y"]).where(F.col("_x").between(F.col("x0"), F.col("x1"))).select("photo_id", "part").distinct()
    return runs.join(kept, ["photo_id", "part"], "left_semi").select("photo_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def grown(mask: DataFrame, sizes: DataFrame, reach: int = 1) -> DataFrame:
    """Pixels within ``reach`` lines and columns of a mask, inside the photo (``photo_id, h, w``)."""
    steps = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    wide = mask.select("photo_id", "y", steps("x").alias("x")).select("photo_id", steps("y").alias("y"), "x").distinct()
    return wide.join(sizes.hint("shuffle_hash"), "photo_id").where((F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("h")) & (F.col("x") < F.col("w"))).select("photo_id", "y", "x")


def alignment(mask: DataFrame, found: DataFrame, sizes: DataFrame, *, band: int = 8, least: int = 100) -> DataFrame:
    """``photo_id, score``: the share of a mask's border that lies within ``band`` pixels (a disc) of an edge; 1 for small masks.

    The border is where the mask, grown by a pixel, differs from the mask shrunk by one.
    """
    mask = mask.select("photo_id", "y", "x").distinct()
    pixel = ["photo_id", "y", "x"]
    # Beyond the photo's border nothing shrinks a mask.
    missing = grown(mask, sizes).join(mask.hint("merge"), pixel, "left_anti")
    border = missing.unionByName(grown(missing, sizes).join(mask.hint("merge"), pixel, "left_semi")).distinct()
    disc = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in range(-band, band + 1) for dx in range(-band, band + 1) if dy * dy + dx * dx <= band * band])
    near = found.select("photo_id", "y", "x", F.explode(disc).alias("_o")).select("photo_id", (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct().withColumn("_near", F.lit(1))
    met = border.join(near.hint("merge"), pixel, "left").groupBy("photo_id").agg(F.avg(F.coalesce("_near", F.lit(0))).alias("_share"))
    n = mask.groupBy("photo_id").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(met, "photo_id", "left").select("photo_id", F.when((F.col("_n") < least) | F.col("_share").isNull(), 1.0).otherwise(F.col("_share")).alias("score"))


# --- lines ------------------------------------------------------------------------------


def votes(found: DataFrame, angles: int) -> DataFrame:
    """``photo_id, angle, offset, n``: how many edge pixels lie on each line. Angle a of ``angles`` is the normal's, a / angles of a half turn."""
    kind = dict(found.dtypes)["photo_id"]

    def count(photo: pa.Table) -> pa.Table:
        return _table(photo, dict(zip(("angle", "offset", "n"), voted(*_pixels(photo), angles), strict=True)))

    return found.select("photo_id", "y", "x").groupBy("photo_id").applyInArrow(count, f"photo_id {kind}, angle int, offset int, n long")


def voted(y: np.ndarray, x: np.ndarray, angles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Angles, offsets and votes of the lines that some of a photo's pixels lie on."""
    turn = np.arange(angles) * (math.pi / angles)
    far = math.ceil(math.hypot(np.abs(y).max(), np.abs(x).max())) + 1
    n = np.zeros(angles * (2 * far + 1), np.int64)
    for at in range(0, len(y), SLICE):
        # Nine digits settle half-way values.
        offset = np.rint(np.round(np.outer(np.cos(turn), x[at : at + SLICE]) + np.outer(np.sin(turn), y[at : at + SLICE]), 9)).astype(np.int64)
        n += np.bincount((offset + far + np.arange(angles)[:, None] * (2 * far + 1)).ravel(), minlength=len(n))
    found = np.flatnonzero(n)
    return found // (2 * far + 1), found % (2 * far + 1) - far, n[found]


def peaks(counted: DataFrame, least: int, angles: int, *, angle_reach: int = ANGLE_REACH, offset_reach: int = OFFSET_REACH) -> DataFrame:
    """Lines with ``least`` votes that none around them beats; ties go to the smaller angle, then offset.

    Half a turn on, a line has the negative offset, so the neighbourhood goes round.
    """
    kind = dict(counted.dtypes)["photo_id"]

    def best(photo: pa.Table) -> pa.Table:
        columns = {c: photo.column(c).to_numpy() for c in ("angle", "offset", "n")}
        top = unbeaten(*columns.values(), angles, angle_reach, offset_reach)
        return _table(photo, {c: v[top] for c, v in columns.items()})

    return counted.select("photo_id", "angle", "offset", "n").where(F.col("n") >= least).groupBy("photo_id").applyInArrow(best, f"photo_id {kind}, angle int, offset int, n long")


def unbeaten(angle: np.ndarray, offset: np.ndarray, n: np.ndarray, angles: int, angle_reach: int, offset_reach: int) -> np.ndarray:
    """Places of the lines that none around them beats."""
    rank = np.empty(len(n), np.int64)
    rank[np.lexsort((-offset, -angle, n))] = np.arange(len(n))
    top = np.ones(len(n), bool)
    for at in range(0, len(n), SLICE):
        part = slice(at, at + SLICE)
        apart = np.abs(angle[part, None] - angle)
        near = (apart <= angle_reach) & (np.abs(offset[part, None] - offset) <= offset_reach)
        near |= (apart >= angles - angle_reach) & (np.abs(offset[part, None] + offset) <= offset_reach)
        top[part] = ~(near & (rank > rank[part, None])).any(1)
    return np.flatnonzero(top)


def lines(found: DataFrame, *, votes_least: int = 120, length: float = 120, gap: float = 15, angles: int = 360) -> DataFrame:
    """``photo_id, x1, y1, x2, y2``: segments along lines of edge pixels with enough votes, at least ``length`` long, without gaps above ``gap``.

    Pixels within one of a peak's line belong to it.  A photo's edge pixels are in one task; votes are never rows.
    """
    kinds = dict(found.dtypes)

    def segments(photo: pa.Table) -> pa.Table:
        y, x = _pixels(photo)
        angle, offset, n = (v for v in voted(y, x, angles))
        strong = n >= votes_least
        angle, offset, n = angle[strong], offset[strong], n[strong]
        ends = [np.zeros((0, 4), np.int64)]
        for k in unbeaten(angle, offset, n, angles, ANGLE_REACH, OFFSET_REACH):
            turn = angle[k] * (math.pi / angles)
            near = np.abs(x * math.cos(turn) + y * math.sin(turn) - offset[k]) <= 1.0
            px, py = x[near], y[near]
            t = py * math.cos(turn) - px * math.sin(turn)
            order = np.lexsort((px, py, t))
            px, py, t = px[order], py[order], t[order]
            first = np.flatnonzero(np.r_[True, np.diff(t) > gap])
            last = np.r_[first[1:], len(t)] - 1
            # Of pixels beside each other at a segment's begin, the last.
            begin = np.searchsorted(t, t[first], "right") - 1
            long = t[last] - t[first] >= length
            ends.append(np.stack([px[begin], py[begin], px[last], py[last]], 1)[long])
        return _table(photo, dict(zip(("x1", "y1", "x2", "y2"), np.concatenate(ends).T, strict=True)), {"x1": "x", "y1": "y", "x2": "x", "y2": "y"})

    schema = f"photo_id {kinds['photo_id']}, x1 {kinds['x']}, y1 {kinds['y']}, x2 {kinds['x']}, y2 {kinds['y']}"
    return found.select("photo_id", "y", "x").groupBy("photo_id").applyInArrow(segments, schema)


def _pixels(photo: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(photo.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))


def _table(photo: pa.Table, columns: dict[str, np.ndarray], like: dict[str, str] | None = None) -> pa.Table:
    """Rows of one photo; columns have the type of another if ``like`` names one."""
    wide = {"n": pa.int64()} | {c: photo.schema.field(k).type for c, k in (like or {}).items()}
    n = len(next(iter(columns.values())))
    ids = photo.column("photo_id").take(pa.array(np.zeros(n, np.int64)))
    return pa.table([ids, *[pa.array(v, wide.get(c, pa.int32())) for c, v in columns.items()]], names=["photo_id", *columns])
