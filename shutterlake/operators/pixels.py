"""Pixel aggregates as column expressions over rows (photo_id, y, x, b, g, r)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators import scoring


def luma() -> Column:
    return 0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("r")


def exposure(pixels: DataFrame) -> DataFrame:
    """``blown, crushed, span, score`` of each photo; one partial aggregation and exact percentiles."""
    g = F.rint(luma())
    m = pixels.groupBy("photo_id").agg(
        F.avg((g >= 250).cast("int")).alias("blown"), F.avg((g <= 5).cast("int")).alias("crushed"), F.percentile(g, F.array(F.lit(0.01), F.lit(0.99))).alias("p")
    ).select("photo_id", "blown", "crushed", (F.col("p")[1] - F.col("p")[0]).alias("span"))
    return m.withColumn("score", scoring.exposure_score(F.col("blown"), F.col("crushed"), F.col("span")))


def colour_cast(pixels: DataFrame) -> DataFrame:
    """``cast, score`` from channel means over all pixels; null and 0 for black photos."""
    m = pixels.groupBy("photo_id").agg(*[F.avg(c).alias(c) for c in "bgr"])
    grey = (F.col("b") + F.col("g") + F.col("r")) / 3
    cast = F.sqrt(sum((F.pow(F.col(c) / grey - 1, F.lit(2.0)) for c in "bgr"), F.lit(0.0)))
    out = m.select("photo_id", F.when(grey >= 1e-3, cast).alias("cast"))
    return out.withColumn("score", F.coalesce(F.least(F.lit(10.0), F.greatest(F.lit(0.0), 10 - 70 * F.col("cast"))), F.lit(0.0)))


def tonal(pixels: DataFrame) -> DataFrame:
    """``median, spread`` of luma: the measures of composition and anchors."""
    g = luma()
    return pixels.groupBy("photo_id").agg(F.percentile(g, F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("p")).select("photo_id", F.col("p")[1].alias("median"), (F.col("p")[2] - F.col("p")[0]).alias("spread"))


def bounding_boxes(pixels: DataFrame, inside: Column) -> DataFrame:
    """``area, x0, y0, x1, y1`` of the pixels inside; photos without any have no row."""
    return pixels.where(inside).groupBy("photo_id").agg(F.count(F.lit(1)).alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


def mask_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``iou`` of two masks given as rows (photo_id, y, x)."""
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), ["photo_id", "y", "x"], "full")
    return both.groupBy("photo_id").agg((F.count(F.col("in_a") + F.col("in_b")) / F.count(F.lit(1))).alias("iou"))
