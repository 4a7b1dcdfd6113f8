"""Robust statistics and comparisons of measures, as aggregates and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median(c: Column | str) -> Column:
    return F.percentile(c, 0.5)


def exact_mean(value: Column) -> Column:
    """Aggregate: the mean of doubles from a decimal sum, the same in whatever order and tasks rows come, so equal means are equal.

    Groups with a value that 12 places before and after the point don't hold (or one that isn't finite) take the sum of doubles.
    """
    held = value.try_cast("decimal(24,12)")
    return F.when(F.bool_and(F.coalesce(held.cast("double") == value, value.isNull())), F.avg(held).cast("double")).otherwise(F.avg(value))


def median_deviation(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``median, mad`` of each group, both exact: the second pass joins the first's row a group."""
    mid = rows.groupBy(*keys).agg(median(value).alias("median"))
    return rows.join(mid, keys).groupBy(*keys).agg(F.max("median").alias("median"), median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def circular_mean(degrees: Column) -> Column:
    """Aggregate; in [0, 360)."""
    angle = F.degrees(F.atan2(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees)))))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def z_scores(rows: DataFrame, keys: list[str], value: str, least: float = 1e-6) -> DataFrame:
    """``z`` of each row within its group, by population deviation; rows without a group have none.

    Groups are aggregated map-side and joined back, so that a large one stays spread.
    """
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_dev"))
    return rows.join(stats, keys, "left").withColumn("z", (F.col(value) - F.col("_mean")) / (F.col("_dev") + least)).drop("_mean", "_dev")


def histogram(rows: DataFrame, value: str, low: float, high: float, bins: int, *keys: str) -> DataFrame:
    """``bin, n, share``; the upper border lies in the last bin, values outside in none."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).between(low, high)).groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys)) if keys else None
    if total is None:
        sums = counts.agg(F.sum("n").alias("total"))
        return counts.join(F.broadcast(sums), F.lit(True)).select("bin", "n", (F.col("n") / F.col("total")).alias("share"))
    return counts.select(*keys, "bin", "n", (F.col("n") / total).alias("share"))


def anchor(rows: DataFrame, keys: list[str], channels: list[str], least: int = 50) -> DataFrame:
    """Median of medians: each group with enough rows gives its medians, and all groups give theirs; ``samples`` counts groups."""
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[median(c).alias(c) for c in channels]).where(F.col("_n") >= least)
    return groups.agg(*[median(c).alias(f"{c}_anchor") for c in channels], F.count(F.lit(1)).alias("samples"))


def anchor_shift(current: Column, target: Column, strength: float = 0.6, most: float = 14.0) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(-most), (target - current) * strength))


def systematic_sample(rows: DataFrame, group: str, order: str, most: int = 24) -> DataFrame:
    """Every (n // most)-th row of a group in order, the first ``most`` of them."""
    w = Window.partitionBy(group)
    i = F.row_number().over(w.orderBy(order)) - 1
    numbered = rows.withColumn("_i", i).withColumn("_step", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / most)).cast("int"))
    return numbered.where((F.col("_i") % F.col("_step") == 0) & (F.col("_i") / F.col("_step") < most)).drop("_i", "_step")


def match_moments(rows: DataFrame, key: str, value: str, reference, tiny: float = 1e-6) -> DataFrame:
    """``matched``: each group's values moved to the mean and deviation of the reference group."""
    own = rows.groupBy(key).agg(F.avg(value).alias("_m"), (F.stddev_pop(value) + tiny).alias("_s"))
    ref = own.where(F.col(key) == F.lit(reference)).select(F.col("_m").alias("_rm"), F.col("_s").alias("_rs"))
    stats = own.join(F.broadcast(ref), F.lit(True))
    moved = (F.col(value) - F.col("_m")) * (F.col("_rs") / F.col("_s")) + F.col("_rm")
    return rows.join(stats, key).withColumn("matched", F.when(F.col(key) == F.lit(reference), F.col(value)).otherwise(moved)).drop("_m", "_s", "_rm", "_rs")


def psnr(mse: Column, peak: float = 255.0) -> Column:
    """Decibels; infinite for equal inputs."""
    return F.when(mse == 0, F.lit(math.inf)).otherwise(20 * F.log10(peak / F.sqrt(mse)))


def pair_metrics(a: Column, b: Column, peak: float = 1.0) -> dict[str, Column]:
    """mse, mae, psnr and global ssim of two arrays of equal length."""
    n = F.size(a).cast("double")

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def mean(x):
        return total(F.transform(x, lambda v: v.cast("double"))) / n

    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    mse = total(F.transform(gaps, lambda d: d * d)) / n
    ma, mb = mean(a), mean(b)
    va = total(F.transform(a, lambda v: v.cast("double") * v.cast("double"))) / n - ma * ma
    vb = total(F.transform(b, lambda v: v.cast("double") * v.cast("double"))) / n - mb * mb
    cov = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))) / n - ma * mb
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ssim = (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))
    return {"mse": mse, "mae": total(F.transform(gaps, F.abs)) / n, "psnr": psnr(mse, peak), "ssim": ssim}


def array_quality(a: Column, b: Column) -> dict[str, Column]:
    """max_diff and the ratio of different values of two arrays of equal length; ``pair_metrics`` has the rest."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return {"max_diff": F.array_max(gaps), "different": F.size(F.filter(gaps, lambda d: d > 0)) / F.size(a)}


def quality_summary(pairs: DataFrame, *, key: str, max_pairs: int | None = None) -> DataFrame:
    """Means of psnr and ssim over pairs without an error, their number and that of failures; the first ``max_pairs`` by key if given."""
    rows = pairs if max_pairs is None else pairs.orderBy(key).limit(max_pairs)
    good = F.col("error").isNull()
    return rows.agg(F.avg(F.when(good, F.col("psnr"))).alias("psnr_mean"), F.avg(F.when(good, F.col("ssim"))).alias("ssim_mean"), F.count_if(good).alias("n"), F.count_if(~good).alias("failures"))


def lab_anchor(pixels: DataFrame, least: int = 50) -> DataFrame:
    """``l, a, b`` medians of a photo's mid-tones (50 < L < 220), ``n`` of these, and ``hue``, the mean weighted by saturation.

    ``pixels``: photo_id, l, a, b, hue, saturation.  Photos with fewer mid-tones than ``least`` have no row.
    """
    mid = (F.col("l") > 50) & (F.col("l") < 220)
    weight = F.col("saturation") + 1
    m = pixels.groupBy("photo_id").agg(F.count_if(mid).alias("n"), *[median(F.when(mid, F.col(c))).alias(c) for c in ("l", "a", "b")], (F.sum(F.col("hue") * weight) / F.sum(weight)).alias("hue"))
    return m.where(F.col("n") >= least)


def lab_shift(photos: DataFrame, target: DataFrame, strength: float = 0.6, most: float = 14.0) -> DataFrame:
    """``shift_a, shift_b`` of each photo towards the medians of all (one row ``a, b``); 0 where both are below 0.4 or mid-tones are few."""
    rows = photos.join(F.broadcast(target.select(F.col("a").alias("_a"), F.col("b").alias("_b"))), F.lit(True))
    moves = {c: anchor_shift(F.col(c), F.col(f"_{c}"), strength, most) for c in "ab"}
    skip = (F.col("n") < 100) | ((F.abs(moves["a"]) < 0.4) & (F.abs(moves["b"]) < 0.4))
    return rows.select("photo_id", *[F.when(skip, 0.0).otherwise(v).alias(f"shift_{c}") for c, v in moves.items()])
