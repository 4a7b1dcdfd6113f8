"""Scores, grades, verdicts and rules. Constants are the fixed values of the measures they name."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the nine quality categories.
QC_WEIGHTS = {
    "exposure": 1.30, "white_balance": 1.20, "sharpness": 1.20, "color_richness": 1.00, "vertical_alignment": 0.90,
    "halo": 1.10, "sky_quality": 0.90, "noise": 0.80, "composition": 0.80,
}
#: Least score of each grade.
GRADES = (("S", 9.3), ("A", 8.5), ("B", 7.5), ("C", 6.5))
#: Share of the frame that a mask class may cover.
COVERAGE = {
    "wall": (0.20, 0.75), "floor": (0.03, 0.40), "ceiling": (0.02, 0.30), "window": (0.0, 0.40), "door": (0.0, 0.30),
    "opening": (0.0, 0.40), "crown": (0.0, 0.05), "baseboard": (0.0, 0.05), "casing": (0.0, 0.08), "light": (0.0, 0.10),
}
#: Weights of mask metrics and of mask classes.
MASK_METRICS = {"coverage_sanity": 0.20, "boundary_smoothness": 0.15, "no_orphan_blobs": 0.15, "edge_alignment": 0.25, "hole_rate": 0.15, "soft_alpha_quality": 0.10}
MASK_CLASSES = {"wall": 1.5, "floor": 1.2, "ceiling": 1.0, "window": 1.3, "door": 1.0, "opening": 1.3, "crown": 0.5, "baseboard": 0.5, "casing": 0.7, "light": 0.3}
#: The review's questions and procedure checks.
QUESTIONS = {"halo_window_corners": 0.30, "ceiling_neutrality": 0.25, "move_in_feel": 0.45}
PROCEDURE = {"verticals": 0.15, "lens_residual": 0.10, "sharpness_uniformity": 0.20, "shadow_noise": 0.20, "consistency": 0.35}
NEUTRAL = 7.5


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate; weights that aren't positive don't count, 0.0 where none is."""
    w = F.when(weight > 0, weight)
    return F.coalesce(F.sum(value * w) / F.sum(F.when(value.isNotNull(), w)), F.lit(0.0))


def grade(score: Column) -> Column:
    out = F.lit("D")
    for name, least in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def verdict(score: Column, passes: float, reviews: float) -> Column:
    return F.when(score >= passes, "pass").when(score >= reviews, "review").otherwise("fail")


def scorecard(scores: DataFrame, key: str, weights: dict[str, float] = QC_WEIGHTS, weak_below: float = 8.0) -> DataFrame:
    """``overall, grade, weak``: rows (key, category, score, applicable) become a row a key.

    The grade is taken before rounding; weak categories come lowest first.
    """
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("category") == name, F.lit(w)).otherwise(weight)
    use = F.when(F.col("applicable") & F.col("score").isNotNull(), weight)
    weak = F.collect_list(F.when(F.col("applicable") & (F.col("score") < weak_below), F.struct("score", "category")))
    out = scores.groupBy(key).agg(weighted_mean(F.col("score"), use).alias("_overall"), weak.alias("_weak"))
    return out.select(key, F.bround("_overall", 2).alias("overall"), grade(F.col("_overall")).alias("grade"), F.array_join(F.transform(F.slice(F.sort_array("_weak"), 1, 3), lambda x: x["category"]), ",").alias("weak"))


def rolled_back(before: Column, after: Column, slack: float = 0.5) -> Column:
    return after + slack < before


def coverage_score(name: Column, share: Column) -> Column:
    """1 inside the class's range, falling in proportion below it and half as fast above; unknown classes score 1."""
    out = F.lit(1.0)
    for k, (low, high) in COVERAGE.items():
        below = share / max(low, 0.01) if low else F.lit(1.0)
        inside = F.when(share < low, below).when(share > high, F.greatest(F.lit(0.0), 1.0 - 0.5 * (share - high) / max(high, 0.01))).otherwise(1.0)
        out = F.when(name == k, inside).otherwise(out)
    return out


def mask_report(masks: DataFrame, key: str, name: str = "class", overlaps: DataFrame | None = None) -> DataFrame:
    """Overall of each photo's masks: a weighted mean with a denominator of at least 1, less the sum of overlaps above 0.05.

    ``overlaps``: rows (key, iou), one for each pair of a photo's masks that should exclude each other.
    """
    score = sum((F.col(m) * w for m, w in MASK_METRICS.items()), F.lit(0.0))
    weight = F.lit(1.0)
    for k, w in MASK_CLASSES.items():
        weight = F.when(F.col(name) == k, F.lit(w)).otherwise(weight)
    found = masks.groupBy(key).agg((F.sum(score * weight) / F.greatest(F.lit(1.0), F.sum(weight))).alias("_score"))
    if overlaps is None:
        found = found.withColumn("_lost", F.lit(0.0))
    else:
        found = found.join(overlaps.where("iou > 0.05").groupBy(key).agg(F.sum("iou").alias("_lost")), key, "left")
    overall = F.greatest(F.lit(0.0), F.col("_score") - F.coalesce("_lost", F.lit(0.0)))
    return found.select(key, overall.alias("overall")).withColumn("verdict", verdict(F.col("overall"), 0.85, 0.65))


def review(rows: DataFrame) -> DataFrame:
    """``overall, verdict, findings`` from a column for each question and check."""
    # Decimal weights: what is decimal itself is weighted exactly, so sums at a verdict's border come out as written.
    weighed = lambda weights: sum((F.col(k) * F.lit(Decimal(str(w))) for k, w in weights.items()), F.lit(Decimal(0)))
    overall = 0.55 * weighed(QUESTIONS) + 0.45 * weighed(PROCEDURE)
    least = {**dict.fromkeys(QUESTIONS, 0.7), "verticals": 0.7, "sharpness_uniformity": 0.65, "shadow_noise": 0.65, "consistency": 0.55}
    findings = F.concat_ws(",", *[F.when(F.col(k) < v, k) for k, v in least.items()])
    return rows.withColumn("overall", overall).withColumn("verdict", verdict(F.col("overall"), 0.78, 0.55)).withColumn("findings", findings)


#: Weight, tolerance and slope of each clipped share in an exposure's score.
CLIPPING = {"blown": (0.4, 0.005, 60.0), "crushed": (0.3, 0.02, 35.0)}


def exposure_score(blown: Column, crushed: Column, span: Column) -> Column:
    """Two shares that cost points beyond their tolerance, and three steps of tonal span; 0..10."""
    total = 0.3 * F.when(span >= 200, 10.0).when(span >= 160, 7.0).otherwise(5.5)
    for share, (weight, tolerance, slope) in zip((blown, crushed), CLIPPING.values(), strict=True):
        over = F.greatest(share - tolerance, F.lit(0.0))
        total = total + weight * F.greatest(10.0 - slope * over, F.lit(0.0))
    return F.greatest(F.least(total, F.lit(10.0)), F.lit(0.0))


def preflight(blur: Column, high: Column, low: Column, luma: Column) -> Column:
    """Worst of the severities of four measures: 0 ok, 1 info, 2 warn, 3 fail; ``decisions.preflight`` takes all."""
    return F.greatest(
        F.when(blur < 60, 3).when(blur < 150, 2).otherwise(0), F.when(high >= 18, 3).when(high >= 8, 2).otherwise(0),
        F.when(low >= 25, 3).when(low >= 12, 2).otherwise(0), F.when(luma < 35, 3).when(luma < 60, 1).when(luma > 220, 2).otherwise(0),
    )


def hero_score(sharpness: Column, pixels: Column, mean: Column, blown: Column, exterior: Column) -> Column:
    size = F.least(F.lit(1.0), pixels / (1920 * 1080))
    exposure = F.greatest(1.0 - F.abs(mean - 130) / 130, F.lit(0.1))
    return sharpness * size * exposure * (1.0 + F.least(blown * 12.0, F.lit(1.5))) * (1.0 + F.least(exterior * 8.0, F.lit(1.5)))


def delivery_outcome(status: Column) -> Column:
    """Of one attempt: 2xx ends well, 4xx but 408 and 429 gives up, all else is tried again."""
    return F.when(status.between(200, 299), "delivered").when(status.between(400, 499) & ~status.isin(408, 429), "gave_up").otherwise("retry")


def final_outcome(attempts: DataFrame, key: str, number: str, status: str, most: int = 6) -> DataFrame:
    """``outcome, attempts`` of each delivery: the first attempt that ends it, else exhausted or pending."""
    rows = attempts.where(F.col(number) <= most).withColumn("_o", delivery_outcome(F.col(status)))
    ends = F.min(F.when(F.col("_o") != "retry", F.struct(number, "_o")))
    out = rows.groupBy(key).agg(ends.alias("e"), F.max(number).alias("last"))
    return out.select(key, F.coalesce("e._o", F.when(F.col("last") >= most, "exhausted").otherwise("pending")).alias("outcome"), F.coalesce(f"e.{number}", "last").cast("int").alias("attempts"))


def set_iou(members: DataFrame, group: str, item: str) -> DataFrame:
    """``a, b, n_both, n_either, iou`` for each pair of groups that share an item.

    Items meet by an equi-join; a pair's count is pre-aggregated.  The number of
    groups is small by nature (classes of masks); items may be many.
    """
    rows = members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    sizes = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    a, b = rows.select(F.col("g").alias("a"), "i"), rows.select(F.col("g").alias("b"), "i")
    both = a.join(b, "i").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    out = both.join(sizes.select(F.col("g").alias("a"), F.col("n").alias("n_a")), "a").join(sizes.select(F.col("g").alias("b"), F.col("n").alias("n_b")), "b")
    either = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return out.select("a", "b", "n_both", either.alias("n_either"), (F.col("n_both") / either).alias("iou"))


def ranked(rows: DataFrame, score: str, key: str, n: int) -> DataFrame:
    """The n best, with ``place``: a top-k first, then a window over these n rows alone."""
    best = rows.orderBy(F.desc(score), key).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), key)))


def guarded(steps: DataFrame, key: str, *, order: str, before: str, after: str, weight: str) -> DataFrame:
    """``n_rolled_back, before, after, weak`` of each photo's chain of agents.

    A step whose score falls by more than half a point is taken back, so it counts with
    its score before.  Means are weighted; weak are the kept scores below 8, least first.
    """
    back = rolled_back(F.col(before), F.col(after))
    kept = F.when(back, F.col(before)).otherwise(F.col(after))
    rows = steps.withColumn("_kept", kept).withColumn("_back", back)
    weak = F.collect_list(F.when(F.col("_kept") < 8, F.struct("_kept", order)))
    out = rows.groupBy(key).agg(
        F.count_if("_back").alias("n_rolled_back"), weighted_mean(F.col(before), F.col(weight)).alias("before"), weighted_mean(F.col("_kept"), F.col(weight)).alias("after"), F.transform(F.array_sort(weak), lambda x: x[order]).alias("weak")
    )
    return out.withColumn("grade", grade(F.col("after")))
