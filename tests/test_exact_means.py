"""Means that are equal are equal in whatever order their rows come, and their order goes by name."""

import datetime

from pyspark.sql import functions as F

from shutterlake import catalog
from shutterlake.operators import statistics


def events(spark, path, rows):
    made = [(k, datetime.datetime(2024, 1, 1), 1, "view", v, "{}") for k, v in rows]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_equal_means_are_told_apart_by_name(spark, tmp_path):
    """0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1 in doubles."""
    three = events(spark, tmp_path / "three", [*enumerate([0.1, 0.3, 0.3, 0.2, 0.2, 0.2, 0.3, 0.1, 0.1])])
    assert "3 weak categories; begin with exposure." in catalog.queries()["audit_summary"](spark, three).first()["summary"]


def test_weak_categories_of_equal_means_go_by_name(spark, tmp_path):
    nine = events(spark, tmp_path / "nine", [(9 * k + c, v) for c, values in enumerate([(0.3, 0.2, 0.1), (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)]) for k, v in enumerate(values)] + [(8, 0.2)])
    assert catalog.queries()["weak_top3"](spark, nine).first()["weak"] == "composition,exposure,sharpness"


def test_values_that_decimals_do_not_hold_are_summed_as_doubles(spark):
    groups = {"tiny": [1e-20, 3e-20], "huge": [1e20, 3e20], "nan": [float("nan"), 1.0], "inf": [float("inf"), 1.0], "none": [None], "some": [None, 0.5, -0.0], "thirds": [1 / 3, 1 / 3]}
    frame = spark.createDataFrame([(k, v) for k, values in groups.items() for v in values], "k string, v double")
    a = frame.groupBy("k").agg(statistics.exact_mean(F.col("v")).alias("mean"), F.avg("v").alias("plain"))
    assert all(r["mean"] == r["plain"] or r["k"] == "nan" and r["mean"] != r["mean"] for r in a.collect())
