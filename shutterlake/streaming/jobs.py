"""Streams of captures and job updates."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def burst_stream(shots: DataFrame, *, group: str, ts: str, gap: str = "6 seconds", late: str = "1 minute") -> DataFrame:
    """Bursts of a stream: a session window closes a gap after its last shot, once the watermark has passed.

    A window holds shots up to and including the gap, as batch grouping does for shots with a time.
    """
    return shots.withWatermark(ts, late).groupBy(group, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n")).select(group, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def bracket_stream(shots: DataFrame, *, group: str, ts: str, ev: str, item: str, tolerance: str = "3 seconds", late: str = "1 minute", least: int = 2, most: int = 7) -> DataFrame:
    """``group, items`` of each bracket of a stream of shots, once the watermark has passed its last shot.

    A session window holds shots that follow each other within the tolerance; inside
    it a bracket ends where an exposure repeats or ``most`` shots are in it, as in
    ``sessions.stateful_brackets``.  What is left of a window with fewer than
    ``least`` shots, or without a second exposure, makes no bracket.
    """
    shot = F.struct(F.col(ts).alias("t"), F.col(item).alias("item"), F.col(ev).alias("ev"))
    timed = shots.withWatermark(ts, late)
    sessions = timed.groupBy(group, F.session_window(ts, tolerance)).agg(F.array_sort(F.collect_list(shot)).alias("shots"))
    cell = F.struct(F.array().cast("array<string>").alias("items"), F.array().cast("array<double>").alias("evs"))
    start = F.struct(F.array(cell).alias("groups"))

    def step(state, s):
        groups = state["groups"]
        last = F.element_at(groups, -1)
        fits = (F.size(last["items"]) == 0) | (s["ev"].isNotNull() & ~F.coalesce(F.array_contains(last["evs"], s["ev"].cast("double")), F.lit(False)) & (F.size(last["items"]) < most))
        known = F.filter(F.array(s["ev"].cast("double")), lambda e: e.isNotNull())
        grown = F.struct(F.concat(last["items"], F.array(s["item"].cast("string"))).alias("items"), F.concat(last["evs"], known).alias("evs"))
        new = F.struct(F.array(s["item"].cast("string")).alias("items"), known.alias("evs"))
        return F.struct(F.when(fits, F.concat(F.slice(groups, 1, F.size(groups) - 1), F.array(grown))).otherwise(F.concat(groups, F.array(new))).alias("groups"))

    groups = sessions.select(group, F.aggregate("shots", start, step, lambda s: s["groups"]).alias("groups"))
    good = F.filter("groups", lambda g: F.size(g["items"]).between(least, most) & (F.size(F.array_distinct(g["evs"])) >= 2))
    return groups.select(group, F.explode(good).alias("_bracket")).select(group, F.col("_bracket.items").alias("items"))


def latest_status(updates: DataFrame, *, key: str, ts: str, status: str, late: str | None = None) -> DataFrame:
    """The newest status of each job; complete or update mode. With ``late``, rows older than the watermark are left out, though a job's state stays."""
    updates = updates if late is None else updates.withWatermark(ts, late)
    return updates.groupBy(key).agg(F.max_by(status, ts).alias(status), F.max(ts).alias(ts))


def deliver(updates: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch to a sink; a batch that fails is tried again with its number, so sinks can tell repeats."""
    return updates.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).outputMode("update").start()


#: Seconds before each further attempt of a delivery.
DELAYS = (2, 8, 30, 120, 300)


def deliver_rows(rows: DataFrame, attempt: Callable[[tuple], int], *, delays=DELAYS, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` with ``outcome, attempts``: each row is sent until it is taken, refused for good, or out of attempts.

    ``attempt`` gets a row's values and returns a status as of HTTP (or raises: tried
    again).  It runs on the executors, so that deliveries spread; a task that is tried
    again sends its rows again, and receivers must tell repeats by their id.
    """
    names = rows.columns

    def run(batches):
        for batch in batches:
            told = []
            for values in batch.itertuples(index=False, name=None):
                for number, delay in enumerate((*delays, None), 1):
                    try:
                        status = attempt(values)
                    except Exception:  # an attempt that fails is tried again, as one that times out
                        status = 0
                    if 200 <= status < 300 or (400 <= status < 500 and status not in (408, 429)) or delay is None:
                        break
                    wait(delay)
                outcome = "delivered" if 200 <= status < 300 else "exhausted" if delay is None and not (400 <= status < 500 and status not in (408, 429)) else "gave_up"
                told.append((*values, outcome, number))
            yield pd.DataFrame(told, columns=[*names, "outcome", "attempts"])

    return rows.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", outcome string, attempts int")
