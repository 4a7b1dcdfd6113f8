"""Bursts and exposure brackets in capture streams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.operators import likeness

#: Fixed value: thumbnails of one scene correlate by so much.
ALIKE = 0.93


def bursts(shots: DataFrame, *, group: str, ts_us: str, order: str, gap_s: float = 6.0) -> DataFrame:
    """``burst`` numbers within a group: a gap of more than ``gap_s`` begins a new one.

    Rows without a time sort first, as time 0, and never begin one.
    """
    at = F.coalesce(F.col(ts_us), F.lit(0)).cast("long")
    w = Window.partitionBy(group).orderBy(at, order)
    cut = F.when(F.col(ts_us).isNotNull() & (F.lag(ts_us).over(w).isNotNull()) & (F.col(ts_us) - F.lag(ts_us).over(w) > F.lit(int(gap_s * 1e6))), 1).otherwise(0)
    return shots.withColumn("_cut", cut).withColumn("burst", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def classify(shots: DataFrame, *, keys: list[str], ev: str, brightness: str, ev_spread: float = 1.0, brightness_spread: float = 0.18) -> DataFrame:
    """``reason`` and ``confidence`` of each burst: by exposure, by brightness, or single shots."""
    n = F.count(F.lit(1))
    spread = lambda c: F.max(c) - F.min(c)
    all_known = lambda c: F.count(c) == n
    by_ev = (n > 1) & all_known(ev) & (spread(ev) >= ev_spread)
    by_brightness = (n > 1) & all_known(brightness) & (spread(brightness) >= brightness_spread)
    return shots.groupBy(*keys).agg(
        n.alias("n"),
        F.when(n == 1, "single").when(by_ev, "exposure").when(by_brightness, "brightness").otherwise("none").alias("reason"),
        F.when(n == 1, 1.0).when(by_ev, 1.0).when(by_brightness, 0.6).otherwise(1.0).alias("confidence"),
    )


def middle(value: Column, order: Column, item: Column, n: Column | None = None) -> Column:
    """Aggregate: the item at position n // 2 by value, ties by order."""
    items = F.sort_array(F.collect_list(F.struct(value.alias("v"), order.alias("o"), item.alias("i"))))
    return F.element_at(items, (F.floor(F.size(items) / 2) + 1).cast("int"))["i"]


def fold_sorted(rows: DataFrame, group: str, order: list[Column | str], schema: str, start) -> DataFrame:
    """A fold over each group's rows in order, whatever the size of a group.

    Groups are dealt by hash and sorted within partitions; ``start(group)`` gives
    an object whose ``row(*values)`` and ``end()`` return lists of output rows.
    Batches stream through, so a task holds one fold's state only.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        current, state = None, None
        for batch in batches:
            out = []
            for key, *values in batch.itertuples(index=False, name=None):
                if state is None or key != current:
                    if state is not None:
                        out += state.end()
                    current, state = key, start(key)
                out += state.row(*values)
            yield pd.DataFrame(out, columns=names)
        if state is not None:
            yield pd.DataFrame(state.end(), columns=names)

    return rows.where(F.col(group).isNotNull()).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


class _Bracket:
    def __init__(self, group, tolerance_us: float, least: int, most: int):
        self.group, self.tolerance_us, self.least, self.most = group, tolerance_us, least, most
        self.open, self.evs, self.last, self.number = [], [], None, 0

    def end(self) -> list[tuple]:
        good = self.least <= len(self.open) <= self.most and len(set(self.evs)) >= 2
        out = [(self.group, k, self.number if good else -1) for k in self.open]
        self.number += good
        self.open, self.evs = [], []
        return out

    def row(self, ts_us, ev, item) -> list[tuple]:
        timed, known = not pd.isna(ts_us), not pd.isna(ev)
        near = self.open and timed and self.last is not None and ts_us - self.last <= self.tolerance_us
        out = [] if near and known and ev not in self.evs and len(self.open) < self.most else self.end()
        self.open.append(item)
        if known:
            self.evs.append(ev)
        self.last = ts_us if timed else None
        return out


def stateful_brackets(shots: DataFrame, *, group: str, ts_us: str, ev: str, item: str, tolerance_s: float = 3.0, least: int = 2, most: int = 7) -> DataFrame:
    """``bracket`` of each shot, -1 for singles: a fold in time order.

    A shot joins the open bracket if it comes within the tolerance of the one
    before, brings a new exposure, and the bracket isn't full; a bracket counts
    with ``least`` or more shots and two exposures.  Shots without a time come
    first and are singles; one without an exposure joins no bracket, but may begin
    one.  Shots without a group are left out.
    """
    kinds = dict(shots.dtypes)
    rows = shots.select(group, ts_us, ev, item)
    return fold_sorted(rows, group, [F.asc_nulls_first(ts_us), item], f"{group} {kinds[group]}, {item} {kinds[item]}, bracket int", lambda g: _Bracket(g, tolerance_s * 1e6, least, most))


def bracket_labels(members: DataFrame, *keys: str, item: str, ev: str, order: str) -> DataFrame:
    """``reference, ev_low, ev_high, label`` of each bracket: the shot nearest to no compensation (unknown counts as 99 stops), the first one on ties."""
    rank = F.struct(F.coalesce(F.abs(F.col(ev)), F.lit(99.0)), F.col(order))
    out = members.groupBy(*keys).agg(F.min_by(item, rank).alias("reference"), F.coalesce(F.min(ev), F.lit(0.0)).alias("ev_low"), F.coalesce(F.max(ev), F.lit(0.0)).alias("ev_high"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("label", F.format_string("%s_ev[%+.1f..%+.1f]_n=%d", F.col("reference").cast("string"), F.col("ev_low").cast("double"), F.col("ev_high").cast("double"), F.col("n")))


def filename_prefix(stem: Column) -> Column:
    """What stands before a stem's counter of up to five digits; the stem itself without one."""
    form = r"^(.+?)[_-]?([0-9]{1,5})$"
    return F.when(stem.rlike(form), F.regexp_replace(F.regexp_extract(stem, form, 1), "[_-]+$", "")).otherwise(stem)


def refine_by_filename(shots: DataFrame, *, cluster: str, ts: str, stem: str) -> DataFrame:
    """``part`` of each shot inside its time cluster: null for shots with a time, the filename's prefix for the others."""
    return shots.withColumn("part", F.when(F.col(ts).isNull(), filename_prefix(F.col(stem))))


def one_prefix(stem: Column) -> Column:
    """Aggregate: whether two or more shots all end with a counter and share what stands before it."""
    counted = stem.rlike(r"^(.+?)[_-]?([0-9]{1,5})$")
    return (F.count(F.lit(1)) > 1) & F.bool_and(counted) & (F.min(filename_prefix(stem)) == F.max(filename_prefix(stem)))


class _Shots:
    """Looks a few shots ahead of an anchor, takes the longest run that spreads enough, and goes on behind it."""

    def __init__(self, group, same, window: int, forced: bool):
        self.group, self.same, self.window, self.forced = group, same, window, forced
        self.held: list[tuple] = []
        self.number = 0

    @staticmethod
    def spread(values) -> float:
        known = [v for v in values if not pd.isna(v)]
        return max(known) - min(known) if len(known) > 1 else -1.0

    def chosen(self, run: list[tuple]) -> int:
        """How many of the run's shots make a bracket; 1 if none do."""
        evs, light = [s[2] for s in run], [s[3] for s in run]
        if self.forced:
            spreads = self.spread(evs) >= 0.5 or self.spread(light) >= 12
            return len(run) if len(run) == self.window and spreads else 1
        sizes = [n for n in (5, 4, 3, 2) if n <= len(run)]
        by_ev = next((n for n in sizes if self.spread(evs[:n]) >= 1), 1)
        return by_ev if by_ev > 1 else next((n for n in sizes if self.spread(light[:n]) >= 18), 1)

    def take(self) -> list[tuple]:
        run = self.held[:1]
        for shot in self.held[1 : self.window]:
            if not self.same(run[0], shot):
                break
            run.append(shot)
        n = self.chosen(run)
        # min() keeps the first of equals.
        best = min(run[:n], key=lambda s: abs(s[3] - 128.0) if not pd.isna(s[3]) else float("inf"))[0]
        out = [(self.group, s[0], self.number, best) for s in run[:n]]
        self.held, self.number = self.held[n:], self.number + 1
        return out

    def row(self, ts_us, item, ev, brightness, *looks) -> list[tuple]:
        self.held.append((item, ts_us, ev, brightness, *looks))
        return self.take() if len(self.held) >= self.window else []

    def end(self) -> list[tuple]:
        out = []
        while self.held:
            out += self.take()
        return out


def greedy_brackets(
    shots: DataFrame, *, group: str, ts_us: str, item: str, ev: str, brightness: str, window: int = 5, forced: bool = False, near_s: float = 3.0, far_s: float = 6.0,
    thumb: str | None = None, shape: tuple[str, ...] = (), alike: float = ALIKE,
) -> DataFrame:
    """``task, reference`` of each shot: brackets found by a scan that looks ``window`` shots ahead.

    A shot is of the anchor's scene if it has its ``shape`` and was taken within ``near_s``; not beyond
    ``far_s``; and between them, or without a time, if their thumbnails (arrays of 0 to 255)
    correlate by ``alike``; flat ones and photos without any never do.  Of such a run the longest
    prefix (5 at most) counts whose exposures spread by a stop, or else whose brightness
    spreads by 18; ``forced`` asks for just ``window`` shots, half a stop or 12.  The scan
    goes on behind a bracket, or with the next shot where there is none.  The reference
    is the shot nearest to a brightness of 128.  A task holds ``window`` shots of a group.
    """

    def same(first, shot):
        if first[5:] != shot[5:]:
            return False
        if not (pd.isna(first[1]) or pd.isna(shot[1])):
            apart = abs(shot[1] - first[1])
            if apart > far_s * 1e6 or apart <= near_s * 1e6:
                return apart <= near_s * 1e6
        if first[4] is None or shot[4] is None or len(first[4]) != len(shot[4]):
            return False
        a, b = (np.frombuffer(s[4], np.uint8).astype(float) for s in (first, shot))
        return bool(a.std() >= 1e-3 and b.std() >= 1e-3 and np.corrcoef(a, b)[0, 1] >= alike)

    kinds = dict(shots.dtypes)
    look = likeness.packed(F.col(thumb)) if thumb else F.lit(None).cast("binary")
    rows = shots.select(group, ts_us, item, ev, brightness, look.alias("_look"), *[F.col(c).alias(f"_shape{k}") for k, c in enumerate(shape)])
    return fold_sorted(rows, group, [F.asc_nulls_first(ts_us), item], f"{group} {kinds[group]}, {item} {kinds[item]}, task int, reference {kinds[item]}", lambda g: _Shots(g, same, window, forced))


def near_pairs(rows: DataFrame, *, group: str, ts_us: str, item: str, within_s: float) -> DataFrame:
    """Pairs (a, b) of one group, a before b by id, at most so far apart.

    Time is cut into steps of that width, so a row meets rows of three steps
    only, by an equi-join that adaptive execution can split.
    """
    width = int(within_s * 1e6)
    step = F.floor(F.col(ts_us) / width)
    a = rows.select(F.col(group).alias("g"), step.alias("step"), F.col(item).alias("a"), F.col(ts_us).alias("a_us"))
    b = rows.select(F.col(group).alias("g"), F.explode(F.sequence(step - 1, step + 1)).alias("step"), F.col(item).alias("b"), F.col(ts_us).alias("b_us"))
    return a.join(b, ["g", "step"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("a_us") - F.col("b_us")) <= width)).select(F.col("g").alias(group), "a", "b", F.abs(F.col("a_us") - F.col("b_us")).alias("apart_us"))


def scene_pairs(shots: DataFrame, *, group: str, ts_us: str, item: str, thumb: str = "thumb", shape: tuple[str, ...] = (), near_s: float = 3.0, far_s: float = 6.0, alike: float = ALIKE) -> DataFrame:
    """``near_pairs`` of one scene: of one ``shape``, and taken within ``near_s`` or else with thumbnails that correlate. Shots without a time are in none.

    Thumbnails are fetched for the pairs that time leaves open only.
    """
    plain = shots.select(group, ts_us, item)
    pairs = near_pairs(plain.where(F.col(ts_us).isNotNull()), group=group, ts_us=ts_us, item=item, within_s=far_s)
    looks = shots.select(item, F.struct(F.lit(0), *shape).alias("_shape"), thumb).hint("merge")
    side = lambda c, with_thumb: looks.select(F.col(item).alias(c), F.col("_shape").alias(f"_shape_{c}"), *([F.col(thumb).alias(f"_thumb_{c}")] if with_thumb else []))
    within = F.col("apart_us") <= int(near_s * 1e6)
    same = F.col("_shape_a").eqNullSafe(F.col("_shape_b"))
    sure = pairs.where(within).join(side("a", False), "a").join(side("b", False), "b").where(same)
    asked = pairs.where(~within).join(side("a", True), "a").join(side("b", True), "b").where(same)
    asked = asked.where(likeness.correlation(F.col("_thumb_a"), F.col("_thumb_b")) >= alike)
    return sure.select(pairs.columns).unionByName(asked.select(pairs.columns))


def greedy_boxes(boxes: DataFrame, *, group: str, item: str, limit: float = 0.3) -> DataFrame:
    """Boxes (x, y, w, h) that stay when each, largest first, drops those that overlap it by more than ``limit``.

    A group's boxes are one array: a photo has few.  Ties go by item, then place.
    """
    number = lambda c: F.col(c).cast("double").alias(c)
    box = F.struct((-F.col("w").cast("double") * F.col("h")).alias("_less"), F.col(item).alias("item"), *map(number, "xywh"))
    rows = boxes.groupBy(group).agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    kind = dict(rows.dtypes)["_boxes"]

    def overlaps(k, b):
        side = lambda at, size: F.greatest(F.lit(0.0), F.least(k[at] + k[size], b[at] + b[size]) - F.greatest(k[at], b[at]))
        shared = side("x", "w") * side("y", "h")
        # The small addend keeps a box that overlaps by just the limit.
        return shared / (k["w"] * k["h"] + b["w"] * b["h"] - shared + 1e-6) >= limit

    kept = F.aggregate("_boxes", F.array().cast(kind), lambda held, b: F.when(F.exists(held, lambda k: overlaps(k, b)), held).otherwise(F.concat(held, F.array(b))))
    return rows.select(group, F.explode(kept).alias("_b")).select(group, F.col("_b.item").alias(item))
