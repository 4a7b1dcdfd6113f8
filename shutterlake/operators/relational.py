"""Keyed records: lookups, recent lists, partial updates, inserts, anti-joins, pairings and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_recent(records: DataFrame, created: str, key: str, limit: int = 50) -> DataFrame:
    """The newest records; ties by key. A top-k of each partition, then of those."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be from 1 to 500")
    return records.orderBy(F.desc(created), key).limit(limit)


def lookup(records: DataFrame, key: str, value) -> DataFrame:
    """Records with a key; the filter reaches the scan."""
    return records.where(F.col(key) == F.lit(value))


def partial_update(records: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], *, strict: bool = False) -> DataFrame:
    """Records with each column replaced where the update has a value for it. ``updates`` has a row a key.

    Updates of keys that no record has change nothing; if ``strict``, they fail the job.
    """
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = records.withColumn("_here", F.lit(True)).join(new, records[key] == new["_key"], "full" if strict else "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit("no record has the key "), F.col("_key").cast("string")))
        joined = joined.where(F.when(F.col("_here").isNull(), unknown.isNull()).otherwise(True))
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in records.columns])


def touch(at: Column, matches: Column, now: Column) -> Column:
    """The time of last use, set where a key matches."""
    return F.when(matches, now).otherwise(at)


def merge_maps(old: Column, new: Column) -> Column:
    """Entries of both; the new one wins. Null maps are empty."""
    empty = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, empty), F.coalesce(new, empty)
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def insert_if_absent(records: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``records`` and those of ``fresh`` whose key they lack."""
    return records.unionByName(fresh.join(records.select(key), key, "left_anti"))


def duplicate_keys(fresh: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Keys that an insert must refuse: in ``records`` already or more than once in ``fresh``."""
    twice = fresh.groupBy(key).count().where("count > 1").select(key)
    return fresh.select(key).join(records.select(key), key, "left_semi").union(twice).distinct()


def upsert(records: DataFrame, fresh: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key; a fresh row wins over one of equal order. Rows are combined before the shuffle."""
    columns = records.columns
    rows = records.withColumn("_fresh", F.lit(0)).unionByName(fresh.withColumn("_fresh", F.lit(1)))
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), F.struct(order, "_fresh")).alias("_row"))
    return best.select(key, "_row.*").select(*columns)


def active(records: DataFrame, revoked: str, env: str, wanted: str | None) -> DataFrame:
    """Records that aren't revoked, of one environment or of any."""
    kept = records.where(F.col(revoked).isNull())
    return kept if wanted is None else kept.where(F.col(env) == wanted)


def revoke(revoked: Column, matches: Column, now: Column) -> Column:
    """The first revocation time stays."""
    return F.when(matches & revoked.isNull(), now).otherwise(revoked)


def without_existing(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return tasks.join(done.select(key), key, "left_anti")


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of each value and of all (key null there), as ``n``."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def count_with_total(rows: DataFrame, key: str) -> DataFrame:
    return rows.rollup(key).agg(F.count(F.lit(1)).alias("n"), F.grouping(key).cast("int").alias("is_total"))


def one_to_many(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Each left row with each of its right rows; left rows without any go."""
    return left.join(right, list(on))


def union_sources(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of all sources, in the order given, with ``source`` and its rank."""
    out = None
    for rank, (name, rows) in enumerate(parts):
        rows = rows.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no source")
    return out


def progress(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Position, size of the group and percent done, 5 + int(90 * i / n), row by row."""
    w = Window.partitionBy(group)
    return rows.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("progress_pct", (F.lit(5) + F.floor(90 * F.col("i") / F.col("n"))).cast("int"))


def running_verdicts(rows: DataFrame, group: str, order: str, verdict: str, names: Sequence[str]) -> DataFrame:
    """How many rows of each verdict a group has seen so far, as ``n_<verdict>``."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.count_if(F.col(verdict) == n).over(w).alias(f"n_{n}") for n in names])


def report_table(hits: DataFrame, *, sources: Sequence[str], source: str = "source", order: str = "stars") -> DataFrame:
    """``source, place, line``: a Markdown table row for each hit, sources in their order, the most starred first.

    Tags are cut to five, descriptions to 200 characters; bars are escaped and line breaks blank.
    """
    rank = first = F.lit(len(sources))
    for k, name in enumerate(sources):
        first = F.when(F.col(source) == name, k).otherwise(first)
    rank = first
    text = F.left(F.replace(F.replace(F.coalesce("description", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit(200))
    stars = F.coalesce(F.col(order).cast("string"), F.lit(""))
    cells = [F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")")), stars, F.coalesce("pushed_at", F.lit("")), F.array_join(F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 5), ", "), text]
    place = F.row_number().over(Window.partitionBy(source).orderBy(F.desc_nulls_last(order), "name"))
    return hits.select(source, rank.alias("_rank"), place.alias("place"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")).where(F.col("_rank") < len(sources)).drop("_rank")
