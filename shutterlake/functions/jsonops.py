"""JSON records, their canonical form, tokens and stable ids."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

BUCKETS = 1024

STAGE = "struct<name:string,applied:boolean,skipped:boolean,error:string,duration_ms:double>"
FULL_STAGE = "struct<name:string,applied:boolean,skipped:boolean,error:string,duration_ms:double,warnings:array<array<string>>,metrics:map<string,double>,reason:string,artifacts:map<string,string>>"


def to_report(stages: Column) -> Column:
    return F.to_json(F.struct(stages.alias("stages")))


def from_report(text: Column) -> Column:
    """Stages of a JSON report; those that aren't objects go, missing flags are false, a missing duration is 0."""
    read = F.from_json(text, f"stages array<{STAGE}>")["stages"]
    kept = F.filter(F.coalesce(read, F.array().cast(f"array<{STAGE}>")), lambda s: s.isNotNull())
    return F.transform(kept, lambda s: F.struct(F.coalesce(s["name"], F.lit("")).alias("name"), F.coalesce(s["applied"], F.lit(False)).alias("applied"), F.coalesce(s["skipped"], F.lit(False)).alias("skipped"), s["error"].alias("error"), F.coalesce(s["duration_ms"], F.lit(0.0)).alias("duration_ms")))


def full_report(job_id: Column, stages: Column, duration_ms: Column, halted: Column) -> Column:
    """A job's report as JSON: its stages with their warnings (pairs), metrics, reasons and artifacts."""
    return F.to_json(F.struct(job_id.alias("job_id"), duration_ms.alias("duration_ms"), halted.alias("halted"), stages.alias("stages")))


def read_full_report(text: Column) -> Column:
    """``job_id, duration_ms, halted, stages`` of such a JSON text; what is missing takes its default, and only pairs are warnings."""
    read = F.from_json(text, f"struct<job_id:string,duration_ms:double,halted:boolean,stages:array<{FULL_STAGE}>>")
    kept = F.filter(F.coalesce(read["stages"], F.array().cast(f"array<{FULL_STAGE}>")), lambda s: s.isNotNull())

    def whole(s):
        flag = lambda n: F.coalesce(s[n], F.lit(False)).alias(n)
        pairs = F.filter(F.coalesce(s["warnings"], F.array().cast("array<array<string>>")), lambda w: F.size(w) == 2)
        return F.struct(
            F.coalesce(s["name"], F.lit("")).alias("name"), flag("applied"), flag("skipped"), s["error"].alias("error"), F.coalesce(s["duration_ms"], F.lit(0.0)).alias("duration_ms"), pairs.alias("warnings"),
            F.coalesce(s["metrics"], F.create_map().cast("map<string,double>")).alias("metrics"), F.coalesce(s["reason"], F.lit("")).alias("reason"), F.coalesce(s["artifacts"], F.create_map().cast("map<string,string>")).alias("artifacts"),
        )

    return F.struct(F.coalesce(read["job_id"], F.lit("")).alias("job_id"), F.coalesce(read["duration_ms"], F.lit(0.0)).alias("duration_ms"), F.coalesce(read["halted"], F.lit(False)).alias("halted"), F.transform(kept, whole).alias("stages"))


def names_where(stages: Column, test) -> Column:
    return F.transform(F.filter(stages, test), lambda s: s["name"])


def applied(stages: Column) -> Column:
    return names_where(stages, lambda s: s["applied"])


def skipped(stages: Column) -> Column:
    return names_where(stages, lambda s: s["skipped"])


def errored(stages: Column) -> Column:
    """Names of stages with an error that isn't empty."""
    return names_where(stages, lambda s: s["error"].isNotNull() & (s["error"] != ""))


def stable_id(namespace: str, text: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{namespace}|"), text))


def photo_id(height: Column, width: Column, channels: Column, features: Column, namespace: str = "photo") -> Column:
    """SHA-1 of a namespace, the photo's shape as 64-bit and its perceptual hash as 32-bit little-endian numbers."""
    swapped = lambda hex_, n: F.array_join(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(hex_, i * 2 + 1, F.lit(2)))), "")
    shape = F.concat(*[swapped(F.lpad(F.hex(v.cast("long")), 16, "0"), 8) for v in (height, width, channels)])
    # The features are zeros and ones, whose float patterns are fixed.
    bits = F.array_join(F.transform(features, lambda f: F.when(f == 1, "0000803F").otherwise("00000000")), "")
    return F.sha1(F.concat(F.encode(F.lit(namespace), "utf-8"), F.unhex(F.concat(shape, bits))))


def u64(digest: Column) -> Column:
    """The first 16 hex digits as an unsigned number, which a bigint can't hold."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.conv(F.substring(F.sha1(token), 1, 8), 16, 10).cast("long") % buckets


def hash_features(tokens: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, value`` of each key's (token, value) rows: sums of a bucket over the length of all its sums."""
    sums = tokens.groupBy(key, bucket(F.col("token"), buckets).alias("bucket")).agg(F.sum("value").alias("sum"))
    size = sums.groupBy(key).agg(F.sqrt(F.sum(F.col("sum") * F.col("sum"))).alias("size"))
    return sums.join(size, key).select(key, "bucket", F.when(F.col("size") > 0, F.col("sum") / F.col("size")).otherwise(F.col("sum")).alias("value"))


def nesting(text: Column) -> Column:
    """Levels of objects and arrays in a JSON text: how far its brackets nest outside of strings."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(\\.|[^"\\])*"', ""), r"[^\[\]{}]", "")
    steps = F.transform(F.split(bare, ""), lambda c: F.when(c.isin("{", "["), 1).when(c.isin("}", "]"), -1).otherwise(0))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    return F.aggregate(steps, start, lambda s, d: F.struct((s["now"] + d).alias("now"), F.greatest(s["most"], s["now"] + d).alias("most")), lambda s: s["most"])


def json_leaves(rows: DataFrame, key: str, text: str, *, depth: int | None = None) -> DataFrame:
    """``key, token, value``: a row for each leaf of a JSON text.

    The token is the leaf's path, ``a.b[0]``; a string is part of its token and counts
    1, true and false count 1 and 0, null 0.  Texts that aren't JSON have no leaves, nor
    have empty objects and arrays.  One aggregate over the texts finds how deep they go
    (or ``depth`` says so); each level is one explode of what is nested there.
    """
    spark = rows.sparkSession
    parsed = F.try_parse_json(F.col(text))
    if depth is None:
        depth = rows.agg(F.max(F.when(parsed.isNotNull(), nesting(F.col(text)))).alias("n")).first()["n"] or 0
    level = rows.select(F.col(key).alias("_key"), F.lit("").alias("_path"), parsed.alias("_v")).where("_v is not null")
    out = None
    for k in range(depth + 1):
        kind, path = F.schema_of_variant("_v"), F.col("_path")
        nested = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
        text_of = F.try_variant_get("_v", "$", "string")
        number = F.when(kind == "BOOLEAN", F.try_variant_get("_v", "$", "boolean").cast("double")).when(F.is_variant_null("_v"), F.lit(0.0)).otherwise(F.try_variant_get("_v", "$", "double"))
        found = level.where(~nested).select(
            F.col("_key").alias(key), F.when(kind == "STRING", F.concat(path, F.lit("="), text_of)).otherwise(path).alias("token"), F.when(kind == "STRING", 1.0).otherwise(number).alias("value")
        )
        out = found if out is None else out.unionByName(found)
        if k < depth:
            parts = level.where(nested).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
            step = F.when(F.col("key").isNull(), F.concat(path, F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(path == "", F.col("key")).otherwise(F.concat(path, F.lit("."), F.col("key")))
            level = parts.select("_key", step.alias("_path"), F.col("value").alias("_v"))
    return out


def canonical_json(text: Column) -> Column:
    """Sorted keys, no white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


@pandas_udf(T.LongType())
def _seed(seeds: pd.Series, stages: pd.Series) -> pd.Series:
    made = [None if s is None or n is None else int.from_bytes(hashlib.blake2b(f"{s}:{n}".encode(), digest_size=4).digest(), "big") for s, n in zip(seeds, stages, strict=True)]
    return pd.Series(made, dtype="Int64")


def stage_seed(seed: Column, stage: Column) -> Column:
    """A 32-bit seed of (job seed, stage); null for a null seed. Seeds go as text, as a null beside a large number would round it."""
    return _seed(seed.cast("string"), stage)


def signer(secret: str):
    """HMAC-SHA256 of ``timestamp.body`` as hex."""

    @pandas_udf(T.StringType())
    def sign(times: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([hmac.new(secret.encode(), f"{int(t)}.{b}".encode(), hashlib.sha256).hexdigest() for t, b in zip(times, bodies, strict=True)])

    return sign


def fresh_and_equal(time: Column, now: Column, given: Column, expected: Column, window_s: int = 300) -> Column:
    return (F.abs(now - time) <= window_s) & (given == expected)
