"""Image folders, catalogs and pairs as DataFrames; CSV reports. Paths are only touched by Spark's readers."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "tif", "tiff", "bmp")
#: Suffixes of cameras' raw files.
RAW_SUFFIXES = ("arw", "cr2", "cr3", "dng", "nef", "nrw", "orf", "pef", "raf", "raw", "rw2", "sr2", "srf", "srw", "x3f", "3fr", "erf", "kdc", "mef", "mos", "mrw", "iiq")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def find_images(spark: SparkSession, folder: str, *, recursive: bool = False, suffixes=IMAGE_SUFFIXES) -> DataFrame:
    """``path, length, modificationTime`` of the images below a folder; contents are not read (columns are pruned)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "modificationTime").where(suffix(F.col("path")).isin(*suffixes))


def folder_or_list(spark: SparkSession, paths: str | list[str], *, raw: bool = False, recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime`` of a folder's images or of the files named, by path; with camera raw files if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(paths)
    return files.select("path", "length", "modificationTime").where(suffix(F.col("path")).isin(*IMAGE_SUFFIXES, *(RAW_SUFFIXES if raw else ()))).orderBy("path")


def read_images(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """``path, image``: JPEG, PNG, BMP, GIF and TIFF files decoded by Spark's image source, as BGR or grey; null where a file can't be decoded."""
    files = spark.read.format("image").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    i = F.col("image")
    kept = files.where(suffix(i["origin"]).isin(*IMAGE_SUFFIXES))
    return kept.select(i["origin"].alias("path"), F.when(i["height"] > 0, F.struct(i["height"].alias("h"), i["width"].alias("w"), i["nChannels"].alias("c"), i["data"].alias("data"))).alias("image"))


def assets(spark: SparkSession, root: str) -> DataFrame:
    """``category, path``: a sub-folder is a category, files of the root are ``uncategorized``."""
    depth = len([p for p in root.rstrip("/").split("/") if p and not p.endswith(":")])
    found = find_images(spark, root, recursive=True)
    parts = F.filter(F.split(F.regexp_replace("path", r"^[a-z0-9]+:/*", ""), "/"), lambda p: p != "")
    return found.select(F.when(F.size(parts) > depth + 1, F.get(parts, depth)).otherwise("uncategorized").alias("category"), "path")


def manifests(spark: SparkSession, root: str, schema: str = "name string, task string, version string, inputs array<string>") -> DataFrame:
    """Rows of all ``manifest.json`` below a folder; malformed ones go."""
    rows = spark.read.schema(f"{schema}, _bad string").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(root)
    return rows.where(F.col("_bad").isNull() & F.col("name").isNotNull()).drop("_bad")


def pairs(paths: DataFrame) -> DataFrame:
    """``key, input, target``: ``<key>_input.*`` with the first ``<key>_target.*``; inputs without one go."""
    named = paths.select("path", F.regexp_extract(stem(F.col("path")), r"^(.*)_(input|target)$", 1).alias("key"), F.regexp_extract(stem(F.col("path")), r"^(.*)_(input|target)$", 2).alias("role"))
    targets = named.where("role = 'target'").groupBy("key").agg(F.min("path").alias("target"))
    return named.where("role = 'input'").select("key", F.col("path").alias("input")).join(targets, "key")


def exif_time(text: Column) -> Column:
    """Seconds since 1970 of ``YYYY:MM:DD HH:MM:SS`` in the session's time zone; null where it is none."""
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def rational(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def safe_key(key: Column) -> Column:
    """A storage key without empty, ``.`` and ``..`` parts; null where nothing is left."""
    parts = F.filter(F.split(F.regexp_replace(key, r"\\", "/"), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def encode_png(image: np.ndarray) -> bytes:
    """BGR or grey."""
    colour = image.ndim == 3
    rows = np.ascontiguousarray(image[..., ::-1] if colour else image).reshape(image.shape[0], -1)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], 1).tobytes()
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if colour else 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


@F.pandas_udf(T.BinaryType())
def png(images: pd.DataFrame) -> pd.Series:
    """Files of image structs (h, w, c, data); null for a null image."""
    shape = lambda r: (r.h, r.w) if r.c == 1 else (r.h, r.w, r.c)
    return pd.Series([None if r.data is None else encode_png(np.frombuffer(r.data, np.uint8).reshape(shape(r))[..., : 3 if r.c > 1 else None]) for r in images.itertuples()])


def with_orientation(image: np.ndarray, orientation: int) -> np.ndarray:
    """The pixels as they are to be seen, for the eight values of the orientation tag; others leave them."""
    turned = np.swapaxes(image, 0, 1) if orientation in (5, 6, 7, 8) else image
    if orientation in (3, 4, 7, 8):
        turned = turned[::-1]
    return turned[:, ::-1] if orientation in (2, 3, 6, 7) else turned


def report_lines(rows: DataFrame, order: str, comments: list[str], summary: list) -> DataFrame:
    """Lines of a report: comments, the header, a line a row, and a summary."""
    columns = [c for c in rows.columns if c != order]
    head = [*(f"# {c}" for c in comments), ",".join(columns)]
    lines = [(-2, k, line) for k, line in enumerate(head)] + [(1, 0, ",".join("" if v is None else str(v) for v in summary))]
    fixed = rows.sparkSession.createDataFrame(lines, "part int, place long, value string")
    body = rows.select(F.lit(0).alias("part"), F.col(order).cast("long").alias("place"), F.to_csv(F.struct(*columns), {"quote": '"', "escape": '"'}).alias("value"))
    return fixed.unionByName(body)


def write_report(rows: DataFrame, path: str, *, order: str, comments: list[str], summary: list) -> None:
    """One UTF-8 file with a byte order mark, for spreadsheets; reports are small by nature."""
    lines = report_lines(rows, order, comments, summary).repartition(1).sortWithinPartitions("part", "place")
    first = F.when((F.col("part") == -2) & (F.col("place") == 0), F.lit("\ufeff")).otherwise("")
    lines.select(F.concat(first, "value").alias("value")).write.mode("overwrite").text(path)


def retry_delays(attempt: int, base: float = 2.0, most: int = 3) -> float | None:
    """Seconds to wait after a failed attempt (from 0); None when no more follow."""
    return base * math.pow(2, attempt) if attempt < most else None
