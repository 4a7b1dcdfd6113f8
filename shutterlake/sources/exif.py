"""Capture metadata of photos: a table of EXIF fields beside each path.

Only the head of a file is sent to Python, a slice of ``binaryFile`` content; the
decisions on the fields (times, lens profiles) are column expressions.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file in which its metadata is looked for.
HEAD = 262_144
#: Numbers of the tags that are read.
TAGS = {
    0x0112: "orientation", 0x0132: "changed", 0x9003: "taken", 0x9204: "bias_ev", 0x8827: "iso", 0x829A: "exposure_s", 0x829D: "f_number", 0x920A: "focal_mm", 0xA434: "lens",
}
SUB_DIRECTORY = 0x8769
KINDS = {
    "orientation": T.IntegerType(), "changed": T.StringType(), "taken": T.StringType(), "bias_ev": T.DoubleType(), "iso": T.IntegerType(), "exposure_s": T.DoubleType(),
    "f_number": T.DoubleType(), "focal_mm": T.DoubleType(), "lens": T.StringType(),
}
SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in KINDS.items()])
#: Size and letter of each value type (text, 16 and 32 bits, fractions without and with sign).
TYPES = {2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 10: (8, "ii")}


def block(data: bytes) -> bytes:
    """The TIFF structure that holds a file's metadata: of a JPEG segment, a PNG chunk, or the file itself."""
    if data[:2] in (b"II", b"MM"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = data.find(b"eXIf")
        return data[at + 4 :] if at > 0 else b""
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def fields(data: bytes) -> dict:
    """The known fields of a file's head; those that are missing or broken are left out."""
    tiff = block(data)
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict = {}
    if order is None or len(tiff) < 8:
        return out
    todo, seen = [struct.unpack_from(order + "I", tiff, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in seen or at + 2 > len(tiff):
            continue
        seen.add(at)
        for k in range(struct.unpack_from(order + "H", tiff, at)[0]):
            entry = at + 2 + 12 * k
            if entry + 12 > len(tiff):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", tiff, entry)
            size, letter = TYPES.get(kind, (0, ""))
            place = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", tiff, entry + 8)[0]
            if not size or not count or place + size * count > len(tiff):
                continue
            if tag == SUB_DIRECTORY:
                todo.append(struct.unpack_from(order + "I", tiff, place)[0])
            elif tag in TAGS and TAGS[tag] not in out:
                if letter == "s":
                    out[TAGS[tag]] = tiff[place : place + count].split(b"\0")[0].decode("utf-8", "replace").strip()
                else:
                    value = struct.unpack_from(order + letter, tiff, place)
                    out[TAGS[tag]] = value[0] if len(value) == 1 else value[0] / value[1] if value[1] else 0.0
    return out


@F.pandas_udf(SCHEMA)
def exif(heads: pd.Series) -> pd.DataFrame:
    rows = [fields(h or b"") for h in heads]
    columns = {}
    for name, kind in KINDS.items():
        text = isinstance(kind, T.StringType)
        values = [v if (v := r.get(name)) is not None and isinstance(v, str) == text else None for r in rows]
        columns[name] = pd.array(values, dtype="object" if text else "Int32" if isinstance(kind, T.IntegerType) else "Float64")
    return pd.DataFrame(columns)


def read_exif(spark: SparkSession, folder: str, *, recursive: bool = False) -> DataFrame:
    """``path`` and a column for each field, null where the file doesn't say; files are read at their heads only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", exif(F.substring("content", 1, HEAD)).alias("e")).select("path", "e.*")


def capture_time(taken: Column, changed: Column) -> Column:
    """Seconds since 1970, of when the photo was taken or else changed; null where neither is a time."""
    text = F.coalesce(F.nullif(taken, F.lit("")), changed)
    return F.unix_timestamp(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))).cast("double")


#: Parts of a lens's name, all of which must be there (or one of those separated by |), and its profile.
LENSES = (
    (("rf", "14-35"), "canon_rf_14_35"), (("rf", "15-35"), "canon_rf_15_35"), (("ef", "16-35"), "canon_ef_16_35_iii"), (("fe 14-24|14-24mm gm",), "sony_fe_14_24"), (("fe 16-35",), "sony_fe_16_35"),
    (("z 14-24",), "nikon_z_14_24"), (("z 14-30",), "nikon_z_14_30"), (("sigma", "14-24"), "sigma_art_14_24"), (("sigma", "24-70"), "sigma_art_24_70"), (("tamron", "17-28"), "tamron_17_28"),
)


def lens_profile(lens: Column) -> Column:
    """The first profile whose parts a lens's name has."""
    out = F.lit(None).cast("string")
    for parts, name in reversed(LENSES):
        test = F.lit(True)
        for part in parts:
            test = test & F.lower(lens).rlike(part)
        out = F.when(test, name).otherwise(out)
    return out
