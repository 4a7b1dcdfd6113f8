"""A sink of files with commit, and metadata blocks spliced into image files.

Rows (key, data) become files.  A task stages its files in a folder of its attempt; when
all tasks are done the driver moves each task's folder to its place, one move a task, and
leaves a list of them.  A failed attempt removes its folder, an aborted job all of them.
"""

from __future__ import annotations

import contextlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGED = "_staged"


class Staged(WriterCommitMessage):
    def __init__(self, folder: str, part: str, files: int):
        self.folder, self.part, self.files = folder, part, files


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def plain_key(key: str) -> str:
    """A key without empty, ``.`` and ``..`` parts, so that no file lands outside."""
    parts = [p for p in key.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    if not parts:
        raise ValueError(f"no usable key: {key!r}")
    return "/".join(parts)


class FileWriter(DataSourceWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Staged:
        system, root = open_fs(self.root)
        part = f"part-{TaskContext.get().partitionId():06d}-{self.job[:8]}"
        folder = f"{root}/{STAGED}/{self.job}/{part}-{uuid.uuid4().hex}"
        seen: set[str] = set()
        try:
            for row in iterator:
                if row["key"] is None or row["data"] is None:
                    continue
                key = plain_key(row["key"])
                if key in seen:
                    raise ValueError(f"two rows of one key: {key!r}")
                seen.add(key)
                system.create_dir(f"{folder}/{key}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{folder}/{key}") as out:
                    out.write(bytes(row["data"]))
        except BaseException:
            with contextlib.suppress(OSError):
                system.delete_dir(folder)
            raise
        return Staged(folder, part, len(seen))

    def commit(self, messages: list[Staged | None]) -> None:
        system, root = open_fs(self.root)
        done = [m for m in messages if m is not None and m.files]
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for item in system.get_file_info(fs.FileSelector(root)):
                if item.type == fs.FileType.Directory and item.base_name.startswith("part-"):
                    system.delete_dir(item.path)
        for m in done:
            system.move(m.folder, f"{root}/{m.part}")
        with system.open_output_stream(f"{root}/_committed-{self.job[:8]}.json") as out:
            out.write(json.dumps({"parts": {m.part: m.files for m in done}}).encode())
        self._clear(system, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*open_fs(self.root))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        with contextlib.suppress(OSError):
            system.delete_dir(f"{root}/{STAGED}/{self.job}")
        with contextlib.suppress(OSError):
            if not system.get_file_info(fs.FileSelector(f"{root}/{STAGED}")):  # other jobs may stage there
                system.delete_dir(f"{root}/{STAGED}")


class FileSink(DataSource):
    """``df.select('key', 'data').write.format('files').mode('append').option('path', root).save()``.

    Files appear as ``root/part-*/key`` once all tasks are done.  Rows without key or data
    are passed over; a key that comes twice in a task is an error; ``overwrite`` replaces
    what earlier jobs committed.
    """

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "key string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], overwrite)


# --- metadata blocks ----------------------------------------------------------------


def jpeg_segments(data: bytes) -> tuple[list[tuple[int, bytes]], int]:
    """(marker, body) of the segments before the image data, and where that begins."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG file")
    at, found = 2, []
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack_from(">H", data, at + 2)[0]
        found.append((data[at + 1], data[at + 4 : at + 2 + size]))
        at += 2 + size
    return found, at


ICC, EXIF = b"ICC_PROFILE\0", b"Exif\0\0"


def with_metadata(data: bytes, exif: bytes | None = None, icc: bytes | None = None) -> bytes:
    """The same JPEG or PNG with these blocks in place of its own; ``exif`` is a TIFF block, ``icc`` a profile. Pixels are untouched."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png_with(data, exif, icc)
    old, body = jpeg_segments(data)
    kept = [(m, b) for m, b in old if not (m == 0xE1 and exif is not None and b.startswith(EXIF)) and not (m == 0xE2 and icc is not None and b.startswith(ICC))]
    new = []
    if exif is not None:
        if len(exif) > 65_527:
            raise ValueError("an EXIF block has at most 65,527 bytes")
        new.append((0xE1, EXIF + exif))
    if icc is not None:
        pieces = [icc[k : k + 65_000] for k in range(0, len(icc), 65_000)]
        new += [(0xE2, ICC + bytes([k + 1, len(pieces)]) + p) for k, p in enumerate(pieces)]
    # A JFIF segment stays first, as readers expect it.
    head = 1 if kept and kept[0][0] == 0xE0 else 0
    pack = lambda m, b: bytes([0xFF, m]) + struct.pack(">H", len(b) + 2) + b
    return data[:2] + b"".join(pack(m, b) for m, b in [*kept[:head], *new, *kept[head:]]) + data[body:]


def _png_with(data: bytes, exif: bytes | None, icc: bytes | None) -> bytes:
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    gone = {kind for kind, block in ((b"eXIf", exif), (b"iCCP", icc)) if block is not None}
    new = (chunk(b"iCCP", b"icc\0\0" + zlib.compress(icc)) if icc is not None else b"") + (chunk(b"eXIf", exif) if exif is not None else b"")
    at, out = 8, [data[:8]]
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind not in gone:
            out.append(data[at : at + 12 + size])
        if kind == b"IHDR":
            out.append(new)
        at += 12 + size
    return b"".join(out)
