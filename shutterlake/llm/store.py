"""Folders that all executors share, and whole files in them.

Jobs that write their own file formats put them below the session's
``spark.checkpoint.dir``.  Workers reach it through ``pyarrow.fs``, so the folder
may be local (tests), on HDFS or in an object store.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one (tests) gets a folder of its own; elsewhere that is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shutterlake-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place for scratch files, which ``release`` removes: when called, or else as the driver ends."""
    if not _made:
        atexit.register(release)
    _made.append(f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release() -> None:
    """Removes all scratch folders of this driver. Frames that read them can't be used any more."""
    while _made:
        with contextlib.suppress(OSError):
            system, path = open_fs(_made.pop())
            system.delete_dir(path)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextlib.contextmanager
def writing(uri: str):
    """A stream whose file appears under its name only when complete, so that a
    task that is tried again, or runs twice, leaves one whole file."""
    system, path = open_fs(uri)
    moves = system.type_name in ("local", "hdfs")
    if moves:
        system.create_dir(path.rpartition("/")[0], recursive=True)
    target = f"{path}.{uuid.uuid4().hex}.part" if moves else path
    try:
        with system.open_output_stream(target) as out:
            yield out
        if moves:
            system.move(target, path)
    except BaseException:
        with contextlib.suppress(OSError):
            system.delete_file(target)
        raise


def reading(uri: str):
    system, path = open_fs(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    system, path = open_fs(uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_file(path)


_kept: dict[str, Callable[[], None]] = {}
_now = [""]


def starts(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Called where a task of an operator begins. Spark uses worker processes again, so one that served another operator lets go of that one's tables.

    ``forget`` drops what this operator keeps in a worker.
    """
    if forget:
        _kept[operator] = forget
    if _now[0] != operator:
        for other in [k for k in _kept if k != operator]:
            _kept.pop(other)()
        _now[0] = operator
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError, OSError):  # the C library keeps freed memory, where it is one that can be asked
            ctypes.CDLL(None).malloc_trim(0)


def spread(rows):
    """Rows of fewer files than the session has cores, dealt over all cores: a file may be one row group, which is one task.

    Tables of many files are left as they are; the shuffle is of a few files at most.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < len(rows.inputFiles()) < cores else rows


def materialize(df, name: str):
    """Writes a frame below the shared folder and reads it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
