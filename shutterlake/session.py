"""Session defaults for stand-alone use; on a cluster the submitted configuration wins."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shutterlake")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which the driver and all executors share. A local session without one gets a folder of its own; elsewhere that is an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shutterlake-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get().rstrip("/")


_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A place of its own for a table below the shared folder, removed as the driver ends."""
    if not _made:
        atexit.register(release)
    _made.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def release() -> None:
    """Removes the folders of this driver; frames that read them can't be used any more."""
    from pyarrow import fs

    while _made:
        with contextlib.suppress(OSError):
            system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", _made.pop()))
            system.delete_dir(path)


#: Rows that one task makes of what ``dealt`` gave it, about.
TASK_ROWS = 1 << 21


def dealt(rows: DataFrame, key: str, each: int, n: int | None = None) -> DataFrame:
    """The rows hashed by ``key`` over as many tasks as bound what each makes of them, if every row becomes ``each``.

    Small rows that grow (a photo into its pixels) are dealt before they do; Spark would plan
    by their size on disk.  What is grouped by ``key`` afterwards needs no further shuffle.
    ``n``: how many rows become ``each``, if not all that are dealt do.
    """
    n = rows.count() if n is None else n
    spread = min(n, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(max(1, spread, -(-n * each // TASK_ROWS)), key)


def settled(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The same rows from a table in the shared folder: what made them isn't planned or run again, whichever executors are lost."""
    path = new_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
