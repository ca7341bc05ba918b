"""Session set-up and the shared-folder tables that cut lineage in iterative jobs."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "wayloom", cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("WAYLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def state_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, or a local one on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="wayloom-state-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def must_fall(before: int, after: int, what: str) -> None:
    """Raise when a round of a loop has settled nothing, as no later one would."""
    if after >= before:
        raise RuntimeError(f"{what}: a round settled none of {after} rows")


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


#: How many bytes of rows a byte of a written table is taken to hold; ids and tile keys often pack as tightly as that.
PACKED = 32
#: Seconds between two collections in the driver's JVM.
COLLECT_EVERY = 15.0
_collected = 0.0


def keep(df: DataFrame, name: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short plan that survives lost executors.

    Spark takes the size of the files for that of the rows when it chooses what to broadcast through the driver. Files of
    ids are many times smaller than their rows, so the session is told unless it has a factor of its own.
    """
    spark = df.sparkSession
    path = f"{state_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", str(float(PACKED)))
    _drop_shuffles(spark)
    kept = spark.read.schema(df.schema).parquet(path)
    _PLACES[kept] = path
    return kept


def is_kept(df: DataFrame) -> bool:
    """Whether ``df`` is a table that ``keep`` has written and nobody has forgotten."""
    return df in _PLACES


#: Rows of a kept table that may travel through the driver, some tens of MB when they are ids and hashes.
FEW = 500_000


def few(kept: DataFrame, columns: DataFrame | None = None, rows: int = FEW) -> DataFrame:
    """``kept``, or ``columns`` taken from it, marked for broadcast when the kept table has at most ``rows`` rows.

    For joins of something very wide with something that is nearly always small. Rows are counted in the footers of the
    files, since sizes are guessed with care for tables that pack tightly.
    """
    out = kept if columns is None else columns
    return F.broadcast(out) if kept.count() <= rows else out


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that were written down: it does so when the driver's JVM collects
    garbage, which small drivers of long jobs do too seldom. Short jobs never come to it."""
    global _collected
    now = time.monotonic()
    if now - _collected >= COLLECT_EVERY:
        if _collected:
            spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()


def forget(*spent: DataFrame) -> None:
    """Delete the folders of tables that ``keep`` has written, once nothing is going to read them any more.

    Loops call it for the state of an earlier round when the next one has been written. Other DataFrames are left alone.
    """
    for df in spent:
        path = _PLACES.pop(df, None)
        if path is not None:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def keep_counted(df: DataFrame, name: str = "state", **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``keep`` plus some aggregates of the written rows, taken during the same write."""
    seen = Observation()
    kept = keep(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name)
    return kept, {n: v or 0 for n, v in seen.get.items()}
