"""Many small numbers from one set of tasks to another in a few packed rows."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession


def bucket_count(spark: SparkSession) -> int:
    """Buckets for packed numbers: two for each shuffle partition, so that they grow with the cluster's setting."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(rows: np.ndarray, key: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of a structured array, dealt to buckets by ``key``: one (bucket, data) row for each bucket that gets some."""
    to = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    rows, to = rows[order], to[order]
    cut = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to))
    return pa.RecordBatch.from_arrays(
        [pa.array(to[cut[:-1]], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["bucket", "data"])


def unpacked(t: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("data").to_pylist()), kind)


def drop_spent(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now, and not at the driver's next garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
