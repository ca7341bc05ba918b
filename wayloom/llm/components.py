"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import keep_counted

#: Links that one task finishes; more of them go through rounds over all tasks first.
FEW = 200_000


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``v`` and ``root`` (smallest reachable number) of each vertex of the links ``a``-``b``, except roots themselves.

    Each round hangs every vertex's larger neighbours onto its smallest one, then its smaller neighbours likewise, until
    nothing moves or at most ``few`` links are left, which one task goes through (some megabytes). Rounds grow with the
    logarithm of a component's size. Each round is written to the shared folder.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()

    def sums(df: DataFrame, name: str):
        return keep_counted(df, name, n=F.count("*"), s=F.sum(F.xxhash64("a", "b").cast("decimal(30,0)")))

    now, mark = sums(ordered(edges), "links")
    while mark["n"] > few:
        # large star: the larger neighbours of each vertex go to its smallest neighbour (or itself)
        both = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = ordered(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: each vertex and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        after, next_mark = sums(ordered(small), "links")
        if next_mark == mark:
            return now.select(F.col("a").alias("v"), F.col("b").alias("root"))
        now, mark = after, next_mark

    def finish(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((find(a), find(b)))
                root[high] = low
        got = [(v, find(v)) for v in root]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, r in got if v != r], pa.int64()), pa.array([r for v, r in got if v != r], pa.int64())], ["v", "root"])

    return now.coalesce(1).mapInArrow(finish, "v bigint, root bigint")
