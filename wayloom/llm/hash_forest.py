"""Nearest neighbours by inner product from a forest of sorted hash strings with variable-length prefix matches.

Each tree gives every vector a long string of bits, one for each random hyperplane. A tree is the sorted list of strings,
so the vectors that share a prefix with a query lie side by side. Per query, all trees descend to their longest matches and
then ascend level by level together until enough candidates are met; these are compared exactly. No query stops below the
level at which the trees keep the wanted share of true neighbours; each run measures it with exact answers of some queries.

On a cluster a tree is dealt out by the first ``shallow`` bits (a block), crowded blocks in slices of bounded size, and the
queries go to the blocks of their own prefix. Ascending stops at the block, so ``shallow`` is chosen from the row count.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep
from .batches import by_group, hash_part

#: Levels below ``shallow`` that trees tell apart.
LEVELS = 20


@dataclass
class Planes:
    """Hyperplanes of all trees (dimensions + 1 x trees * bits), cut points, and the squared length all vectors are filled to."""

    normals: np.ndarray
    cuts: np.ndarray
    trees: int
    bits: int
    top: float

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Strings (rows x trees) as numbers, first bit highest. Candidates are filled to one length by a further
        coordinate, which is 0 for queries, so that angles order as inner products do."""
        fill = np.zeros((len(x), 1)) if query else np.sqrt(np.maximum(self.top - (x * x).sum(1, keepdims=True), 0))
        on = (np.hstack([x, fill]) @ self.normals > self.cuts).reshape(len(x), self.trees, self.bits)
        return on.astype(np.int64) @ (1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64))


def picked(vectors: DataFrame, seed: int, n: int) -> DataFrame:
    """``n`` rows by a hash of ``rep``; the vectors themselves are read only of these."""
    place = F.xxhash64("rep", F.lit(seed))
    last = vectors.select(place.alias("place")).orderBy("place").limit(n).agg(F.max("place")).first()[0]
    return vectors.filter(place <= F.lit(last)).orderBy("rep")


def fit_planes(vectors: DataFrame, dims: int, trees: int, bits: int, sample: int, seed: int = 11) -> Planes:
    """Random hyperplanes, cut at the medians of at most ``sample`` rows so that bits halve the rows."""
    rows = picked(vectors, 42, sample).select("x").collect()
    x = np.array([r.x for r in rows], np.float64).reshape(-1, dims)
    top = vectors.agg(F.max(F.expr("aggregate(x, 0D, (a, v) -> a + cast(v as double) * v)"))).first()[0] or 0.0
    planes = Planes(np.random.default_rng(seed).normal(size=(dims + 1, trees * bits)), np.zeros(trees * bits), trees, bits, top)
    if len(x):
        fill = np.sqrt(np.maximum(top - (x * x).sum(1, keepdims=True), 0))
        planes.cuts = np.median(np.hstack([x, fill]) @ planes.normals, axis=0)
    return planes


def number_kind(vectors: DataFrame, vec_col: str) -> str:
    """``float`` for vectors of such numbers, else ``double``."""
    return "float" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "double"


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, most: int) -> DataFrame:
    """``x``, ``ids`` (its ``most`` smallest ids, ascending) and ``rep`` (the first) of each different vector that takes part."""
    fit = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast(f"array<{number_kind(vectors, vec_col)}>").alias("x")).filter(
        "id is not null and x is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < float('inf'))"
        " and exists(x, v -> v != 0)")
    first = fit.distinct().withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("id"))).filter(F.col("k") <= most)
    return first.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])


def stop_level(found: DataFrame, seekers: DataFrame, planes: Broadcast, k: int, probes: int, share: float) -> int:
    """The longest prefix that at least ``share`` of the ``k`` true neighbours have in common with their query in one of the
    trees; 0 if every prefix loses more. The true neighbours are those of at most ``probes`` queries, compared with all rows."""
    some = picked(seekers, 5, probes).collect()
    if not some:
        return 0
    dims = len(some[0].x)
    asked = found.sparkSession.sparkContext.broadcast((np.array([r.rep for r in some]), np.array([r.x for r in some], np.float64)))

    def run(batches):
        """The best rows of a partition for each probe; ``apart`` is the least difference of their strings over all trees."""
        p, (reps, q) = planes.value, asked.value
        score, near, x = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0, dims))
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                v = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                rep = part.column("rep").to_numpy()
                rough = np.where(reps[:, None] == rep, -np.inf, q @ v.T)
                top = np.argpartition(-rough, min(k, len(v)) - 1, axis=1)[:, :k]
                score = np.hstack([score, np.take_along_axis(rough, top, 1)])
                near, x = np.hstack([near, rep[top]]), np.concatenate([x, v[top]], axis=1)
                best = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                score, near, x = (np.take_along_axis(score, best, 1), np.take_along_axis(near, best, 1),
                                  np.take_along_axis(x, best[:, :, None], 1))
        if score.shape[1]:
            at = p.keys(q, True)
            for i in range(len(q)):
                apart = (at[i] ^ p.keys(x[i], False)).min(1)
                good = np.isfinite(score[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(good.sum(), reps[i])), pa.array(near[i][good]), pa.array(score[i][good]), pa.array(apart[good])],
                                                 ["rep", "near", "score", "apart"])

    exact = found.select("rep", "x").mapInArrow(run, "rep bigint, near bigint, score double, apart bigint")
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    rows = exact.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k).select("apart").collect()
    bits = planes.value.bits
    common = sorted((bits - int(r.apart).bit_length() for r in rows), reverse=True)
    return common[math.ceil(share * len(common)) - 1] if common else 0


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 24, candidates: int = 24 * 3072, slice_rows: int = 16_384,
            sample: int = 8192, probes: int = 200, share: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest found of each query by inner product: ``query_id``, ``rank`` (from 1), the id column and ``score``.

    ``queries`` are rows of ``vectors``; a query's own id is left out. Ties go to the smaller id. ``candidates`` is the number
    of prefix matches over all trees at which ascending may stop; a table of fewer rows is compared whole. Ascending goes on to
    the level at which ``share`` of the true neighbours of ``probes`` queries are met (``stop_level``), whatever the row count;
    where the trees would then meet as many rows as there are, every row is compared once. ``sample`` bounds the rows that the
    cut points are taken from; every row is in the index.

    Rows with a null id, or a vector that is null, empty, zero or has null or non-finite components, take no part; nor do
    vectors of another length than most. Equal vectors are searched once. Rows repeated in full count once. An empty table
    gives an empty result; other columns do not matter.
    """
    spark = vectors.sparkSession
    shape = f"query_id bigint, rank int, {id_col} bigint, score double"
    found = keep(distinct_vectors(vectors, id_col, vec_col, k + 1), "vectors")
    sizes = found.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], shape)
    dims, rows, real = sizes.dims, sizes["count"], np.dtype("<f4" if number_kind(vectors, vec_col) == "float" else "<f8")
    found = found.filter(F.size("x") == dims)
    shallow = max(0, int(math.log2(max(1, rows * trees / (4 * candidates)))))
    bits = min(62, shallow + LEVELS)
    planes = spark.sparkContext.broadcast(fit_planes(found, dims, trees, bits, sample))

    wanted = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vec_col).cast(f"array<{number_kind(vectors, vec_col)}>").alias("x")).filter("query_id is not null")
    asked = keep(wanted.distinct().join(found.select("x", "rep"), "x").select("query_id", "rep"), "asked")
    seekers = found.join(asked.select("rep").distinct(), "rep", "left_semi")
    deepest = stop_level(found, seekers, planes, k, probes, share)
    if trees >= 1 << deepest:  # prefixes that short meet every row, most of them more than once
        deepest, trees = 0, 1
    shallow = min(shallow, deepest)

    def strings(df: DataFrame, query: bool, whole: bool) -> DataFrame:
        """A row for each vector and tree."""
        def run(batches):
            p = planes.value
            for b in batches:
                x = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(real).reshape(-1, dims)
                key = p.keys(x.astype(np.float64), query)
                for t in range(trees):
                    cols = [pa.array(np.full(len(x), t), pa.int32()), pa.array(key[:, t] >> (p.bits - shallow)), pa.array(key[:, t]), b.column("rep")]
                    names = ["tree", "block", "key", "rep"]
                    if whole:
                        cols.append(pa.array([v.tobytes() for v in x], pa.binary()))
                        names.append("x")
                    yield pa.RecordBatch.from_arrays(cols, names)

        return df.select("rep", "x").mapInArrow(run, "tree int, block bigint, key bigint, rep bigint" + ", x binary" * whole)

    place = ["tree", "block"]
    slices = keep(strings(found, False, False).groupBy(*place).count().join(
        strings(seekers, True, False).groupBy(*place).agg(F.count("*").alias("asked")), place).select(
        *place, F.ceil(F.col("count") / slice_rows).cast("int").alias("n"), F.ceil(F.col("asked") / slice_rows).cast("int").alias("m")), "slices")

    def dealt(whole: bool, levels: DataFrame | None = None) -> DataFrame:
        """Rows and queries of a block side by side in units of bounded size: each slice of rows meets each slice of queries."""
        have = strings(found, False, whole).join(slices, place).select(
            "*", hash_part("rep", F.col("n")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(0).alias("ask"))
        ask = strings(seekers, True, whole).join(slices, place).select(
            "*", hash_part("rep", F.col("m")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), F.lit(1).alias("ask"))
        have = have.withColumn("level", F.lit(0))
        ask = ask.join(levels, "rep") if levels is not None else ask.withColumn("level", F.lit(0))
        names = [*place, "i", "j", "ask", "key", "rep", "level"] + ["x"] * whole
        return have.select(*names).unionAll(ask.select(*names))

    unit = [*place, "i", "j"]

    def ranges(t: pa.Table):
        """The sorted keys of the rows of a unit, the queries' keys, and where the first query is."""
        ask = t.column("ask").to_numpy()
        cut = int(np.searchsorted(ask, 1))
        key = t.column("key").to_numpy()
        return key[:cut], key[cut:], cut

    def count(t: pa.Table):
        have, ask, cut = ranges(t)
        if not len(have) or not len(ask):
            return None
        met = []
        for up in range(bits - shallow + 1):  # 0: the whole string
            low = ask >> up << up
            met.append(np.searchsorted(have, low + (1 << up)) - np.searchsorted(have, low))
        return {"rep": t.column("rep").to_numpy()[cut:].tolist(), "met": np.array(met).T.tolist()}

    met = by_group(dealt(False), unit, ["ask", "key", "rep"], count, "rep bigint, met array<bigint>")
    depth = bits - shallow + 1
    total = met.groupBy("rep").agg(F.array(*[F.sum(F.col("met")[u]) for u in range(depth)]).alias("met"))
    # the longest common level at which the trees together have met enough; the block itself if none has
    level = F.coalesce(F.array_position(F.transform("met", lambda v: v >= candidates), True), F.lit(0))
    level = F.greatest(F.when(level == 0, depth - 1).otherwise(level - 1), F.lit(bits - deepest))
    levels = keep(total.select("rep", level.cast("int").alias("level")), "levels")

    def search(t: pa.Table):
        have, ask, cut = ranges(t)
        if not len(have) or not len(ask):
            return None
        x = np.frombuffer(b"".join(t.column("x").to_pylist()), real).reshape(-1, dims).astype(np.float64)
        size, slack = np.sqrt((x * x).sum(1)), 4 * dims * np.finfo(np.float64).eps
        rep, up = t.column("rep").to_numpy(), t.column("level").to_numpy()[cut:].astype(np.int64)
        low = ask >> up << up
        lo, hi = np.searchsorted(have, low), np.searchsorted(have, low + (np.int64(1) << up))
        out: dict[str, list] = {"rep": [], "near": [], "score": []}
        span, member = np.unique(np.stack([lo, hi], 1), axis=0, return_inverse=True)
        for s, (a, b) in enumerate(span):
            if a == b:
                continue
            who = np.flatnonzero(member.ravel() == s)
            for part in np.array_split(who, max(1, len(who) * (b - a) // 4_000_000)):
                rough = x[cut + part] @ x[a:b].T
                n = min(k + 1, b - a)
                # all rows that rounding may have put below the n-th, then in exact order, ties by id
                least = np.partition(rough, b - a - n, axis=1)[:, b - a - n] - slack * size[cut + part] * size[a:b].max()
                who_, near_ = np.nonzero(rough >= least[:, None])
                for lo in range(0, len(who_), 1 << 18):
                    lo_hi = slice(lo, lo + (1 << 18))
                    rough[who_[lo_hi], near_[lo_hi]] = (x[cut + part[who_[lo_hi]]] * x[a + near_[lo_hi]]).sum(-1)  # one order of adding for all
                score = rough[who_, near_]
                order = np.lexsort((rep[a + near_], -score, who_))
                place = np.arange(len(order)) - np.searchsorted(who_[order], who_[order])
                order = order[place < n]
                out["rep"] += rep[cut + part[who_[order]]].tolist()
                out["near"] += rep[a + near_[order]].tolist()
                out["score"] += score[order].tolist()
        return out

    pairs = by_group(dealt(True, levels), unit, ["ask", "key", "rep"], search, "rep bigint, near bigint, score double").distinct()
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    kept = pairs.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= k + 1).drop("k")
    members = kept.join(found.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias(id_col))
    full = asked.join(members, "rep").filter(F.col("query_id") != F.col(id_col))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return full.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
