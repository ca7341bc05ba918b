"""Hard negatives by exact integer inner products, scored with the Four Russians' tables.

Vectors become integers. A candidate is kept as bit planes: one bit of all dimensions, eight dimensions to a byte. For each
anchor and each group of eight dimensions there is a table of the sums of all 256 subsets of the anchor's components, so a
plane's share of the score is one lookup for each byte; the planes are added from the highest down, shifting by one.

Anchors in blocks meet all rows in slices, unit by unit. The first pass meets rows of the anchor's own label and finds its
positives; the second meets all rows and finds, for each positive, the best rows of other labels between the two bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep, keep_counted
from .batches import by_group, hash_part

#: Rows and anchors that are scored in one step, so that tables and sums stay in the processor's cache.
STEP_ROWS, STEP_ANCHORS = 1024, 256


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Two's complement of rows of integers: rows x planes (lowest first) x bytes of eight dimensions."""
    return np.packbits(((x[:, None, :] >> np.arange(bits)[:, None]) & 1).astype(np.uint8), axis=2, bitorder="little")


def from_planes(planes: np.ndarray, dims: int) -> np.ndarray:
    on = np.unpackbits(planes, axis=2, bitorder="little")[:, :, :dims].astype(np.int64)
    weight = np.int64(1) << np.arange(planes.shape[1], dtype=np.int64)
    weight[-1] = -weight[-1]
    return (on * weight[:, None]).sum(1)


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """Groups x 256 x anchors: the sum of the components that a byte's bits choose."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    whole = np.zeros((n, groups * 8), kind)
    whole[:, :dims] = anchors
    out = np.zeros((groups, 256, n), kind)
    for bit in range(8):
        out[:, 1 << bit:2 << bit] = out[:, :1 << bit] + whole[:, bit::8].T[:, None, :]
    return out


def scores(anchors: np.ndarray, planes: np.ndarray, bound: int) -> np.ndarray:
    """Anchors x rows: all inner products. ``bound`` is above every sum on the way."""
    kind = np.int32 if bound < 1 << 31 else np.int64
    out = np.empty((len(anchors), len(planes)), np.int64)
    bits, groups = planes.shape[1:]
    for a in range(0, len(anchors), STEP_ANCHORS):
        table = subset_sums(anchors[a:a + STEP_ANCHORS], kind)
        for r in range(0, len(planes), STEP_ROWS):
            part = planes[r:r + STEP_ROWS]
            total = np.zeros((len(part), table.shape[2]), kind)
            found = np.empty_like(total)
            for k in range(bits - 1, -1, -1):
                for g in range(groups):
                    np.take(table[g], part[:, k, g], axis=0, out=found)
                    total += found
                if k == bits - 1:  # the sign's plane
                    np.negative(total, out=total)
                if k:
                    total += total
            out[a:a + STEP_ANCHORS, r:r + STEP_ROWS] = total.T
    return out


def _first(score: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` best of ``among`` (ascending places), ties by place."""
    if len(among) > n:
        s = score[among]
        among = among[s >= np.partition(s, len(s) - n)[len(s) - n]]
    return among[np.argsort(-score[among], kind="stable")][:n]


def hard_negatives(vectors: DataFrame, is_anchor: Column | str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, block: int = 1024, slice_rows: int = 16_384, id_col: str = "vec_id", vec_col: str = "embedding",
                   label_col: str = "label") -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score`` and ``negative_score``.

    A score is the inner product of floor(scale * component). The positives of a row that ``is_anchor`` (a condition on the
    input's columns) are the ``positives`` best other rows of its label; for each of them, the ``negatives`` best rows of
    another label that score at least ``low`` and at most ``high`` percent of it come back. Higher scores first, ties by the
    smaller id; all, if there are fewer.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do empty vectors or those of
    another length than most. Rows repeated in full count once; different rows of one id are rows of their own. An empty
    table, or one without anchors, gives an empty result; other columns do not matter. Scores beyond a long raise ValueError.

    Shuffled are each row once for each block of anchors and each anchor once for each slice of rows; of each unit at most
    ``negatives`` rows for each anchor and positive.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    x = F.transform(F.col(vec_col), lambda v: F.floor(v.cast("double") * scale))
    fit = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vec_col) > 0)
                         & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))))
    top = F.greatest(*[F.abs(f(vec_col).cast("double")) for f in (F.array_max, F.array_min)])
    sizes = fit.groupBy(F.size(vec_col).alias("dims")).agg(F.count("*").alias("n"), F.max(top).alias("top")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return empty
    dims, most = sizes.dims, int(sizes.top * scale) + 2
    bits = most.bit_length() + 1
    bound = dims * most << bits
    if bound * 100 >= 1 << 63:
        raise ValueError("scores of these vectors do not fit into a long")
    groups = -(-dims // 8)

    def pack(batches):
        for b in batches:
            q = b.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)
            planes = pa.array([p.tobytes() for p in bit_planes(q, bits)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("ask"), planes], ["id", "label", "ask", "x"])

    asks = F.coalesce(F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor, F.lit(False)).cast("int")
    packed = fit.filter(F.size(vec_col) == dims).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), asks.alias("ask"), x.alias("x")).mapInArrow(
        pack, "id bigint, label bigint, ask int, x binary")
    rows, count = keep_counted(packed.distinct().withColumn("row", F.monotonically_increasing_id()), "rows", n=F.count("*"), asked=F.sum("ask"))
    if not count["asked"]:
        return empty

    def planes_of(t: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(t.column("x").to_pylist()), np.uint8).reshape(-1, bits, groups)

    def unit(t: pa.Table):
        """Rows in order of id, anchors, and all their scores."""
        cut = int(np.searchsorted(t.column("ask").to_numpy(), 1))
        if not cut or cut == t.num_rows:
            return None
        planes = planes_of(t)
        return t.slice(0, cut), t.slice(cut), scores(from_planes(planes[cut:], dims), planes[:cut], bound)

    def dealt(have: DataFrame, ask: DataFrame, n: Column, m: Column, extra: list[str]) -> DataFrame:
        """Each of ``n`` slices of rows beside each of ``m`` blocks of anchors."""
        have = have.select("*", hash_part("row", n).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), m - 1)).alias("j")).withColumn("ask", F.lit(0))
        ask = ask.select("*", hash_part("row", m).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).withColumn("ask", F.lit(1))
        names = ["i", "j", "ask", "label", "id", "row", "x"]
        none = [F.lit(None).cast("array<bigint>").alias(e) for e in extra]
        return have.select(*names, *none).unionAll(ask.select(*names, *extra))

    def near(t: pa.Table):
        got = unit(t)
        if got is None:
            return None
        have, ask, score = got
        ids, row, out = have.column("id").to_numpy(), have.column("row").to_numpy(), {"row": [], "positive_id": [], "positive": [], "score": []}
        for s, own in zip(score, ask.column("row").to_numpy()):
            best = _first(s, np.flatnonzero(row != own), positives)
            out["row"] += [own] * len(best)
            out["positive_id"] += ids[best].tolist()
            out["positive"] += row[best].tolist()
            out["score"] += s[best].tolist()
        return out

    anchors = rows.filter("ask = 1")
    labels = keep(rows.groupBy("label").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("n"),
                                            F.ceil(F.sum("ask") / block).cast("int").alias("m")).filter("m > 0"), "labels")
    found = by_group(dealt(rows.join(labels, "label"), anchors.join(labels, "label"), F.col("n"), F.col("m"), []), ["label", "i", "j"],
                     ["ask", "id", "row"], near, "row bigint, positive_id bigint, positive bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "positive_id", "positive"))
    chosen = found.withColumn("k", place).filter(F.col("k") <= positives)
    wanted = keep(anchors.join(chosen.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "positive_id", "score"))).alias("p")), "row").select(
        "label", "id", "row", "x", F.col("p.positive_id").alias("positive_ids"), F.col("p.score").alias("levels")), "anchors")

    def hard(t: pa.Table):
        got = unit(t)
        if got is None:
            return None
        have, ask, score = got
        ids, row, label = have.column("id").to_numpy(), have.column("row").to_numpy(), have.column("label").to_numpy()
        out: dict[str, list] = {n: [] for n in ("row", "k", "anchor_id", "positive_id", "positive_score", "negative", "negative_id", "negative_score")}
        mine = zip(score, *(ask.column(c).to_pylist() for c in ("row", "id", "label", "positive_ids", "levels")))
        for s, own, anchor, lab, names, levels in mine:
            other = label != lab
            for k, (name, level) in enumerate(zip(names, levels)):
                best = _first(s, np.flatnonzero(other & (s <= high * level // 100) & (s >= -(-low * level // 100))), negatives)
                for col, v in (("row", own), ("k", k), ("anchor_id", anchor), ("positive_id", name), ("positive_score", level)):
                    out[col] += [v] * len(best)
                out["negative"] += row[best].tolist()
                out["negative_id"] += ids[best].tolist()
                out["negative_score"] += s[best].tolist()
        return out

    slices, blocks = -(-count["n"] // slice_rows), -(-count["asked"] // block)
    hits = by_group(dealt(rows, wanted, F.lit(slices), F.lit(blocks), ["positive_ids", "levels"]), ["i", "j"], ["ask", "id", "row"], hard,
                    "row bigint, k int, anchor_id bigint, positive_id bigint, positive_score bigint, negative bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("row", "k").orderBy(F.desc("negative_score"), "negative_id", "negative")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).select(*empty.columns)
