"""Patches, splits, draws and fixed-width samples. Draws hang on a seed and the row's keys, so a task that runs
again, or data laid out differently, draws the same."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import KEY, dense_ids

# Fixed value: samples per epoch of the small-tile data.
SMALL_TILE_EPOCH = 84_667


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in [0, 1) from seed and keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def gaussian(seed: int, *keys: str | Column) -> Column:
    u = F.greatest(uniform(seed, *keys), F.lit(1e-12))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * uniform(seed + 1_000_003, *keys))


def jitter(points: DataFrame, seed: int, sigma: float = 1.0, keys: Sequence[str] = ("tile_id", "patch_id", "pid")) -> DataFrame:
    """Add normal noise to px, py."""
    return points.withColumns({
        "px": F.col("px") + sigma * gaussian(seed, *keys, F.lit("x")),
        "py": F.col("py") + sigma * gaussian(seed, *keys, F.lit("y"))})


def split_of(tile: Column) -> Column:
    """The numbered split of the large tiles; NULL beyond tile 179."""
    return (
        F.when((tile < 0) | (tile >= 180), F.lit(None).cast("string"))
        .when(tile % 10 < 8, F.lit("train"))
        .when((tile % 10 == 9) | (tile % 20 == 8), F.lit("test"))
        .when(tile % 20 == 18, F.lit("validation"))
    )


def training_tiles(splits: DataFrame) -> DataFrame:
    """Training uses the train and validation tiles together."""
    train = splits.filter("split = 'train'").select(*KEY)
    return train.unionByName(splits.filter("split = 'validation'").select(*KEY))


def all_split_tiles(splits: DataFrame) -> DataFrame:
    order = ("test", "validation", "train")
    parts = [splits.filter(F.col("split") == s).select(*KEY, "split") for s in order]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def first_tiles(tiles: DataFrame, k: int = 4) -> DataFrame:
    """The first k tiles, for a trial run."""
    return tiles.select(*KEY).distinct().orderBy(*KEY).limit(k)


def patch_grid(tiles: DataFrame, size: int, patch: int, margin: int, per_edge: int) -> DataFrame:
    """Evenly spread patches per tile, corners rounded half to even, x first: (tile_id, patch_id, x0, y0, x1, y1)."""
    low, high = margin, size - (patch + margin)
    step = (high - low) / (per_edge - 1) if per_edge > 1 else 0.0
    at = lambda i: F.bround(F.lit(float(low)) + i * F.lit(float(step))).cast("int")
    axis = F.sequence(F.lit(0), F.lit(per_edge - 1))
    cells = tiles.select(*KEY).withColumn("_i", F.explode(axis)).withColumn("_j", F.explode(axis))
    x, y = at(F.col("_i")), at(F.col("_j"))
    return cells.select(
        *KEY, (F.col("_i") * per_edge + F.col("_j")).cast("bigint").alias("patch_id"),
        x.alias("x0"), y.alias("y0"), (x + patch).alias("x1"), (y + patch).alias("y1"))


def evaluation_grid(tiles: DataFrame, size: int, patch: int, margin: int) -> DataFrame:
    return patch_grid(tiles, size, patch, margin, math.ceil((size - 2 * margin) / patch))


def epoch_length(size: int, patch: int, small: bool = False) -> int:
    return SMALL_TILE_EPOCH if small else max(1, int(size / patch)) ** 2 * 2500


def random_patches(tiles: DataFrame, n: int, size: int, patch: int, margin: int, seed: int) -> DataFrame:
    """n patches with uniform tile, corner and quarter turn: (patch_id, tile_id, x0, y0, x1, y1, turns)."""
    listed = tiles.select(*KEY).distinct()
    numbered = dense_ids(listed.withColumn("_all", F.lit(0)), ["tile_id"], "_t", [F.floor(F.xxhash64("tile_id") / (1 << 50))], by=("_all",))
    total = listed.count()
    span = size - (patch + margin) - margin + 1
    draw = tiles.sparkSession.range(n).withColumnRenamed("id", "patch_id")
    pick = lambda salt, m: F.floor(uniform(seed, "patch_id", F.lit(salt)) * m)
    draw = draw.withColumns({
        "_t": pick("tile", total).cast("bigint"), "x0": (pick("x", span) + margin).cast("int"),
        "y0": (pick("y", span) + margin).cast("int"), "turns": pick("turn", 4).cast("int")})
    out = draw.join(numbered.select("_t", *KEY), "_t")
    return out.select("patch_id", *KEY, "x0", "y0", (F.col("x0") + patch).alias("x1"), (F.col("y0") + patch).alias("y1"), "turns")


#: Units that a weight of one is cut into.
WEIGHT_UNITS = 1_000_000


def weighted_draws(points: DataFrame, n: int, seed: int, group: Sequence[str] = ("tile_id", "patch_id"), bins: int = 64) -> DataFrame:
    """n draws with replacement per group, by ``weight``: (group, sample_id, pid).

    Weights run up inside a group (a patch after thinning, so a bounded number of points), in whole numbers of a
    millionth. Draws meet the points whose interval shares their bin, not every point of the group; each draw meets one.
    """
    group = list(group)
    before = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # whole numbers leave no gap between neighbours and none at the end; a group without any weight draws evenly
    parts = points.select(*group, "pid", F.round(F.coalesce("weight", F.lit(0.0)) * WEIGHT_UNITS).cast("bigint").alias("_k"))
    parts = parts.withColumn("_k", F.when(F.sum("_k").over(Window.partitionBy(*group)) > 0, F.col("_k")).otherwise(F.lit(1)))
    spans = parts.select(*group, "pid", F.sum("_k").over(before).alias("_hi"), "_k", F.sum("_k").over(Window.partitionBy(*group)).alias("_all"))
    spans = spans.filter("_k > 0").withColumn("_lo", F.col("_hi") - F.col("_k"))
    totals = spans.groupBy(*group).agg(F.max("_all").alias("_all"))
    spans = spans.withColumn("_bin", F.explode(F.expr(f"sequence(_lo * {bins} div _all, (_hi - 1) * {bins} div _all)")))
    draws = totals.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_u", F.least(F.floor(uniform(seed, *group, "sample_id") * F.col("_all")).cast("bigint"), F.col("_all") - 1))
    # many draws come of each total, which Spark does not see when it looks for small tables to broadcast
    draws = draws.withColumn("_bin", F.expr(f"_u * {bins} div _all")).drop("_all").hint("merge")
    return draws.join(spans, [*group, "_bin"]).filter("_u >= _lo and _u < _hi").select(*group, "sample_id", "pid")


def pad_samples(pairs: DataFrame, width: int, group: Sequence[str] = ("tile_id", "patch_id", "sample_id", "src")) -> DataFrame:
    """One row per sample with exactly ``width`` targets: real ones by rank, then (src, not connected, not valid).

    ``pairs``: (group, rank, dst, connected), at most ``width`` per sample, else the query fails; dst may be NULL for a
    sample without targets.
    """
    e = F.when(F.col("dst").isNotNull(), F.struct("rank", "dst", "connected", F.lit(True).alias("valid")))
    lists = pairs.groupBy(*group).agg(F.sort_array(F.collect_list(e)).alias("_l"))
    filler = F.struct(F.lit(None).cast("bigint").alias("rank"), F.col("src").alias("dst"), F.lit(False).alias("connected"), F.lit(False).alias("valid"))
    full = F.slice(F.concat("_l", F.array_repeat(filler, width)), 1, width)
    full = F.when(F.size("_l") > width, F.raise_error(F.lit(f"a sample has more than {width} targets"))).otherwise(full)
    return lists.withColumn("_l", full).select(
        *group, F.transform("_l", lambda x: x["dst"]).alias("targets"),
        F.transform("_l", lambda x: x["connected"]).alias("connected"), F.transform("_l", lambda x: x["valid"]).alias("valid"))


def in_batches(patches: DataFrame, size: int, seed: int | None = None, group: Sequence[str] = ("tile_id", "patch_id")) -> DataFrame:
    """Deal patches to batches of ``size``, the last one maybe smaller: (group, batch, slot).

    With a seed the order is drawn, else it is that of the keys. Repeated patches count once.
    """
    ids = patches.select(*group).distinct().withColumn("_all", F.lit(0))
    order, chunk = list(group), [F.col(group[0])]
    if seed is not None:
        ids = ids.withColumn("_h", F.xxhash64(F.lit(seed), *group))
        order, chunk = ["_h", *group], [F.shiftright("_h", 48)]
    numbered = dense_ids(ids, order, "_n", chunk, by=("_all",))
    return numbered.select(*group, F.expr(f"_n div {size}").alias("batch"), F.expr(f"_n % {size}").alias("slot"))


def pad_points(
    points: DataFrame, patches: DataFrame, group: Sequence[str] = ("tile_id", "patch_id"), batches: DataFrame | None = None
) -> DataFrame:
    """Point list of each patch, filled with (0, 0) up to the longest list; an empty patch gets one such point.

    Patch-local numbers exist only here: the k-th entry is the k-th point by id. With ``batches`` (see ``in_batches``)
    lists are only as long as the longest of their batch, and the columns ``batch`` and ``slot`` are added.
    """
    group = list(group)
    lists = points.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("pid", "px", "py"))).alias("_l"))
    all_ = patches.select(*group).distinct()
    if batches is not None:
        many = points.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        wide = batches.join(many, group, "left").groupBy("batch").agg(F.greatest(F.max(F.coalesce("_n", F.lit(0))), F.lit(1)).cast("int").alias("_w"))
        all_ = all_.join(batches, group).join(wide, "batch")
    all_ = all_.join(lists, group, "left").withColumn("_l", F.coalesce("_l", F.array().cast(lists.schema["_l"].dataType)))
    if batches is None:
        longest = F.lit(max(1, all_.agg(F.max(F.size("_l"))).first()[0] or 0))
    else:
        longest = F.col("_w")
    zero = F.array_repeat(F.array(F.lit(0.0), F.lit(0.0)), longest)
    xy = F.transform("_l", lambda e: F.array(e["px"].cast("double"), e["py"].cast("double")))
    return all_.select(
        *group, *(["batch", "slot"] if batches is not None else []),
        F.transform("_l", lambda e: e["pid"]).alias("pids"), F.slice(F.concat(xy, zero), F.lit(1), longest).alias("points"))


def with_local_ids(samples: DataFrame, points: DataFrame, group: Sequence[str] = ("tile_id", "patch_id")) -> DataFrame:
    """``src`` and ``dst`` as places in the point list of their patch, as ``pad_points`` orders it. An end that is no
    point of the patch fails the query."""
    group = list(group)
    place = F.row_number().over(Window.partitionBy(*group).orderBy("pid")) - 1  # a patch's points, bounded by thinning
    at = points.select(*group, "pid", place.cast("bigint").alias("_at"))
    out = samples
    for end in ("src", "dst"):
        known = F.when(F.col(end).isNotNull(), F.coalesce("_at", F.raise_error(F.lit("a sample's end is no point of its patch")).cast("bigint")))
        out = out.join(at.withColumnRenamed("pid", end), [*group, end], "left").withColumn(end, known).drop("_at")
    return out


def export_samples(
    points: DataFrame, samples: DataFrame, patches: DataFrame, n: int, width: int, batch: int, seed: int | None = None,
    group: Sequence[str] = ("tile_id", "patch_id"),
) -> tuple[DataFrame, DataFrame]:
    """Rows of equal shape for training, as two tables that (batch, slot) links.

    Points: (group, batch, slot, pids, points), lists as long as the longest of the batch. Samples: (group, batch, slot,
    sample_id, pairs, connected, valid), ``width`` pairs (source, target) of places in the point list; filled up with
    (source, source), neither connected nor valid. A patch without points has one point (0, 0) and ``n`` samples of
    pairs (0, 0). ``samples``: (group, sample_id, src, rank, dst, connected), dst null for a source without targets.
    """
    group = list(group)
    batches = in_batches(patches, batch, seed, group)
    local = pad_samples(with_local_ids(samples, points, group), width, (*group, "sample_id", "src"))
    full = empty_patch_samples(patches, local, n, width, group)
    pairs = F.transform("targets", lambda t: F.array(F.col("src"), t)).alias("pairs")
    return pad_points(points, patches, group, batches), full.join(batches, group).select(
        *group, "batch", "slot", "sample_id", pairs, "connected", "valid")


def empty_patch_samples(patches: DataFrame, samples: DataFrame, n: int, width: int, group: Sequence[str] = ("tile_id", "patch_id")) -> DataFrame:
    """Samples for export: a patch without points gets n samples of ``width`` pairs (0, 0), none valid."""
    bare = patches.select(*group).join(samples.select(*group).distinct(), list(group), "left_anti")
    no = F.array_repeat(F.lit(False), width)
    zero = F.array_repeat(F.lit(0).cast("bigint"), width)
    fake = bare.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(
        *group, "sample_id", F.lit(0).cast("bigint").alias("src"), zero.alias("targets"), no.alias("connected"), no.alias("valid"))
    return samples.select(*fake.columns).unionByName(fake)
