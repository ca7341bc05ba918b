"""Spatial joins: grid cells turn distance and box predicates into equi-joins.

A cell that holds very many rows, on either side, is cut into blocks: the rows of both sides are dealt by number and
each part of one side meets each part of the other, so one crowded place never ends up in one task and no pair is lost.
Boxes of very different sizes lie in grids of several levels, so a long box fills no more cells than a short one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

KEY = ("tile_id",)
ROWS_PER_SLICE = 200_000


def _dealt(df: DataFrame, parts: Column, own: str) -> DataFrame:
    """Number the rows of crowded keys and deal them over ``parts``.

    Equal rows get numbers of their own. Rows are ordered by two hashes inside their partition first, so a task that runs
    again deals the same rows to the same parts whatever the order in which it fetched them. Other rows are not ordered.
    """
    crowded = parts > 1
    values = [F.col(c) for c in df.columns if not c.startswith("_parts")]
    return (
        df.sortWithinPartitions(F.when(crowded, F.xxhash64(*values)), F.when(crowded, F.hash(*values)))
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn(own, F.pmod("_row", parts).cast("int"))
        .drop("_row")
    )


def slice_hot_keys(left, right, keys: Sequence[str], rows_per_slice: int = ROWS_PER_SLICE, both: bool = True):
    """Add a ``_slice`` column to both sides so that (keys, _slice) joins to the same pairs as ``keys``.

    A key with L rows on the left and R on the right gets a = L / rows_per_slice by b = R / rows_per_slice blocks; a left
    row goes to the b blocks of its part, a right row to its a, and each pair meets in one block. ``both=False``, for a right side
    with few rows a key or a join that keeps rows of the left without partners, counts and cuts the left side alone.

    Both sides are counted in one pass with partial counts. All crowded keys are in the list that is broadcast. It has
    one row for more than ``rows_per_slice`` rows of data, so its size is bounded: some megabytes for a thousand million
    rows. Maps cannot be hashed and are refused by Spark.
    """
    side = lambda df, l, r: df.select(*keys, F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    counted = side(left, 1, 0).unionByName(side(right, 0, 1)) if both else side(left, 1, 0)
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.sum(c) / rows_per_slice)).cast("int")
    hot = F.broadcast(
        counted.groupBy(*keys).agg(parts("_l").alias("_parts_l"), parts("_r").alias("_parts_r"))
        .filter("_parts_l > 1 or _parts_r > 1"))
    a, b = F.coalesce("_parts_l", F.lit(1)), F.coalesce("_parts_r", F.lit(1))
    left = _dealt(left.join(hot, list(keys), "left"), a, "_a")
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0), b - 1)))
    right = right.join(hot, list(keys), "left")
    right = _dealt(right, b, "_b") if both else right.withColumn("_b", F.lit(0))
    right = right.withColumn("_a", F.explode(F.sequence(F.lit(0), a - 1)))
    block = (F.col("_a") * b + F.col("_b")).alias("_slice")
    done = lambda df: df.select(*[c for c in df.columns if c not in ("_a", "_b", "_parts_l", "_parts_r")], block)
    return done(left), done(right)


def sliced_join(
    left, right, keys: Sequence[str], how: str = "inner", rows_per_slice: int = ROWS_PER_SLICE, rows: int | None = None,
    both: bool = True, parts: int | None = None,
) -> DataFrame:
    """Equi-join in which keys crowded on either side are dealt over several tasks (see ``slice_hot_keys``).

    Joins other than inner ones cut the left side alone; those that keep rows of the right without partners are refused.
    ``rows`` is the known number of left rows, if any: no more than one slice's worth cannot crowd a key. ``parts`` is the number
    of tasks of a join that makes many rows of few: by the size of its input Spark would pack it into one or two.
    """
    spread = lambda df, on: df if parts is None else df.repartition(parts, *on)
    if how.replace("outer", "").strip("_") in ("right", "full", ""):
        raise ValueError(f"{how}: turn the sides round, or join without slices")
    if rows is not None and rows <= rows_per_slice:
        return spread(left, keys).join(spread(right, keys), list(keys), how)
    left, right = slice_hot_keys(left, right, keys, rows_per_slice, both and how == "inner")
    on = [*keys, "_slice"]
    return spread(left, on).join(spread(right, on), on, how).drop("_slice")


def _cells(df, name: str, low: Column, high: Column | None, size: Column) -> DataFrame:
    first = F.floor(low / size).cast("bigint")
    if high is None:
        return df.withColumn(name, first)
    return df.withColumn(name, F.explode(F.sequence(first, F.floor(high / size).cast("bigint"))))


def _level(box: Sequence[Column], cell: float) -> Column:
    """The lowest level whose cells, ``cell`` times a power of two, are at least as long as the box."""
    longest = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(float(cell)))
    return F.ceil(F.log2(longest / cell)).cast("int")


def _levels(df: DataFrame) -> Column:
    """All levels in use, as one value: at most some sixty numbers."""
    return df.select(F.sort_array(F.collect_set("_level"))).scalar()


def _meetings(df: DataFrame, box: Sequence[Column], cell: float, other_levels: Column, left: bool) -> DataFrame:
    """Each box in the cells of its own level and of the higher levels of the other side: at most four a level.

    ``_kind`` keeps apart who meets whom on a level: 0 for two boxes of that level, 1 for a left box of that level and a
    smaller right one, 2 the other way round. Two smaller ones never meet there.
    """
    own, up = (1, 2) if left else (2, 1)
    at = df.select("*", F.posexplode(F.concat(F.array("_level"), other_levels)).alias("_pos", "_at")).filter("_pos = 0 or _at > _level")
    kinds = F.when(F.col("_pos") == 0, F.array(F.lit(0), F.lit(own))).otherwise(F.array(F.lit(up)))
    at = at.withColumn("_kind", F.explode(kinds)).withColumn("_level", F.col("_at")).drop("_pos", "_at")
    size = cell * F.pow(F.lit(2.0), F.col("_level"))
    return _cells(_cells(at, "_cx", box[0], box[2], size), "_cy", box[1], box[3], size)


def box_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Sequence[Column],
    right_box: Sequence[Column],
    cell: float,
    by: Sequence[str] = KEY,
    rows_per_slice: int = ROWS_PER_SLICE,
    levels: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Candidate pairs of rows whose boxes share a grid cell, each pair once; of two boxes only those that touch.

    A box is (x0, y0, x1, y1), or (x, y) for a point on the left. Apart from ``by`` the two sides must have
    different column names. The caller applies its exact predicate to the result. A row with a null in its box meets
    nothing.

    Each box lies on the level whose cells are at least as long as itself and is looked for on every level in use, so it
    fills at most four cells a level however long it is. ``levels=False`` is for boxes known to be no longer than a few
    cells: one grid, and no look at the sizes. ``parts``: see ``sliced_join``.
    """
    point = len(left_box) == 2
    lx, ly = left_box[0], left_box[1]
    size = F.lit(float(cell))
    on = [*by, "_cx", "_cy"]
    if not levels:
        l = _cells(left, "_cx", lx, None if point else left_box[2], size)
        l = _cells(l, "_cy", ly, None if point else left_box[3], size)
        r = _cells(right, "_cx", right_box[0], right_box[2], size)
        r = _cells(r, "_cy", right_box[1], right_box[3], size)
    else:
        size = cell * F.pow(F.lit(2.0), F.col("_level"))
        r = right.withColumn("_level", _level(right_box, cell))
        on.append("_level")
        if point:
            l = left.withColumn("_level", F.explode(_levels(r)))
            l = _cells(_cells(l, "_cx", lx, None, size), "_cy", ly, None, size)
            r = _cells(_cells(r, "_cx", right_box[0], right_box[2], size), "_cy", right_box[1], right_box[3], size)
        else:
            l = left.withColumn("_level", _level(left_box, cell))
            of_l, of_r = _levels(l), _levels(r)
            l, r = _meetings(l, left_box, cell, of_r, True), _meetings(r, right_box, cell, of_l, False)
            on.append("_kind")
    if not point:
        # worked out here, as powers are dear where many pairs meet
        l = l.withColumn("_size", size)
    pairs = sliced_join(l, r, on, rows_per_slice=rows_per_slice, parts=parts)
    if not point:
        overlap = (lx <= right_box[2]) & (right_box[0] <= left_box[2]) & (ly <= right_box[3]) & (right_box[1] <= left_box[3])
        # boxes that share several cells meet in the one that holds the corner of their overlap
        corner_x = F.floor(F.greatest(lx, right_box[0]) / F.col("_size")).cast("bigint")
        corner_y = F.floor(F.greatest(ly, right_box[1]) / F.col("_size")).cast("bigint")
        pairs = pairs.filter(overlap & (F.col("_cx") == corner_x) & (F.col("_cy") == corner_y))
    return pairs.drop("_cx", "_cy", "_level", "_kind", "_size")


def radius_join(
    left: DataFrame,
    right: DataFrame,
    radius: float,
    left_xy: tuple[str, str] = ("x", "y"),
    right_xy: tuple[str, str] = ("x2", "y2"),
    by: Sequence[str] = KEY,
    strict: bool = False,
    cell: float | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Pairs at most ``radius`` apart (less than ``radius`` when ``strict``), with their squared distance ``d2``.
    ``parts``: see ``sliced_join``."""
    lx, ly, rx, ry = F.col(left_xy[0]), F.col(left_xy[1]), F.col(right_xy[0]), F.col(right_xy[1])
    pad = radius * (1 + 1e-9)
    d2 = (lx - rx) * (lx - rx) + (ly - ry) * (ly - ry)
    near = box_join(left, right, (lx, ly), (rx - pad, ry - pad, rx + pad, ry + pad), cell or 2 * radius, by, levels=False, parts=parts)
    near = near.withColumn("d2", d2.cast("double"))
    limit = F.lit(float(radius) * float(radius))
    return near.filter(F.col("d2") < limit if strict else F.col("d2") <= limit)


def point_in_box_join(points: DataFrame, boxes: DataFrame, cell: float, by: Sequence[str] = KEY) -> DataFrame:
    """Points (x, y) with every box (x0, y0, x1, y1) that holds them; all four borders belong to the box."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    pairs = box_join(points, boxes, (F.col("x"), F.col("y")), box, cell, by)
    return pairs.filter(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3]))


#: So few points are looked for at the radius at once.
AT_ONCE = 2_000
#: Places that one task looks around at once; they find some tens of points each.
PLACES_A_TASK = 10_000


def parts_of_places(spark: SparkSession, n: int) -> int:
    """Tasks of a search around ``n`` places, so that a task holds the pairs of about as many whatever the data."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PLACES_A_TASK))


def shares_of(n: int) -> list[float]:
    """Shares of a radius at which ``n`` points are looked for before those who found too little look as far as the radius: each
    the half of the next, the first such that as many points as ``AT_ONCE`` lie within it when n points fill the same ground."""
    halvings = math.ceil(math.log(n / max(1, AT_ONCE), 4)) if n > AT_ONCE else 0
    return [0.5 ** h for h in range(halvings, 0, -1)]


def nearest_neighbours(
    points: DataFrame,
    k: int,
    radius: float,
    sources: DataFrame | None = None,
    id_col: str = "pid",
    by: Sequence[str] = KEY,
) -> DataFrame:
    """The k nearest other points less than ``radius`` away: (by, src, dst, rank, distance), ties by id.

    Points that share a location share their neighbours, so the search runs once per location, against at most
    k+1 ids of each location; a big pile of copies costs no more than k+1 points. Locations of many points are searched at
    shares of the radius first (see ``shares_of``): one that finds k+1 points there has all it needs, and only the others look
    as far as ``radius``. Each share is the half of the next, so one that goes on meets some four times k points and the pairs
    follow the points, not the square of how closely they lie. A task looks around about ``PLACES_A_TASK`` locations.
    """
    src = sources if sources is not None else points
    here = Window.partitionBy(*by, "x", "y").orderBy(id_col)
    targets = keep(
        points.select(*by, "x", "y", id_col)
        .withColumn("_n", F.row_number().over(here))
        .filter(F.col("_n") <= k + 1)
        .select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col(id_col).alias("dst")),
        "targets")
    order = Window.partitionBy(*by, "x", "y").orderBy("d2", "dst")
    many = targets.count()
    parts = parts_of_places(points.sparkSession, many) if many > AT_ONCE else None

    def within(places: DataFrame, far: float) -> DataFrame:
        found = radius_join(places, targets, far, by=by, strict=True, parts=parts)
        return (
            found.withColumn("_n", F.row_number().over(order))
            .filter(F.col("_n") <= k + 1)
            .groupBy(*by, "x", "y")
            .agg(F.sort_array(F.collect_list(F.struct("d2", "dst"))).alias("_near"))
        )

    places = src.select(*by, "x", "y").distinct()
    settled: list[DataFrame] = []
    for share in shares_of(many):
        got = keep(within(places, radius * share).filter(F.size("_near") > k), "near")
        settled.append(got)
        places = keep(places.join(got.select(*by, "x", "y"), [*by, "x", "y"], "left_anti"), "places")
    lists = reduce(DataFrame.unionByName, [*settled, within(places, radius)])
    own = src.select(*by, "x", "y", F.col(id_col).alias("src"))
    mine = F.slice(F.filter("_near", lambda e: e["dst"] != F.col("src")), 1, k)
    return (
        sliced_join(own, lists, [*by, "x", "y"], both=False)
        .select(*by, "src", F.posexplode(mine).alias("_pos", "_e"))
        .select(
            *by, "src", F.col("_e.dst").alias("dst"), (F.col("_pos") + 1).cast("bigint").alias("rank"),
            F.sqrt("_e.d2").alias("distance"),
        )
    )


def without_near(points: DataFrame, others: DataFrame, radius: float, id_col: str = "node_id", by: Sequence[str] = KEY):
    """Points that have none of ``others`` (x, y) within ``radius``."""
    marks = others.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2")).distinct()
    hit = radius_join(points, marks, radius, by=by).select(*by, id_col).distinct()
    return points.join(hit, [*by, id_col], "left_anti")


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with the number ``_band`` of their range of ``order``; written down, as ranges are drawn by a sample."""
    return keep(rows.repartitionByRange(*order).withColumn("_band", F.spark_partition_id()), "ranges")


def running_start(
    df: DataFrame, order: Sequence[str], value, name: str, chunk: Sequence[Column] | None = None, by: Sequence[str] = KEY
) -> DataFrame:
    """Sum of ``value`` over the rows before this one, per ``by`` group in ``order``, without sorting a whole
    group in one task.

    Values are summed per chunk, those sums are run up over the short list of chunks, and rows are only ordered inside a
    chunk. The chunks are the ranges of (``by``, ``order``) into which Spark parts the rows: about equally full whatever the
    values are like, so a group has no more chunks than there are partitions. ``chunk`` saves writing the ranges down where
    coarse values that rise with ``order`` are known to hold neither very many rows nor hardly any.
    """
    if chunk is None:
        df = in_ranges(df.withColumn("_v", value.cast("bigint")), [*by, *order])
        parts, marked = ["_band"], df
    else:
        parts = [f"_k{i}" for i in range(len(chunk))]
        marked = df.select("*", value.cast("bigint").alias("_v"), *[c.alias(p) for c, p in zip(chunk, parts)])
    earlier = Window.partitionBy(*by).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*by, *parts)
        .agg(F.sum("_v").alias("_sum"))
        .select(*by, *parts, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*by, *parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        marked.withColumn("_before", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
        .join(starts, [*by, *parts])
        .withColumn(name, (F.col("_start") + F.col("_before")).cast("bigint"))
        .drop("_start", "_before", "_v", *parts)
    )


def dense_ids(df: DataFrame, order: Sequence[str], name: str, chunk: Sequence[Column] | None = None, by: Sequence[str] = KEY) -> DataFrame:
    """Ids 0, 1, 2, ... per ``by`` group in ``order`` (see ``running_start``)."""
    return running_start(df, order, F.lit(1), name, chunk, by)


def spread_out(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct rows dealt over all shuffle partitions: for compact rows that are about to grow into many,
    where small input would otherwise be packed into one task."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*cols).repartition(n, *cols).distinct()


def id_chunk(col: str, size: int = 65_536) -> list[Column]:
    return [F.floor(F.col(col) / size)]


def cell_chunk(a: str = "x", b: str = "y", size: int = 64) -> list[Column]:
    return [F.floor(F.col(a) / size), F.floor(F.col(b) / size)]
