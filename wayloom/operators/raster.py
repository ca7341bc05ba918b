"""Rasters as pixel tables: (tile_id, y, x, band, value) or (tile_id, y, x, keypoint, road)."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coords import byte_score, rotate_pixel
from ..session import keep, keep_counted
from .graph import degrees, with_ends
from .select import suppress_near
from .spatial import KEY, box_join, radius_join, spread_out


def fuse_masks(patch_scores: DataFrame, bands: tuple[str, ...] = ("keypoint", "road")) -> DataFrame:
    """Mean score of each pixel over the patches that cover it; NULL where no patch scores the band.

    A plain grouped mean: partial sums are formed before the shuffle. Works on a stream of patches as well.
    """
    return patch_scores.groupBy(*KEY, "y", "x").agg(*[F.avg(b).alias(b) for b in bands])


def to_bytes(masks: DataFrame, bands: tuple[str, ...] = ("keypoint", "road")) -> DataFrame:
    return masks.withColumns({b: byte_score(F.col(b)) for b in bands})


def crop(pixels: DataFrame, patches: DataFrame, cell: float = 256.0) -> DataFrame:
    """Pixels of each patch with their place inside it; the box (x0, y0, x1, y1) is half-open."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    pairs = box_join(pixels, patches, (F.col("x"), F.col("y")), box, cell)
    return pairs.filter("x >= x0 and x < x1 and y >= y0 and y < y1").withColumns(
        {"px": F.col("x") - F.col("x0"), "py": F.col("y") - F.col("y0")})


def rotate(pixels: DataFrame, size: int, turns: Column) -> DataFrame:
    x, y = rotate_pixel(F.col("x"), F.col("y"), size, turns)
    return pixels.withColumns({"x": x, "y": y})


def normalize(pixels: DataFrame, mean: Mapping[str, float], std: Mapping[str, float]) -> DataFrame:
    """(value - mean) / std with constants per band."""
    def table(m):
        return F.create_map(*[F.lit(v) for kv in m.items() for v in (kv[0], float(kv[1]))])

    return pixels.withColumn("value", (F.col("value") - table(mean)[F.col("band")]) / table(std)[F.col("band")])


def mask_points(masks: DataFrame, band: str, threshold: float) -> DataFrame:
    """Pixels of a byte mask strictly above ``threshold`` (a share of 255), with their score."""
    if threshold > 1:
        raise ValueError("threshold is a share of 255, at most 1")
    return masks.filter(F.col(band) > threshold * 255).select(*KEY, "x", "y", F.col(band).alias("score"))


def pixel_id(x: Column, y: Column) -> Column:
    return y.cast("bigint") * F.lit(1 << 24).cast("bigint") + x.cast("bigint")


def extract_points(
    masks: DataFrame,
    keypoint_threshold: float,
    road_threshold: float,
    keypoint_radius: float,
    road_radius: float,
    score_scale: str = "raw",
) -> DataFrame:
    """Graph points from byte masks: thin keypoints and road pixels each, join them with keypoints first, thin again.

    With ``score_scale='raw'`` byte scores count as forced, so only the last thinning removes anything; 'unit'
    divides them by 255, so that each step thins. Returns (tile_id, pid, x, y).
    """
    div = 255.0 if score_scale == "unit" else 1.0

    def thin(band, threshold, radius):
        p = mask_points(masks, band, threshold).withColumn("pid", pixel_id(F.col("x"), F.col("y")))
        if score_scale == "raw" and threshold * 255 >= 1:
            return p  # all scores are above 1, hence forced
        return suppress_near(p.withColumn("score", F.col("score") / div), radius)

    junctions = thin("keypoint", keypoint_threshold, keypoint_radius).withColumn("score", F.lit(1.0))
    roads = thin("road", road_threshold, road_radius).withColumn("score", F.lit(0.0))
    # one id per candidate: a pixel may be both a junction and a road point
    both = junctions.withColumn("pid", F.col("pid") * 2).unionByName(roads.withColumn("pid", F.col("pid") * 2 + 1))
    kept = suppress_near(both.select(*KEY, "pid", "x", "y", "score"), road_radius)
    return kept.select(*KEY, "pid", "x", "y")


def keypoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the edges whose number of neighbours is not two."""
    return nodes.join(degrees(edges).filter("degree <> 2").select(*KEY, "node_id"), [*KEY, "node_id"], "left_semi")


def _inside(size: int | None) -> str:
    return "true" if size is None else f"x >= 0 and y >= 0 and x < {size} and y < {size}"


def draw_discs(points: DataFrame, radius: int, size: int | None = None) -> DataFrame:
    """Pixels (tile_id, y, x) covered by filled discs: all within ``radius`` of a centre at whole coordinates."""
    spots = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in spots])
    px = points.select(*KEY, F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    px = spread_out(px, *KEY, "x", "y")
    px = px.withColumn("_o", F.explode(offsets))
    return px.select(*KEY, (F.col("y") + F.col("_o.j")).alias("y"), (F.col("x") + F.col("_o.i")).alias("x")).filter(
        _inside(size)).distinct()


def draw_lines(segments: DataFrame, width: float, size: int | None = None) -> DataFrame:
    """Pixels (tile_id, y, x) at most width/2 from a segment (ax, ay, bx, by).

    Each line is walked along its longer axis and spreads only over a narrow band, so the work grows with its
    length and not with the area of its box.
    """
    half = width / 2.0
    ends = ("ax", "ay", "bx", "by")
    s = segments.select(*KEY, *[F.col(c).cast("double").alias(c) for c in ends])
    s = spread_out(s, *KEY, *ends)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    steep = F.abs(dy) > F.abs(dx)
    pick = lambda a, b: F.when(steep, F.col(b)).otherwise(F.col(a))
    slope = F.coalesce(F.when(steep, dx / F.nullif(dy, F.lit(0.0))).otherwise(dy / F.nullif(dx, F.lit(0.0))), F.lit(0.0))
    s = s.withColumns({
        "ua": pick("ax", "ay"), "ub": pick("bx", "by"), "va": pick("ay", "ax"), "slope": slope, "steep": steep,
        "dx": dx, "dy": dy, "n": dx * dx + dy * dy})
    s = s.withColumn("u", F.explode(F.sequence(
        F.floor(F.least("ua", "ub") - half).cast("bigint"), F.ceil(F.greatest("ua", "ub") + half).cast("bigint"))))
    on = F.least(F.greatest(F.col("u").cast("double"), F.least("ua", "ub")), F.greatest("ua", "ub"))
    mid = F.col("va") + (on - F.col("ua")) * F.col("slope")
    # at a slope of at most 1 the band is half * sqrt(2) wide on either side
    band = half * 1.4143
    s = s.withColumn("v", F.explode(F.sequence(F.floor(mid - band).cast("bigint"), F.ceil(mid + band).cast("bigint"))))
    s = s.select(
        *KEY, F.when(F.col("steep"), F.col("v")).otherwise(F.col("u")).alias("x"),
        F.when(F.col("steep"), F.col("u")).otherwise(F.col("v")).alias("y"), *ends, "dx", "dy", "n")
    near = F.expr(
        "CASE WHEN (x-ax)*dx+(y-ay)*dy <= 0 THEN (x-ax)*(x-ax)+(y-ay)*(y-ay) "
        "WHEN (x-ax)*dx+(y-ay)*dy >= n THEN (x-bx)*(x-bx)+(y-`by`)*(y-`by`) "
        "ELSE ((x-ax)*dy-(y-ay)*dx)*((x-ax)*dy-(y-ay)*dx)/n END") <= half * half
    return s.filter(near).filter(_inside(size)).select(*KEY, "y", "x").distinct()


def draw_graph(nodes: DataFrame, edges: DataFrame, dilation: int, size: int) -> DataFrame:
    """A graph with coordinates in 0..1 as pixels: squares of 2*dilation+1 at nodes, lines 2*dilation wide."""
    n = nodes.withColumns({"x": (F.col("x") * size).cast("int"), "y": (F.col("y") * size).cast("int")})
    span = F.sequence(F.lit(-dilation), F.lit(dilation))
    squares = n.select(*KEY, "x", "y").distinct().withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span)).select(
        *KEY, (F.col("y") + F.col("_j")).cast("bigint").alias("y"), (F.col("x") + F.col("_i")).cast("bigint").alias("x")).filter(_inside(size))
    lines = draw_lines(with_ends(edges, n), 2 * dilation, size)
    return squares.unionByName(lines).distinct()


def drawing_difference(pred, gt, size: int, thin: int = 1, thick: int = 5) -> DataFrame:
    """Pixels of the thin drawing of one graph outside the thick drawing of the other: kind 'false' or 'missed'.

    ``pred`` and ``gt`` are (nodes, edges) with coordinates in 0..1.
    """
    keys = [*KEY, "y", "x"]
    extra = draw_graph(*pred, thin, size).join(draw_graph(*gt, thick, size), keys, "left_anti").withColumn("kind", F.lit("false"))
    missed = draw_graph(*gt, thin, size).join(draw_graph(*pred, thick, size), keys, "left_anti").withColumn("kind", F.lit("missed"))
    return extra.unionByName(missed)


def label_masks(nodes: DataFrame, edges: DataFrame, size: int, radius: int = 3, width: float = 3.0) -> DataFrame:
    """Keypoint and road label pixels of each tile's graph: (tile_id, y, x, band)."""
    whole = nodes.withColumns({"x": F.col("x").cast("int"), "y": F.col("y").cast("int")})
    dots = draw_discs(keypoints(whole, edges), radius, size).withColumn("band", F.lit("keypoint"))
    roads = draw_lines(with_ends(edges, whole), width, size).withColumn("band", F.lit("road"))
    return dots.unionByName(roads)


def sample_features(points: DataFrame, features: DataFrame, patch_size: float, grid: int, id_col: str = "pid") -> DataFrame:
    """Bilinear sample of a feature grid at points inside their patch; outside the grid counts as zero.

    ``points``: (tile_id, patch_id, id, px, py); ``features``: (tile_id, patch_id, fy, fx, vec). The grid position
    is p / patch * grid - 0.5. Four corners per point are joined and combined element by element.
    """
    gx = F.col("px") / patch_size * grid - 0.5
    gy = F.col("py") / patch_size * grid - 0.5
    p = points.select(*KEY, "patch_id", id_col, gx.alias("gx"), gy.alias("gy"))
    corner = F.array(*[F.struct(F.lit(2 * j + i).alias("n"), F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)])
    p = p.withColumn("_c", F.explode(corner))
    fx, fy = F.floor("gx") + F.col("_c.i"), F.floor("gy") + F.col("_c.j")
    p = p.select(
        *KEY, "patch_id", id_col, F.col("_c.n").alias("n"), fx.cast("int").alias("fx"), fy.cast("int").alias("fy"),
        ((1 - F.abs(F.col("gx") - fx)) * (1 - F.abs(F.col("gy") - fy))).alias("w"))
    hit = p.join(features.select(*KEY, "patch_id", "fy", "fx", "vec"), [*KEY, "patch_id", "fy", "fx"], "left")
    four = hit.groupBy(*KEY, "patch_id", id_col).agg(F.sort_array(F.collect_list(F.struct("n", "w", "vec"))).alias("_four"))
    known = F.filter("_four", lambda e: e["vec"].isNotNull())
    scaled = F.transform(known, lambda e: F.transform(e["vec"], lambda v: v.cast("double") * e["w"]))
    total = F.aggregate(
        F.slice(scaled, 2, 4), F.element_at(scaled, 1),
        lambda acc, e: F.zip_with(acc, e, lambda a, b: a + b))
    return four.withColumn("vec", F.when(F.size(known) > 0, total)).drop("_four")


def pair_features(pairs: DataFrame, vectors: DataFrame, points: DataFrame, drop: str | None = None) -> DataFrame:
    """Source vector, target vector and offset of each pair in one array; ``drop`` zeroes 'target' or 'offset'.

    ``pairs``: (tile_id, patch_id, src, dst, …); ``vectors``: (tile_id, patch_id, pid, vec); ``points``:
    (tile_id, patch_id, pid, px, py).
    """
    full = vectors.join(points.select(*KEY, "patch_id", "pid", "px", "py"), [*KEY, "patch_id", "pid"])
    at = [*KEY, "patch_id"]
    s = full.select(*at, F.col("pid").alias("src"), F.col("vec").alias("sv"), F.col("px").alias("sx"), F.col("py").alias("sy"))
    t = full.select(*at, F.col("pid").alias("dst"), F.col("vec").alias("tv"), F.col("px").alias("tx"), F.col("py").alias("ty"))
    zero = lambda a: F.transform(a, lambda v: F.lit(0.0))
    both = pairs.join(s, [*at, "src"]).join(t, [*at, "dst"])
    tv = zero(F.col("tv")) if drop == "target" else F.col("tv").cast("array<double>")
    off = F.array((F.col("tx") - F.col("sx")).cast("double"), (F.col("ty") - F.col("sy")).cast("double"))
    off = zero(off) if drop == "offset" else off
    return both.withColumn("vec", F.concat(F.col("sv").cast("array<double>"), tv, off)).drop("sv", "tv", "sx", "sy", "tx", "ty")


def pack_patches(pixels: DataFrame, patches: DataFrame, cell: float = 256.0) -> DataFrame:
    """One row per patch with its pixel values in (y, x, band) order; a row is as long as one patch."""
    inside = crop(pixels, patches, cell)
    cells = inside.groupBy(*KEY, "patch_id").agg(F.sort_array(F.collect_list(F.struct("py", "px", "band", "value"))).alias("_v"))
    return cells.select(*KEY, "patch_id", F.transform("_v", lambda e: e["value"].cast("float")).alias("values"))


def score_patches(packed: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a user's patch scorer: it gets an iterator of Arrow batches of packed patches and yields batches of
    ``schema``, for example ``tile_id bigint, patch_id bigint, py int, px int, keypoint double, road double``."""
    return packed.mapInArrow(scorer, schema)


def score_pairs(grouped: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Run a user's pair scorer over rows that hold one source with all its targets (at most k of them)."""
    return grouped.mapInArrow(scorer, schema)


def cost_field(masks: DataFrame, points: DataFrame, radius: int = 4, band: str = "road") -> DataFrame:
    """max(255 on discs around points, 255 - road): (tile_id, y, x, cost)."""
    discs = draw_discs(points, radius).withColumn("_d", F.lit(255))
    cost = F.greatest(F.coalesce("_d", F.lit(0)), 255 - F.col(band))
    return masks.join(discs, [*KEY, "y", "x"], "left").select(*KEY, "y", "x", cost.alias("cost"))


def walk_cost_field(masks: DataFrame, points: DataFrame, radius: int = 6, blocked_above: int = 200, band: str = "road") -> DataFrame:
    """The form for path search: 0 means blocked, a free pixel costs at least 1."""
    c = F.when(F.col("cost") == 0, 1).when(F.col("cost") > blocked_above, 0).otherwise(F.col("cost"))
    return cost_field(masks, points, radius, band).withColumn("cost", c)


def line_of_sight(pairs: DataFrame, cost: DataFrame, free_radius: int = 4) -> DataFrame:
    """Whether all pixels on the straight line between two points cost less than 255, discs at both ends aside.

    ``pairs``: (tile_id, src, dst, ax, ay, bx, by) in whole pixels; pixels without a cost count as free.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.greatest(F.abs(dx), F.abs(dy))
    p = pairs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n").cast("bigint"))))
    t = F.coalesce(F.col("_i") / F.nullif(F.col("_n") * 1.0, F.lit(0.0)), F.lit(0.0))
    p = p.withColumns({"x": F.floor(F.col("ax") + t * dx + 0.5), "y": F.floor(F.col("ay") + t * dy + 0.5)})
    r2 = free_radius * free_radius
    free = ((F.col("x") - F.col("ax")) ** 2 + (F.col("y") - F.col("ay")) ** 2 <= r2) | (
        (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2 <= r2)
    seen = p.join(cost, [*KEY, "y", "x"], "left")
    top = F.max(F.when(free, F.lit(0)).otherwise(F.coalesce("cost", F.lit(0))))
    return seen.groupBy(*KEY, "src", "dst").agg((top < 255).alias("connected"))


def connected_over_pixels(points: DataFrame, walk_cost: DataFrame, radius: float, free_radius: int = 6) -> DataFrame:
    """Pairs of points within ``radius`` joined by a way of fewer than ``radius`` steps over unblocked pixels
    (cost > 0; discs around both ends are free), steps going to all eight neighbours: (tile_id, src, dst).

    The search runs once for each source and not for each pair, over unblocked pixels and the source's own disc. A way
    enters the target's disc once: from any pixel of a disc the way to its middle stays inside, and no other is shorter than
    its longer side. So targets ask for the fronts in and around their discs, in a join at the end. A step back leads to one
    of the last two fronts, so a step is held against these alone. Points without an id or a place meet nothing.
    """
    pts = points.select(*KEY, "pid", F.col("x").cast("bigint").alias("x"), F.col("y").cast("bigint").alias("y"))
    other = pts.select(*KEY, F.col("pid").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = keep(radius_join(pts.withColumnRenamed("pid", "src"), other, radius).filter("src < dst").drop("d2"), "pairs")
    free = keep(walk_cost.filter("cost > 0").select(*KEY, "y", "x").distinct(), "free")
    at = [*KEY, "src", "sx", "sy", "y", "x"]
    steps = math.ceil(radius) - 1
    front = keep(pairs.select(*KEY, "src", F.col("x").alias("sx"), F.col("y").alias("sy"), "y", "x").distinct(), "front")
    fronts = [front]
    ring = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    in_disc = lambda u, v: (F.col("x") - F.col(u)) ** 2 + (F.col("y") - F.col(v)) ** 2 <= free_radius ** 2
    for _ in range(steps):
        step = front.withColumn("_o", F.explode(ring)).withColumns({"x": F.col("x") + F.col("_o.i"), "y": F.col("y") + F.col("_o.j")}).drop("_o").distinct()
        for known in fronts[-2:]:
            step = step.join(known, at, "left_anti")
        step = step.join(free.withColumn("_free", F.lit(True)), [*KEY, "y", "x"], "left")
        front, n = keep_counted(step.filter(in_disc("sx", "sy") | F.col("_free")).select(*at), "front", n=F.count(F.lit(1)))
        if not n["n"]:
            break
        fronts.append(front)
    found = reduce(DataFrame.unionByName, [f.select(*KEY, "src", "y", "x", F.lit(k).alias("k")) for k, f in enumerate(fronts)])
    wide = free_radius + 1
    target = pairs.select(*KEY, "src", "dst", "x2", "y2")
    box = (F.col("x2") - wide, F.col("y2") - wide, F.col("x2") + wide, F.col("y2") + wide)
    near = box_join(found, target, (F.col("x"), F.col("y")), box, 2 * wide + 1, by=(*KEY, "src"), levels=False)
    # of a pixel beside the disc, the neighbour inside that lies nearest to the middle
    dx, dy = F.abs(F.col("x") - F.col("x2")), F.abs(F.col("y") - F.col("y2"))
    inner = lambda c: F.greatest(c - 1, F.lit(0))
    beside = inner(dx) ** 2 + inner(dy) ** 2 <= free_radius ** 2
    rest = F.when(in_disc("x2", "y2"), F.greatest(dx, dy)).when(beside, 1 + F.greatest(inner(dx), inner(dy)))
    return near.filter(F.col("k") + rest <= steps).select(*KEY, "src", "dst").distinct()
