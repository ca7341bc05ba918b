"""Training samples from true graphs: spread points per patch, and for drawn sources the nearest points with a flag
whether the road leads there directly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import rotate_in_patch
from ..operators.graph import crossovers, degrees, reach, subdivide, undirected
from ..operators.sampling import export_samples, jitter, weighted_draws
from ..operators.select import random_scores, suppress_near
from ..operators.spatial import KEY, nearest_neighbours, point_in_box_join, radius_join, without_near
from ..session import keep

PATCH = ("tile_id", "patch_id")


@dataclass(frozen=True)
class Options:
    """Fixed values of the default setting, in pixels."""

    patch: int = 512
    resolution: float = 4.0
    crossover_radius: float = 4.0
    interest_radius: float = 32.0
    road_radius: float = 16.0
    neighbour_radius: float = 64.0
    neighbours: int = 16
    samples: int = 512
    high_weight: float = 0.9
    low_weight: float = 0.1


def sample_points(nodes: DataFrame, edges: DataFrame, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Points of the subdivided graph away from crossovers: (tile_id, pid, x, y, junction, weight); and its edges."""
    flat = undirected(edges)
    over = keep(crossovers(nodes, flat).select(*KEY, "x", "y"), "crossovers")
    sub_n, sub_e = (keep(df, "subdivided") for df in subdivide(nodes, flat, options.resolution))
    far = without_near(sub_n, over, options.crossover_radius)
    junction = degrees(sub_e).filter("degree <> 2").select(*KEY, "node_id", F.lit(True).alias("junction"))
    lone = sub_n.join(degrees(sub_e), [*KEY, "node_id"], "left_anti").select(*KEY, "node_id", F.lit(True).alias("junction"))
    marks = keep(junction.unionByName(lone), "junctions")
    spots = sub_n.join(marks, [*KEY, "node_id"]).select(*KEY, "x", "y").unionByName(over).distinct()
    near = radius_join(
        sub_n, spots.select(*KEY, F.col("x").alias("x2"), F.col("y").alias("y2")), options.interest_radius
    ).select(*KEY, "node_id").distinct().withColumn("_near", F.lit(True))
    out = far.join(marks, [*KEY, "node_id"], "left").join(near, [*KEY, "node_id"], "left").select(
        *KEY, F.col("node_id").alias("pid"), "x", "y", F.coalesce("junction", F.lit(False)).alias("junction"),
        F.when(F.col("_near"), options.high_weight).otherwise(options.low_weight).alias("weight"))
    return out, sub_e


def patch_samples(nodes: DataFrame, edges: DataFrame, patches: DataFrame, seed: int, options: Options = Options()) -> tuple[DataFrame, DataFrame]:
    """Points and pairs of each patch (tile_id, patch_id, x0, y0, x1, y1, turns).

    Points: (tile_id, patch_id, pid, px, py), turned with the patch and shaken a little. Pairs: (tile_id, patch_id,
    sample_id, src, rank, dst, connected); dst is NULL for a source without neighbours. A search from the source
    stops at each of its targets, so only the first point along a road counts as connected.
    """
    points, sub_e = sample_points(nodes, edges, options)
    inside = point_in_box_join(keep(points, "label-points"), patches, 128.0)
    packed = inside.withColumn("tile_id", F.struct("tile_id", "patch_id")).drop("patch_id")
    draw = random_scores(packed, F.when(F.col("junction"), F.lit(2.0)).otherwise(0.0), seed)
    thin = suppress_near(draw, options.road_radius)
    thin = thin.withColumn("patch_id", F.col("tile_id.patch_id")).withColumn("tile_id", F.col("tile_id.tile_id"))
    thin = keep(thin.select(*PATCH, "pid", "x", "y", "weight", "x0", "y0", "turns"), "thinned")
    drawn = keep(weighted_draws(thin, options.samples, seed + 1), "draws")
    wanted = drawn.select(*PATCH, "pid").distinct()
    near = keep(nearest_neighbours(
        thin, options.neighbours, options.neighbour_radius, sources=thin.join(wanted, [*PATCH, "pid"], "left_semi"), by=PATCH), "near")
    source = F.struct("patch_id", F.col("src").alias("pid")).alias("source")
    stops = near.select(*KEY, source, F.col("dst").alias("node"))
    begin = near.select(*KEY, source, F.col("src").alias("node")).distinct()
    depth = int(options.neighbour_radius // options.resolution)
    found = reach(sub_e, begin, depth, stops).select(
        *KEY, F.col("source.patch_id").alias("patch_id"), F.col("source.pid").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("_hit"))
    pairs = near.join(found, [*PATCH, "src", "dst"], "left").select(
        *PATCH, "src", "rank", "dst", F.coalesce("_hit", F.lit(False)).alias("connected"))
    samples = drawn.withColumnRenamed("pid", "src").join(pairs, [*PATCH, "src"], "left").select(
        *PATCH, "sample_id", "src", "rank", "dst", "connected")
    px, py = rotate_in_patch(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), options.patch, F.col("turns"))
    turned = thin.select(*PATCH, "pid", px.alias("px"), py.alias("py"))
    return jitter(turned, seed + 2), samples


def training_batches(
    nodes: DataFrame, edges: DataFrame, patches: DataFrame, seed: int, batch: int, options: Options = Options()
) -> tuple[DataFrame, DataFrame]:
    """``patch_samples`` brought to equal shapes in drawn batches of ``batch`` patches, empty patches included: points and
    samples as ``export_samples`` returns them, with ``options.samples`` samples a patch and ``options.neighbours`` pairs each."""
    points, samples = patch_samples(nodes, edges, patches, seed, options)
    return export_samples(points, samples, patches, options.samples, options.neighbours, batch, seed + 3, PATCH)
