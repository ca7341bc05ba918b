"""From patch scores to road graphs: fuse, thin, pair, score, vote. All tiles go through one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.raster import extract_points, fuse_masks, pack_patches, pair_features, sample_features, score_pairs, score_patches, to_bytes
from ..operators.scoring import clean_pair_scores, vote_edges
from ..operators.spatial import KEY, nearest_neighbours, point_in_box_join
from ..session import keep
from ..sources.sinks import rounded_adjacency

PATCH = ("tile_id", "patch_id")
IMAGE_SCHEMA = "tile_id bigint, patch_id bigint, py int, px int, keypoint double, road double, fy int, fx int, vec array<float>"
PAIR_SCHEMA = "tile_id bigint, patch_id bigint, src bigint, dst bigint, score double"


@dataclass(frozen=True)
class Options:
    """Fixed values of the default setting: thresholds as shares, radii in pixels."""

    keypoint_threshold: float = 0.248
    road_threshold: float = 0.364
    link_threshold: float = 0.5
    keypoint_radius: float = 8.0
    road_radius: float = 16.0
    neighbour_radius: float = 64.0
    neighbours: int = 16
    score_scale: str = "raw"


def scored_patches(pixels: DataFrame, patches: DataFrame, scorer: Callable, schema: str) -> DataFrame:
    """Cut patches, run the user's scorer on each, and put its pixels back in tile coordinates.

    The scorer yields (tile_id, patch_id, py, px, keypoint, road).
    """
    local = score_patches(pack_patches(pixels, patches), scorer, schema)
    at = patches.select(*PATCH, "x0", "y0")
    return local.join(at, list(PATCH)).select(
        *PATCH, (F.col("py") + F.col("y0")).alias("y"), (F.col("px") + F.col("x0")).alias("x"), "keypoint", "road")


def image_graph(
    pixels: DataFrame,
    patches: DataFrame,
    patch_scorer: Callable,
    pair_scorer: Callable,
    options: Options = Options(),
    patch_size: float = 512.0,
    grid: int = 32,
    schema: str = IMAGE_SCHEMA,
    pair_schema: str = PAIR_SCHEMA,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Image pixels to (nodes, edges, adjacency) in one call.

    ``patch_scorer`` yields rows of two kinds in ``schema``: scores of a pixel (py, px, keypoint, road) with the rest null,
    and cells of its feature map (fy, fx, vec) with the rest null. The features are sampled at the points of each pair and
    handed to ``pair_scorer``. Patches are scored once; the rows are written to the shared folder.
    """
    local = keep(score_patches(pack_patches(pixels, patches), patch_scorer, schema), "image-scores")
    at = patches.select(*PATCH, "x0", "y0")
    scores = local.filter("fy is null").join(at, list(PATCH)).select(
        *PATCH, (F.col("py") + F.col("y0")).alias("y"), (F.col("px") + F.col("x0")).alias("x"), "keypoint", "road")
    features = local.filter("fy is not null").select(*PATCH, "fy", "fx", "vec")
    nodes, edges = extract_graph(scores, patches, pair_scorer, options, features, patch_size, grid, pair_schema)
    return nodes, edges, rounded_adjacency(nodes, edges)


def fused_masks(patch_scores: DataFrame) -> DataFrame:
    """Byte masks; means are rounded to 9 decimals so that the order of summation cannot change a byte."""
    bands = ("keypoint", "road")
    return to_bytes(fuse_masks(patch_scores).withColumns({b: F.round(b, 9) for b in bands}), bands)


def candidate_pairs(points: DataFrame, patches: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """Points inside each patch (borders included) and their nearest neighbours there."""
    inside = point_in_box_join(points, patches, 128.0).select(
        *PATCH, "pid", "x", "y", (F.col("x") - F.col("x0")).alias("px"), (F.col("y") - F.col("y0")).alias("py"))
    inside = keep(inside, "inside")
    return inside, nearest_neighbours(inside, options.neighbours, options.neighbour_radius, by=PATCH)


def pairs_by_source(pairs: DataFrame, inside: DataFrame, features: DataFrame | None, patch_size: float, grid: int) -> DataFrame:
    """One row per patch and source: the targets with pair vectors (source, target, offset) in order of rank."""
    if features is None:
        vec = inside.select(*PATCH, "pid", F.array().cast("array<double>").alias("vec"))
    else:
        none = F.array().cast("array<double>")
        vec = sample_features(inside, features, patch_size, grid).withColumn("vec", F.coalesce("vec", none))
    full = pair_features(pairs, vec, inside)
    # at most `neighbours` targets per source
    return full.groupBy(*PATCH, "src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "vec"))).alias("targets"))


def extract_graph(
    patch_scores: DataFrame,
    patches: DataFrame,
    pair_scorer: Callable,
    options: Options = Options(),
    features: DataFrame | None = None,
    patch_size: float = 512.0,
    grid: int = 32,
    schema: str = PAIR_SCHEMA,
) -> tuple[DataFrame, DataFrame]:
    """(nodes(tile_id, node_id, r, c), edges(tile_id, src, dst, score)).

    ``pair_scorer`` gets Arrow batches of (tile_id, patch_id, src, targets) and yields ``schema``.
    """
    masks = fused_masks(patch_scores)
    points = keep(extract_points(
        masks, options.keypoint_threshold, options.road_threshold, options.keypoint_radius, options.road_radius, options.score_scale), "graph-points")
    inside, pairs = candidate_pairs(points, patches, options)
    scores = score_pairs(pairs_by_source(pairs, inside, features, patch_size, grid), pair_scorer, schema)
    edges = vote_edges(clean_pair_scores(scores.withColumn("valid", F.lit(True))), options.link_threshold)
    nodes = points.select(*KEY, F.col("pid").alias("node_id"), F.col("y").alias("r"), F.col("x").alias("c"))
    return nodes, edges
