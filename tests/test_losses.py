"""Cases in which rows once went missing without a word."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayloom.operators import paths, raster, sampling, spatial
from wayloom.operators.select import greedy_keep, suppress_near
from wayloom.plans import apls
from wayloom.sources import graphs


def test_long_path_is_walked_to_its_end(spark, frame):
    n = 70
    links = frame([(k, k + 1, 1) for k in range(n)], "u bigint, v bigint, w bigint")
    seeds = frame([(0, 0, 0)], "source bigint, node bigint, d bigint")
    got = {r.node: r.d for r in paths.spread(seeds, links).collect()}
    assert got == {k: k for k in range(n + 1)}


def test_padding_refuses_to_cut(frame):
    pairs = frame([(0, 0, 1, k, 10 + k, True) for k in range(5)], "patch_id bigint, sample_id bigint, src bigint, rank bigint, dst bigint, connected boolean")
    assert sampling.pad_samples(pairs, 5).count() == 1
    with pytest.raises(PySparkException, match="more than 3 targets"):
        sampling.pad_samples(pairs, 3).collect()


def test_every_draw_meets_a_point(frame):
    rows = [(0, k, 0.1) for k in range(10)] + [(1, k, 1 / 3) for k in range(3)] + [(2, 5, 0.0), (2, 6, 0.0)] + [(3, 1, 0.0), (3, 2, 1e6)]
    got = sampling.weighted_draws(frame(rows, "patch_id bigint, pid bigint, weight double"), 3000, seed=2)
    assert {r.patch_id: r["count"] for r in got.groupBy("patch_id").count().collect()} == {0: 3000, 1: 3000, 2: 3000, 3: 3000}
    assert got.filter("patch_id = 3 and pid = 1").count() == 0 and got.filter("patch_id = 2").select("pid").distinct().count() == 2
    shares = {r.pid: r["count"] / 3000 for r in got.filter("patch_id = 0").groupBy("pid").count().collect()}
    assert all(abs(s - 0.1) < 0.03 for s in shares.values()) and len(shares) == 10


@pytest.mark.parametrize("steps,radius,joined", [(11, 12.0, True), (11, 11.5, True), (11, 11.2, True), (12, 12.5, True)])
def test_pixel_ways_of_fewer_steps_than_the_radius(frame, steps, radius, joined):
    points = frame([(1, 0, 0), (2, steps, 0)], "pid bigint, x bigint, y bigint")
    cost = frame([(0, x, 1) for x in range(steps + 1)], "y bigint, x bigint, cost bigint")
    got = raster.connected_over_pixels(points, cost, radius, free_radius=0).count()
    assert (got == 1) == joined


def test_pixel_way_around_is_too_long(frame):
    points = frame([(1, 0, 0), (2, 4, 0)], "pid bigint, x bigint, y bigint")
    wall = [(y, x, 1) for y in range(-4, 5) for x in range(0, 5) if not (x == 2 and y > -4)]
    cost = frame(wall, "y bigint, x bigint, cost bigint")
    assert raster.connected_over_pixels(points, cost, 7.0, free_radius=0).count() == 0  # the way takes 8 steps
    assert raster.connected_over_pixels(points, cost, 9.0, free_radius=0).count() == 1


@pytest.mark.parametrize("lat", [0.0, 41.0, 60.0, 75.0])
def test_snaps_at_any_latitude(frame, lat):
    metre = 1 / 111111.0
    east = 9 * metre / math.cos(math.radians(lat))
    points = frame([(k, lat + k * 0.01, 10.0 + k * 0.00123) for k in range(40)], "node_id bigint, lat double, lon double")
    nodes = frame([(k, lat + k * 0.01, 10.0 + k * 0.00123 + 9 * metre / math.cos(math.radians(lat + k * 0.01)) * 0.999) for k in range(40)],
                  "node_id bigint, lat double, lon double")
    edges = frame([(0, 1)], "src bigint, dst bigint").limit(0)
    got = {r.node_id: r.other for r in apls.snap_exclusively(points, nodes, edges).collect()}
    assert got == {k: k for k in range(40)} and east > 0


def test_all_hot_keys_are_sliced(spark):
    left = spark.range(600).select((F.col("id") % 30).alias("k"), F.col("id").alias("a"))
    right = spark.range(90).select((F.col("id") % 30).alias("k"), F.col("id").alias("b"))
    l, r = spatial.slice_hot_keys(left, right, ["k"], rows_per_slice=5)
    assert l.select("k", "_slice").distinct().groupBy("k").count().filter("count > 1").count() == 30
    assert spatial.sliced_join(left, right, ["k"], rows_per_slice=5).distinct().count() == 600 * 3 == spatial.sliced_join(left, right, ["k"], rows_per_slice=5).count()


def test_forest_ids_of_any_length_stay_apart(frame):
    schema = "tree_id bigint, id bigint, lat double, lon double, parent bigint, similar_tree bigint, similar_id bigint, out_region bigint"
    good = frame([(1, 0, 0.0, 0.0, 0, -1, -1, 0), (1, 9_999_999, 1.0, 1.0, 0, -1, -1, 0)], schema)
    assert graphs.load_forest(good)[0].count() == 2
    # packed as tree * 10,000,000 + id, the second of these would be called like the third
    long = frame([(1, 0, 0.0, 0.0, 0, -1, -1, 0), (1, 10_000_000, 1.0, 1.0, 0, -1, -1, 0), (2, 0, 5.0, 5.0, 0, -1, -1, 1)], schema)
    n, e, t = graphs.load_forest(long)
    assert {(tuple(r.node_id), r.lat) for r in n.collect()} == {((1, 0), 0.0), ((1, 10_000_000), 1.0), ((2, 0), 5.0)}
    assert {(tuple(r.src), tuple(r.dst)) for r in e.collect()} == {((1, 0), (1, 0)), ((1, 0), (1, 10_000_000)), ((2, 0), (2, 0))}
    assert [tuple(r.node_id) for r in t.collect()] == [(2, 0)]


def test_points_without_a_place_end_the_suppression(spark, frame):
    nan = float("nan")
    rows = [(1, 0.0, 0.0, 0.9), (2, 1.0, 0.0, 0.8), (3, None, 0.0, 0.7), (4, 50.0, nan, 0.6), (5, 60.0, 0.0, None), (None, 70.0, 0.0, 0.5), (6, 90.0, 0.0, 0.1)]
    points = frame(rows, "pid bigint, x double, y double, score double")
    assert sorted(r.pid for r in suppress_near(points, 5.0).collect()) == [1, 6]
    assert suppress_near(points.withColumn("tile_id", F.lit(None).cast("bigint")), 5.0).count() == 0


def test_conflicts_in_a_circle_raise(spark, frame):
    items = frame([(1, False), (2, False), (None, False)], "id bigint, always boolean")
    with pytest.raises(RuntimeError):
        greedy_keep(items, frame([(1, 2), (2, 1)], "first bigint, second bigint"))
    assert sorted(r.id for r in greedy_keep(items, frame([(1, 2)], "first bigint, second bigint")).collect()) == [1]
