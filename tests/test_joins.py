"""Joins under skew and boxes of very different sizes, against all pairs."""

import random

from pyspark.sql import functions as F

from wayloom.operators import spatial


def test_equal_rows_use_all_slices(spark):
    left = spark.range(1000).select(F.lit(1).alias("k"), F.lit(7).alias("a")).coalesce(1)
    right = spark.range(3).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    l, _ = spatial.slice_hot_keys(left, right, ["k"], rows_per_slice=10)
    assert sorted(r["count"] for r in l.groupBy("_slice").count().collect()) == [10] * 100
    joined = spatial.sliced_join(left, right, ["k"], rows_per_slice=10)
    assert {r.b: r["count"] for r in joined.groupBy("b").count().collect()} == {0: 1000, 1: 1000, 2: 1000}


def test_a_crowded_right_side_is_cut(spark):
    left = spark.range(2).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(1000).select(F.lit(1).alias("k"), F.lit("x").alias("b"))
    _, r = spatial.slice_hot_keys(left, right, ["k"], rows_per_slice=10)
    assert r.groupBy("_slice").count().count() == 100
    assert spatial.sliced_join(left, right, ["k"], rows_per_slice=10).count() == 2000


def test_blocks_of_both_sides_lose_no_pair(spark):
    rnd = random.Random(5)
    a = [(rnd.choice([1, 1, 1, 2, None]), i % 40) for i in range(150)]
    b = [(rnd.choice([1, 1, 2, 2, 3, None]), i % 9) for i in range(120)]
    left, right = spark.createDataFrame(a, "k int, a int"), spark.createDataFrame(b, "k int, b int")
    want = sorted((i, x, y) for i, x in a for j, y in b if i is not None and i == j)
    for n in (1, 7, 1000):
        assert sorted(map(tuple, spatial.sliced_join(left, right, ["k"], rows_per_slice=n).collect())) == want
    l, r = spatial.slice_hot_keys(left, right, ["k"], rows_per_slice=7)
    assert max(x["count"] for df in (l, r) for x in df.groupBy("k", "_slice").count().filter("k is not null").collect()) <= 14


def test_left_joins_keep_each_row_once(spark):
    left = spark.range(50).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(60).select(F.lit(0).cast("bigint").alias("k"), F.col("id").alias("b"))
    for how, n in (("left", 25 * 60 + 25), ("left_semi", 25), ("left_anti", 25)):
        assert spatial.sliced_join(left, right, ["k"], how, rows_per_slice=4).count() == n


def test_partitions_that_run_again_deal_alike(spark):
    """The parts do not hang on the order in which a partition's rows come."""
    left = spark.range(400).select(F.lit(1).alias("k"), (F.col("id") % 50).alias("a")).coalesce(1)
    right = spark.range(1).select(F.lit(1).alias("k"))
    seen = []
    for order in (F.col("a").asc(), F.col("a").desc()):
        l, _ = spatial.slice_hot_keys(left.sortWithinPartitions(order), right, ["k"], rows_per_slice=9)
        seen.append(sorted(map(tuple, l.select("a", "_slice").collect())))
    assert seen[0] == seen[1]


def _boxes(rnd, n):
    out = []
    for i in range(n):
        x, y = rnd.uniform(-50, 300), rnd.uniform(-50, 300)
        w, h = (rnd.choice([0.0, 1.0, 4.0, 8.0, rnd.uniform(0, 3), rnd.uniform(0, 400)]) for _ in range(2))
        out.append((i, x, y, x + w, y + h))
    return out


def _overlap(p, q):
    return p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4]


def test_boxes_of_all_sizes_meet_once(frame):
    rnd = random.Random(8)
    a, b = _boxes(rnd, 120), _boxes(rnd, 120)
    l = frame([*a, (999, None, 0.0, 1.0, 1.0)], "a bigint, ax0 double, ay0 double, ax1 double, ay1 double")
    r = frame([*b, (999, 0.0, 0.0, None, 1.0)], "b bigint, bx0 double, by0 double, bx1 double, by1 double")
    lb, rb = ([F.col(s + c) for c in ("x0", "y0", "x1", "y1")] for s in "ab")
    over = (lb[0] <= rb[2]) & (rb[0] <= lb[2]) & (lb[1] <= rb[3]) & (rb[1] <= lb[3])
    want = sorted((p[0], q[0]) for p in a for q in b if _overlap(p, q))
    for n in (5, 100_000):
        got = spatial.box_join(l, r, lb, rb, 4.0, rows_per_slice=n).filter(over).select("a", "b").collect()
        assert sorted(map(tuple, got)) == want
    flat = spatial.box_join(l, r, lb, rb, 4.0, levels=False).filter(over).select("a", "b").collect()
    assert sorted(map(tuple, flat)) == want


def test_points_meet_boxes_of_all_sizes(frame):
    rnd = random.Random(9)
    boxes = _boxes(rnd, 80)
    pts = [(i, rnd.uniform(-60, 500), rnd.uniform(-60, 500)) for i in range(150)] + [(500 + b[0], b[1], b[4]) for b in boxes]
    got = spatial.point_in_box_join(
        frame([*pts, (9999, None, 1.0)], "pid bigint, x double, y double"),
        frame(boxes, "b bigint, x0 double, y0 double, x1 double, y1 double"), 4.0).select("pid", "b").collect()
    assert sorted(map(tuple, got)) == sorted(
        (p, b[0]) for p, x, y in pts for b in boxes if b[1] <= x <= b[3] and b[2] <= y <= b[4])


def test_a_long_box_fills_few_cells(frame):
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    long = frame([(i, 3.0, 3.0, 3.0 + 10.0 ** i, 5.0) for i in range(9)], "b bigint, x0 double, y0 double, x1 double, y1 double")
    marked = long.withColumn("_level", spatial._level(box, 1.0))
    at = spatial._meetings(marked, box, 1.0, F.array().cast("array<int>"), True).filter("_kind = 0")
    assert max(r["count"] for r in at.groupBy("b").count().collect()) <= 4


def test_empty_sides(frame):
    a = frame([], "a bigint, ax0 double, ay0 double, ax1 double, ay1 double")
    b = frame([(1, 0.0, 0.0, 1.0, 1.0)], "b bigint, bx0 double, by0 double, bx1 double, by1 double")
    lb, rb = ([F.col(s + c) for c in ("x0", "y0", "x1", "y1")] for s in "ab")
    assert spatial.box_join(a, b, lb, rb, 4.0).count() == 0
    assert spatial.box_join(b, a, rb, lb, 4.0).count() == 0


def test_crowded_neighbours_are_looked_for_nearby_first(spark, frame, monkeypatch):
    from wayloom.operators import spatial

    pts = [(i, float(i % 20), float(i // 20)) for i in range(400)] + [(1000, 300.0, 300.0), (1001, 330.0, 300.0), (1002, 5.0, 5.0)]
    p = frame(pts, "pid bigint, x double, y double")
    rows = lambda: {tuple(r) for r in spatial.nearest_neighbours(p, 4, 48.0).collect()}
    want = rows()
    looked = []
    join = spatial.radius_join

    def counted(left, right, radius, **more):
        looked.append((radius, left.count()))
        return join(left, right, radius, **more)

    monkeypatch.setattr(spatial, "radius_join", counted)
    monkeypatch.setattr(spatial, "AT_ONCE", 0)
    assert rows() == want
    assert dict(looked)[48.0] == 2  # the two that lie alone
