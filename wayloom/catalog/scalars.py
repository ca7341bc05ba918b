"""Queries for coordinate, geometry and pixel expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..functions import geometry as G
from ..operators import graph, raster, sampling, scoring
from . import fixtures as fx
from . import query
from .fixtures import sql

r6 = lambda c: F.round(c, 6)
LAT = "(41.0 - {r}/111111.0)"
LON = "(-71.0 + {c}/111111.0/cos(radians(41.0)))"


def lat(r):
    return LAT.format(r=r)


def lon(c):
    return LON.format(c=c)


@query("coordinate_frames", sql("gt", f"""
SELECT tile_id, node_id, y AS sx, x AS sy, y AS nx, 400 - x AS ny, 400 - (400 - x) AS back0, y AS back1,
  round({lat('x')}, 9) AS lat, round({lon('y')}, 9) AS lon,
  printf('%.7f_%.7f', {lat('x')}, {lon('y')}) AS loc_key,
  cast(trunc({lat('x')}*111111.0/2.0) as bigint) AS cell_lat, cast(trunc({lon('y')}*111111.0/2.0) as bigint) AS cell_lon
FROM fx_gt_nodes"""))
def coordinate_frames(spark, d):
    n, _ = fx.gt(spark, d)
    r, c = F.col("x"), F.col("y")
    sx, sy = C.rc_to_xy(r, c)
    nx, ny = C.native_to_xy(r, c)
    b0, b1 = C.xy_to_native(nx, ny)
    la, lo = C.to_latlon(r, c)
    return n.select(
        "tile_id", "node_id", sx.alias("sx"), sy.alias("sy"), nx.alias("nx"), ny.alias("ny"), b0.alias("back0"), b1.alias("back1"),
        F.round(la, 9).alias("lat"), F.round(lo, 9).alias("lon"), C.location_key(la, lo).alias("loc_key"),
        C.metre_cell(la, 2.0).alias("cell_lat"), C.metre_cell(lo, 2.0).alias("cell_lon"))


@query("latlon_pixels", sql("gt", f"""
SELECT tile_id, node_id, cast(512 - trunc(({lat('y')}-40.98)/((41.0-40.98)/512)) as integer) AS r,
  cast(trunc(({lon('x')}-(-71.0))/((-70.97-(-71.0))/640)) as integer) AS c FROM fx_gt_nodes"""))
def latlon_pixels(spark, d):
    n, _ = fx.gt(spark, d)
    la, lo = C.to_latlon(F.col("y"), F.col("x"))
    r, c = C.latlon_to_pixel(la, lo, F.lit(40.98), F.lit(-71.0), F.lit(41.0), F.lit(-70.97), 512, 640)
    return n.select("tile_id", "node_id", r.alias("r"), c.alias("c"))


def _latlon_ends(spark, d):
    n, e = fx.gt(spark, d)
    ends = graph.with_ends(e, n)
    la1, lo1 = C.to_latlon(F.col("ay"), F.col("ax"))
    la2, lo2 = C.to_latlon(F.col("by"), F.col("bx"))
    return ends.withColumns({"la1": la1, "lo1": lo1, "la2": la2, "lo2": lo2})


LL = f"""fx_ll AS (SELECT *, {lat('ay')} AS la1, {lon('ax')} AS lo1, {lat('b_y')} AS la2, {lon('bx')} AS lo2 FROM fx_ends)"""


@query("latlon_distances", sql("gt ends", """
SELECT tile_id, src, dst,
  round(sqrt((la1-la2)*(la1-la2)+(lo1-lo2)*cos(radians(la1))*(lo1-lo2)*cos(radians(la1))), 9) AS degrees,
  round(sqrt(((la1-la2)*111111.0)^2+((lo1-lo2)*111111.0*cos(radians(la1)))^2), 6) AS metres,
  round(u1/un, 6) AS dir_lat, round(u2/un, 6) AS dir_lon, round(1-abs((u1*1.0+u2*0.0)/un), 6) AS gap_north,
  round(CASE WHEN vn=0 THEN 100000.0 ELSE sqrt((dy/vn-1.0)^2+(dx/vn)^2) END, 6) AS dir_dist
FROM (SELECT *, la2-la1 AS u1, (lo2-lo1)*cos(radians(40.0)) AS u2,
  sqrt((la2-la1)^2+((lo2-lo1)*cos(radians(40.0)))^2) AS un, (b_y-ay)*1.0 AS dy, (bx-ax)*1.0 AS dx,
  sqrt((b_y-ay)*(b_y-ay)+(bx-ax)*(bx-ax)) AS vn FROM fx_ll)""", LL))
def latlon_distances(spark, d):
    e = _latlon_ends(spark, d)
    la1, lo1, la2, lo2 = (F.col(c) for c in ("la1", "lo1", "la2", "lo2"))
    u = C.unit_direction(la2 - la1, lo2 - lo1)
    return e.select(
        "tile_id", "src", "dst", F.round(C.degree_distance(la1, lo1, la2, lo2), 9).alias("degrees"),
        r6(C.metre_distance(la1, lo1, la2, lo2)).alias("metres"), r6(u[0]).alias("dir_lat"), r6(u[1]).alias("dir_lon"),
        r6(C.angle_gap(u, (F.lit(1.0), F.lit(0.0)))).alias("gap_north"),
        r6(C.direction_distance((F.col("by") - F.col("ay")) * 1.0, (F.col("bx") - F.col("ax")) * 1.0, F.lit(1.0), F.lit(0.0))).alias("dir_dist"))


@query("point_to_segment", sql("gt ends", """
SELECT tile_id, src, dst, round(sqrt((px-(ax+s*(bx-ax)))^2+(py-(ay+s*(b_y-ay)))^2), 6) AS dist,
  least(ax,bx)-1 AS x0, least(ay,b_y)-1 AS y0, greatest(ax,bx)+1 AS x1, greatest(ay,b_y)+1 AS y1
FROM (SELECT *, greatest(0.0, least(1.0, ((px-ax)*(bx-ax)+(py-ay)*(b_y-ay))*1.0/((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay)))) AS s
  FROM (SELECT *, ax+dst%97-20 AS px, ay+src%89-30 AS py FROM fx_ends))"""))
def point_to_segment(spark, d):
    n, e = fx.gt(spark, d)
    p = graph.with_ends(e, n).withColumns({"px": F.col("ax") + F.col("dst") % 97 - 20, "py": F.col("ay") + F.col("src") % 89 - 30})
    box = G.segment_box(*[F.col(c) for c in ("ax", "ay", "bx", "by")])
    dist = G.point_segment_distance(*[F.col(c) for c in ("ax", "ay", "bx", "by", "px", "py")])
    return p.select("tile_id", "src", "dst", r6(dist).alias("dist"), *[b.alias(n) for b, n in zip(box, ("x0", "y0", "x1", "y1"))])


@query("point_to_segment_latlon", sql("gt ends", """
SELECT tile_id, src, dst, round(sqrt((p0-s*q0)^2+(p1-s*q1)^2)*111111.0, 4) AS metres
FROM (SELECT *, greatest(0.0, least(1.0, (p0*q0+p1*q1)/(q0*q0+q1*q1))) AS s FROM (SELECT *, la2-la1 AS q0, (lo2-lo1)*cos(radians(la1)) AS q1,
  (src%50-25)/111111.0 AS p0, (dst%60-30)/111111.0*cos(radians(la1)) AS p1 FROM fx_ll))""", LL))
def point_to_segment_latlon(spark, d):
    e = _latlon_ends(spark, d)
    la1, lo1, la2, lo2 = (F.col(c) for c in ("la1", "lo1", "la2", "lo2"))
    dist = G.point_segment_distance_latlon(la1, lo1, la2, lo2, la1 + (F.col("src") % 50 - 25) / 111111.0, lo1 + (F.col("dst") % 60 - 30) / 111111.0)
    return e.select("tile_id", "src", "dst", F.round(dist * 111111.0, 4).alias("metres"))


def _segments(spark, d):
    return fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey%50 AS ax", "l_suppkey%40 AS ay", "l_partkey%31 AS bx", "l_suppkey%37 AS `by`",
        "l_orderkey%50 AS cx", "l_orderkey%40 AS cy", "cast(l_quantity as bigint) AS dx", "l_linenumber*7 AS dy")


SEG = """seg AS (SELECT l_orderkey, l_linenumber, l_partkey%50 AS ax, l_suppkey%40 AS ay, l_partkey%31 AS bx, l_suppkey%37 AS b_y,
  l_orderkey%50 AS cx, l_orderkey%40 AS cy, cast(l_quantity as bigint) AS dx, l_linenumber*7 AS dy FROM lineitem)"""


@query("segment_crossing", sql("", """
SELECT l_orderkey, l_linenumber, round(ax+a*1.0/(a-b)*(bx-ax), 6) AS x, round(ay+a*1.0/(a-b)*(b_y-ay), 6) AS y
FROM (SELECT *, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) AS c, (bx-ax)*(dy-ay)-(b_y-ay)*(dx-ax) AS d,
  (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) AS a, (dx-cx)*(b_y-cy)-(dy-cy)*(bx-cx) AS b FROM seg)
WHERE c*d<0 AND a*b<0""").replace("FROM seg)", "FROM (" + SEG.split("AS (", 1)[1] + ")"))
def segment_crossing(spark, d):
    p = G.crossing_point(*[F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")])
    return _segments(spark, d).withColumn("p", p).filter("p is not null").select(
        "l_orderkey", "l_linenumber", r6("p.x").alias("x"), r6("p.y").alias("y"))


@query("ray_hits", """
SELECT l_orderkey, l_linenumber, round(px,6) AS x, round(py,6) AS y, round(sqrt((px-ax)*(px-ax)+(py-ay)*(py-ay)),6) AS reach
FROM (SELECT *, cx+f*(dx-cx) AS px, cy+f*(dy-cy) AS py FROM (
  -- heights of the segment's ends over the ray's line; f is where on the segment the height is zero
  SELECT *, CASE WHEN hc<>hd THEN hc*1.0/(hc-hd) END AS f FROM (
    SELECT *, (bx-ax)*cy-(b_y-ay)*cx-((bx-ax)*ay-(b_y-ay)*ax) AS hc, (bx-ax)*dy-(b_y-ay)*dx-((bx-ax)*ay-(b_y-ay)*ax) AS hd FROM (""" + SEG.split("AS (", 1)[1] + """)))
WHERE f BETWEEN 0 AND 1 AND (px-ax)*(bx-ax)+(py-ay)*(b_y-ay)>=0""")
def ray_hits(spark, d):
    s = _segments(spark, d)
    c = {k: F.col(k) for k in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy")}
    hit = G.ray_hit(c["ax"], c["ay"], c["bx"] - c["ax"], c["by"] - c["ay"], c["cx"], c["cy"], c["dx"], c["dy"])
    return s.withColumn("h", hit).filter("h is not null").select(
        "l_orderkey", "l_linenumber", r6("h.x").alias("x"), r6("h.y").alias("y"), r6("h.reach").alias("reach"))


KLON = "cos(41.0/180.0*3.1415926)"


@query("inner_region", sql("gt", f"""
SELECT tile_id, node_id,
  la > 41.0-2048.0/111111.0+100.0/111111.0 AND la < 41.0-100.0/111111.0 AND lo > -71.0+100.0/111111.0/{KLON}
    AND lo < -71.0+2048.0/111111.0/{KLON}-100.0/111111.0/{KLON} AS in_tile,
  la-40.985 > 0.07*0.015 AND 41.0-la > 0.07*0.015 AND lo+71.0 > 0.07*0.025 AND -70.975-lo > 0.07*0.025 AS in_margin,
  x>24 AND x<376 AND y>24 AND y<376 AS in_crop
FROM (SELECT *, {lat('y')} AS la, {lon('x')} AS lo FROM fx_gt_nodes)"""))
def inner_region(spark, d):
    n, _ = fx.gt(spark, d)
    la, lo = C.to_latlon(F.col("y"), F.col("x"))
    return n.select(
        "tile_id", "node_id", C.in_tile(la, lo).alias("in_tile"),
        C.inside_margin(la, lo, F.lit(40.985), F.lit(-71.0), F.lit(41.0), F.lit(-70.975)).alias("in_margin"),
        C.in_crop(F.col("x"), F.col("y")).alias("in_crop"))


@query("cropped_adjacency", sql("gt both", """
SELECT tile_id, r, c, n.r2 - 24 AS nr, n.c2 - 24 AS nc FROM (
  SELECT a.tile_id, a.y%400-24 AS r, a.x%400-24 AS c, b.y%400 AS r2, b.x%400 AS c2 FROM fx_both e
  JOIN fx_gt_nodes a ON a.tile_id=e.tile_id AND a.node_id=e.src JOIN fx_gt_nodes b ON b.tile_id=e.tile_id AND b.node_id=e.dst
  WHERE a.y%400>24 AND a.y%400<376 AND a.x%400>24 AND a.x%400<376) n WHERE r2>24 AND r2<376 AND c2>24 AND c2<376"""))
def cropped_adjacency(spark, d):
    from ..sources import graphs

    n, e = fx.gt(spark, d)
    n = n.select("tile_id", "node_id", (F.col("y") % 400).alias("r"), (F.col("x") % 400).alias("c"))
    adj = graphs.adjacency_table(n, e, ("r", "c"))
    cut = graphs.crop_adjacency(adj)
    return cut.select("tile_id", F.col("node.r").alias("r"), F.col("node.c").alias("c"), F.explode("nbrs").alias("n")).select(
        "tile_id", "r", "c", F.col("n.r").alias("nr"), F.col("n.c").alias("nc"))


@query("patch_rotation", sql("points", """
SELECT tile_id, pid, CASE t WHEN 0 THEN px WHEN 1 THEN py WHEN 2 THEN 256-px ELSE 256-py END AS x,
  CASE t WHEN 0 THEN py WHEN 1 THEN 256-px WHEN 2 THEN 256-py ELSE px END AS y
FROM (SELECT *, x-100 AS px, y-90 AS py, pid%4 AS t FROM fx_points)"""))
def patch_rotation(spark, d):
    p = fx.points(spark, d)
    x, y = C.rotate_in_patch(F.col("x") - 100, F.col("y") - 90, 256, F.col("pid") % 4)
    return p.select("tile_id", "pid", x.alias("x"), y.alias("y"))


@query("pixel_rotation", sql("patch", """
SELECT tile_id, patch_id, band, score, CASE t WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN 63-x ELSE 63-y END AS x,
  CASE t WHEN 0 THEN y WHEN 1 THEN 63-x WHEN 2 THEN 63-y ELSE x END AS y FROM (SELECT *, patch_id AS t FROM fx_patch)"""))
def pixel_rotation(spark, d):
    return raster.rotate(fx.patch_scores(spark, d), 64, F.col("patch_id")).select("tile_id", "patch_id", "band", "score", "x", "y")


@query("pixel_normalize", sql("patch", """
SELECT tile_id, patch_id, y, x, band, round((score*255 - CASE band WHEN 'road' THEN 103.53 ELSE 116.28 END)
  / CASE band WHEN 'road' THEN 57.375 ELSE 57.12 END, 6) AS value, round(score*255/255.0, 6) AS mask FROM fx_patch"""))
def pixel_normalize(spark, d):
    p = fx.patch_scores(spark, d).withColumn("value", F.col("score") * 255)
    p = p.withColumn("mask", r6(F.col("value") / 255.0))
    out = raster.normalize(p, {"road": 103.53, "keypoint": 116.28}, {"road": 57.375, "keypoint": 57.12})
    return out.select("tile_id", "patch_id", "y", "x", "band", r6("value").alias("value"), "mask")


FUSED = """fused AS (SELECT tile_id, y, x, avg(CASE WHEN band='keypoint' THEN score END) AS keypoint,
  avg(CASE WHEN band='road' THEN score END) AS road FROM fx_patch GROUP BY ALL)"""


@query("mask_fusion", sql("patch", """
SELECT tile_id, y, x, round(keypoint,6) AS keypoint, round(road,6) AS road FROM fused""", FUSED))
def mask_fusion(spark, d):
    f = raster.fuse_masks(fx.wide_patch_scores(spark, d))
    return f.select("tile_id", "y", "x", r6("keypoint").alias("keypoint"), r6("road").alias("road"))


def byte_masks(spark, d):
    # 9 decimals before the cut, so that the order of summation cannot move a score over a whole number
    f = raster.fuse_masks(fx.wide_patch_scores(spark, d))
    return raster.to_bytes(f.withColumns({b: F.round(b, 9) for b in ("keypoint", "road")}))


@query("mask_points", sql("patch", """
SELECT tile_id, y, x, band, score FROM (
  SELECT tile_id, y, x, 'keypoint' AS band, cast(floor(round(keypoint,9)*255) as integer) AS score FROM fused
  UNION ALL SELECT tile_id, y, x, 'road', cast(floor(round(road,9)*255) as integer) FROM fused)
WHERE score > CASE band WHEN 'road' THEN 0.364 ELSE 0.248 END * 255""", FUSED))
def mask_points(spark, d):
    m = byte_masks(spark, d)
    k = raster.mask_points(m, "keypoint", 0.248).withColumn("band", F.lit("keypoint"))
    return k.unionByName(raster.mask_points(m, "road", 0.364).withColumn("band", F.lit("road"))).select("tile_id", "y", "x", "band", "score")


@query("patch_crop", sql("patch", """
SELECT p.tile_id, b.patch AS patch, p.band, p.x - b.x0 AS px, p.y - b.y0 AS py, p.score FROM fx_patch p JOIN
 (SELECT DISTINCT tile_id, patch_id AS patch, (patch_id%2)*20 AS x0, (patch_id//2)*12 AS y0 FROM fx_patch) b
 ON p.tile_id=b.tile_id AND p.x>=b.x0 AND p.x<b.x0+32 AND p.y>=b.y0 AND p.y<b.y0+24"""))
def patch_crop(spark, d):
    p = fx.patch_scores(spark, d)
    boxes = p.select("tile_id", F.col("patch_id").alias("patch")).distinct().selectExpr(
        "tile_id", "patch", "(patch%2)*20 AS x0", "(patch div 2)*12 AS y0", "(patch%2)*20+32 AS x1", "(patch div 2)*12+24 AS y1")
    return raster.crop(p.drop("patch_id"), boxes, 16.0).select("tile_id", "patch", "band", "px", "py", "score")


@query("pair_score_cleanup", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey%17=0 THEN -100.0 ELSE l_discount*10 END AS raw,
  round(1/(1+exp(-(l_tax*100-4))), 6) AS sigmoid
FROM lineitem WHERE l_partkey%17<>0""")
def pair_score_cleanup(spark, d):
    p = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") % 17 != 0).alias("valid"),
        F.when(F.col("l_partkey") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("l_discount") * 10).alias("score"), "l_tax")
    return scoring.clean_pair_scores(p).select(
        "l_orderkey", "l_linenumber", F.col("score").alias("raw"), r6(C.sigmoid(F.col("l_tax") * 100 - 4)).alias("sigmoid"))


DISC = "disc AS (SELECT i, j FROM range(-6,7) a(i), range(-6,7) b(j))"


@query("cost_fields", sql("patch points", """
SELECT m.tile_id, m.y, m.x, greatest(CASE WHEN d4.x IS NULL THEN 0 ELSE 255 END, 255-m.road) AS sight,
  CASE WHEN greatest(CASE WHEN d6.x IS NULL THEN 0 ELSE 255 END, 255-m.road)=0 THEN 1
       WHEN greatest(CASE WHEN d6.x IS NULL THEN 0 ELSE 255 END, 255-m.road)>200 THEN 0
       ELSE greatest(CASE WHEN d6.x IS NULL THEN 0 ELSE 255 END, 255-m.road) END AS walk
FROM (SELECT tile_id, y, x, coalesce(cast(floor(round(road,9)*255) as integer),0) AS road FROM fused) m
LEFT JOIN (SELECT DISTINCT tile_id, x+i AS x, y+j AS y FROM fx_points, disc WHERE i*i+j*j<=16) d4 USING (tile_id, x, y)
LEFT JOIN (SELECT DISTINCT tile_id, x+i AS x, y+j AS y FROM fx_points, disc WHERE i*i+j*j<=36) d6 USING (tile_id, x, y)""", FUSED, DISC))
def cost_fields(spark, d):
    m = byte_masks(spark, d).withColumn("road", F.coalesce("road", F.lit(0)))
    p = fx.points(spark, d)
    a = raster.cost_field(m, p).withColumnRenamed("cost", "sight")
    b = raster.walk_cost_field(m, p).withColumnRenamed("cost", "walk")
    return a.join(b, ["tile_id", "y", "x"])


@query("tile_split", """
SELECT p_partkey AS tile_id, CASE WHEN p_partkey>=180 THEN NULL WHEN p_partkey%10<8 THEN 'train'
  WHEN p_partkey%10=9 OR p_partkey%20=8 THEN 'test' ELSE 'validation' END AS split FROM part""")
def tile_split(spark, d):
    return fx.table(spark, d, "part").select(F.col("p_partkey").alias("tile_id"), sampling.split_of(F.col("p_partkey")).alias("split"))


@query("split_unions", """
WITH s AS (SELECT p_partkey AS tile_id, CASE WHEN p_partkey%10<8 THEN 'train'
  WHEN p_partkey%10=9 OR p_partkey%20=8 THEN 'test' ELSE 'validation' END AS split FROM part WHERE p_partkey<180)
SELECT tile_id, 'training' AS use FROM s WHERE split IN ('train','validation') UNION ALL SELECT tile_id, 'all' FROM s""")
def split_unions(spark, d):
    s = tile_split(spark, d).filter("split is not null")
    return sampling.training_tiles(s).withColumn("use", F.lit("training")).unionByName(
        sampling.all_split_tiles(s).select("tile_id").withColumn("use", F.lit("all")))


def _grid_sql(k, size, patch, margin):
    step = (size - (patch + margin) - margin) / (k - 1)
    at = lambda i: f"cast(round_even({float(margin)} + {i}*{step!r}, 0) as integer)"
    return f"""SELECT s_suppkey AS tile_id, i*{k}+j AS patch_id, {at('i')} AS x0, {at('j')} AS y0,
  {at('i')}+{patch} AS x1, {at('j')}+{patch} AS y1 FROM supplier, range({k}) a(i), range({k}) b(j)"""


@query("patch_grid", _grid_sql(16, 2048, 512, 64))
def patch_grid(spark, d):
    return sampling.patch_grid(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id")), 2048, 512, 64, 16)


@query("evaluation_grid", _grid_sql(4, 2048, 512, 64))
def evaluation_grid(spark, d):
    return sampling.evaluation_grid(fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id")), 2048, 512, 64)
