"""Queries for spatial joins and drawing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chains, graph, raster, spatial
from . import fixtures as fx
from . import query
from .fixtures import sql

r6 = lambda c: F.round(c, 6)


@query("nearest_neighbours", sql("points", """
SELECT tile_id, src, dst, rank, round(sqrt(d2),6) AS distance FROM (
 SELECT a.tile_id, a.pid AS src, b.pid AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2,
  row_number() OVER (PARTITION BY a.tile_id, a.pid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.pid) AS rank
 FROM fx_points a JOIN fx_points b ON a.tile_id=b.tile_id AND a.pid<>b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<64*64) WHERE rank<=16"""))
def nearest_neighbours(spark, d):
    k = spatial.nearest_neighbours(fx.points(spark, d), 16, 64.0)
    return k.withColumn("distance", r6("distance"))


@query("radius_pairs", sql("points", """
SELECT a.tile_id, a.pid AS a, b.pid AS b FROM fx_points a JOIN fx_points b ON a.tile_id=b.tile_id AND a.pid<b.pid
 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=256"""))
def radius_pairs(spark, d):
    p = fx.points(spark, d)
    o = p.select("tile_id", F.col("pid").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.radius_join(p.withColumnRenamed("pid", "a"), o, 16.0).filter("a < b").select("tile_id", "a", "b")


BOXES = """boxes AS (SELECT tile_id, i*9+j AS patch_id, i*48 AS x0, j*48 AS y0, i*48+128 AS x1, j*48+128 AS y1
 FROM (SELECT DISTINCT tile_id FROM fx_points), range(9) a(i), range(9) b(j))"""


def _boxes(spark, d):
    axis = F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))
    t = fx.points(spark, d).select("tile_id").distinct().withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis))
    return t.selectExpr("tile_id", "i*9+j AS patch_id", "i*48 AS x0", "j*48 AS y0", "i*48+128 AS x1", "j*48+128 AS y1")


@query("points_in_boxes", sql("points", """
SELECT p.tile_id, p.pid, b.patch_id FROM fx_points p JOIN boxes b ON p.tile_id=b.tile_id AND p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1""", BOXES))
def points_in_boxes(spark, d):
    return spatial.point_in_box_join(fx.points(spark, d), _boxes(spark, d), 64.0).select("tile_id", "pid", "patch_id")


WILD = """wild AS (SELECT c_nationkey::bigint AS tile_id, c_custkey AS src, c_custkey*7 AS dst, (c_custkey*53)%700 AS ax, (c_custkey*91)%650 AS ay,
  (c_custkey*53)%700+(c_custkey%83)-40 AS bx, (c_custkey*91)%650+(c_custkey%71)-30 AS b_y FROM customer)"""


@query("crossovers", sql("", "WITH " + WILD + """
SELECT tile_id, src, src2, round(ax+a*1.0/(a-b)*(bx-ax),6) AS x, round(ay+a*1.0/(a-b)*(b_y-ay),6) AS y FROM (
 SELECT e.tile_id, e.src, f.src AS src2, e.ax, e.ay, e.bx, e.b_y,
  (e.bx-e.ax)*(f.ay-e.ay)-(e.b_y-e.ay)*(f.ax-e.ax) AS c, (e.bx-e.ax)*(f.b_y-e.ay)-(e.b_y-e.ay)*(f.bx-e.ax) AS d,
  (f.bx-f.ax)*(e.ay-f.ay)-(f.b_y-f.ay)*(e.ax-f.ax) AS a, (f.bx-f.ax)*(e.b_y-f.ay)-(f.b_y-f.ay)*(e.bx-f.ax) AS b
 FROM wild e JOIN wild f ON e.tile_id=f.tile_id AND e.src<f.src) WHERE c*d<0 AND a*b<0"""))
def crossovers(spark, d):
    c = fx.table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) AS tile_id", "c_custkey AS k")
    ends = c.selectExpr("tile_id", "k*2 AS node_id", "(k*53)%700 AS x", "(k*91)%650 AS y").unionByName(
        c.selectExpr("tile_id", "k*2+1 AS node_id", "(k*53)%700+(k%83)-40 AS x", "(k*91)%650+(k%71)-30 AS y"))
    edges = c.selectExpr("tile_id", "k*2 AS src", "k*2+1 AS dst")
    x = graph.crossovers(ends, edges)
    return x.selectExpr("tile_id", "src div 2 AS src", "src2 div 2 AS src2", "round(x,6) AS x", "round(y,6) AS y")


@query("points_away_from", sql("points", """
SELECT tile_id, pid FROM fx_points a WHERE NOT EXISTS (SELECT 1 FROM fx_points b WHERE a.tile_id=b.tile_id AND b.pid%5=0
 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=16)"""))
def points_away_from(spark, d):
    p = fx.points(spark, d)
    return spatial.without_near(p, p.filter("pid % 5 = 0"), 4.0, id_col="pid").select("tile_id", "pid")


@query("polyline_connections", sql("", "WITH " + WILD + """, e AS (SELECT tile_id, src AS line, 0 AS part, ax AS x, ay AS y FROM wild
 UNION ALL SELECT tile_id, src, 1, bx, b_y FROM wild), c AS (SELECT a.tile_id, a.line AS i, b.line AS j, a.part AS i_end, b.part AS j_end FROM e a JOIN e b
  ON a.tile_id=b.tile_id AND a.line<b.line AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<144)
SELECT * FROM c UNION ALL SELECT tile_id, j, i, j_end, i_end FROM c"""))
def polyline_connections(spark, d):
    c = fx.table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) AS tile_id", "c_custkey AS line")
    ends = c.selectExpr("tile_id", "line", "0 AS end", "(line*53)%700 AS x", "(line*91)%650 AS y").unionByName(
        c.selectExpr("tile_id", "line", "1 AS end", "(line*53)%700+(line%83)-40 AS x", "(line*91)%650+(line%71)-30 AS y"))
    return chains.polyline_connections(ends, 12.0)


@query("drawn_discs", sql("gt", """
SELECT DISTINCT tile_id, y+j AS y, x+i AS x FROM fx_gt_nodes, range(-3,4) a(i), range(-3,4) b(j) WHERE i*i+j*j<=9"""))
def drawn_discs(spark, d):
    return raster.draw_discs(fx.gt(spark, d)[0], 3)


LINE_PIXELS = """seg AS (SELECT tile_id, ax::double AS ax, ay::double AS ay, bx::double AS bx, b_y::double AS b_y FROM fx_ends),
cand AS (SELECT s.*, unnest(range(cast(least(ax,bx)-{p} as bigint), cast(greatest(ax,bx)+{p}+1 as bigint))) AS x FROM seg s),
cand2 AS (SELECT c.*, unnest(range(cast(least(ay,b_y)-{p} as bigint), cast(greatest(ay,b_y)+{p}+1 as bigint))) AS y FROM cand c),
par AS (SELECT *, (x-ax)*(bx-ax)+(y-ay)*(b_y-ay) AS t, (bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay) AS n, (x-ax)*(b_y-ay)-(y-ay)*(bx-ax) AS c FROM cand2),
lines AS (SELECT DISTINCT tile_id, y, x FROM par
  WHERE CASE WHEN t<=0 THEN (x-ax)*(x-ax)+(y-ay)*(y-ay) WHEN t>=n THEN (x-bx)*(x-bx)+(y-b_y)*(y-b_y) ELSE c*c/n END<={h}*{h})"""


@query("drawn_lines", sql("gt ends", "SELECT tile_id, y, x FROM lines", LINE_PIXELS.format(p=3, h=1.5)))
def drawn_lines(spark, d):
    n, e = fx.gt(spark, d)
    return raster.draw_lines(graph.with_ends(e, n), 3.0)


@query("label_masks", sql("gt ends both", """
SELECT tile_id, y, x, 'road' AS band FROM lines WHERE x BETWEEN 0 AND 2047 AND y BETWEEN 0 AND 2047 UNION ALL
SELECT DISTINCT n.tile_id, y+j AS y, x+i AS x, 'keypoint' FROM fx_gt_nodes n JOIN (SELECT tile_id, src, count(*) AS c FROM fx_both GROUP BY ALL) g
 ON g.tile_id=n.tile_id AND g.src=n.node_id, range(-3,4) a(i), range(-3,4) b(j) WHERE c<>2 AND i*i+j*j<=9
 AND x+i BETWEEN 0 AND 2047 AND y+j BETWEEN 0 AND 2047""", LINE_PIXELS.format(p=3, h=1.5)))
def label_masks(spark, d):
    n, e = fx.gt(spark, d)
    return raster.label_masks(n, e, 2048)


def _draw_sql(name, nodes, edges, dil):
    half = float(dil)
    return f"""{name}_e AS (SELECT e.tile_id, a.x::double AS ax, a.y::double AS ay, b.x::double AS bx, b.y::double AS b_y FROM {edges} e
  JOIN {nodes} a ON a.tile_id=e.tile_id AND a.node_id=e.src JOIN {nodes} b ON b.tile_id=e.tile_id AND b.node_id=e.dst),
{name}_1 AS (SELECT s.*, unnest(range(cast(least(ax,bx)-{dil}-1 as bigint), cast(greatest(ax,bx)+{dil}+2 as bigint))) AS x FROM {name}_e s),
{name}_2 AS (SELECT c.*, unnest(range(cast(least(ay,b_y)-{dil}-1 as bigint), cast(greatest(ay,b_y)+{dil}+2 as bigint))) AS y FROM {name}_1 c),
{name} AS MATERIALIZED (SELECT DISTINCT tile_id, y, x FROM (SELECT *, (x-ax)*(bx-ax)+(y-ay)*(b_y-ay) AS t, (bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay) AS n, (x-ax)*(b_y-ay)-(y-ay)*(bx-ax) AS c FROM {name}_2)
   WHERE CASE WHEN t<=0 THEN (x-ax)*(x-ax)+(y-ay)*(y-ay) WHEN t>=n THEN (x-bx)*(x-bx)+(y-b_y)*(y-b_y) ELSE c*c/n END<={half}*{half}
  UNION SELECT tile_id, y+j, x+i FROM {nodes}, range(-{dil},{dil + 1}) a(i), range(-{dil},{dil + 1}) b(j))"""


@query("drawing_difference", sql("gt pred", """
SELECT * FROM (SELECT *, 'false' AS kind FROM (SELECT * FROM p1 EXCEPT SELECT * FROM g5)
UNION ALL SELECT *, 'missed' FROM (SELECT * FROM g1 EXCEPT SELECT * FROM p5)) WHERE x BETWEEN 0 AND 4095 AND y BETWEEN 0 AND 4095""",
    _draw_sql("p1", "fx_pred_nodes", "fx_pred_edges", 1), _draw_sql("p5", "fx_pred_nodes", "fx_pred_edges", 5),
    _draw_sql("g1", "fx_gt_nodes", "fx_gt_edges", 1), _draw_sql("g5", "fx_gt_nodes", "fx_gt_edges", 5)))
def drawing_difference(spark, d):
    unit = lambda ne: (ne[0].select("tile_id", "node_id", (F.col("x") / 4096.0).alias("x"), (F.col("y") / 4096.0).alias("y")), ne[1])
    return raster.drawing_difference(unit(fx.pred(spark, d)), unit(fx.gt(spark, d)), 4096)


@query("line_of_sight", sql("patch marked", """
SELECT tile_id, src, dst, max(CASE WHEN (px-ax)*(px-ax)+(py-ay)*(py-ay)<=16 OR (px-bx)*(px-bx)+(py-b_y)*(py-b_y)<=16 THEN 0 ELSE coalesce(cost,0) END)<255 AS connected
FROM (SELECT *, cast(floor(ax+CASE WHEN n=0 THEN 0 ELSE i*1.0::double/n END*(bx-ax)+0.5) as bigint) AS px, cast(floor(ay+CASE WHEN n=0 THEN 0 ELSE i*1.0::double/n END*(b_y-ay)+0.5) as bigint) AS py
  FROM (SELECT *, unnest(range(0, n+1)) AS i FROM (SELECT *, greatest(abs(bx-ax), abs(b_y-ay)) AS n FROM
   (SELECT a.tile_id, a.pid AS src, b.pid AS dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM fx_marked a JOIN fx_marked b
    ON a.tile_id=b.tile_id AND a.pid<b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=256))))
LEFT JOIN (SELECT tile_id AS t2, y AS y2, x AS x2, greatest(CASE WHEN d.px IS NULL THEN 0 ELSE 255 END, 255-road) AS cost FROM
   (SELECT tile_id, y, x, coalesce(cast(floor(round(avg(CASE WHEN band='road' THEN score END),9)*255) as integer),0) AS road FROM fx_patch GROUP BY ALL) m
   LEFT JOIN (SELECT DISTINCT tile_id AS t, x+i AS px, y+j AS py FROM fx_marked, range(-4,5) a(i), range(-4,5) b(j) WHERE i*i+j*j<=16) d
   ON d.t=m.tile_id AND d.px=m.x AND d.py=m.y) ON t2=tile_id AND y2=py AND x2=px GROUP BY ALL"""))
def line_of_sight(spark, d):
    from .scalars import byte_masks

    at = fx.marked_pixels(spark, d)
    b = at.select("tile_id", F.col("pid").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by"))
    p = spatial.radius_join(at, b, 16.0, right_xy=("bx", "by")).filter("pid < dst").select(
        "tile_id", F.col("pid").alias("src"), "dst", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    m = byte_masks(spark, d).withColumn("road", F.coalesce("road", F.lit(0)))
    return raster.line_of_sight(p, raster.cost_field(m, at))


@query("feature_sampling", sql("patch places", """
SELECT p.tile_id, p.patch_id, p.pid, round(sum(w*v1),12) AS v1, round(sum(w*v2),12) AS v2 FROM (
 SELECT tile_id, patch_id, pid, floor(gx)+i AS fx, floor(gy)+j AS fy, (1-abs(gx-(floor(gx)+i)))*(1-abs(gy-(floor(gy)+j))) AS w FROM (
  SELECT tile_id, patch_id, pid, px/256.0::double*16-0.5 AS gx, py/256.0::double*16-0.5 AS gy FROM fx_places), range(2) a(i), range(2) b(j)) p
LEFT JOIN (SELECT tile_id, patch_id, x%16 AS fx, y%16 AS fy, max(score) AS v1, min(score) AS v2 FROM fx_patch GROUP BY ALL) f
 ON f.tile_id=p.tile_id AND f.patch_id=p.patch_id AND f.fx=p.fx AND f.fy=p.fy GROUP BY ALL"""))
def feature_sampling(spark, d):
    # scores of four decimals times multiples of 1/256 end at twelve decimals, so no rounding falls on a tie
    v = _sampled(spark, d)
    return v.select("tile_id", "patch_id", "pid", F.round(F.col("vec")[0], 12).alias("v1"), F.round(F.col("vec")[1], 12).alias("v2"))


def _sampled(spark, d):
    f = fx.patch_scores(spark, d).groupBy("tile_id", "patch_id", (F.col("x") % 16).cast("int").alias("fx"), (F.col("y") % 16).cast("int").alias("fy")).agg(
        F.array(F.max("score"), F.min("score")).alias("vec"))
    return raster.sample_features(fx.patch_points(spark, d), f, 256.0, 16)


@query("pair_features", sql("patch places", """
SELECT a.tile_id, a.patch_id, a.pid AS src, b.pid AS dst, [a.px/256.0::double, a.py/256.0::double, b.px/256.0::double, b.py/256.0::double, (b.px-a.px)::double, (b.py-a.py)::double] AS full_vec,
 [a.px/256.0::double, a.py/256.0::double, 0.0::double, 0.0::double, (b.px-a.px)::double, (b.py-a.py)::double] AS no_target
FROM fx_places a JOIN fx_places b ON a.tile_id=b.tile_id AND a.patch_id=b.patch_id AND a.pid<>b.pid AND (a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)<=256"""))
def pair_features(spark, d):
    p = fx.patch_points(spark, d)
    o = p.select("tile_id", "patch_id", F.col("pid").alias("dst"), F.col("px").alias("x2"), F.col("py").alias("y2"))
    pairs = spatial.radius_join(p.withColumnsRenamed({"px": "x", "py": "y"}), o, 16.0, by=("tile_id", "patch_id")).filter("pid <> dst").select(
        "tile_id", "patch_id", F.col("pid").alias("src"), "dst")
    vec = p.select("tile_id", "patch_id", "pid", F.array(F.col("px") / 256.0, F.col("py") / 256.0).alias("vec"))
    full = raster.pair_features(pairs, vec, p).withColumnRenamed("vec", "full_vec")
    none = raster.pair_features(pairs, vec, p, drop="target").withColumnRenamed("vec", "no_target")
    return full.join(none, ["tile_id", "patch_id", "src", "dst"])
