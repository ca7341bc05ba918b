"""Queries for ranking, greedy selection, sampling and padding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import coords as C
from ..operators import sampling, select, spatial
from . import fixtures as fx
from . import query
from .fixtures import sql

RANKED = """ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC,
   xor(x*73856093, y*19349663)%1000003, pid) AS n FROM {src})"""


def _scan_sql(forced, r):
    """A sequential scan, one point of every tile per step."""
    return f"""scan(tile_id, n, kept) AS (SELECT DISTINCT tile_id, 0::bigint, []::struct(pid bigint, x bigint, y bigint, f boolean)[] FROM ranked
 UNION ALL SELECT s.tile_id, s.n+1, CASE WHEN {forced} OR len([k FOR k IN s.kept IF (k.x-r.x)*(k.x-r.x)+(k.y-r.y)*(k.y-r.y)<={r * r}])=0
   THEN list_append(s.kept, {{'pid': r.pid, 'x': r.x, 'y': r.y, 'f': {forced}}}) ELSE s.kept END
  FROM scan s JOIN ranked r ON r.tile_id=s.tile_id AND r.n=s.n+1)"""


@query("suppressed_points", sql("points", """
SELECT tile_id, k.pid AS pid FROM (SELECT tile_id, unnest(kept) AS k FROM scan s WHERE n=(SELECT max(n) FROM ranked r WHERE r.tile_id=s.tile_id))""",
    RANKED.format(src="fx_points"), _scan_sql("false", 16)))
def suppressed_points(spark, d):
    return select.suppress_near(fx.points(spark, d), 16.0).select("tile_id", "pid")


@query("suppressed_with_forced", sql("points", """
SELECT tile_id, k.pid AS pid FROM (SELECT tile_id, unnest(kept) AS k FROM scan s WHERE n=(SELECT max(n) FROM ranked r WHERE r.tile_id=s.tile_id))""",
    RANKED.format(src="(SELECT tile_id, pid, x, y, score*1.2 AS score FROM fx_points)"),
    _scan_sql("(r.score>1.0)", 16)))
def suppressed_with_forced(spark, d):
    p = fx.points(spark, d).withColumn("score", F.col("score") * 1.2)
    return select.suppress_near(p, 16.0).select("tile_id", "pid")


PAIRS16 = """near AS (SELECT a.tile_id, a.pid AS a, b.pid AS b, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS cost FROM fx_points a JOIN fx_points b
 ON a.tile_id=b.tile_id AND a.pid%2=0 AND b.pid%2=1 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<=1600),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY cost, a, b) AS n FROM near),
scan(tile_id, n, ua, ub) AS (SELECT DISTINCT tile_id, 0::bigint, []::bigint[], []::bigint[] FROM ranked UNION ALL
 SELECT s.tile_id, s.n+1, CASE WHEN list_contains(ua, r.a) OR list_contains(ub, r.b) THEN ua ELSE list_append(ua, r.a) END,
  CASE WHEN list_contains(ua, r.a) OR list_contains(ub, r.b) THEN ub ELSE list_append(ub, r.b) END FROM scan s JOIN ranked r ON r.tile_id=s.tile_id AND r.n=s.n+1)"""


@query("cheapest_matching", sql("points", """
SELECT s.tile_id, unnest(ua) AS a, unnest(ub) AS b FROM scan s WHERE n=(SELECT max(n) FROM ranked r WHERE r.tile_id=s.tile_id)""", PAIRS16))
def cheapest_matching(spark, d):
    p = fx.points(spark, d)
    return select.nearest_matching(
        p.filter("pid % 2 = 0").withColumnRenamed("pid", "a"), p.filter("pid % 2 = 1").withColumnRenamed("pid", "b"), 40.0).select("tile_id", "a", "b")


@query("triage_filter", sql("triage", "SELECT img_id, round(smd,9) AS smd FROM fx_triage WHERE smd>0.05"))
def triage_filter(spark, d):
    return select.worst_first(fx.triage(spark, d), "smd", 0.05).select("img_id", F.round("smd", 9).alias("smd"))


@query("triage_worst_tenth", sql("triage", """
SELECT img_id, round(smd,9) AS smd FROM (SELECT *, row_number() OVER (ORDER BY smd DESC, img_id) AS n, count(*) OVER () AS c FROM fx_triage) WHERE n<=floor(c*0.1)"""))
def triage_worst_tenth(spark, d):
    return select.worst_share(fx.triage(spark, d), "smd", 0.1, "img_id").select("img_id", F.round("smd", 9).alias("smd"))


@query("triage_sample")
def triage_sample(spark, d):
    """200 rows without replacement out of those above the limit, worst first."""
    return select.worst_first(fx.triage(spark, d), "smd", 0.05, 200, seed=7)


@query("first_point_per_cell", sql("gt", f"""
SELECT tile_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY tile_id, cast(trunc((41.0-y/111111.0)*111111.0/60.0) as bigint),
 cast(trunc((-71.0+x/111111.0/cos(radians(41.0)))*111111.0/60.0) as bigint) ORDER BY node_id%7, node_id) AS n FROM fx_gt_nodes) WHERE n=1"""))
def first_point_per_cell(spark, d):
    n, _ = fx.gt(spark, d)
    la, lo = C.to_latlon(F.col("y"), F.col("x"))
    return select.first_per_cell(n, [C.metre_cell(la, 60.0), C.metre_cell(lo, 60.0)], [F.col("node_id") % 7, F.col("node_id")]).select("tile_id", "node_id")


KNN4 = """knn AS (SELECT * FROM (SELECT a.tile_id, a.pid AS src, b.pid AS dst,
  row_number() OVER (PARTITION BY a.tile_id, a.pid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.pid) AS rank
 FROM fx_points a JOIN fx_points b ON a.tile_id=b.tile_id AND a.pid<>b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<24*24) WHERE rank<=6)"""


def _padded(spark, d):
    p = fx.points(spark, d)
    knn = spatial.nearest_neighbours(p, 6, 24.0)
    all_ = p.select("tile_id", F.col("pid").alias("src")).join(knn, ["tile_id", "src"], "left")
    return sampling.pad_samples(all_.withColumn("connected", (F.col("src") + F.col("dst")) % 2 == 0), 6, ("tile_id", "src"))


@query("padded_samples", sql("points", """
SELECT p.tile_id, p.pid AS src, list(coalesce(k.dst, p.pid) ORDER BY r.i) AS targets, list(coalesce((k.src+k.dst)%2=0, false) ORDER BY r.i) AS connected,
 list(k.dst IS NOT NULL ORDER BY r.i) AS valid FROM fx_points p, range(1,7) r(i)
LEFT JOIN knn k ON k.tile_id=p.tile_id AND k.src=p.pid AND k.rank=r.i GROUP BY ALL""", KNN4))
def padded_samples(spark, d):
    return _padded(spark, d)


@query("padded_points", sql("points", """
SELECT t.tile_id, t.patch_id, coalesce(l.pids, []) AS pids, list_concat(coalesce(l.xy, []), [[0.0::double, 0.0::double] FOR i IN range(m - coalesce(len(l.xy),0))]) AS points FROM
 (SELECT * FROM (SELECT DISTINCT tile_id FROM fx_points), range(8) r(patch_id)) t
 LEFT JOIN (SELECT tile_id, pid%7 AS patch_id, list(pid ORDER BY pid) AS pids, list([x::double, y::double] ORDER BY pid) AS xy FROM fx_points GROUP BY ALL) l USING (tile_id, patch_id),
 (SELECT max(c) AS m FROM (SELECT count(*) AS c FROM fx_points GROUP BY tile_id, pid%7))"""))
def padded_points(spark, d):
    p = fx.points(spark, d).selectExpr("tile_id", "pid%7 AS patch_id", "pid", "x AS px", "y AS py")
    patches = p.select("tile_id").distinct().withColumn("patch_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    return sampling.pad_points(p, patches)


@query("empty_patch_samples", sql("points", """
SELECT tile_id, patch_id, i AS sample_id, 0 AS src, false AS any_valid, 4 AS width FROM (SELECT * FROM (SELECT DISTINCT tile_id FROM fx_points), range(8) r(patch_id)), range(3) s(i)
WHERE patch_id=7 UNION ALL SELECT tile_id, pid%7, pid, pid, true, 1 FROM fx_points"""))
def empty_patch_samples(spark, d):
    p = fx.points(spark, d)
    s = p.selectExpr("tile_id", "pid%7 AS patch_id", "pid AS sample_id", "pid AS src", "array(pid) AS targets", "array(false) AS connected", "array(true) AS valid")
    patches = p.select("tile_id").distinct().withColumn("patch_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    out = sampling.empty_patch_samples(patches, s, 3, 4)
    return out.select("tile_id", "patch_id", "sample_id", "src", F.exists("valid", lambda v: v).alias("any_valid"), F.size("valid").alias("width"))


PATCHES7 = """patches AS (SELECT *, row_number() OVER (ORDER BY tile_id, patch_id)-1 AS n
 FROM (SELECT DISTINCT tile_id FROM fx_points), range(8) r(patch_id)),
spots AS (SELECT tile_id, pid%7 AS patch_id, pid, x, y, row_number() OVER (PARTITION BY tile_id, pid%7 ORDER BY pid)-1 AS at FROM fx_points),
near AS (SELECT * FROM (SELECT a.tile_id, a.patch_id, a.pid AS src, b.pid AS dst, a.at AS src_at, b.at AS dst_at,
  row_number() OVER (PARTITION BY a.tile_id, a.pid ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.pid) AS rank
 FROM spots a JOIN spots b ON a.tile_id=b.tile_id AND a.patch_id=b.patch_id AND a.pid<>b.pid AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)<48*48) WHERE rank<=6)"""


def _exported(spark, d):
    p = fx.points(spark, d).withColumn("patch_id", F.col("pid") % 7)
    near = spatial.nearest_neighbours(p, 6, 48.0, by=("tile_id", "patch_id"))
    all_ = p.select("tile_id", "patch_id", F.col("pid").alias("sample_id"), F.col("pid").alias("src")).join(near, ["tile_id", "patch_id", "src"], "left")
    patches = p.select("tile_id").distinct().withColumn("patch_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))))
    points = p.select("tile_id", "patch_id", "pid", F.col("x").alias("px"), F.col("y").alias("py"))
    return sampling.export_samples(points, all_.withColumn("connected", (F.col("src") + F.col("dst")) % 2 == 0), patches, 3, 6, 5)


@query("exported_points", sql("points", """
SELECT tile_id, patch_id, n//5 AS batch, n%5 AS slot, coalesce(pids, []) AS pids,
 list_concat(coalesce(xy, []), [[0.0::double, 0.0::double] FOR i IN range(greatest(1, max(coalesce(len(xy),0)) OVER (PARTITION BY n//5)) - coalesce(len(xy),0))]) AS points
FROM patches LEFT JOIN (SELECT tile_id, patch_id, list(pid ORDER BY pid) AS pids, list([x::double, y::double] ORDER BY pid) AS xy FROM spots GROUP BY ALL) USING (tile_id, patch_id)""", PATCHES7))
def exported_points(spark, d):
    """Point lists of patches in batches of five, an empty patch in each tile."""
    return _exported(spark, d)[0]


@query("exported_samples", sql("points", """
SELECT p.tile_id, p.patch_id, p.n//5 AS batch, p.n%5 AS slot, s.pid AS sample_id, list([s.at, coalesce(k.dst_at, s.at)] ORDER BY r.i) AS pairs,
 list(coalesce((k.src+k.dst)%2=0, false) ORDER BY r.i) AS connected, list(k.dst IS NOT NULL ORDER BY r.i) AS valid
FROM patches p JOIN spots s USING (tile_id, patch_id), range(1,7) r(i) LEFT JOIN near k ON k.tile_id=p.tile_id AND k.src=s.pid AND k.rank=r.i GROUP BY ALL
UNION ALL SELECT tile_id, patch_id, n//5, n%5, i, [[0,0] FOR x IN range(6)], [false FOR x IN range(6)], [false FOR x IN range(6)] FROM patches, range(3) t(i) WHERE patch_id=7""", PATCHES7))
def exported_samples(spark, d):
    """Samples of the same batches, their pairs by places in the point lists."""
    return _exported(spark, d)[1]


@query("random_patches")
def random_patches(spark, d):
    """One random patch per order: its number grows with the data."""
    tiles = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("tile_id"))
    n = fx.table(spark, d, "orders").count()
    return sampling.random_patches(tiles, n, 2048, 512, 64, seed=11)


@query("weighted_draws")
def weighted_draws(spark, d):
    p = fx.points(spark, d).selectExpr("tile_id", "pid%5 AS patch_id", "pid", "CASE WHEN pid%3=0 THEN 0.9D ELSE 0.1D END AS weight")
    return sampling.weighted_draws(p, 32, seed=3)


@query("jittered_points")
def jittered_points(spark, d):
    p = fx.points(spark, d).selectExpr("tile_id", "pid%5 AS patch_id", "pid", "x*1.0D AS px", "y*1.0D AS py")
    return sampling.jitter(p, seed=5)


@query("random_score_thinning")
def random_score_thinning(spark, d):
    """Thinning under random scores, every seventh point forced to stay."""
    p = select.random_scores(fx.points(spark, d), F.when(F.col("pid") % 7 == 0, F.lit(2.0)).otherwise(0.0), seed=9)
    return select.suppress_near(p, 16.0).select("tile_id", "pid")
