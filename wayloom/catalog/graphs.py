"""Queries for graph tables: sources, sinks, edge sets, relabelling, subdivision."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, scoring
from ..sources import graphs as src
from ..sources import sinks
from . import fixtures as fx
from . import query
from .fixtures import sql

VOTED = """voted AS (SELECT tile_id, src, dst FROM fx_pairs GROUP BY ALL HAVING round(avg(score),9) > 0.5),
flat AS (SELECT DISTINCT tile_id, least(src,dst) AS src, greatest(src,dst) AS dst FROM voted),
nodes0 AS (SELECT DISTINCT tile_id, node FROM (SELECT tile_id, src AS node FROM fx_pairs UNION ALL SELECT tile_id, dst FROM fx_pairs)),
both0 AS (SELECT tile_id, src, dst FROM flat UNION SELECT tile_id, dst, src FROM flat),
deg0 AS (SELECT tile_id, src AS node, count(*) AS degree FROM both0 GROUP BY ALL)"""


@query("edge_voting_graph", sql("pairs", """
SELECT tile_id, node, row_number() OVER (PARTITION BY tile_id ORDER BY node)-1 AS node_id, degree, degree<>2 AS junction,
  (SELECT list(dst ORDER BY dst) FROM both0 b WHERE b.tile_id=d.tile_id AND b.src=d.node) AS nbrs
FROM deg0 d""", VOTED))
def edge_voting_graph(spark, d):
    """Vote per-patch edge scores, keep accepted links as an undirected graph without isolated nodes."""
    links = graph.undirected(scoring.vote_edges(fx.pair_scores(spark, d), 0.5))
    both = graph.symmetric(links)
    deg = graph.degrees(links).withColumnRenamed("node_id", "node")
    nbrs = both.groupBy("tile_id", F.col("src").alias("node")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    nodes = graph.dense_ids(deg, ["node"], "node_id", graph.id_chunk("node"))
    return nodes.join(nbrs, ["tile_id", "node"]).select(
        "tile_id", "node", "node_id", "degree", (F.col("degree") != 2).alias("junction"), "nbrs")


@query("edge_score_votes", sql("pairs", """
SELECT tile_id, src, dst, round(avg(score),6) AS score FROM fx_pairs GROUP BY ALL HAVING round(avg(score),9) > 0.5"""))
def edge_score_votes(spark, d):
    return scoring.vote_edges(fx.pair_scores(spark, d), 0.5).withColumn("score", F.round("score", 6))


ORDER_PATH = """pts AS (SELECT l_orderkey AS tile_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey%100, l_suppkey%5)-1 AS node_id,
  40.0::double+(l_partkey%100)/100.0::double AS lat, -71.0::double+(l_suppkey%5)/8.0::double AS lon FROM lineitem)"""


@query("graph_json_nodes", sql("", "WITH " + ORDER_PATH + """
SELECT tile_id, node_id, round(lat,7) AS lat, round(lon,7) AS lon, printf('%.7f_%.7f', lat, lon) AS loc_key,
  min(node_id) OVER (PARTITION BY tile_id, printf('%.7f_%.7f', lat, lon)) AS first_id FROM pts"""))
def graph_json_nodes(spark, d):
    """Each order's line items as one JSON document with a path graph, parsed back to node rows."""
    n, _ = src.parse_graph_json(_order_documents(spark, d))
    return n.select("tile_id", "node_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), "loc_key", "first_id")


@query("graph_json_edges", sql("", "WITH " + ORDER_PATH + """
SELECT a.tile_id, a.node_id AS src, b.node_id AS dst FROM pts a JOIN pts b ON a.tile_id=b.tile_id AND b.node_id=a.node_id+1"""))
def graph_json_edges(spark, d):
    return src.parse_graph_json(_order_documents(spark, d))[1]


def _order_documents(spark, d):
    li = fx.table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey%100 AS a", "l_suppkey%5 AS b", "format_string('[%.4f, %.4f]', 40.0+(l_partkey%100)/100.0D, -71.0+(l_suppkey%5)/8.0D) AS p")
    # a document is one text value by nature; an order has few line items
    g = li.groupBy(F.col("l_orderkey").alias("tile_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "a", "b", "p"))).alias("_l"))
    nodes = F.concat_ws(",", F.transform("_l", lambda e: e["p"]))
    edges = F.when(F.size("_l") > 1, F.concat_ws(",", F.transform(
        F.sequence(F.lit(0), F.size("_l") - 2), lambda i: F.format_string("[%d, %d]", i, i + 1)))).otherwise(F.lit(""))
    return g.select("tile_id", F.concat(F.lit("[["), nodes, F.lit("],["), edges, F.lit("]]")).alias("doc"))


def _rc(nodes):
    return nodes.select("tile_id", "node_id", F.col("y").alias("r"), F.col("x").alias("c"))


DENSE = """spots AS (SELECT DISTINCT tile_id, y AS r, x AS c FROM fx_gt_nodes),
dense AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY floor(r/64), floor(c/64), r, c)-1 AS node_id FROM spots),
dedges AS (SELECT e.tile_id, s.node_id AS src, t.node_id AS dst FROM fx_both e
  JOIN fx_gt_nodes a ON a.tile_id=e.tile_id AND a.node_id=e.src JOIN fx_gt_nodes b ON b.tile_id=e.tile_id AND b.node_id=e.dst
  JOIN dense s ON s.tile_id=e.tile_id AND s.r=a.y AND s.c=a.x JOIN dense t ON t.tile_id=e.tile_id AND t.r=b.y AND t.c=b.x)"""


@query("adjacency_nodes", sql("gt both", "SELECT tile_id, node_id, r, c FROM dense", DENSE))
def adjacency_nodes(spark, d):
    n, e = fx.gt(spark, d)
    return src.from_adjacency(src.adjacency_table(_rc(n), e))[0]


@query("adjacency_nodes_native", sql("gt both", "SELECT tile_id, node_id, c AS x, 400-r AS y FROM dense", DENSE))
def adjacency_nodes_native(spark, d):
    from ..functions.coords import native_to_xy

    n, e = fx.gt(spark, d)
    return src.from_adjacency(src.adjacency_table(_rc(n), e), native_to_xy)[0]


@query("adjacency_edges", sql("gt both", "SELECT tile_id, src, dst FROM dedges", DENSE))
def adjacency_edges(spark, d):
    n, e = fx.gt(spark, d)
    return src.from_adjacency(src.adjacency_table(_rc(n), e))[1]


@query("road_graph_region", sql("gt both", """
SELECT tile_id, count(*) AS nodes, round(min(41.0-y/111111.0)-300.0/111111.0, 9) AS min_lat, round(-71.0-500.0/111111.0, 9) AS min_lon,
  round(41.0+300.0/111111.0, 9) AS max_lat, round(max(-71.0+x/111111.0/cos(radians(41.0)))+500.0/111111.0, 9) AS max_lon
FROM fx_gt_nodes GROUP BY tile_id"""))
def road_graph_region(spark, d):
    n, e = fx.gt(spark, d)
    nodes, _, region = src.road_graph(src.adjacency_table(_rc(n), e))
    c = nodes.filter("node_score = 100").groupBy("tile_id").agg(F.count(F.lit(1)).alias("nodes"))
    return region.join(c, "tile_id").select("tile_id", "nodes", *[F.round(k, 9).alias(k) for k in ("min_lat", "min_lon", "max_lat", "max_lon")])


@query("tiles_to_evaluate", sql("gt pred both", """
SELECT DISTINCT cast(n_nationkey as bigint) AS tile_id FROM nation WHERE n_nationkey IN (SELECT tile_id FROM fx_gt_nodes)
  AND n_nationkey IN (SELECT tile_id FROM fx_pred_edges)"""))
def tiles_to_evaluate(spark, d):
    tiles = fx.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("tile_id"))
    return src.with_prediction(src.non_empty(tiles, fx.gt(spark, d)[0]), fx.pred(spark, d)[1])


NUM = """num AS (SELECT tile_id, node_id, x, y, row_number() OVER (PARTITION BY tile_id ORDER BY node_id)-1 AS i FROM fx_gt_nodes),
und AS (SELECT DISTINCT n.tile_id, least(a.i,b.i) AS s, greatest(a.i,b.i) AS t FROM fx_gt_edges n
  JOIN num a ON a.tile_id=n.tile_id AND a.node_id=n.src JOIN num b ON b.tile_id=n.tile_id AND b.node_id=n.dst),
fst AS (SELECT tile_id, min((s,t)) AS m FROM und GROUP BY tile_id)"""


@query("graph_json_sink", sql("gt", """
SELECT tile_id, 0 AS part, i AS a, 0 AS b, (CASE WHEN i=0 THEN '[[' ELSE ',' END)
  || printf('[%.9f, %.9f]', 41.0-y/111111.0, -71.0+x/111111.0/cos(radians(41.0))) AS line FROM num
UNION ALL SELECT tile_id, 1, 0, 0, '],[' FROM (SELECT DISTINCT tile_id FROM num) UNION ALL
SELECT tile_id, 3, 0, 0, ']]' FROM (SELECT DISTINCT tile_id FROM num) UNION ALL
SELECT u.tile_id, 2, s, t, (CASE WHEN (s,t)=m THEN '' ELSE ',' END) || printf('[%d, %d]', s, t) FROM und u JOIN fst USING (tile_id)""", NUM))
def graph_json_sink(spark, d):
    n, e = fx.gt(spark, d)
    return sinks.graph_json_lines(_rc(n), e)


@query("adjacency_sink", sql("gt both", """
SELECT n.tile_id, n.r, n.c, count(DISTINCT (m.r, m.c)) FILTER (m.r IS NOT NULL) AS n_nbrs, coalesce(sum(DISTINCT m.r*100000+m.c),0)::bigint AS nbr_sum
FROM (SELECT tile_id, node_id, cast(round_even(y+0.5,0) as bigint) AS r, cast(round_even(x+0.25,0) as bigint) AS c FROM fx_gt_nodes) n
LEFT JOIN fx_both e ON e.tile_id=n.tile_id AND e.src=n.node_id
LEFT JOIN (SELECT tile_id, node_id, cast(round_even(y+0.5,0) as bigint) AS r, cast(round_even(x+0.25,0) as bigint) AS c FROM fx_gt_nodes) m
  ON m.tile_id=e.tile_id AND m.node_id=e.dst GROUP BY ALL"""))
def adjacency_sink(spark, d):
    n, e = fx.gt(spark, d)
    half = n.select("tile_id", "node_id", (F.col("y") + 0.5).alias("r"), (F.col("x") + 0.25).alias("c"))
    a = sinks.rounded_adjacency(half, e)
    return a.select(
        "tile_id", F.col("node.r").alias("r"), F.col("node.c").alias("c"), F.size("nbrs").cast("bigint").alias("n_nbrs"),
        F.aggregate("nbrs", F.lit(0).cast("bigint"), lambda s, e: s + e["r"] * 100000 + e["c"]).alias("nbr_sum"))


def _forest(spark, d):
    li = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    first = li.filter("l_linenumber = 1").selectExpr("l_orderkey AS tree_id", "l_suppkey%10 AS tile_id")
    return li.selectExpr(
        "l_orderkey AS tree_id", "cast(l_linenumber-1 as bigint) AS id", "l_partkey*1.0D AS lat", "l_suppkey*1.0D AS lon",
        "cast(greatest(l_linenumber-2,0) as bigint) AS parent", "CASE WHEN l_partkey%11=0 THEN l_orderkey ELSE -1 END AS similar_tree",
        "cast(0 as bigint) AS similar_id", "CASE WHEN l_partkey%13=0 THEN 1 ELSE 0 END AS out_region").join(first, "tree_id")


def _packed(name):
    """The number by which the SQL calls a node; ids in these trees have one digit."""
    return F.col(f"{name}.tree_id") * 10_000_000 + F.col(f"{name}.id")


FOREST = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY ALL),
forest AS (SELECT f.tile_id, l_orderkey AS tree_id, l_linenumber-1 AS id, l_partkey::double AS lat, l_suppkey::double AS lon,
  greatest(l_linenumber-2,0) AS parent, CASE WHEN l_partkey%11=0 THEN l_orderkey ELSE -1 END AS similar_tree, 0 AS similar_id,
  CASE WHEN l_partkey%13=0 THEN 1 ELSE 0 END AS out_region FROM li
  JOIN (SELECT l_orderkey, l_suppkey%10 AS tile_id FROM li WHERE l_linenumber=1) f USING (l_orderkey)),
full_f AS (SELECT f.*, p.lat AS plat, p.lon AS plon, s.lat AS slat, s.lon AS slon FROM forest f
  JOIN forest p ON p.tree_id=f.tree_id AND p.id=f.parent LEFT JOIN forest s ON s.tree_id=f.similar_tree AND s.id=f.similar_id
  WHERE f.lat BETWEEN 10 AND 1800),
fe AS (SELECT tile_id, tree_id*10000000+parent AS src, plat, plon, out_region,
  CASE WHEN similar_tree<>-1 THEN similar_tree*10000000+similar_id ELSE tree_id*10000000+id END AS dst,
  CASE WHEN similar_tree<>-1 THEN slat ELSE lat END AS lat, CASE WHEN similar_tree<>-1 THEN slon ELSE lon END AS lon FROM full_f)"""


@query("forest_edges", sql("", "WITH " + FOREST + """
SELECT DISTINCT e.tile_id, e.src, e.dst, t.src IS NOT NULL AS terminal FROM fe e
LEFT JOIN (SELECT DISTINCT tile_id, src FROM fe WHERE out_region=1) t ON t.tile_id=e.tile_id AND t.src=e.src"""))
def forest_edges(spark, d):
    _, e, t = src.load_forest(_forest(spark, d), (10.0, -1e9, 1800.0, 1e9))
    mark = t.select("tile_id", F.col("node_id").alias("src"), F.lit(True).alias("terminal"))
    return e.join(mark, ["tile_id", "src"], "left").select(
        "tile_id", _packed("src").alias("src"), _packed("dst").alias("dst"), F.coalesce("terminal", F.lit(False)).alias("terminal"))


@query("forest_nodes", sql("", "WITH " + FOREST + """
SELECT tile_id, node_id, m.lat AS lat, m.lon AS lon FROM (
 SELECT tile_id, node_id, min({'lat': lat, 'lon': lon}) AS m FROM (SELECT tile_id, src AS node_id, plat AS lat, plon AS lon FROM fe
 UNION ALL SELECT tile_id, dst, lat, lon FROM fe) GROUP BY ALL)"""))
def forest_nodes(spark, d):
    n = src.load_forest(_forest(spark, d), (10.0, -1e9, 1800.0, 1e9))[0]
    return n.withColumn("node_id", _packed("node_id"))


@query("undirected_edges", sql("pairs", """
SELECT DISTINCT tile_id, least(src,dst%40) AS src, greatest(src,dst%40) AS dst FROM fx_pairs WHERE src<>dst%40"""))
def undirected_edges(spark, d):
    p = fx.pair_scores(spark, d).withColumn("dst", F.col("dst") % 40)
    return graph.undirected(p, self_loops=False)


@query("symmetric_edges", sql("gt both", """
SELECT tile_id, src, dst, src*1000+dst AS score FROM fx_gt_edges UNION ALL SELECT tile_id, dst, src, src*1000+dst FROM fx_gt_edges"""))
def symmetric_edges(spark, d):
    return graph.symmetric(fx.gt(spark, d)[1].withColumn("score", F.col("src") * 1000 + F.col("dst")))


@query("distinct_edges", sql("pairs", "SELECT tile_id, src, dst, max(score) AS score FROM fx_pairs GROUP BY ALL"))
def distinct_edges(spark, d):
    return graph.distinct_edges(fx.pair_scores(spark, d).select("tile_id", "src", "dst", "score"))


@query("node_degrees", sql("gt both", "SELECT tile_id, src AS node_id, count(*) AS degree FROM fx_both GROUP BY ALL"))
def node_degrees(spark, d):
    return graph.degrees(fx.gt(spark, d)[1])


@query("neighbour_lists", sql("gt both", "SELECT tile_id, src AS node_id, dst AS neighbour FROM fx_both"))
def neighbour_lists(spark, d):
    return graph.neighbours(fx.gt(spark, d)[1])


@query("adjacency_sets", sql("gt", """
SELECT n.tile_id, n.node_id, coalesce(list(DISTINCT e.dst ORDER BY e.dst) FILTER (e.dst IS NOT NULL), []::bigint[]) AS nbrs FROM fx_gt_nodes n
LEFT JOIN fx_gt_edges e ON e.tile_id=n.tile_id AND e.src=n.node_id GROUP BY ALL"""))
def adjacency_sets(spark, d):
    n, e = fx.gt(spark, d)
    return graph.adjacency_sets(n.select("tile_id", "node_id"), e)


@query("graph_inspection", sql("points pairs", """
SELECT t.tile_id, coalesce(o.n,0) AS one_way, coalesce(c.n,0) AS close_pairs FROM (SELECT DISTINCT tile_id FROM fx_points) t
LEFT JOIN (SELECT tile_id, count(*) AS n FROM (SELECT DISTINCT tile_id, src, dst%40 AS dst FROM fx_pairs) a
  WHERE NOT EXISTS (SELECT 1 FROM fx_pairs b WHERE b.tile_id=a.tile_id AND b.src=a.dst AND b.dst%40=a.src) GROUP BY tile_id) o USING (tile_id)
LEFT JOIN (SELECT a.tile_id, count(*) AS n FROM fx_points a JOIN fx_points b ON a.tile_id=b.tile_id AND a.pid<b.pid
  AND a.x=b.x AND a.y=b.y GROUP BY a.tile_id) c USING (tile_id)"""))
def graph_inspection(spark, d):
    p = fx.points(spark, d).withColumnRenamed("pid", "node_id")
    return graph.inspect(p, fx.pair_scores(spark, d).withColumn("dst", F.col("dst") % 40))


KEPT = """kept AS (SELECT tile_id, node_id, x, y, row_number() OVER (PARTITION BY tile_id ORDER BY node_id)-1 AS i FROM fx_gt_nodes WHERE x%3<>0)"""


@query("filtered_nodes", sql("gt", "SELECT tile_id, i AS node_id, x, y FROM kept", KEPT))
def filtered_nodes(spark, d):
    n, e = fx.gt(spark, d)
    return graph.keep_nodes(n.drop("k"), e, F.col("x") % 3 != 0)[0]


@query("filtered_edges", sql("gt", """
SELECT e.tile_id, a.i AS src, b.i AS dst FROM fx_gt_edges e JOIN kept a ON a.tile_id=e.tile_id AND a.node_id=e.src
JOIN kept b ON b.tile_id=e.tile_id AND b.node_id=e.dst""", KEPT))
def filtered_edges(spark, d):
    n, e = fx.gt(spark, d)
    return graph.keep_nodes(n.drop("k"), e, F.col("x") % 3 != 0)[1]


USED = """used AS (SELECT n.tile_id, n.node_id, row_number() OVER (PARTITION BY n.tile_id ORDER BY n.node_id)-1 AS i FROM fx_gt_nodes n
  WHERE EXISTS (SELECT 1 FROM fx_both b WHERE b.tile_id=n.tile_id AND b.src=n.node_id))"""


@query("without_isolated", sql("gt both", """
SELECT e.tile_id, a.i AS src, b.i AS dst, a.node_id AS old_src FROM fx_gt_edges e JOIN used a ON a.tile_id=e.tile_id AND a.node_id=e.src
JOIN used b ON b.tile_id=e.tile_id AND b.node_id=e.dst""", USED))
def without_isolated(spark, d):
    n, e = fx.gt(spark, d)
    n2 = n.withColumn("old_src", F.col("node_id")).select("tile_id", "node_id", "old_src")
    nodes, edges = graph.drop_isolated(n2, e)
    return edges.join(nodes.withColumnRenamed("node_id", "src"), ["tile_id", "src"]).select("tile_id", "src", "dst", "old_src")


PARTS2 = """pn AS (SELECT tile_id, 0 AS part, row_number() OVER (PARTITION BY tile_id ORDER BY node_id)-1 AS node_id, node_id AS old, x, y FROM fx_gt_nodes
  UNION ALL SELECT tile_id, 1, row_number() OVER (PARTITION BY tile_id ORDER BY node_id)-1, node_id, x, y FROM fx_pred_nodes),
sz AS (SELECT tile_id, part, count(*) AS n FROM pn GROUP BY ALL),
off AS (SELECT tile_id, part, coalesce(sum(n) OVER (PARTITION BY tile_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::bigint AS o FROM sz)"""


@query("combined_graphs", sql("gt pred", """
SELECT e.tile_id, a.node_id+o AS src, b.node_id+o AS dst, e.part FROM (SELECT 0 AS part, * FROM fx_gt_edges UNION ALL SELECT 1, * FROM fx_pred_edges) e
JOIN pn a ON a.tile_id=e.tile_id AND a.part=e.part AND a.old=e.src JOIN pn b ON b.tile_id=e.tile_id AND b.part=e.part AND b.old=e.dst
JOIN off f ON f.tile_id=e.tile_id AND f.part=e.part""", PARTS2))
def combined_graphs(spark, d):
    gn, ge = fx.gt(spark, d)
    pn, pe = fx.pred(spark, d)
    a = graph.renumber(gn.select("tile_id", "node_id", "x", "y"), ge)
    b = graph.renumber(pn.select("tile_id", "node_id", "x", "y"), pe)
    tag = lambda df, i: df.withColumn("part", F.lit(i))
    _, e = graph.combine(tag(a[0], 0).unionByName(tag(b[0], 1)), tag(a[1], 0).unionByName(tag(b[1], 1)))
    return e


@query("dead_ends_removed", sql("gt both", """
SELECT tile_id, src, dst FROM fx_gt_edges WHERE (tile_id, src) NOT IN (SELECT (tile_id, node_id) FROM dead)
  AND (tile_id, dst) NOT IN (SELECT (tile_id, node_id) FROM dead)""", """
dead AS (SELECT n.tile_id, n.node_id FROM fx_gt_nodes n WHERE n.node_id%10<>0 AND (
  (SELECT count(*) FROM fx_both b WHERE b.tile_id=n.tile_id AND b.src=n.node_id)=1
  OR NOT EXISTS (SELECT 1 FROM fx_gt_edges e WHERE e.tile_id=n.tile_id AND e.src=n.node_id)
  OR NOT EXISTS (SELECT 1 FROM fx_gt_edges e WHERE e.tile_id=n.tile_id AND e.dst=n.node_id)))"""))
def dead_ends_removed(spark, d):
    n, e = fx.gt(spark, d)
    return graph.drop_dead_ends(n, e, n.filter("node_id % 10 = 0"))[1]


SUBD = """cut AS (SELECT *, greatest(1, cast(trunc(sqrt((bx-ax)*(bx-ax)+(b_y-ay)*(b_y-ay))/20.0) as integer)) AS n FROM fx_ends),
nb AS (SELECT tile_id, max(node_id)+1 AS base FROM fx_gt_nodes GROUP BY tile_id),
inner_p AS (SELECT c.tile_id, c.src, c.dst, i, ax+i*1.0/n*(bx-ax) AS x, ay+i*1.0/n*(b_y-ay) AS y,
  base-1+row_number() OVER (PARTITION BY c.tile_id ORDER BY src, dst, i) AS node_id FROM cut c JOIN nb ON nb.tile_id=c.tile_id, range(1,100) r(i) WHERE i<n)"""


@query("subdivided_nodes", sql("gt ends", """
SELECT tile_id, node_id, round(x*1.0,6) AS x, round(y*1.0,6) AS y FROM fx_gt_nodes UNION ALL SELECT tile_id, node_id, round(x,6), round(y,6) FROM inner_p""", SUBD))
def subdivided_nodes(spark, d):
    n, e = fx.gt(spark, d)
    return graph.subdivide(n, e, 20.0)[0].select("tile_id", "node_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("subdivided_edges", sql("gt ends", """
SELECT c.tile_id, coalesce(p.node_id, c.src) AS src, coalesce(q.node_id, c.dst) AS dst FROM cut c, range(0,100) r(i)
LEFT JOIN inner_p p ON p.tile_id=c.tile_id AND p.src=c.src AND p.dst=c.dst AND p.i=r.i
LEFT JOIN inner_p q ON q.tile_id=c.tile_id AND q.src=c.src AND q.dst=c.dst AND q.i=r.i+1 WHERE r.i<c.n""", SUBD))
def subdivided_edges(spark, d):
    n, e = fx.gt(spark, d)
    return graph.subdivide(n, e, 20.0)[1]


DENSIFY = """lle AS (SELECT *, 41.0-ay/111111.0 AS la1, -71.0+ax/111111.0/cos(radians(41.0)) AS lo1, 41.0-b_y/111111.0 AS la2,
  -71.0+bx/111111.0/cos(radians(41.0)) AS lo2 FROM fx_ends),
pieces AS (SELECT *, CASE WHEN d>3 THEN cast(trunc(d/2) as integer)+1 ELSE 1 END AS n FROM (SELECT *,
  sqrt(((la1-la2)*111111.0)*((la1-la2)*111111.0)+((lo1-lo2)*111111.0*cos(radians(la1)))*((lo1-lo2)*111111.0*cos(radians(la1)))) AS d FROM lle)),
steps AS (SELECT tile_id, src, dst, i, n,
  CASE WHEN i=0 THEN la1 WHEN i=n THEN la2 ELSE la1*(1-i*1.0/n)+la2*(i*1.0/n) END AS la,
  CASE WHEN i=0 THEN lo1 WHEN i=n THEN lo2 ELSE lo1*(1-i*1.0/n)+lo2*(i*1.0/n) END AS lo FROM pieces, range(0,200) r(i) WHERE i<=n),
keyed AS (SELECT *, (cast(round(la*1e7) as bigint)+900000000)*4294967296+cast(round(lo*1e7) as bigint)+1800000000 AS node_id FROM steps)"""


@query("densified_nodes", sql("gt ends", """
SELECT tile_id, node_id, round(min(la),6) AS lat, round(min(lo),6) AS lon FROM keyed GROUP BY ALL""", DENSIFY))
def densified_nodes(spark, d):
    n, e = fx.gt(spark, d)
    return graph.densify(_latlon(n), e)[0].select("tile_id", "node_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("densified_edges", sql("gt ends", """
SELECT DISTINCT a.tile_id, least(a.node_id,b.node_id) AS src, greatest(a.node_id,b.node_id) AS dst FROM keyed a
JOIN keyed b ON a.tile_id=b.tile_id AND a.src=b.src AND a.dst=b.dst AND b.i=a.i+1 WHERE a.node_id<>b.node_id""", DENSIFY))
def densified_edges(spark, d):
    n, e = fx.gt(spark, d)
    return graph.densify(_latlon(n), e)[1]


def _latlon(nodes):
    from ..functions.coords import to_latlon

    la, lo = to_latlon(F.col("y"), F.col("x"))
    return nodes.select("tile_id", "node_id", la.alias("lat"), lo.alias("lon"))


@query("label_keypoints", sql("gt both", """
SELECT n.tile_id, n.node_id, x, y FROM fx_gt_nodes n JOIN (SELECT tile_id, src, count(*) AS c FROM fx_both GROUP BY ALL) g
ON g.tile_id=n.tile_id AND g.src=n.node_id WHERE c<>2"""))
def label_keypoints(spark, d):
    from ..operators import raster

    n, e = fx.gt(spark, d)
    return raster.keypoints(n.drop("k"), e)
