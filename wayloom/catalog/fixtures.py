"""Road-like views of the test tables, once for Spark and once as SQL text for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import dense_ids, id_chunk


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def points(spark, d):
    return table(spark, d, "embeddings").selectExpr(
        "cast(label as bigint) AS tile_id", "vec_id AS pid",
        "cast(floor((cast(embedding[0] as double)+1)*256) as bigint) AS x",
        "cast(floor((cast(embedding[1] as double)+1)*256) as bigint) AS y",
        "cast((vec_id*7919)%1000 as double)/1000 AS score")


def patch_scores(spark, d):
    return table(spark, d, "events").selectExpr(
        "cast(floor(event_id/12288) as bigint)*3 + user_id%3 AS tile_id", "event_id%4 AS patch_id", "cast(floor(event_id/64) as bigint)%48 AS y", "event_id%64 AS x",
        "CASE WHEN event_type IN ('signup','error') THEN 'keypoint' ELSE 'road' END AS band",
        "least(value/100.0, 1.0) AS score")


def wide_patch_scores(spark, d):
    """The same with one column per band."""
    p = patch_scores(spark, d)
    return p.select(
        "tile_id", "patch_id", "y", "x", F.when(F.col("band") == "keypoint", F.col("score")).alias("keypoint"),
        F.when(F.col("band") == "road", F.col("score")).alias("road"))


def marked_pixels(spark, d):
    """Points strewn over the pixels of every tile."""
    return patch_scores(spark, d).filter("(x*13+y*29+tile_id)%61=0").selectExpr("tile_id", "y*64+x AS pid", "x", "y").distinct()


def patch_points(spark, d):
    """Points at places (px, py) in every patch of 256 by 256."""
    return patch_scores(spark, d).filter("(x+y)%3<>0").selectExpr(
        "tile_id", "patch_id", "y*64+x AS pid", "x*4+y%4 AS px", "y*5+x%5 AS py").distinct()


def pair_scores(spark, d):
    return table(spark, d, "lineitem").selectExpr(
        "cast(floor(l_orderkey/65536) as bigint)*8 + l_orderkey%8 AS tile_id", "l_orderkey AS patch_id", "l_partkey%40 AS src", "100+l_suppkey%25 AS dst",
        "l_discount*10 AS score")


def gt(spark, d):
    """(nodes, edges) of a jittered street grid per nation."""
    c = table(spark, d, "customer").selectExpr("cast(c_nationkey as bigint) AS tile_id", "c_custkey AS node_id")
    k = dense_ids(c, ["node_id"], "k", id_chunk("node_id"))
    nodes = k.selectExpr(
        "tile_id", "node_id", "60+(k%16)*120+((node_id*37)%11) AS x",
        "60+cast(floor(k/16) as bigint)*45+((node_id*101)%11) AS y", "k")
    a = nodes.select("tile_id", F.col("node_id").alias("src"), F.expr(
        "explode(filter(array(CASE WHEN k%16<15 AND node_id%6<>0 THEN k+1 END, CASE WHEN node_id%3=0 THEN k+16 END), v -> v is not null))").alias("k"))
    edges = a.join(nodes.select("tile_id", F.col("node_id").alias("dst"), "k"), ["tile_id", "k"]).select("tile_id", "src", "dst")
    return nodes, edges


def pred(spark, d):
    """The same grid moved by a few pixels, some edges missing."""
    nodes, edges = gt(spark, d)
    moved = nodes.selectExpr("tile_id", "node_id", "x+(node_id%5)-2 AS x", "y+(node_id%3)-1 AS y", "k")
    return moved, edges.filter("(src*31+dst*17)%9<>0")


def labels(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id").selectExpr(
        "doc_id", "cast((doc_id*7919)%1000 as double)/1000 AS score", "quality AS target")


def triage(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey AS img_id", "o_totalprice/1000000.0 AS smd")


PARTS = {
    "points": """fx_points AS (SELECT cast(label as bigint) AS tile_id, vec_id AS pid,
  cast(floor((cast(embedding[1] as double)+1)*256) as bigint) AS x,
  cast(floor((cast(embedding[2] as double)+1)*256) as bigint) AS y,
  cast((vec_id*7919)%1000 as double)/1000 AS score FROM embeddings)""",
    "patch": """fx_patch AS (SELECT cast(floor(event_id/12288) as bigint)*3 + user_id%3 AS tile_id, event_id%4 AS patch_id,
  cast(floor(event_id/64) as bigint)%48 AS y, event_id%64 AS x,
  CASE WHEN event_type IN ('signup','error') THEN 'keypoint' ELSE 'road' END AS band,
  least(value/100.0, 1.0) AS score FROM events)""",
    "marked": "fx_marked AS (SELECT DISTINCT tile_id, y*64+x AS pid, x, y FROM fx_patch WHERE (x*13+y*29+tile_id)%61=0)",
    "places": """fx_places AS (SELECT DISTINCT tile_id, patch_id, y*64+x AS pid, x*4+y%4 AS px, y*5+x%5 AS py
  FROM fx_patch WHERE (x+y)%3<>0)""",
    "pairs": """fx_pairs AS (SELECT cast(floor(l_orderkey/65536) as bigint)*8 + l_orderkey%8 AS tile_id, l_orderkey AS patch_id, l_partkey%40 AS src,
  100+l_suppkey%25 AS dst, l_discount*10 AS score FROM lineitem)""",
    "gt": """fx_gt_nodes AS MATERIALIZED (SELECT tile_id, node_id, 60+(k%16)*120+((node_id*37)%11) AS x,
  60+cast(floor(k/16) as bigint)*45+((node_id*101)%11) AS y, k
  FROM (SELECT cast(c_nationkey as bigint) AS tile_id, c_custkey AS node_id,
    row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)-1 AS k FROM customer) t),
fx_gt_edges AS MATERIALIZED (SELECT a.tile_id, a.node_id AS src, b.node_id AS dst FROM fx_gt_nodes a JOIN fx_gt_nodes b
  ON a.tile_id=b.tile_id AND ((b.k=a.k+1 AND a.k%16<15 AND (a.node_id%6)<>0) OR (b.k=a.k+16 AND (a.node_id%3)=0)))""",
    "pred": """fx_pred_nodes AS MATERIALIZED (SELECT tile_id, node_id, x+(node_id%5)-2 AS x, y+(node_id%3)-1 AS y, k FROM fx_gt_nodes),
fx_pred_edges AS MATERIALIZED (SELECT tile_id, src, dst FROM fx_gt_edges WHERE (src*31+dst*17)%9<>0)""",
    "ends": """fx_ends AS (SELECT e.tile_id, e.src, e.dst, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM fx_gt_edges e
  JOIN fx_gt_nodes a ON a.tile_id=e.tile_id AND a.node_id=e.src JOIN fx_gt_nodes b ON b.tile_id=e.tile_id AND b.node_id=e.dst)""",
    "both": """fx_both AS MATERIALIZED (SELECT tile_id, src, dst FROM fx_gt_edges UNION SELECT tile_id, dst, src FROM fx_gt_edges)""",
    "labels": """fx_labels AS (SELECT d.doc_id, cast((d.doc_id*7919)%1000 as double)/1000 AS score, l.quality AS target
  FROM documents d JOIN labels l ON d.doc_id=l.doc_id)""",
    "triage": "fx_triage AS (SELECT o_orderkey AS img_id, o_totalprice/1000000.0 AS smd FROM orders)",
}


def sql(parts: str, body: str, *more: str) -> str:
    """SQL text with the named views (and further ones) in front."""
    views = [PARTS[p] for p in parts.split()] + list(more)
    return "WITH RECURSIVE " + ",\n".join(views) + "\n" + body if views else body
