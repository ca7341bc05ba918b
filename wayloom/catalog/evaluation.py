"""Queries for pixel and pair evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster, scoring
from ..plans import report
from . import fixtures as fx
from . import query
from .fixtures import sql

r6 = lambda c: F.round(c, 6)
CURVE = """cur AS (SELECT score AS threshold, count(*) AS n, sum(CASE WHEN target=1 THEN 1 ELSE 0 END) AS pos FROM fx_labels GROUP BY score),
pr AS (SELECT threshold, sum(pos) OVER w *1.0::double/sum(n) OVER w AS precision, sum(pos) OVER w *1.0::double/sum(pos) OVER () AS recall FROM cur
 WINDOW w AS (ORDER BY threshold DESC))"""


@query("mask_overlap", sql("patch", """
SELECT band, round(sum(CASE WHEN score>0.5 AND t THEN 1 ELSE 0 END)*1.0::double/nullif(sum(CASE WHEN score>0.5 OR t THEN 1 ELSE 0 END),0),6) AS iou
FROM (SELECT *, (x+y)%3=0 AS t FROM fx_patch) GROUP BY band"""))
def mask_overlap(spark, d):
    p = fx.patch_scores(spark, d).withColumn("target", F.expr("CASE WHEN (x+y)%3=0 THEN 1 ELSE 0 END"))
    return scoring.overlap(p, ["band"]).withColumn("iou", r6("iou"))


@query("pair_f1", sql("labels", """
SELECT round(2.0::double*sum(CASE WHEN score>0.5 AND target=1 THEN 1 ELSE 0 END)/(sum(CASE WHEN score>0.5 THEN 1 ELSE 0 END)+sum(CASE WHEN target=1 THEN 1 ELSE 0 END)),6) AS f1
FROM fx_labels WHERE doc_id%7<>0"""))
def pair_f1(spark, d):
    return scoring.f1(fx.labels(spark, d).withColumn("valid", F.col("doc_id") % 7 != 0)).withColumn("f1", r6("f1"))


@query("precision_recall_curve", sql("labels", "SELECT threshold, round(precision,6) AS precision, round(recall,6) AS recall FROM pr", CURVE))
def precision_recall_curve(spark, d):
    c = scoring.precision_recall_curve(fx.labels(spark, d))
    return c.select("threshold", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("best_threshold", sql("labels", """
SELECT threshold, round(precision,6) AS precision, round(recall,6) AS recall, round(2*precision*recall/(precision+recall),6) AS f1 FROM pr
WHERE precision+recall>0 ORDER BY 2*precision*recall/(precision+recall) DESC, threshold LIMIT 1""", CURVE))
def best_threshold(spark, d):
    b = scoring.best_threshold(scoring.precision_recall_curve(fx.labels(spark, d)))
    return b.select("threshold", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


_BCE = "greatest({x},0.0)-({x})*({t})+ln(1+exp(-abs({x})))"
_FOCAL = ("(0.25*({t})+0.75*(1-({t})))*pow(1-(1/(1+exp(-({x})))*({t})+(1-1/(1+exp(-({x}))))*(1-({t}))),2)*(" + _BCE + ")")


def _loss_sql(f):
    m = f.format(x="(score*8-4)", t="((x+y)%2)")
    p = _BCE.format(x="(l_discount*50-2)", t="(l_partkey%2)")
    return sql("patch", f"""
SELECT round(m,6) AS mask_loss, round(p,6) AS pair_loss, round(m+p,6) AS loss FROM (SELECT avg({m}) AS m FROM fx_patch),
 (SELECT avg({p}) AS p FROM lineitem WHERE l_suppkey%5<>0)""")


def _losses(spark, d, focal):
    m = fx.patch_scores(spark, d).select((F.col("score") * 8 - 4).alias("logit"), F.expr("cast((x+y)%2 as double)").alias("target"))
    p = fx.table(spark, d, "lineitem").select(
        (F.col("l_discount") * 50 - 2).alias("logit"), F.expr("cast(l_partkey%2 as double)").alias("target"), (F.col("l_suppkey") % 5 != 0).alias("valid"))
    return scoring.losses(m, p, focal).select(*[r6(c).alias(c) for c in ("mask_loss", "pair_loss", "loss")])


@query("log_losses", _loss_sql(_BCE))
def log_losses(spark, d):
    return _losses(spark, d, False)


@query("focal_losses", _loss_sql(_FOCAL))
def focal_losses(spark, d):
    return _losses(spark, d, True)


_B = """lab AS (SELECT band AS kind, score, CASE WHEN (x+y)%3=0 THEN 1 ELSE 0 END AS target FROM fx_patch
 UNION ALL SELECT 'pair', round(l_discount*10,3), l_partkey%2 FROM lineitem WHERE l_suppkey%5<>0),
one AS (SELECT kind, sum(CASE WHEN score>0.5 AND target=1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score>0.5 THEN 1 ELSE 0 END) AS made,
 sum(CASE WHEN target=1 THEN 1 ELSE 0 END) AS real FROM lab GROUP BY kind),
c AS (SELECT kind, score AS threshold, count(*) AS n, sum(target) AS pos FROM lab GROUP BY ALL),
pr AS (SELECT kind, threshold, sum(pos) OVER w *1.0::double/sum(n) OVER w AS p, sum(pos) OVER w *1.0::double/sum(pos) OVER (PARTITION BY kind) AS r FROM c
 WINDOW w AS (PARTITION BY kind ORDER BY threshold DESC)),
best AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round(2*p*r/(p+r),12) DESC, threshold) AS k FROM pr WHERE p+r>0)"""


@query("evaluation_report", sql("patch", """
SELECT o.kind, round(tp*1.0::double/nullif(made+real-tp,0),6) AS iou, round(2.0::double*tp/(made+real),6) AS f1, threshold,
 round(p,6) AS best_precision, round(r,6) AS best_recall, round(2*p*r/(p+r),6) AS best_f1 FROM one o JOIN best b ON o.kind=b.kind AND b.k=1""", _B))
def evaluation_report(spark, d):
    px = fx.patch_scores(spark, d).select(
        F.col("band").alias("kind"), "score", F.expr("CASE WHEN (x+y)%3=0 THEN 1 ELSE 0 END").alias("target"), F.lit(True).alias("valid"))
    pr = fx.table(spark, d, "lineitem").select(
        F.lit("pair").alias("kind"), F.round(F.col("l_discount") * 10, 3).alias("score"), F.expr("cast(l_partkey%2 as int)").alias("target"),
        (F.col("l_suppkey") % 5 != 0).alias("valid"))
    out = report.evaluation_report(px.unionByName(pr))
    return out.select("kind", "threshold", *[r6(c).alias(c) for c in ("iou", "f1", "best_precision", "best_recall", "best_f1")])
