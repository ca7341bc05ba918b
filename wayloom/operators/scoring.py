"""Pixel and pair scores against labels: overlap, F1, precision-recall curves, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spatial import in_ranges

# Fixed values of the focal loss.
FOCAL_ALPHA, FOCAL_GAMMA = 0.25, 2.0


def _share(a: Column, b: Column) -> Column:
    return a / F.nullif(b * 1.0, F.lit(0.0))


def overlap(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """Intersection over union of predicted and labelled rows (score, target 0/1)."""
    p, t = F.col("score") > threshold, F.col("target") == 1
    return scored.groupBy(*by).agg(_share(F.sum(F.when(p & t, 1).otherwise(0)), F.sum(F.when(p | t, 1).otherwise(0))).alias("iou"))


def f1(scored: DataFrame, by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """F1 of rows with ``valid`` true."""
    p, t = F.col("score") > threshold, F.col("target") == 1
    hit, made, real = (F.sum(F.when(c, 1).otherwise(0)) for c in (p & t, p, t))
    return scored.filter("valid").groupBy(*by).agg(_share(2 * hit, made + real).alias("f1"))


def precision_recall_curve(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct score: precision and recall of the rows at or above it.

    Rows are counted per score first. The scores are parted by range, so that each part holds about as many of them
    wherever they crowd; counts run up over one row for each part, and inside each part.
    """
    by = list(by)
    per = scored.groupBy(*by, F.col("score").alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("target") == 1, 1).otherwise(0)).alias("pos"))
    per = in_ranges(per, [*by, "threshold"])
    later = Window.partitionBy(*by).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = per.groupBy(*by, "_band").agg(F.sum("n").alias("_bn"), F.sum("pos").alias("_bp")).select(
        *by, "_band", F.coalesce(F.sum("_bn").over(later), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_bp").over(later), F.lit(0)).alias("_p0"),
        F.sum("_bp").over(Window.partitionBy(*by)).alias("_total"))
    inside = Window.partitionBy(*by, "_band").orderBy(F.desc("threshold"))
    run = per.withColumns({"_cn": F.sum("n").over(inside), "_cp": F.sum("pos").over(inside)}).join(bands, [*by, "_band"])
    tp = F.col("_p0") + F.col("_cp")
    return run.select(*by, "threshold", _share(tp, F.col("_n0") + F.col("_cn")).alias("precision"), _share(tp, F.col("_total")).alias("recall"))


def best_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The point with the highest F1, the lowest threshold among equals; points without an F1 are left out."""
    score = _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    rows = curve.withColumn("f1", score).filter("f1 is not null")
    top = F.max_by(F.struct("threshold", "precision", "recall", "f1"), F.struct("f1", -F.col("threshold"))).alias("_t")
    return rows.groupBy(*by).agg(top).select(*by, "_t.threshold", "_t.precision", "_t.recall", "_t.f1")


def logit_loss(logit: Column, target: Column) -> Column:
    """Binary cross-entropy on logits in its stable form."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, target: Column) -> Column:
    p = 1.0 / (1.0 + F.exp(-logit))
    hit = p * target + (1 - p) * (1 - target)
    weight = FOCAL_ALPHA * target + (1 - FOCAL_ALPHA) * (1 - target)
    return weight * F.pow(1 - hit, F.lit(FOCAL_GAMMA)) * logit_loss(logit, target)


def losses(masks: DataFrame, pairs: DataFrame, focal: bool = False) -> DataFrame:
    """Mean mask loss, pair loss over valid pairs, and their sum, in one row.

    ``masks``: (logit, target); ``pairs``: (logit, target, valid).
    """
    loss = focal_loss if focal else logit_loss
    m = masks.select(loss(F.col("logit"), F.col("target")).alias("m"), F.lit(None).cast("double").alias("p"))
    p = pairs.select(
        F.lit(None).cast("double").alias("m"), F.when(F.col("valid"), logit_loss(F.col("logit"), F.col("target"))).alias("p"))
    return m.unionByName(p).agg(F.avg("m").alias("mask_loss"), F.avg("p").alias("pair_loss")).withColumn(
        "loss", F.col("mask_loss") + F.col("pair_loss"))


def clean_pair_scores(pairs: DataFrame) -> DataFrame:
    """Missing scores become -100, then only valid pairs are used; a valid score outside 0..1 is an error."""
    s = F.when(F.isnan("score"), F.lit(-100.0)).otherwise(F.col("score"))
    kept = pairs.withColumn("score", s).filter("valid")
    wrong = (F.col("score") < 0) | (F.col("score") > 1)
    checked = F.when(wrong, F.raise_error(F.format_string("pair score %s is outside 0..1", F.col("score"))).cast("double"))
    return kept.withColumn("score", checked.otherwise(F.col("score")))


def vote_edges(pair_scores: DataFrame, threshold: float) -> DataFrame:
    """Mean score of each directed edge over all patches; edges strictly above ``threshold`` stay.

    Means are rounded to 9 decimals before the comparison, so that the order of summation cannot decide.
    """
    mean = F.avg("score")
    return pair_scores.groupBy("tile_id", "src", "dst").agg(mean.alias("score")).filter(F.round("score", 9) > threshold)
