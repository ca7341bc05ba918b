"""Evaluation report over all score kinds (keypoint pixels, road pixels, pairs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scoring import best_threshold, precision_recall_curve


def evaluation_report(scored: DataFrame) -> DataFrame:
    """``scored``: (kind, score, target, valid). One row per kind with IoU and F1 at 0.5 and the best threshold.

    Rows shrink to counts per distinct score first; all figures are read from those.
    """
    used = scored.filter("valid")
    p, t = F.col("score") > 0.5, F.col("target") == 1
    hit, made, real = (F.sum(F.when(c, 1).otherwise(0)) for c in (p & t, p, t))
    fixed = used.groupBy("kind").agg(hit.alias("hit"), made.alias("made"), real.alias("real"))
    ratio = lambda a, b: a / F.nullif(b * 1.0, F.lit(0.0))
    fixed = fixed.select(
        "kind", ratio(F.col("hit"), F.col("made") + F.col("real") - F.col("hit")).alias("iou"),
        ratio(2 * F.col("hit"), F.col("made") + F.col("real")).alias("f1"))
    best = best_threshold(precision_recall_curve(used, ["kind"]), ["kind"]).withColumnsRenamed(
        {"precision": "best_precision", "recall": "best_recall", "f1": "best_f1"})
    return fixed.join(best, "kind")
