"""Running counts over scores that crowd in a hair's breadth."""

import random

from pyspark.sql import functions as F

from wayloom.operators import scoring, select


def crowded(spark, n=4000):
    r = random.Random(9)
    rows = [(k, (1 - r.random() / 1000) if r.random() < 0.9 else r.random() * 50 - 20, int(r.random() < 0.4)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id bigint, score double, target int")


def test_curve_of_crowded_scores(spark):
    rows, df = crowded(spark)
    got = {x.threshold: (x.precision, x.recall) for x in scoring.precision_recall_curve(df).collect()}
    real = sum(t for _, _, t in rows)
    hit = seen = 0
    for _, s, t in sorted(rows, key=lambda x: -x[1]):
        hit, seen = hit + t, seen + 1
        assert abs(got[s][0] - hit / seen) < 1e-12 and abs(got[s][1] - hit / real) < 1e-12
    assert len(got) == len(rows)


def test_crowded_scores_are_spread(spark):
    _, df = crowded(spark)
    bands = scoring.in_ranges(df.select("score").distinct(), ["score"]).groupBy("_band").count().collect()
    top = max(b["count"] for b in bands)
    assert len(bands) == 1 or top < 0.6 * sum(b["count"] for b in bands)


def test_worst_share_of_crowded_scores(spark):
    rows, df = crowded(spark)
    df = df.withColumn("score", F.round("score", 4))  # many ties
    got = {x.id for x in select.worst_share(df, "score", 0.13, "id").collect()}
    order = sorted(((round(s, 4), k) for k, s, _ in rows), key=lambda x: (-x[0], x[1]))
    want = {k for _, k in order[: int(len(rows) * 0.13)]}
    scores = {x.id: x.score for x in df.collect()}
    assert len(got) == len(want) and sorted(scores[k] for k in got) == sorted(scores[k] for k in want)
