"""Tables that were written down are not taken for as small as their files; steps that grow rows stay off the driver."""

import re

from pyspark.sql import functions as F

from wayloom.operators.sampling import weighted_draws
from wayloom.session import keep


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_packed_tables_are_not_broadcast(spark):
    ids = spark.range(400_000).select((F.col("id") % 7).alias("tile_id"), F.col("id").alias("node_id"), F.lit(4).alias("depth"))
    a, b = keep(ids), keep(ids)
    assert "Broadcast" not in planned(a.join(b, ["tile_id", "node_id"], "left_semi"))
    few = keep(spark.range(100).withColumnRenamed("id", "tile_id"))
    assert "Broadcast" in planned(a.join(few, "tile_id"))


def test_draws_are_not_broadcast(spark):
    p = spark.range(40).select(F.col("id") % 2, F.lit(0).alias("patch_id"), F.col("id").alias("pid"), F.lit(0.5).alias("weight")).toDF("tile_id", "patch_id", "pid", "weight")
    draws = weighted_draws(keep(p), 64, 1)
    assert draws.count() == 128
    assert "Broadcast" not in planned(draws)


def test_points_of_a_walk_are_not_sent(spark, frame):
    from wayloom.plans import topo

    n = frame([(i, 41.0 + 0.0004 * i, -71.0) for i in range(6)], "node_id bigint, lat double, lon double")
    e = frame([(i, i + 1) for i in range(5)] + [(i + 1, i) for i in range(5)], "src bigint, dst bigint")
    pairs = frame([(i, i) for i in range(6)], "node_id bigint, other_id bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = topo.compare_from_nodes((n, e), (n, e), pairs)
        lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
        assert {(r["precision"], r["recall"]) for r in out.collect()} == {(1.0, 1.0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    deep = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    cuts = [i for i, line in enumerate(lines) if "Generate explode(sequence(_f" in line]
    assert cuts
    for i in cuts:
        level = deep(lines[i])
        for above in reversed(lines[:i]):
            if deep(above) < level:
                level = deep(above)
                assert "Exchange" not in above


def test_pairs_of_control_points_are_not_sent(spark, frame):
    from wayloom import catalog
    from wayloom.plans import apls

    catalog.load_all()
    plan = catalog.QUERIES["apls_pair_score"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    keys = re.findall(r"Join (\[[^]]*\])", plan)
    assert keys and not any("source" in k or "target" in k or "po#" in k for k in keys), keys

    points = frame([(i,) for i in range(5)], "node_id bigint")
    snapped = frame([(i, i + 10) for i in range(4)], "node_id bigint, other bigint")
    true = frame([(i, j, 15_000 + 100 * i + j) for i in range(4) for j in range(4) if i != j], "source bigint, target bigint, d bigint")
    other = frame([(i + 10, j + 10, 14_000 + 90 * i + j) for i in range(4) for j in range(4) if i != j and i + j != 3], "source bigint, target bigint, d bigint")
    both = frame([(i, j, 15_000 + 100 * i + j, 14_000 + 90 * i + j if i + j != 3 else None) for i in range(4) for j in range(4) if i != j],
                 "source bigint, target bigint, d1 bigint, d2 bigint")
    assert apls.pair_score(points, snapped, true, other).collect() == apls.score_of_pairs(points, snapped, both).collect()


def test_short_segments_meet_few_others(frame, monkeypatch):
    from wayloom.operators import graph

    met = []
    joined = graph.box_join

    def counted(*args, **kwargs):
        out = joined(*args, **kwargs)
        met.append(out.count())
        return out

    monkeypatch.setattr(graph, "box_join", counted)
    at = [((i * 53) % 700, (i * 91) % 650) for i in range(600)]
    n = frame([r for i, (x, y) in enumerate(at) for r in ((2 * i, x, y), (2 * i + 1, x + i % 41 - 20, y + i % 37 - 18))], "node_id bigint, x int, y int")
    graph.crossovers(n, frame([(2 * i, 2 * i + 1) for i in range(600)], "src bigint, dst bigint"))
    assert 0 < met[0] < 600 * 20, met


def test_crossings_are_worked_out_beside_the_join(frame):
    from wayloom.operators import graph

    n = frame([(i, (i * 53) % 97, (i * 91) % 89) for i in range(60)], "node_id bigint, x bigint, y bigint")
    out = graph.crossovers(n, frame([(2 * i, 2 * i + 1) for i in range(30)], "src bigint, dst bigint"))
    lines = out._jdf.queryExecution().executedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    above = [i for i, line in enumerate(lines) if "CollectMetrics" in line]
    # pairs leave the join between the two, which would otherwise be one piece of code
    assert above and above[0] < join and "CASE" not in lines[join].upper()
    assert out.count() == len({(r.src, r.dst, r.src2, r.dst2) for r in out.collect()}) > 0
