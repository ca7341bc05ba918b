"""Chains traced over stretches of a densified graph are those traced over its single pieces."""

from pyspark.sql import functions as F

from wayloom.operators import chains as C
from wayloom.operators.graph import densify, densify_in_stretches
from wayloom.plans import apls

LL = "node_id bigint, lat double, lon double"
STEP = 0.0002


def crossing(frame):
    """A street that others cross on its inner places, a corner, a spur, a ring apart, an edge that lies on another, a loop."""
    at = {1: (0, 0), 2: (0, 8), 3: (-2, 4), 4: (2, 4), 5: (3, 4), 6: (0, 12), 7: (3, 12), 8: (9, 0), 9: (9, 2), 10: (7, 1), 11: (0, 2), 12: (0, 6), 13: (5, 12), 14: (5, 8)}
    edges = [(1, 2), (3, 4), (4, 5), (2, 6), (6, 7), (8, 9), (9, 10), (10, 8), (11, 12), (7, 13), (13, 14), (14, 7), (1, 1)]
    n = frame([(i, 40.99 + y * STEP, -70.99 + x * STEP) for i, (y, x) in at.items()], LL)
    return n, frame([e for a, b in edges for e in ((a, b), (b, a))], "src bigint, dst bigint")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stretches_give_the_same_chains(frame):
    g = crossing(frame)
    n0, e0 = densify(*g)
    n, e, stretches, steps = densify_in_stretches(*g)
    assert rows(n) == rows(n0) and rows(e) == rows(e0)
    single = steps.select("tile_id", F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))
    assert rows(single) == rows(e0)
    wanted = C.chains(apls.measured(n0, e0))
    got = C.stretch_chains(*apls.measured_stretches(n, stretches, steps))
    for a, b in zip(wanted, got):
        assert rows(a) == rows(b.select(*a.columns)) and a.count()
    assert stretches.count() < 40 < e0.count()
    assert rows(apls.control_points(n, e, apls.SMALL, got[:2])) == rows(apls.control_points(n0, e0, apls.SMALL))


def test_rounds_pass_over_stretches(frame, monkeypatch):
    seen = []
    kept = C.keep_counted

    def counted(df, name="state", **counts):
        seen.append(df.count())
        return kept(df, name, **counts)

    monkeypatch.setattr(C, "keep_counted", counted)
    g = crossing(frame)
    apls.compare_graphs(g, g)
    # both graphs, both directions of at most 40 stretches; single pieces are some hundreds
    assert max(seen[:3]) <= 160


def test_location_ids_round_halves_up(spark):
    from wayloom.operators.graph import _half_up

    v = [0.5, -0.5, 0.49999999999999994, -0.49999999999999994, 1.5, 2.5, -2.5, 410000000.5, 410000000.49999994, -710000000.5, -710000000.4999999, 0.0]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    assert df.select(_half_up(F.col("v")).alias("a")).collect() == df.select(F.round("v").cast("bigint").alias("a")).collect()


def test_pairs_of_paths_are_grouped_once(spark, frame):
    from wayloom.operators import paths

    e = frame([(i, i + 1, 100 + i) for i in range(8)] + [(3, 20, 70), (20, 6, 50)], "src bigint, dst bigint, len bigint")
    ends = frame([(0, 100), (5, 101), (20, 102), (7, 103)], "node_id bigint, name bigint")
    out = paths.shortest_paths(e, ends)
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Aggregate [" in line and "source#" in line and "target#" in line for line in plan) == 1
    plain = paths.shortest_paths(e, ends.select("tile_id", "node_id"))
    name = {0: 100, 5: 101, 20: 102, 7: 103}
    assert {(r.source, r.target, r.d) for r in out.collect()} == {(name[r.source], name[r.target], r.d) for r in plain.collect()}
