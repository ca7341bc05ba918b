"""Distances of starts to edges are worked out after their join, for pairs whose boxes meet."""

from wayloom.plans import topo


def test_distances_are_no_condition_of_the_join(frame):
    n = frame([(i, 41.0 + 0.0004 * i, -71.0) for i in range(3)], "node_id bigint, lat double, lon double")
    e = frame([(0, 1), (1, 2)], "src bigint, dst bigint")
    starts = frame([(7, 41.0001, -71.0, 0, 1)], "start bigint, lat double, lon double, n1 bigint, n2 bigint")
    out = topo.match_edges(starts, n, n, e)
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("SQRT" in line or "COS" in line for line in joins), joins
    assert [(r.start, r.n1, r.n2) for r in out.collect()] == [(7, 0, 1)]
