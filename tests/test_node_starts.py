"""Node starts: pairs are worked out once, near points are counted without listing who is near whom."""

from wayloom.plans import topo


def test_near_points_are_counted_not_listed(frame, monkeypatch):
    names = []
    written = topo.keep

    def noted(df, name="state"):
        names.append(name)
        return written(df, name)

    monkeypatch.setattr(topo, "keep", noted)
    n = frame([(i, 41.0 + 0.0004 * i, -71.0) for i in range(6)], "node_id bigint, lat double, lon double")
    e = frame([(i, i + 1) for i in range(5)] + [(i + 1, i) for i in range(5)], "src bigint, dst bigint")
    short = e.filter("src < 3 and dst < 3")
    pairs = frame([(i, i) for i in range(3)] + [(0, 0)], "node_id bigint, other_id bigint")
    out = topo.compare_from_nodes((n, e), (n, short), pairs, step=0.0001, reach=0.0012)
    got = {r.start.node_id: (r["precision"], round(r["recall"], 6)) for r in out.collect()}
    # marbles 0 to 8 steps from the node at most; holes go on to 12 steps, and those within 1.5 steps of a marble are found
    assert got.keys() == {0, 1, 2} and len(out.collect()) == 3
    assert all(p == 1.0 and 0 < r < 1 for p, r in got.values()), got
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and plan.count("LeftSemi") == 2
    assert names.count("node-pairs") == 1
