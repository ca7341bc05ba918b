"""Rounds cost what their own rows cost: heads go to few cells, a hop does not read all stops."""

import random
from collections import deque

import pytest

from wayloom.operators import graph, select


def test_heads_go_to_four_cells(frame, monkeypatch):
    sent = []
    joined = select.sliced_join

    def counted(left, right, keys, *args, **kwargs):
        sent.append((right.select("x2", "y2").distinct().count(), right.count()))
        return joined(left, right, keys, *args, **kwargs)

    monkeypatch.setattr(select, "sliced_join", counted)
    rng = random.Random(4)
    pts = [(i, rng.random() * 300 - 150, rng.random() * 300 - 150, rng.randrange(50) / 50) for i in range(600)]
    kept = {r.pid for r in select.suppress_near(frame(pts, "pid bigint, x double, y double, score double"), 16.0).collect()}
    assert sent and all(rows <= 4 * heads for heads, rows in sent), sent
    at = {p[0]: p[1:] for p in pts}
    apart = lambda p, q: (at[p][0] - at[q][0]) ** 2 + (at[p][1] - at[q][1]) ** 2
    assert all(apart(p, q) > 256 for p in kept for q in kept if p < q)
    assert all(any(apart(p, q) <= 256 and at[q][2] >= at[p][2] for q in kept) for p in at if p not in kept)


def nearest_hops(links, start, stops, depth):
    seen, todo = {start: 0}, deque([start])
    while todo:
        n = todo.popleft()
        if n in stops or seen[n] == depth:
            continue
        for m in links[n]:
            if m not in seen:
                seen[m] = seen[n] + 1
                todo.append(m)
    return seen


@pytest.mark.parametrize("listed", [64, 0])
def test_a_hop_does_not_read_all_stops(spark, frame, monkeypatch, listed):
    rng = random.Random(7)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(75)}
    links = {n: [b if a == n else a for a, b in edges if n in (a, b)] for n in range(60)}
    starts = [n for n in range(0, 60, 4) if links[n]]
    stops = {s: set(rng.sample(range(60), 9)) for s in starts[1:]}
    plans = []
    written = graph.keep_counted

    def noted(df, name="state", **counts):
        if name == "front":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString() + " ".join(df.inputFiles()))
        return written(df, name, **counts)

    monkeypatch.setattr(graph, "keep_counted", noted)
    monkeypatch.setattr(graph, "STOPS_LISTED", listed)
    got = graph.reach(
        frame(sorted(edges), "src bigint, dst bigint"), frame([(s, s) for s in starts], "source bigint, node bigint"), 7,
        frame([(s, n) for s, of in stops.items() for n in of], "source bigint, node bigint"))
    want = {(s, n, d) for s in starts for n, d in nearest_hops(links, s, stops.get(s, set()), 7).items()}
    assert sorted((r.source, r.node, r.depth) for r in got.collect()) == sorted(want)
    if listed:
        assert plans and not any("/stops-" in p for p in plans)
        fronts = [len({f.split("/front-")[1][:32] for f in p.split() if "/front-" in f}) for p in plans]
        assert max(fronts) <= 2, fronts


def test_written_edges_are_not_written_again(frame, monkeypatch):
    from wayloom.session import keep

    names = []
    written = graph.keep

    def noted(df, name="state"):
        names.append(name)
        return written(df, name)

    monkeypatch.setattr(graph, "keep", noted)
    rows = [(0, 1), (1, 2), (2, 1), (2, 3), (3, 3), (1, 2), (3, 4), (1, 5)]
    edges, start = frame(rows, "src bigint, dst bigint"), frame([(0, 0), (9, 3)], "source bigint, node bigint")
    get = lambda e: sorted((r.source, r.node, r.depth) for r in graph.reach(e, start, 3).collect())
    kept = keep(edges)
    assert get(kept) == get(edges) == [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 5, 2), (9, 0, 3), (9, 1, 2), (9, 2, 1), (9, 3, 0), (9, 4, 1), (9, 5, 3)]
    assert names.count("links") == 1
    flat = graph.undirected(edges)
    assert sorted(map(tuple, graph.degrees(flat, once=True).collect())) == sorted(map(tuple, graph.degrees(edges).collect()))
