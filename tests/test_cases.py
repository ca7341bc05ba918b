"""Small literal cases of single operators."""

from pyspark.sql import functions as F

from wayloom.functions.coords import rc_to_xy
from wayloom.operators import graph
from wayloom.sources import graphs as src
from wayloom.sources import sinks

N, E = "node_id bigint, x double, y double", "src bigint, dst bigint"


def nodes(frame, pts):
    return frame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], N)


def pos(df):
    return {r.node_id: (round(r.x, 6), round(r.y, 6)) for r in df.collect()}


def links(df):
    return {(r.src, r.dst) for r in df.collect()}


def test_isolated_nodes_go(frame):
    n, e = graph.drop_isolated(nodes(frame, [(0, 0), (1, 1), (2, 2)]), frame([(0, 2)], E))
    assert pos(n) == {0: (0, 0), 1: (2, 2)} and links(e) == {(0, 1)}


def test_merge(frame):
    n, e = graph.merge_nodes(nodes(frame, [(0, 0), (1, 1), (1.1, 1.1), (2, 2), (0.1, 0.1)]), frame([(0, 1), (1, 2), (1, 3), (2, 3), (2, 4)], E), 0.2)
    assert pos(n) == {0: (0.05, 0.05), 1: (1.05, 1.05), 2: (2, 2)} and links(e) == {(0, 1), (1, 2)}


def test_merge_twice_changes_nothing(frame):
    n, e = graph.merge_nodes(nodes(frame, [(0, 0), (1, 1), (1.1, 1.1), (2, 2), (0.1, 0.1)]), frame([(0, 1), (1, 3)], E), 0.2)
    n2, e2 = graph.merge_nodes(n, e, 0.2)
    assert pos(n2) == pos(n) and links(e2) == links(e)


def test_split(frame):
    n, e = graph.split_edges(nodes(frame, [(0, 0), (1.01, 1.01), (2, 2), (2, 0)]), frame([(0, 1), (1, 2), (0, 2), (2, 3)], E), 0.2)
    assert links(e) == {(0, 1), (1, 2), (2, 3)}


def test_split_ignores_nodes_beyond_the_end(frame):
    n = nodes(frame, [(0, 0), (10, 0), (10.1, 0), (5, 0.1)])
    assert links(graph.split_edges(n, frame([(0, 1)], E), 0.2)[1]) == {(0, 3), (1, 3)}


def test_combine(frame):
    n = frame([(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (1, 0, 2.0, 2.0), (1, 1, 3.0, 3.0)], "part int, " + N)
    e = frame([(0, 0, 1), (1, 0, 1)], "part int, " + E)
    n2, e2 = graph.combine(n, e)
    assert pos(n2) == {0: (0, 0), 1: (1, 0), 2: (2, 2), 3: (3, 3)} and links(e2) == {(0, 1), (2, 3)}


def rc(frame, pts):
    return nodes(frame, pts).withColumnsRenamed({"x": "r", "y": "c"})


def test_to_adjacency(frame):
    a = sinks.rounded_adjacency(rc(frame, [(0, 0), (1.1, 1.1), (1.6, 1.6)]), frame([(0, 1), (1, 2)], E))
    got = {(r.node.r, r.node.c): {(b.r, b.c) for b in r.nbrs} for r in a.collect()}
    assert got == {(0, 0): {(1, 1)}, (1, 1): {(0, 0), (2, 2)}, (2, 2): {(1, 1)}}


ADJ = "node struct<r:double,c:double>, nbrs array<struct<r:double,c:double>>"


def adjacency(frame, d):
    return frame([((float(a), float(b)), [(float(x), float(y)) for x, y in v]) for (a, b), v in d.items()], ADJ)


def test_from_adjacency(frame):
    n, e = src.from_adjacency(adjacency(frame, {(0, 0): [(1, 1)], (1, 1): [(0, 0), (2, 2)], (2, 2): [(1, 1)]}))
    assert {r.node_id: (r.r, r.c) for r in n.collect()} == {0: (0, 0), 1: (1, 1), 2: (2, 2)}
    assert links(e) == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_neighbours_that_are_no_keys_become_nodes(frame):
    n, e = src.from_adjacency(adjacency(frame, {(1, 2): [(3, 4), (5, 6)], (3, 4): [(1, 2), (5, 6)]}))
    x, y = rc_to_xy(F.col("r"), F.col("c"))
    xy = n.select("node_id", x.alias("x"), y.alias("y"))
    assert n.count() == 3 and graph.undirected(e).count() == 3
    assert pos(xy)[0] == (2, 1)


def test_crossover(frame):
    adj = adjacency(frame, {(0, 1): [(10, 1)], (2, -2): [(2, 10)], (10, 1): [(20, 1)]})
    n, e = src.from_adjacency(adj)
    xy = n.select("tile_id", "node_id", F.col("c").alias("x"), F.col("r").alias("y"))
    assert [(r.x, r.y) for r in graph.crossovers(xy, e).collect()] == [(1.0, 2.0)]


def test_subdivide(frame):
    n, e = graph.subdivide(nodes(frame, [(0, 0), (10, 0), (20, 0)]), frame([(0, 1), (1, 2)], E), 2.0)
    assert n.count() == 11 and e.count() == 10
    ends = graph.with_ends(e, n).selectExpr("sqrt((ax-bx)*(ax-bx)+(ay-`by`)*(ay-`by`)) AS l")
    assert abs(ends.agg(F.sum("l")).first()[0] - 20.0) < 1e-9
