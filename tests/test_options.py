"""Options of the comparisons, each on a small graph whose answer is known."""

import heapq

from pyspark.sql import functions as F
from test_brute import E, LL, both, grid, latlon

from wayloom.operators import paths, sampling
from wayloom.plans import apls, topo

STEP = 0.0005


def road(n, step=STEP):
    """Nodes 0 to n - 1 in a row to the north."""
    return {k: (41.0 + k * step, -71.0) for k in range(n)}


def graph_of(frame, at, edges):
    return frame([(i, *p) for i, p in at.items()], LL), frame(list(edges), E)


def test_walk_along_one_way_roads(frame):
    n, e = graph_of(frame, road(5), [(2, 1), (2, 3), (3, 4), (0, 1)])
    start = frame([(7, 2)], "start bigint, node_id bigint")
    reached = lambda **k: {tuple(sorted((r.u, r.v))) for r in topo.walk_from_nodes(n, e, start, 0.0001, 0.01, **k).filter("u <> v").collect()}
    assert reached() == {(0, 1), (1, 2), (2, 3), (3, 4)}
    assert reached(directed=True) == {(1, 2), (2, 3), (3, 4)}


def test_walk_over_scored_roads(frame):
    n, e = graph_of(frame, road(6), both({(k, k + 1) for k in range(5)}))
    n = n.withColumn("node_score", F.when(F.col("node_id") == 0, 0).otherwise(5))
    e = e.withColumn("edge_score", F.when((F.col("src") + F.col("dst")) == 7, 0).otherwise(9))  # the road from 3 to 4
    start = frame([(1, 2)], "start bigint, node_id bigint")
    pts = topo.walk_from_nodes(n, e, start, 0.0001, 0.01, scored=True).filter("u <> v").collect()
    assert {tuple(sorted((r.u, r.v))) for r in pts} == {(1, 2), (2, 3)}


def test_walk_points_on_a_condition(frame):
    n, e = graph_of(frame, road(4), both({(0, 1), (1, 2), (2, 3)}))
    start = frame([(1, 1, 2, 0, topo.pico(STEP))], "start bigint, n1 bigint, n2 bigint, d1 bigint, d2 bigint")
    all_ = topo.walk_points(n, e, start, 0.0001, 0.001).collect()
    some = topo.walk_points(n, e, start, 0.0001, 0.001, where=F.col("lat") > 41.0006).collect()
    assert {tuple(r) for r in some} == {tuple(r) for r in all_ if r.lat > 41.0006} and 0 < len(some) < len(all_)


def test_starting_points_on_lit_pixels(frame):
    at, edges = grid(3)
    n, e = graph_of(frame, latlon(at), both(edges))
    box = (40.99, -71.0, 41.0, -70.99)
    region = frame([box], "min_lat double, min_lon double, max_lat double, max_lon double")
    rows, cols = 60, 50
    pixel = lambda r: (rows - int((r.lat - box[0]) / ((box[2] - box[0]) / rows)), int((r.lon - box[1]) / ((box[3] - box[1]) / cols)))
    all_ = topo.starting_points(n, e).collect()
    lit = sorted({pixel(r) for r in all_})[::2] + [(0, 5), (5, 0), (rows, 1)]
    got = topo.starting_points(n, e, region, mask=(frame(lit, "r int, c int"), rows, cols)).collect()
    want = {tuple(r.start) for r in all_ if pixel(r) in lit and 0 < pixel(r)[0] < rows and 0 < pixel(r)[1] < cols}
    assert {tuple(r.start) for r in got} == want and 0 < len(want) < len(all_)


def test_first_ends_of_positions_in_the_older_way(frame):
    links = frame([(0, 1, 100), (1, 0, 100), (1, 2, 50), (2, 1, 50), (2, 3, 100), (3, 2, 100)], "u bigint, v bigint, w bigint")
    pos = frame([(1, 0, 1, 30, 70), (2, 2, 3, 10, 90)], "id bigint, n1 bigint, n2 bigint, d1 bigint, d2 bigint")
    pairs = frame([(1, 2)], "p bigint, q bigint")
    d = lambda compat: paths.position_distances(pos, pairs, links, 10_000, compat).first().d
    assert d(False) == 70 + 50 + 10
    assert d(True) == 30 + 50 + 10  # the second end starts with the first one's distance


def test_single_pair_of_nodes(frame):
    at, edges = grid(6)
    size = {(a, b): 3 + (a * 7 + b * 5) % 11 for a, b in edges}
    e = frame([(1, a, b, w) for (a, b), w in size.items()] + [(2, 0, 1, 4)], "tile_id bigint, src bigint, dst bigint, len bigint")
    far, todo = {}, [(0, min(a for a, _ in edges))]
    source = todo[0][1]
    while todo:
        d, u = heapq.heappop(todo)
        if u not in far:
            far[u] = d
            for (a, b), w in size.items():
                if u in (a, b):
                    heapq.heappush(todo, (d + w, a + b - u))
    target = max(far, key=far.get)
    assert [tuple(r) for r in paths.shortest_path(e, source, target).collect()] == [(1, source, target, far[target])]
    assert paths.shortest_path(e, source, 999).count() == 0


def test_control_points_of_both_settings(frame):
    at = latlon({k: (150, 150 + 2 * k) for k in range(61)})
    n, e = graph_of(frame, at, {(k, k + 1) for k in range(60)})
    chosen = lambda setting: sorted(r.node_id for r in apls.control_points(n, e, setting).collect())
    # a chain of 61 nodes is cut in int(61 / interval) + 1 parts; both ends count as well
    assert chosen(apls.CITY) == [0, 20, 40, 60]
    assert chosen(apls.SMALL) == [0, 8, 17, 26, 34, 43, 52, 60]


def test_trial_tiles_and_epochs(frame):
    t = frame([(9,), (3,), (3,), (5,), (1,), (7,)], "tile_id bigint")
    assert [r.tile_id for r in sampling.first_tiles(t).collect()] == [1, 3, 5, 7]
    assert sampling.epoch_length(2048, 512) == 16 * 2500 and sampling.epoch_length(400, 512) == 2500
    assert sampling.epoch_length(400, 256, small=True) == sampling.SMALL_TILE_EPOCH
