"""Iterative and composite operators against plain scans on small random inputs, and their invariants."""

import heapq
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from wayloom.functions.coords import to_latlon
from wayloom.operators import chains, graph, paths, raster, sampling, select, spatial
from wayloom.plans import apls, labels, topo

N, E = "node_id bigint, x double, y double", "src bigint, dst bigint"
LL = "node_id bigint, lat double, lon double"


def grid(seed, cols=5, rows=4, gap=60, keep=0.8, left=200, top=200):
    """A jittered street grid: ({id: (x, y)}, {(a, b)})."""
    rnd = random.Random(seed)
    at = {r * cols + c: (left + c * gap + rnd.randint(-8, 8), top + r * gap + rnd.randint(-8, 8)) for r in range(rows) for c in range(cols)}
    edges = set()
    for i in at:
        if i % cols < cols - 1 and rnd.random() < keep:
            edges.add((i, i + 1))
        if i + cols in at and rnd.random() < keep:
            edges.add((i, i + cols))
    return at, edges


def latlon(at):
    k = math.cos(math.radians(41.0))
    return {i: (41.0 - y / 111111.0, -71.0 + x / 111111.0 / k) for i, (x, y) in at.items()}


def both(edges):
    return sorted(edges | {(b, a) for a, b in edges})


def test_slices_do_not_change_a_join(frame):
    rnd = random.Random(1)
    pts = [(i, rnd.choice([5.0, 5.0, 5.0, rnd.uniform(0, 40)]), rnd.uniform(0, 3)) for i in range(200)]
    a = frame(pts, "a bigint, x double, y double")
    b = frame(pts, "b bigint, x2 double, y2 double")
    box = (F.col("x2") - 2, F.col("y2") - 2, F.col("x2") + 2, F.col("y2") + 2)
    plain = spatial.box_join(a, b, (F.col("x"), F.col("y")), box, 4.0).select("a", "b")
    cut = spatial.box_join(a, b, (F.col("x"), F.col("y")), box, 4.0, rows_per_slice=7).select("a", "b")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, cut.collect()))


def test_neighbours_in_a_pile_of_copies(frame):
    rnd = random.Random(2)
    pts = [(i, 3.0, 3.0) for i in range(60)] + [(60 + i, float(rnd.randint(0, 12)), float(rnd.randint(0, 12))) for i in range(40)]
    got = {}
    for r in spatial.nearest_neighbours(frame(pts, "pid bigint, x double, y double"), 4, 5.0).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst))
    for i, x, y in pts:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in pts if j != i and (x - u) ** 2 + (y - v) ** 2 < 25)[:4]
        assert [d for _, d in sorted(got.get(i, []))] == [j for _, j in near]


def test_dense_ids_over_many_chunks(frame):
    ids = random.Random(3).sample(range(100_000), 300)
    df = frame([(i,) for i in ids], "node_id bigint")
    got = {r.node_id: r.n for r in spatial.dense_ids(df, ["node_id"], "n", spatial.id_chunk("node_id", 500)).collect()}
    assert got == {v: k for k, v in enumerate(sorted(ids))}


def test_components_of_a_long_path_and_a_star(frame):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 200 + i) for i in range(50)] + [(300, 301)]
    got = {r.node: r.label for r in graph.components(frame(pairs, "a bigint, b bigint")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[200 + i] == 7 for i in range(50)) and got[301] == 300


def test_split_like_a_queue(frame):
    rnd = random.Random(4)
    at = [(rnd.uniform(0, 60), rnd.uniform(0, 60)) for _ in range(30)]
    edges = {tuple(sorted(rnd.sample(range(30), 2))) for _ in range(20)}
    t = 3.0

    def nearest(a, b):
        (ax, ay), (bx, by) = at[a], at[b]
        dx, dy = bx - ax, by - ay
        ln = math.hypot(dx, dy)
        px, py = abs(dy) / ln * t, abs(dx) / ln * t
        best = None
        for i, (x, y) in enumerate(at):
            if i in (a, b) or not (min(ax, bx) - px <= x <= max(ax, bx) + px and min(ay, by) - py <= y <= max(ay, by) + py):
                continue
            s = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (ln * ln)))
            d = math.hypot(x - ax - s * dx, y - ay - s * dy)
            if d < t and (best is None or (d, i) < best):
                best = (d, i)
        return best and best[1]

    todo, seen, want = list(edges), set(), set()
    while todo:
        e = todo.pop()
        if e in seen:
            continue
        seen.add(e)
        m = nearest(*e)
        if m is None:
            want.add(e)
        else:
            todo += [tuple(sorted((e[0], m))), tuple(sorted((m, e[1])))]
    n = frame([(i, x, y) for i, (x, y) in enumerate(at)], N)
    got = {(r.src, r.dst) for r in graph.split_edges(n, frame(list(edges), E), t)[1].collect()}
    assert got == want


def test_rings_are_reported_and_the_rest_is_whole(frame):
    ring = [(i, (i + 1) % 9) for i in range(9)]
    path = [(20 + i, 21 + i) for i in range(30)]
    lolly = [(100, 101), (101, 102), (102, 103), (103, 101)]
    links, segments, loops = chains.chains(frame(ring + path + lolly, E))
    assert loops.count() == 9
    assert sorted((r.s0, r.last, r.links) for r in segments.collect()) == [(20, 50, 30), (100, 101, 1), (101, 101, 3)]
    assert links.count() == 34
    _, cut, none = chains.chains(frame(ring, E), breaks=frame([(4,)], "node_id bigint"))
    assert [(r.s0, r.last, r.total) for r in cut.collect()] == [(4, 4, 9)] and none.count() == 0


def dijkstra(adj, seeds, banned=()):
    dist, heap = {}, [(d, n) for n, d in seeds]
    heapq.heapify(heap)
    while heap:
        d, n = heapq.heappop(heap)
        if n in dist:
            continue
        dist[n] = d
        for m, w in adj.get(n, []):
            if m not in dist and m not in banned:
                heapq.heappush(heap, (d + w, m))
    return dist


def test_shortest_paths_with_rings_and_inner_places(frame):
    rnd = random.Random(5)
    edges = [(i, i + 1, rnd.randint(1, 9)) for i in range(40)] + [(0, 40, 3), (10, 55, 2), (55, 30, 4), (80, 81, 5), (81, 82, 1), (82, 80, 2)]
    adj = {}
    for a, b, w in edges:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    marks = [3, 7, 10, 22, 38, 55, 80, 82]
    got = {(r.source, r.target): r.d for r in paths.shortest_paths(
        frame(edges, "src bigint, dst bigint, len bigint"), frame([(m,) for m in marks], "node_id bigint")).collect()}
    want = {(a, b): d for a in marks for b, d in dijkstra(adj, [(a, 0)]).items() if b in marks}
    assert got == want


def test_position_distances(frame):
    at, edges = grid(6)
    ll = latlon(at)
    size = {r.src * 1000 + r.dst: r["len"] for r in topo.measured(frame([(i, *p) for i, p in ll.items()], LL), frame(both(edges), E)).collect()}
    adj = {}
    for a, b in edges:
        w = size[a * 1000 + b]
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, []).append((a, w))
    rnd = random.Random(7)
    pos = []
    for i, (a, b) in enumerate(sorted(edges)):
        w = size[a * 1000 + b]
        d = rnd.randint(0, w)
        pos.append((i, a, b, d, w - d) if rnd.random() < 0.5 else (i, b, a, w - d, d))
    limit = topo.pico(0.002)
    pairs = [(p[0], q[0]) for p, q in itertools.product(pos, pos)]
    links = [(a, b, w) for a in adj for b, w in adj[a]]
    got = {(r.p, r.q): r.d for r in paths.position_distances(
        frame(pos, "id bigint, n1 bigint, n2 bigint, d1 bigint, d2 bigint"), frame(pairs, "p bigint, q bigint"),
        frame(links, "u bigint, v bigint, w bigint"), limit).collect()}
    for p in pos:
        _, n1, n2, d1, d2 = p
        dist = {}
        for s, d in ((n1, d1), (n2, d2)):
            for k, v in dijkstra(adj, [(s, d)], banned={n1, n2} - {s}).items():
                if v <= limit:
                    dist[k] = min(v, dist.get(k, v))
        for q in pos:
            if {q[1], q[2]} == {n1, n2}:
                want = abs(d1 - (q[3] if q[1] == n1 else q[4]))
            else:
                ways = [dist[a] + r for a, far, r in ((q[1], q[2], q[3]), (q[2], q[1], q[4])) if a in dist and far not in (n1, n2)]
                want = min(ways) if ways else None
            assert got[(p[0], q[0])] == want, (p, q)


def test_walk_covers_every_road_once(frame):
    at, edges = grid(8)
    ll = latlon(at)
    n, e = frame([(i, *p) for i, p in ll.items()], LL), frame(both(edges), E)
    size = {(r.src, r.dst): r["len"] for r in topo.measured(n, e).collect()}
    a, b = sorted(edges)[5]
    w = size[(a, b)]
    start = frame([(1, a, b, w // 3, w - w // 3)], "start bigint, n1 bigint, n2 bigint, d1 bigint, d2 bigint")
    step, reach = 0.00005, 0.002
    pts = topo.walk_points(n, e, start, step, reach).collect()
    seen = {(r.u, r.v, r.o) for r in pts}
    assert len(seen) == len(pts)
    adj = {}
    for (u, v), l in size.items():
        adj.setdefault(u, []).append((v, l))
        adj.setdefault(v, []).append((u, l))
    dist = {}
    for s, d in ((a, w // 3), (b, w - w // 3)):
        for k, v in dijkstra(adj, [(s, d)], banned={a, b} - {s}).items():
            dist[k] = min(v, dist.get(k, v))
    dist[a], dist[b] = w // 3, w - w // 3
    st, lim = topo.pico(step), topo.pico(reach)
    want = {(a, b, o) for o in range(0, w + 1, st)}
    for u in dist:
        for v, l in adj[u]:
            if v in (a, b) or dist[u] > lim:
                continue
            o = -(-dist[u] // st) * st - dist[u]
            while o < l and dist[u] + o <= lim:
                opposite = u not in (a, b) and v in dist and dist[v] <= lim
                other = dist.get(v, 0) + l - o
                if not opposite or dist[u] + o < other or (dist[u] + o == other and u < v):
                    want.add((u, v, o))
                o += st
    assert seen == want


def test_matching_size():
    rnd = random.Random(9)
    for _ in range(200):
        pairs = list({(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(rnd.randint(1, 12))})
        best = 0
        for k in range(len(pairs), 0, -1):
            if any(len({a for a, _ in c}) == k == len({b for _, b in c}) for c in itertools.combinations(pairs, k)):
                best = k
                break
        assert topo.matching_size([a for a, _ in pairs], [b for _, b in pairs]) == best


def test_greedy_keep_like_a_scan(frame):
    rnd = random.Random(10)
    n = 60
    always = {i for i in range(n) if rnd.random() < 0.2 and i < 20}
    clash = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.06}
    marked, want = set(), set()
    for i in range(n):
        if i in marked and i not in always:
            continue
        want.add(i)
        marked |= {b for a, b in clash if a == i}
    got = select.greedy_keep(frame([(i, i in always) for i in range(n)], "id bigint, always boolean"), frame(list(clash), "first bigint, second bigint"))
    assert {r.id for r in got.collect()} == want


def metre(p, q):
    a = (p[0] - q[0]) * 111111.0
    b = (p[1] - q[1]) * 111111.0 * math.cos(math.radians(p[0]))
    return math.hypot(a, b)


def dense_graph(frame, ll, edges):
    n, e = graph.densify(frame([(i, *p) for i, p in ll.items()], LL), frame(both(edges), E))
    return {r.node_id: (r.lat, r.lon) for r in n.collect()}, {(r.src, r.dst) for r in e.collect()}, n, e


def hops(adj, s, k):
    seen, front = {s}, {s}
    for _ in range(k):
        front = {m for f in front for m in adj.get(f, ())} - seen
        seen |= front
    return seen


def scan_apls(truth, other, cps, claim):
    """Score of one direction from given control points, by plain search."""
    (tp, te), (op, oe) = truth, other
    tadj, oadj, onb = {}, {}, {}
    for pts, es, adj in ((tp, te, tadj), (op, oe, oadj)):
        for a, b in es:
            w = int(metre(pts[a], pts[b]) * 100)
            adj.setdefault(a, []).append((b, w))
            adj.setdefault(b, []).append((a, w))
    for a in oadj:
        onb[a] = [b for b, _ in oadj[a]]
    held, snap = set(), {}
    for c in sorted(cps):
        near = sorted(((p[0] - tp[c][0]) ** 2 + (p[1] - tp[c][1]) ** 2, i) for i, p in op.items())[:10]
        for _, i in near:
            if i not in held and metre(op[i], tp[c]) < 10.0:
                snap[c] = i
                held |= hops(onb, i, claim)
                break
    cost = cases = 0
    tree_t = {c: dijkstra(tadj, [(c, 0)]) for c in snap}
    tree_o = {c: dijkstra(oadj, [(c, 0)]) for c in set(snap.values())}
    for a, b in itertools.combinations(sorted(cps), 2):
        if a not in snap or b not in snap:
            cost, cases = cost + 1, cases + 1
            continue
        d1 = tree_t[a].get(b, -100) / 100
        if d1 > 100.0:
            d2 = tree_o[snap[a]].get(snap[b], 0) / 100
            cost, cases = cost + min(1.0, abs(d1 - d2) / d1), cases + 1
    return 1 - cost / cases if cases else None


@pytest.fixture(scope="module")
def two_graphs():
    at, edges = grid(11)
    moved = {i: (x + i % 5 - 2, y + i % 3 - 1) for i, (x, y) in at.items()}
    fewer = {e for e in edges if (e[0] * 31 + e[1] * 17) % 7}
    return latlon(at), edges, latlon(moved), fewer


def test_path_similarity_like_a_search(frame, two_graphs):
    ll, edges, ll2, edges2 = two_graphs
    tp, te, tn, tE = dense_graph(frame, ll, edges)
    op, oe, on, oE = dense_graph(frame, ll2, edges2)
    got = apls.compare_graphs((frame([(i, *p) for i, p in ll.items()], LL), frame(both(edges), E)), (frame([(i, *p) for i, p in ll2.items()], LL), frame(both(edges2), E))).first()
    c1 = {r.node_id for r in apls.control_points(tn, tE).collect()}
    c2 = {r.node_id for r in apls.control_points(on, oE).collect()}
    assert len(c1) > 10 and len(c2) > 10
    assert got.gt_to_prop == pytest.approx(scan_apls((tp, te), (op, oe), c1, 4), abs=1e-4)
    assert got.prop_to_gt == pytest.approx(scan_apls((op, oe), (tp, te), c2, 4), abs=1e-4)
    assert got.apls == pytest.approx((got.gt_to_prop + got.prop_to_gt) / 2)


def test_control_points_keep_apart(frame, two_graphs):
    ll, edges, _, _ = two_graphs
    tp, te, tn, tE = dense_graph(frame, ll, edges)
    nb = {}
    for a, b in te:
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    cps = {r.node_id for r in apls.control_points(tn, tE).collect()}
    for c in cps:
        assert not {d for d in hops(nb, c, 4) & cps if d != c and len(nb[d]) != 1 and len(nb[c]) != 1}
    ends = {i for i in nb if len(nb[i]) != 2}
    assert ends & cps


def test_same_graph_scores_one_and_a_second_tile_changes_nothing(spark, frame, two_graphs):
    ll, edges, ll2, edges2 = two_graphs
    g = lambda t, p, e: (frame([(i, *q) for i, q in p.items()], LL, t), frame(both(e), E, t))
    same = apls.compare_graphs(g(1, ll, edges), g(1, ll, edges)).first()
    assert same.apls == pytest.approx(1.0)
    alone = apls.compare_graphs(g(1, ll, edges), g(1, ll2, edges2)).first()
    a1, b1, a2, b2 = g(1, ll, edges), g(1, ll2, edges2), g(2, ll2, edges2), g(2, ll, edges)
    two = apls.compare_graphs((a1[0].union(a2[0]), a1[1].union(a2[1])), (b1[0].union(b2[0]), b1[1].union(b2[1]))).filter("tile_id = 1").first()
    assert two == alone


def region(spark, tile=1):
    return spark.createDataFrame([(tile, 40.99, -71.005, 41.003, -70.99)], "tile_id bigint, min_lat double, min_lon double, max_lat double, max_lon double")


def test_marbles_and_holes_of_one_graph_match(spark, frame, two_graphs):
    ll, edges, ll2, edges2 = two_graphs
    g = (frame([(i, *q) for i, q in ll.items()], LL), frame(both(edges), E))
    scores, kept, tiles = topo.compare_graphs(g, g, region(spark), step=0.0001, reach=0.001)
    s = scores.collect()
    assert s and all(r.precision == 1.0 and r.recall == 1.0 for r in s)
    t = tiles.first()
    assert t.precision == 1.0 and t.recall == 1.0 and t.kept == kept.count()
    h = (frame([(i, *q) for i, q in ll2.items()], LL), frame(both(edges2), E))
    _, _, other = topo.compare_graphs(g, h, region(spark), step=0.0001, reach=0.001)
    o = other.first()
    assert 0 < o.precision <= 1 and 0 < o.overall_recall < 1


def test_tunnels_and_places(spark, frame, two_graphs):
    ll, edges, _, _ = two_graphs
    n, e = frame([(i, *q) for i, q in ll.items()], LL), frame(both(edges), E)
    all_ = topo.starting_points(n, e, region(spark))
    under = sorted(edges)[:6]
    less = topo.starting_points(n, e, region(spark), tunnels=frame(under, E))
    gone = {tuple(sorted((r.n1, r.n2))) for r in all_.collect()} - {tuple(sorted((r.n1, r.n2))) for r in less.collect()}
    assert gone and gone <= set(under)
    assert {tuple(r) for r in less.collect()} <= {tuple(r) for r in all_.collect()}


def test_samples_of_labels(spark, frame):
    at, edges = grid(12, cols=4, rows=3, gap=70, left=60, top=60)
    n = frame([(i, float(x), float(y)) for i, (x, y) in at.items()], N)
    patch = frame([(0, 0, 0, 256, 256, 0)], "patch_id bigint, x0 int, y0 int, x1 int, y1 int, turns int")
    opt = labels.Options(patch=256, samples=16)
    pts, pairs = labels.patch_samples(n, frame(list(edges), E), patch, 3, opt)
    p = {r.pid: (r.px, r.py) for r in pts.collect()}
    rows = pairs.collect()
    assert len({r.sample_id for r in rows}) == 16
    assert all(r.rank is None or 1 <= r["rank"] <= 16 for r in rows) and all(r.src in p for r in rows)
    assert any(r.connected for r in rows) and any(r.connected is False for r in rows)
    again = labels.patch_samples(n.repartition(3), frame(list(edges), E).repartition(5), patch, 3, opt)[1]
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))
    wide = sampling.pad_samples(pairs, 16).collect()
    assert len(wide) == 16 and all(len(r.targets) == len(r.valid) == 16 for r in wide)


def test_draws_follow_weights(frame):
    pts = [(0, i, 0.9 if i < 5 else 0.1) for i in range(50)]
    d = sampling.weighted_draws(frame(pts, "patch_id bigint, pid bigint, weight double"), 2000, seed=1).collect()
    assert len(d) == 2000
    share = sum(r.pid < 5 for r in d) / 2000
    assert abs(share - 0.5) < 0.05


def test_noise_and_scores(frame):
    pts = frame([(0, i, 0.0, 0.0) for i in range(4000)], "patch_id bigint, pid bigint, px double, py double")
    s = sampling.jitter(pts, seed=2).agg(F.avg("px"), F.stddev("px"), F.corr("px", "py")).first()
    assert abs(s[0]) < 0.06 and abs(s[1] - 1) < 0.05 and abs(s[2]) < 0.06
    u = select.random_scores(pts, F.lit(0.0), 3).agg(F.min("score"), F.max("score")).first()
    assert 0.9 <= u[0] < 0.91 and 0.99 < u[1] < 1.0


def test_pixels_join_points(frame):
    cost = [(y, x, 1 if y in (5, 15) or x == 10 else 0) for y in range(20) for x in range(20)]
    pts = frame([(1, 2, 5), (2, 8, 5), (3, 2, 15), (4, 17, 9)], "pid bigint, x bigint, y bigint")
    got = raster.connected_over_pixels(pts, frame(cost, "y int, x int, cost int"), 12.0, free_radius=1)
    assert {(r.src, r.dst) for r in got.collect()} == {(1, 2)}


def test_thinned_points_are_apart_and_cover(frame):
    rnd = random.Random(13)
    pts = [(i, rnd.randint(0, 60), rnd.randint(0, 60), rnd.choice([0.0, 0.5, 1.0])) for i in range(400)]
    kept = {r.pid for r in select.suppress_near(frame(pts, "pid bigint, x bigint, y bigint, score double"), 7.0).collect()}
    at = {i: (x, y) for i, x, y, _ in pts}
    near = lambda a, b: (at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2 <= 49
    assert not any(near(a, b) for a, b in itertools.combinations(kept, 2))
    assert all(any(near(i, k) for k in kept) for i in at)


def test_hubs_give_the_distances_of_the_plain_search(frame):
    """Rings, bridges between dense parts, dead ends, parts without a way between them, two tiles."""
    rnd = random.Random(12)
    links = [(1, k, (k + 1) % 9, rnd.randint(1, 9)) for k in range(9)]  # a ring
    links += [(1, 20 + a, 20 + b, rnd.randint(1, 30)) for a, b in itertools.combinations(range(7), 2)]  # a dense part
    links += [(1, 3, 20, 5), (1, 25, 40, 4), (1, 40, 41, 0), (1, 41, 42, 7)]  # a bridge and a dead end
    links += [(1, 60, 61, 2), (2, 60, 61, 3), (2, 61, 62, 4), (2, 60, 62, 9)]
    links += [(3, a, b, rnd.randint(1, 50)) for a in range(40) for b in rnd.sample(range(40), 2) if a != b]
    both_ways = {}
    for t, a, b, w in links:
        for k in ((t, a, b), (t, b, a)):
            both_ways[k] = min(w, both_ways.get(k, w))
    df = frame([(*k, w) for k, w in both_ways.items()], "tile_id bigint, u bigint, v bigint, w bigint")
    nodes = frame(sorted({k[:2] for k in both_ways}), "tile_id bigint, node_id bigint")
    legs = nodes.select("tile_id", "node_id", F.col("node_id").alias("node"), F.lit(0).cast("bigint").alias("d"))
    got = {(r.tile_id, r.source, r.target): r.d for r in paths.hub_distances(legs, nodes, nodes, paths.hierarchy(df)).collect()}
    seeds = legs.select("tile_id", F.col("node_id").alias("source"), "node", "d")
    want = {(r.tile_id, r.source, r.node): r.d for r in paths.spread(seeds, df, pinned=False).collect()}
    assert got == want


def test_hub_tables_grow_with_the_junctions(frame):
    per = []
    for side in (8, 16):
        rnd = random.Random(side)
        edges = [(r * side + c, q) for r in range(side) for c in range(side) for q, ok in ((r * side + c + 1, c + 1 < side), (r * side + c + side, r + 1 < side)) if ok]
        rows = [(a, b, w) for u, v in edges for w in [rnd.randint(50, 150)] for a, b in ((u, v), (v, u))]
        hubs = paths.hierarchy(frame(rows, "u bigint, v bigint, w bigint"))
        per.append((hubs.up.count() + hubs.core.count()) / side ** 2)
    assert max(per) < 2 * paths.CORE_ROWS, per


def test_negative_lengths_raise(frame):
    with pytest.raises(Exception, match="negative length"):
        paths.spread(frame([(1, 1, 0)], "source bigint, node bigint, d bigint"), frame([(1, 2, -1), (2, 1, -1)], "u bigint, v bigint, w bigint")).count()
