"""Numbers over ranges, a hot score, tiles read line by line, spent state, searches over pixels."""

import math
import os
import random
from collections import deque

from pyspark.sql import functions as F

from wayloom import session
from wayloom.operators import graph, raster, select, spatial
from wayloom.sources import graphs as src
from wayloom.sources import sinks

E = "src bigint, dst bigint"


def test_packed_ids_are_parted_and_numbered(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("tile_id"), (F.col("id") * (1 << 32) + F.col("id") % 7).alias("node_id"))
    bands = spatial.in_ranges(rows, ["tile_id", "node_id"]).groupBy("_band").count().collect()
    assert len(bands) == 1 or max(b["count"] for b in bands) < 10_000
    got = spatial.dense_ids(rows, ["node_id"], "n").collect()
    for t in range(3):
        mine = sorted((r.node_id, r.n) for r in got if r.tile_id == t)
        assert [n for _, n in mine] == list(range(len(mine))) and len(mine) in (6666, 6667)


def test_sums_over_ranges(frame):
    rnd = random.Random(4)
    rows = [(t, i, rnd.randrange(9)) for t in range(3) for i in rnd.sample(range(10**12), 200)] + [(5, 1, 4)]
    got = {(r.tile_id, r.i): r.s for r in spatial.running_start(frame(rows, "tile_id bigint, i bigint, v int"), ["i"], F.col("v"), "s").collect()}
    for t in (0, 1, 2, 5):
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == t):
            assert got[t, i] == total
            total += v
    none = frame([], "tile_id bigint, i bigint, v int")
    assert spatial.running_start(none, ["i"], F.col("v"), "s").count() == 0


def test_renumbering_packed_ids(frame):
    ids = [(i << 32) | j for i in range(5) for j in range(6)]
    n, e = graph.renumber(frame([(i,) for i in ids], "node_id bigint"), frame(list(zip(ids, ids[1:])), E))
    assert sorted(r.node_id for r in n.collect()) == list(range(30))
    assert sorted((r.src, r.dst) for r in e.collect()) == [(k, k + 1) for k in range(29)]


def test_worst_share_when_most_rows_have_one_score(spark):
    rows = [(k, 0.5 if k % 10 else k / 1000 + 1) for k in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, score double").repartition(5)
    got = {r.id for r in select.worst_share(df, "score", 0.37, "id").collect()}
    assert got == {k for k, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:740]}
    assert select.worst_share(df, "score", 0.0, "id").count() == 0 and select.worst_share(df, "score", 1.0, "id").count() == 2000


def street(n):
    """Two tiles: a street of n nodes with ids far apart, and one of three."""
    nodes = [(1, k * 1000, 10.0 + k, 20.0 + k % 50) for k in range(n)] + [(2, k, 30.0 + k, 40.0) for k in range(3)]
    edges = [(1, k * 1000, k * 1000 + 1000) for k in range(n - 1)] + [(2, 0, 1), (2, 1, 2)]
    return nodes, edges


def same_street(nodes, edges, n):
    got = {(int(r.tile_id), r.node_id): (r.lat, r.lon, r.first_id) for r in nodes.collect()}
    assert set(got) == {(1, k) for k in range(n)} | {(2, k) for k in range(3)}
    lats = [got[1, k][0] for k in range(n)]
    assert all(a > b for a, b in zip(lats, lats[1:])) and all(got[1, k][2] == k for k in range(n))
    assert {(int(r.tile_id), r.src, r.dst) for r in edges.collect()} == {(1, k, k + 1) for k in range(n - 1)} | {(2, 0, 1), (2, 1, 2)}


def test_tiles_are_read_line_by_line_from_pieces_of_files(spark, frame, tmp_path):
    nodes, edges = street(1500)
    n, e = frame(nodes, "tile_id bigint, node_id bigint, r double, c double"), frame(edges, "tile_id bigint, " + E)
    sinks.write_graph_json(n, e, str(tmp_path / "folders"), partitions=3)
    largest = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # files are read in many pieces, not in order
    try:
        back, links = src.read_graph_json(spark, str(tmp_path / "folders"))
        assert back.rdd.getNumPartitions() > 0
        same_street(back, links, 1500)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", largest)


def test_shelves_hold_many_tiles(spark, frame, tmp_path):
    nodes, edges = street(300)
    n, e = frame(nodes, "tile_id bigint, node_id bigint, r double, c double"), frame(edges, "tile_id bigint, " + E)
    sinks.write_graph_shelves(n, e, str(tmp_path / "s"), shelves=2)
    same_street(*src.read_graph_shelves(spark, str(tmp_path / "s")), 300)
    more = frame([(t, 0, 0, 10, 20) for t in range(40)], "tile_id bigint, y int, x int, keypoint int, road int")
    sinks.write_masks(more, str(tmp_path / "m"), shelves=3)
    assert len(list((tmp_path / "m").glob("shelf=*"))) <= 3 and spark.read.parquet(str(tmp_path / "m")).count() == 80
    sinks.write_adjacency(n, e, str(tmp_path / "a"), shelves=2)
    assert len(list((tmp_path / "a").glob("shelf=*"))) <= 2 and spark.read.parquet(str(tmp_path / "a")).count() == 303


def test_loops_delete_the_state_of_earlier_rounds(spark, frame):
    folder = session.state_folder(spark).replace("file:", "")
    before = set(os.listdir(folder))
    pairs = frame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert graph.components(pairs).filter("label = 0").count() == 61
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("stars")]) == 1
    df = session.keep(pairs, "gone")
    place = [f for f in os.listdir(folder) if f.startswith("gone")]
    session.forget(df, pairs)
    assert len(place) == 1 and not [f for f in os.listdir(folder) if f.startswith("gone")]


def pixel_ways(points, free, radius, disc):
    """Each pair searched on its own."""
    out = set()
    for i, x, y in points:
        for j, u, v in points:
            if i < j and (x - u) ** 2 + (y - v) ** 2 <= radius ** 2:
                ok = lambda a, b: (a, b) in free or (a - x) ** 2 + (b - y) ** 2 <= disc ** 2 or (a - u) ** 2 + (b - v) ** 2 <= disc ** 2
                far, todo = {(x, y): 0}, deque([(x, y)])
                while todo:
                    a, b = todo.popleft()
                    for c in (-1, 0, 1):
                        for d in (-1, 0, 1):
                            if (a + c, b + d) not in far and far[a, b] + 1 < radius and ok(a + c, b + d):
                                far[a + c, b + d] = far[a, b] + 1
                                todo.append((a + c, b + d))
                if (u, v) in far:
                    out.add((i, j))
    return out


def test_pixel_search_per_source_equals_search_per_pair(frame):
    rnd = random.Random(21)
    for disc, radius, share in ((0, 9.0, 0.5), (2, 10.5, 0.3), (3, 12.0, 0.4)):
        free = {(x, y) for x in range(40) for y in range(40) if rnd.random() < share}
        points = [(k, rnd.randrange(40), rnd.randrange(40)) for k in range(60)]
        cost = frame([(y, x, 1) for x, y in free] + [(0, 0, 0)], "y bigint, x bigint, cost bigint")
        got = raster.connected_over_pixels(frame(points, "pid bigint, x bigint, y bigint"), cost, radius, free_radius=disc)
        want = pixel_ways(points, free, radius, disc)
        close = sum(i < j and math.dist((x, y), (u, v)) <= radius for i, x, y in points for j, u, v in points)
        assert sorted((r.src, r.dst) for r in got.collect()) == sorted(want) and 0 < len(want) < close
