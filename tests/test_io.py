"""Files in and out."""

import json
import struct
import zlib

from pyspark.sql import functions as F

from wayloom.operators import raster
from wayloom.sources import graphs as src
from wayloom.sources import rasters, sinks

E = "src bigint, dst bigint"


def png(path, pixels, gray=False):
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in ((p,) if gray else p)) for row in pixels)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if gray else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_graph_documents_go_out_and_come_back(spark, frame, tmp_path):
    n = frame([(7, 10.0, 20.0), (9, 30.0, 40.0), (12, 50.0, 60.0)], "node_id bigint, r double, c double")
    e = frame([(7, 9), (9, 7), (9, 12)], E)
    sinks.write_graph_json(n, e, str(tmp_path / "out"), partitions=3)
    parts = sorted((tmp_path / "out" / "tile_id=1").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    nodes, edges = json.loads(text)
    assert len(nodes) == 3 and edges == [[0, 1], [1, 2]]
    back_nodes, back_edges = src.read_graph_json(spark, str(tmp_path / "out"))
    assert {(r.tile_id, r.node_id) for r in back_nodes.collect()} == {(1, 0), (1, 1), (1, 2)}
    assert {(r.tile_id, r.src, r.dst) for r in back_edges.collect()} == {(1, 0, 1), (1, 1, 2)}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "tile_a.json").write_text(text)
    n2, e2 = src.read_graph_json(spark, str(tmp_path / "docs"))
    assert {(r.tile_id, r.node_id) for r in n2.collect()} == {("tile_a", 0), ("tile_a", 1), ("tile_a", 2)}
    assert {(r.src, r.dst) for r in e2.collect()} == {(0, 1), (1, 2)}


def test_images_become_pixels(spark, tmp_path):
    png(tmp_path / "t1.png", [[(1, 2, 3), (4, 5, 6)], [(7, 8, 9), (10, 11, 12)]])
    px = {(r.y, r.x, r.band): r.value for r in rasters.read_image_pixels(spark, str(tmp_path)).collect()}
    assert len(px) == 12 and px[(0, 0, "red")] == 1 and px[(1, 0, "green")] == 8 and px[(1, 1, "blue")] == 12
    png(tmp_path / "t1.png", [[0, 50], [200, 255]], gray=True)
    m = rasters.read_image_pixels(spark, str(tmp_path), gray_band="road")
    assert {(r.y, r.x): r.value for r in m.collect()} == {(0, 0): 0, (0, 1): 50, (1, 0): 200, (1, 1): 255}


def test_split_manifest(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"train": ["a", "b"], "valid": ["c"], "test": ["d"]}, indent=1))
    got = {(r.tile_id, r.split) for r in rasters.read_splits(spark, str(tmp_path / "s.json")).collect()}
    assert got == {("a", "train"), ("b", "train"), ("c", "validation"), ("d", "test")}


def test_masks_and_adjacency_and_scores_are_written(spark, frame, tmp_path):
    m = frame([(0, 0, 10, 20), (0, 1, 30, None)], "y int, x int, keypoint int, road int")
    sinks.write_masks(m, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.tile_id, r.band, r.x, r.value) for r in back.collect()} >= {(1, "keypoint", 1, 30.0), (1, "road", 0, 20.0)}
    sinks.write_adjacency(frame([(0, 0.5, 1.5), (1, 2.5, 3.0)], "node_id bigint, r double, c double"), frame([(0, 1)], E), str(tmp_path / "a"))
    a = {(r.node.r, r.node.c): [(b.r, b.c) for b in r.nbrs] for r in spark.read.parquet(str(tmp_path / "a")).collect()}
    assert a == {(0, 2): [(2, 3)], (2, 3): [(0, 2)]}
    sinks.write_scores(frame([(0.5,)], "apls double"), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().apls == 0.5


def test_fusion_runs_on_a_stream(spark, frame, tmp_path):
    rows = frame([(0, 0, 0.2, 0.4), (0, 0, 0.4, 0.8), (1, 0, 1.0, 0.0)], "y int, x int, keypoint double, road double")
    rows.write.parquet(str(tmp_path / "in"))
    live = raster.fuse_masks(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("fused_stream").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.y, r.x): (round(r.keypoint, 6), round(r.road, 6)) for r in spark.table("fused_stream").collect()}
    assert got == {(0, 0): (0.3, 0.6), (1, 0): (1.0, 0.0)}


def test_edge_to_unknown_node_is_an_error(frame):
    n = frame([(0, 1.0, 1.0)], "node_id bigint, r double, c double")
    try:
        sinks.graph_json_lines(n, frame([(0, 5)], E)).collect()
    except Exception as err:
        assert "is not a node" in str(err)
    else:
        raise AssertionError("no error")


def test_threshold_above_one_is_rejected(frame):
    m = frame([(0, 0, 10)], "y int, x int, road int")
    try:
        raster.mask_points(m, "road", 64.0)
    except ValueError:
        return
    raise AssertionError("no error")


def test_region_of_interest(frame):
    a = frame([((30.0, 30.0), [(40.0, 40.0), (10.0, 30.0)]), ((10.0, 30.0), [(30.0, 30.0)])], "node struct<r:double,c:double>, nbrs array<struct<r:double,c:double>>")
    got = src.crop_adjacency(a).select(F.col("node.r"), F.size("nbrs")).collect()
    assert [tuple(r) for r in got] == [(6.0, 1)]
