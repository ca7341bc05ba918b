"""Training export: batches, widths per batch, local numbers, empty patches."""

import pytest
from pyspark.errors import PySparkException

from wayloom.operators import sampling
from wayloom.plans import labels

POINTS = "patch_id bigint, pid bigint, px double, py double"
SAMPLES = "patch_id bigint, sample_id bigint, src bigint, rank bigint, dst bigint, connected boolean"


def test_batches_hold_every_patch_once(frame):
    patches = frame([(i % 90,) for i in range(180)], "patch_id bigint")
    for seed in (None, 4):
        got = sampling.in_batches(patches, 8, seed).collect()
        assert sorted((r.batch, r.slot) for r in got) == [(i // 8, i % 8) for i in range(90)]
        assert sorted(r.patch_id for r in got) == list(range(90))
    one, two = ({r.patch_id: (r.batch, r.slot) for r in sampling.in_batches(p, 8, 4).collect()} for p in (patches, patches.repartition(7)))
    assert one == two != {i: (i // 8, i % 8) for i in range(90)}


def test_lists_are_as_long_as_their_batch_needs(frame):
    patches = frame([(0,), (1,), (2,), (3,), (4,)], "patch_id bigint")
    points = frame([(0, 70, 1.0, 2.0), (1, 7, 3.0, 4.0), (1, 5, 5.0, 6.0), (1, 9, 7.0, 8.0), (4, 1, 9.0, 9.5)], POINTS)
    got = {r.patch_id: r for r in sampling.pad_points(points, patches, batches=sampling.in_batches(patches, 2)).collect()}
    assert {i: len(r.points) for i, r in got.items()} == {0: 3, 1: 3, 2: 1, 3: 1, 4: 1}
    assert got[1].pids == [5, 7, 9] and got[1].points == [[5.0, 6.0], [3.0, 4.0], [7.0, 8.0]]
    assert got[0].points == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]] and got[2].pids == [] and got[2].points == [[0.0, 0.0]]


def test_pairs_are_places_in_the_lists(frame):
    patches = frame([(0,), (1,)], "patch_id bigint")
    points = frame([(0, 30, 1.0, 1.0), (0, 10, 2.0, 2.0), (0, 20, 3.0, 3.0)], POINTS)
    samples = frame([(0, 0, 30, 1, 10, True), (0, 0, 30, 2, 20, False), (0, 1, 20, None, None, None)], SAMPLES)
    _, got = sampling.export_samples(points, samples, patches, 2, 3, 2)
    rows = {(r.patch_id, r.sample_id): (r.pairs, r.connected, r.valid) for r in got.collect()}
    no = [False] * 3
    assert rows == {
        (0, 0): ([[2, 0], [2, 1], [2, 2]], [True, False, False], [True, True, False]),
        (0, 1): ([[1, 1]] * 3, no, no), (1, 0): ([[0, 0]] * 3, no, no), (1, 1): ([[0, 0]] * 3, no, no)}
    with pytest.raises(PySparkException, match="no point of its patch"):
        sampling.export_samples(points, frame([(0, 0, 30, 1, 99, True)], SAMPLES), patches, 2, 3, 2)[1].collect()
    points, got = sampling.export_samples(points.limit(0), samples.limit(0), patches, 2, 3, 2)
    assert got.count() == 4 and [r.points for r in points.collect()] == [[[0.0, 0.0]]] * 2


def test_one_call_from_graph_to_batches(spark, frame):
    nodes = frame([(i, 20 + 30 * i, 40) for i in range(6)], "node_id bigint, x bigint, y bigint")
    edges = frame([(i, i + 1) for i in range(5)], "src bigint, dst bigint")
    patches = frame([(0, 0, 0, 256, 256, 1), (1, 900, 900, 1156, 1156, 0), (2, 60, 0, 316, 256, 0)],
                    "patch_id bigint, x0 bigint, y0 bigint, x1 bigint, y1 bigint, turns int")
    opt = labels.Options(patch=256, samples=12)
    points, samples = labels.training_batches(nodes, edges, patches, 3, 2, opt)
    plain = {(r.patch_id, r.sample_id, r.src, r.dst): r.connected for r in labels.patch_samples(nodes, edges, patches, 3, opt)[1].collect()}
    lists = {r.patch_id: r for r in points.collect()}
    rows = samples.collect()
    assert sorted((r.patch_id, r.sample_id) for r in rows) == [(p, i) for p in range(3) for i in range(12)]
    seen = {}
    for r in rows:
        at = lists[r.patch_id]
        assert (at.batch, at.slot) == (r.batch, r.slot) and len(r.pairs) == len(r.connected) == len(r.valid) == 16
        if r.patch_id == 1:
            assert r.pairs == [[0, 0]] * 16 and not any(r.valid) and at.pids == []
        for (s, t), linked, ok in zip(r.pairs, r.connected, r.valid):
            if ok:
                seen[r.patch_id, r.sample_id, at.pids[s], at.pids[t]] = linked
    assert seen and seen == {k: v for k, v in plain.items() if k[3] is not None}
